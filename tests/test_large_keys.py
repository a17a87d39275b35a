"""Keys of more digits than the small tables have."""

from spritespark import catalog
from tests.oracle import connection, same


def test_frame_numbers_of_any_length(spark, tmp_path):
    rows = [("STEEL", "Brand#13", k) for k in (7, 999_999, 1_000_000, 12_345_678)]
    spark.createDataFrame(rows, "p_type string, p_brand string, p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    same(catalog.queries()["src_frame_sequence"](spark, str(tmp_path)), connection(tmp_path), catalog.oracle_sql()["src_frame_sequence"])
