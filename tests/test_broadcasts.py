"""Pixels are never broadcast: Spark takes them for as small as the text or the file they come from."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from spritespark import catalog

#: Stored tables of a row or a few for a picture or an animation.
SMALL_TABLES = ("canvases", "models", "grids", "palettes")

QUERIES = [
    "crop_to_slice",
    "bg_remove_gradient",
    "compose_groups",
    "grid_cells_fractional",
    "grid_pitch_detect",
    "flatten_modes",
    "native_pixel_report",
    "palette_asof",
    "pick_cels",
    "pick_cels_bounds",
    "remap",
]

#: Queries that sum up pixels to as many rows, or explode what they have summed up.
SUMMED = ["compose_groups", "remap"]


def broadcast_rows(plan, summed=False):
    """The explodes and stored tables whose rows a plan broadcasts as they are or, with ``summed``, also after an aggregate or a window."""
    found, lines = [], [(len(re.match(r"[ :]*(\+- )?", x)[0]), x) for x in plan.split("\n")]
    for k, (depth, line) in enumerate(lines):
        below = None
        if "BroadcastExchange" not in line:
            continue
        for d, x in lines[k + 1 :]:
            if d <= depth:
                break
            if below is not None and d > below:
                continue
            below = d if re.search(r"Aggregate|Window", x) and not summed else None
            stored = re.search(r"/([a-z_]+)-[0-9a-f]{32}", x)
            if re.search(r"Generate (pos)?explode\((split|embedding|sequence)" if not summed else "Generate ", x) or stored and stored[1] not in SMALL_TABLES:
                found.append(x.strip()[:120])
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_pixels_are_not_broadcast(spark, small, monkeypatch, name):
    """In the plan of the result, and in those of the tables stored on the way."""
    plans, write = [], DataFrameWriter.parquet
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(plan(self._df)), write(self, *a, **b))[1])
    plans.append(plan(catalog.queries()[name](spark, small)))
    assert [x for p in plans for x in broadcast_rows(p, name in SUMMED)] == []
