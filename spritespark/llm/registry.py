"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spritespark.llm.collocations import phrase_collocations
from spritespark.llm.decontamination import contaminated_documents
from spritespark.llm.jaccard import shingle_links
from spritespark.llm.lm_scoring import class_scores
from spritespark.llm.packing import packed_pieces
from spritespark.llm.pii import personal_data
from spritespark.llm.quality import quality_scores
from spritespark.llm.ranked_search import ranked_documents
from spritespark.llm.simhash import fingerprints
from spritespark.llm.token_counts import token_counts
from spritespark.llm.token_output import packed_ids
from spritespark.llm.toxicity import toxicity_scores
from spritespark.llm.url_filters import listed_captures
from spritespark.llm.sql import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality_scores,
        "op2_toxicity": toxicity_scores,
        "op3_url_filters": listed_captures,
        "op4_token_output": packed_ids,
        "op5_decontamination": contaminated_documents,
        "op6_pii": personal_data,
        "op7_lm_scoring": class_scores,
        "op8_simhash": fingerprints,
        "op9_packing": packed_pieces,
        "op10_jaccard": shingle_links,
        "op11_ranked_search": ranked_documents,
        "op12_collocations": phrase_collocations,
        "op13_token_counts": token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
