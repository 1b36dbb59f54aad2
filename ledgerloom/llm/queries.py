"""The queries of this package, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, jaccard, language, lexical, line_dedup, lm_scoring, mixing, neighbours, pii, quality, simhash, toxicity

MODULES = [bpe, line_dedup, neighbours, simhash, quality, toxicity, pii, lm_scoring, language, mixing, lexical, alignment, jaccard]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
