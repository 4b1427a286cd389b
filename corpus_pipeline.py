"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.common import read_table, written
from gridlark.llm.mixing import mixed
from gridlark.llm.neardup import one_of_each
from gridlark.llm.packing import packed
from gridlark.llm.secrets import redacted
from gridlark.llm.toxicity import not_toxic

STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("secrets", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models and automata decide in it: not expressible in SQL; tests/llm compare it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
