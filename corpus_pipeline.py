"""Corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyscript.llm.common import table, written
from tallyscript.llm.decontaminate import decontamination_stage
from tallyscript.llm.language import language_stage
from tallyscript.llm.mixing import mixing_stage
from tallyscript.llm.near import near_stage
from tallyscript.llm.shards import sharding_stage

#: (name, function of (spark, docs, sf_dir)): documents with a language, one of each near-duplicate group, none with
#: benchmark text, as often as the sources' weights ask for, and stored in shards.
STAGES = [
    ("language", language_stage),
    ("near", near_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("shard", sharding_stage),
]

#: The stages hold a trained classifier and hashes that SQL does not have; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
