"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name: the module and function that make it.
NAMED = {
    "op1_shards": ("tallyscript.llm.shards", "op1"),
    "op2_language_id": ("tallyscript.llm.language", "op2"),
    "op3_toxicity": ("tallyscript.llm.toxicity", "op3"),
    "op4_near_dedup": ("tallyscript.llm.near", "op4"),
    "op5_source_mix": ("tallyscript.llm.mixing", "op5"),
    "op6_decontaminate": ("tallyscript.llm.decontaminate", "op6"),
    "op7_secret_scan": ("tallyscript.llm.secrets", "op7"),
    "op8_host_quality": ("tallyscript.llm.quality", "op8"),
    "op9_repeats": ("tallyscript.llm.repeats", "op9"),
    "op10_token_shards": ("tallyscript.llm.tokens", "op10"),
    "op11_centroids": ("tallyscript.llm.clusters", "op11"),
    "op12_periods": ("tallyscript.llm.periods", "op12"),
    "op13_chats": ("tallyscript.llm.chats", "op13"),
}

#: Query name: the module and the SQL in it.
SQL = {
    "op4_near_dedup": ("tallyscript.llm.near", "OP4_SQL"),
    "op5_source_mix": ("tallyscript.llm.mixing", "OP5_SQL"),
    "op6_decontaminate": ("tallyscript.llm.decontaminate", "OP6_SQL"),
    "op8_host_quality": ("tallyscript.llm.quality", "OP8_SQL"),
    "op11_centroids": ("tallyscript.llm.clusters", "OP11_SQL"),
    "op13_chats": ("tallyscript.llm.chats", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(module), function) for name, (module, function) in NAMED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(module), sql) for name, (module, sql) in SQL.items()}
