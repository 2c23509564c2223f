"""Registry of the subpackage: query name to callable, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name to the module that holds it.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_simhash": "simhash",
    "op3_packing": "packing",
    "op4_url_filter": "url_filter",
    "op5_bpe": "bpe",
    "op6_warc": "warc",
    "op7_embedding_dedup": "embed_dedup",
    "op8_sharding": "sharding",
    "op9_chat_perspectives": "chat",
    "op10_exact_dedup": "exact_dedup",
    "op11_conversation_trie": "conv_trie",
    "op12_spelling_variants": "spelling",
    "op13_pii": "pii",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
