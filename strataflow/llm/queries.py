"""Queries of the text operators: name -> (spark, folder) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.common import table
from strataflow.llm import garbled, leakage, lookalike, tokens


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "samples", "sample_id", "keywords")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items", "item_id", "passage")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": lambda s, d: garbled.garbled(_samples(s, d)).select("sample_id", "keyword"),
    "p3_restored": lambda s, d: garbled.garbled(_samples(s, d)),
    "p6_ids": lambda s, d: tokens.encode_corpus(_documents(s, d)),
    "p7_found": lambda s, d: leakage.leaked(_documents(s, d), _items(s, d)),
    "p7_templates": lambda s, d: leakage.reparameterised_pairs(_documents(s, d), _items(s, d)),
    "p8_found": lambda s, d: lookalike.equal_looks(_documents(s, d)),
    "p8_classes": lambda s, d: lookalike.classes(_documents(s, d)),
    "p8_forms": lambda s, d: lookalike.consistent(_documents(s, d)),
}

# A tag is written like one (a name, perhaps attributes with values); comments go too.
_TAG = r"""</?\p{{L}}[\p{{L}}\p{{N}}_:.-]*(\s+[\p{{L}}\p{{N}}_:.-]+\s*=\s*("[^"<>]*"|''[^''<>]*''|[^\s"''<>=]+))*\s*/?>|<!--[^<>]*-->"""
_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '" + _TAG + r"', ' ', 'g')), '[\p{{L}}\p{{N}}]+')"

ORACLE = {
    "p7_found": f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text <> ''),
     i AS (SELECT DISTINCT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
     dw AS (SELECT DISTINCT doc_id, list_aggregate(w[k:k + 11], 'string_agg', ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
     iw AS (SELECT DISTINCT item_id, list_aggregate(w[k:k + 11], 'string_agg', ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)""",
}
