"""Delimited event files of unknown dialect: find it from all lines, read with Spark's own reader."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|")
_POINT, _COMMA = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), re.compile(r"[+-]?(\d+,?\d*|,\d+)([eE][+-]?\d+)?$")


@dataclass(frozen=True)
class Dialect:
    separator: str
    decimal_comma: bool
    header: bool


def sniff(lines: list[str]) -> Dialect:
    """The separator that gives the most equal number of fields, whether numbers use a comma, and whether the first line is a header."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return Dialect(",", False, False)

    def quality(s: str) -> tuple:
        counts = [x.count(s) for x in lines]
        usual = max(set(counts), key=counts.count)
        return (usual > 0, counts.count(usual), usual)

    separator = max(SEPARATORS, key=quality)
    cells = [[c.strip().strip('"') for c in x.split(separator)] for x in lines]
    number = lambda c, comma: bool((_COMMA if comma else _POINT).match(c))
    body = [c for row in cells[1:] for c in row if c]
    comma = separator != "," and sum(number(c, True) for c in body) > sum(number(c, False) for c in body)
    header = len(cells) > 1 and not any(number(c, comma) for c in cells[0] if c)
    return Dialect(separator, comma, header)


def _separator(lines: DataFrame) -> str:
    """The separator that most lines hold equally often, by one aggregation over all lines."""
    own = lines.where(F.trim("value") != "").select(F.inline(F.array(*[F.struct(F.lit(i).alias("s"), (F.length("value") - F.length(F.replace(F.col("value"), F.lit(c), F.lit("")))).alias("n")) for i, c in enumerate(SEPARATORS)])))
    usual = own.groupBy("s", "n").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "n")).alias("m"))
    best = usual.agg(F.max(F.struct((F.col("m.n") > 0).alias("any"), "m.k", "m.n", (-F.col("s")).alias("first"))).alias("b")).first().b
    return SEPARATORS[-best["first"]] if best else ","


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files, numbers as doubles (null where a cell is none) when most of a column's cells are numbers. All rows decide, not the first."""
    lines = spark.read.text(path)
    separator = _separator(lines)
    first = lines.where(F.trim("value") != "").limit(1).collect()
    raw = spark.read.csv(path, sep=separator, header=False)
    point, comma = (p.pattern.removesuffix("$") for p in (_POINT, _COMMA))
    trimmed = {c: F.trim(F.col(c)) for c in raw.columns}
    is_number = lambda c, p: F.count_if(trimmed[c].rlike(f"^(?:{p})$"))
    counts = raw.agg(*[x for c in raw.columns for x in (is_number(c, point).alias(f"p{c}"), is_number(c, comma).alias(f"c{c}"))]).first()
    with_comma = separator != "," and sum(counts[f"c{c}"] for c in raw.columns) > sum(counts[f"p{c}"] for c in raw.columns)
    number = re.compile(f"(?:{comma if with_comma else point})$")
    cells = [c.strip().strip('"') for c in first[0].value.split(separator)] if first else []
    header = bool(cells) and not any(number.match(c) for c in cells if c)
    df = spark.read.csv(path, sep=separator, header=header)
    filled = df.agg(*[x for c in df.columns for x in (F.count_if(F.trim(F.col(f"`{c}`")) != "").alias(f"n{c}"), F.count_if(F.trim(F.col(f"`{c}`")).rlike(number.pattern.replace("(?:", "^(?:", 1))).alias(f"k{c}"))]).first()
    out = {}
    for c in df.columns:
        if filled and filled[f"k{c}"] > filled[f"n{c}"] / 2:
            text = F.trim(F.col(f"`{c}`"))
            out[c] = (F.regexp_replace(text, ",", ".") if with_comma else text).try_cast("double")
    return df.withColumns(out)
