"""Dates and quarters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_compact(x: Column) -> Column:
    """yyyyMMdd; anything else, partial dates too, is null."""
    return F.when(x.rlike(r"^\d{8}$"), F.try_to_date(x, "yyyyMMdd"))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def quarters_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(quarter, first_day, last_day) of every quarter that the days from start to end touch."""
    first = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "quarter").cast("date"), F.lit(end).cast("date"), F.expr("interval 3 months")))
    t = spark.range(1).select(first.alias("first_day"))
    return t.select(quarter_label(F.col("first_day")).alias("quarter"), "first_day", F.last_day(F.add_months("first_day", 2)).alias("last_day"))


def expand_quarters(tokens: list[str]) -> list[tuple[int, int]]:
    """Quarters of tokens like 2012q4 and ranges like 2012q4..2013q2, in order, each once."""

    def one(token: str) -> tuple[int, int]:
        m = re.fullmatch(r"(\d{4})q([1-4])", token.strip().lower())
        if not m:
            raise ValueError(f"not a quarter: {token!r}")
        return int(m[1]), int(m[2])

    out: list[tuple[int, int]] = []
    for token in tokens:
        low, _, high = token.partition("..")
        (y, q), last = one(low), one(high or low)
        while (y, q) <= last:
            if (y, q) not in out:
                out.append((y, q))
            y, q = (y, q + 1) if q < 4 else (y + 1, 1)
    return out
