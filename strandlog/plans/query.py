"""The query entry: an expression over a log, as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.jmes.lower import is_jmes, query
from strandlog.operators.log import bundles, query_stats, simple_path


def value_of(expression: str, mode: str = "auto") -> Column:
    if mode == "jmes" or mode == "auto" and is_jmes(expression):
        return query(expression, F.col("raw"))
    return simple_path(expression)


def run(ops: DataFrame, expression: str, spec: str | None = None, last: int | None = None, mode: str = "auto") -> DataFrame:
    """global_pos and value of each operation, in the bundles of spec, for which the expression has a value."""
    if spec is not None:
        last = last if last is not None else ops.agg(F.max("bundle")).first()[0] or 0
        ops = bundles(ops, spec, last)
    return ops.select("global_pos", value_of(expression, mode).alias("value")).where("value is not null")


def stats(ops: DataFrame, expression: str, mode: str = "auto") -> DataFrame:
    return query_stats(ops, value_of(expression, mode))
