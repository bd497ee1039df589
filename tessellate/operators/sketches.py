"""Mergeable summaries of extractions: kept per part of a table, merged later over any parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that a summary of frequent values keeps, and registers (as a power of two) of one of distinct values.
TRACKED, REGISTERS = 1000, 14


def summarized(rows: DataFrame, by: list[str], distinct: str, measured: str, frequent: str) -> DataFrame:
    """One row for each group ``by`` (a day, a source ...): states of three sketches, as binary columns to be stored.

    ``distinct`` counts different values, ``measured`` gives quantiles of whole numbers,
    ``frequent`` the most frequent values.  States are of fixed size, and partial ones are
    made before anything is shuffled; nulls count for nothing.
    """
    return rows.groupBy(*by).agg(
        F.hll_sketch_agg(distinct, F.lit(REGISTERS)).alias("distinct"),
        F.kll_sketch_agg_bigint(F.col(measured).cast("bigint")).alias("quantiles"),
        F.call_function("approx_top_k_accumulate", F.col(frequent), F.lit(TRACKED)).alias("frequent"),
        F.count("*").alias("n"),
    )


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """The states of :func:`summarized` for coarser groups; merging is associative, so merged states can be merged again."""
    return states.groupBy(*by).agg(
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_bigint("quantiles").alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
        F.sum("n").alias("n"),
    )


def n_distinct(state: Column) -> Column:
    """About how many different values there were: two standard errors are some 1.6 per cent."""
    return F.hll_sketch_estimate(state)


def quantiles(state: Column, *shares: float) -> Column:
    """Values at the given shares of the rows; ranks are off by some 1.3 per cent of them at most."""
    return F.kll_sketch_get_quantile_bigint(state, F.array(*[F.lit(float(s)) for s in shares]))


def top(state: Column, k: int) -> Column:
    """The ``k`` most frequent values as (item, count); exact while a state has seen no more than three quarters of ``TRACKED`` values."""
    return F.call_function("approx_top_k_estimate", state, F.lit(k))
