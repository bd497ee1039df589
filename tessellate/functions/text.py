"""Text functions on columns; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that end sentences, what may close behind them, and titles whose full stop doesn't.
END_MARKS = (".", "?", "!", "。", "！", "？", "।")
CLOSING = ("\"", "'", "”", "’", "»", ")", "]", "}")
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.")


def normalized_token(token: Column) -> Column:
    """Lower case, without one final ``s`` of words longer than three letters (not ``ss``)."""
    low = F.lower(token)
    plural = (F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss")
    return F.when(plural, F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def sanitized(text: Column) -> Column:
    """White space inside becomes one space, that at the ends goes; nothing left gives null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "), F.lit(""))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether half-open intervals share a position; any null end means no."""
    return F.coalesce((start_a < end_b) & (start_b < end_a), F.lit(False))


#: Three of them open a block and the next three close it.
FENCE = "```"


def fence_bodies(output: Column, tags: tuple[str, ...] = ("json",)) -> Column:
    """Bodies of fenced blocks that are untagged or have one of ``tags``.

    Between fences stands text by turns outside and inside of blocks; what has no closing
    fence is no block.  A block's tag is what it starts with of ASCII letters, digits and
    ``-+_``.
    """
    between = F.split(output, FENCE)
    inside = F.filter(between, lambda _, k: (k % 2 == 1) & (k < F.size(between) - 1))
    tag = lambda block: F.regexp_extract(block, "^[-+_0-9A-Za-z]*", 0)
    fitting = F.filter(inside, lambda block: F.lower(tag(block)).isin("", *tags))
    return F.transform(fitting, lambda block: F.regexp_replace(F.substring(block, F.length(tag(block)) + 1, F.length(block)), r"(?U)^\s+|\s+$", ""))
