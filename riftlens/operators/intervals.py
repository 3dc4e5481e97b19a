"""Interval stabbing: the narrowest interval that holds a point, per key.

The key makes it an equi-join; a group with very many intervals can be cut into bins of rows first, so that a point meets
only the intervals of its bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows to a bin: a point meets the intervals that touch its bin, however many its key has.
BIN_ROWS = 512


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point: str = "row", start: str = "start_row", end: str = "end_row", index: str = "sym_idx", bin_rows: int | None = BIN_ROWS) -> DataFrame:
    """Every point with ``index`` of its narrowest holding interval (ties to the lowest index), null where none holds it.

    Both sides are cut into bins of rows (without ``bin_rows`` a key is one bin).  Only keys and places are matched, each place of a key once; the points' other columns
    are joined to what was found.
    """
    slim = intervals.select(*keys, start, end, index).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    bin_of = lambda c: F.floor(F.col(c) / bin_rows) if bin_rows else F.lit(0).cast("long")
    slim = slim.withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    names = [f"__k{i}" for i in range(len(keys))]
    places = points.where(F.col(point).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(point).alias("__p")).distinct()
    places = places.withColumn("__b", bin_of("__p"))
    same = F.col("__bin") == F.col("__b")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    holds = same & (F.col("__p") >= F.col(start)) & (F.col("__p") <= F.col(end))
    best = F.min_by(F.col(index), F.struct(F.col(end) - F.col(start), F.col(index)))
    found = places.join(slim, holds).groupBy(*names, "__p").agg(best.alias("__found"))
    back = points[point] == F.col("__p")
    for k, n in zip(keys, names, strict=True):
        back = back & points[k].eqNullSafe(F.col(n))
    return points.join(found, back, "left").select(*points.columns, F.col("__found").alias(index))


def effective_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``row`` of each diff line on the new side: its own, for deleted lines that of the line before, else after, else null."""
    order = Window.partitionBy(*keys).orderBy("line_seq")
    before = F.last("new_lineno", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("new_lineno", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    own = F.when(F.col("kind") == "del", F.coalesce(before, after)).otherwise(F.col("new_lineno"))
    return lines.withColumn("row", F.greatest(own - 1, F.lit(0)))


def attribute_lines(lines: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Each diff line with the innermost symbol that holds its row."""
    return innermost(effective_rows(lines, keys), symbols, keys)


def contained(blocks: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(block_id, sym_idx) of every symbol that lies within a block."""
    s = symbols.select(*(F.col(k).alias(f"__r_{k}") for k in keys), "start_row", "end_row", "sym_idx")
    same = F.lit(True)
    for k in keys:
        same = same & (blocks[k] == s[f"__r_{k}"])
    return blocks.join(s, same & (F.col("start_row") >= blocks["block_start"]) & (F.col("end_row") <= blocks["block_end"])).select(*(blocks[k] for k in keys), "block_id", "sym_idx")


def attribute_impls(refs: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Supertype references to their innermost symbol, else to every symbol within the enclosing block, else dropped.

    ``refs`` has ref_id, row, block_start, block_end (null without a block); out come ref_id, sym_idx, in_header.
    """
    direct = innermost(refs, symbols, keys)
    header = direct.join(symbols.select(*keys, "sym_idx", F.col("start_row").alias("__h")), [*keys, "sym_idx"], "left")
    hit = header.where("sym_idx is not null").select(*keys, "ref_id", "sym_idx", (F.col("row") == F.col("__h")).alias("in_header"))
    missed = direct.where("sym_idx is null and block_start is not null").drop("sym_idx").withColumn("block_id", F.col("ref_id"))
    inside = contained(missed, symbols, keys).select(*keys, F.col("block_id").alias("ref_id"), "sym_idx", F.lit(True).alias("in_header"))
    return hit.unionByName(inside)


def complex_flags(lines: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Whether changed lines fall under two or more outermost symbols."""
    changed = effective_rows(lines, keys).where("kind <> 'ctx' and row is not null").select(*keys, "row").distinct()
    s = symbols.select(*(F.col(k).alias(f"__r_{k}") for k in keys), "start_row", "end_row", "sym_idx")
    same = (F.col("row") >= F.col("start_row")) & (F.col("row") <= F.col("end_row"))
    for k in keys:
        same = same & (changed[k] == s[f"__r_{k}"])
    first = changed.join(s, same).groupBy(*keys, "row").agg(F.min("sym_idx").alias("first"))
    return first.groupBy(*keys).agg((F.countDistinct("first") >= 2).alias("complex"))
