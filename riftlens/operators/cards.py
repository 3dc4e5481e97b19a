"""Cards: one per changed file, with counts, gutter numbers, runs, snippets and summaries.

Repeated rows of the line table count once; files without added or deleted lines make no card.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftlens.functions import text as X


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.dropDuplicates(["file_id", "line_seq"])


def routed(files: DataFrame) -> DataFrame:
    """How each file is rendered: binary before deleted before added before modified."""
    return files.withColumn("route", F.when(F.col("is_binary"), "binary").when(F.col("status") == "Deleted", "deleted").when(F.col("status") == "Added", "added").otherwise("modified"))


def line_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count_if(F.col("kind") == "add").alias("adds"), F.count_if(F.col("kind") == "del").alias("dels"), F.count(F.lit(1)).alias("lines"))


def file_counts(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(F.countDistinct("new_path").alias("files"))


def with_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Files that have an added or deleted line."""
    return files.join(lines.where("kind in ('add', 'del')").select("file_id").distinct(), "file_id", "left_semi")


def gutter(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``n``: the number shown at each line; deleted lines repeat the last shown one, the first start below the first line."""
    order = Window.partitionBy(*keys).orderBy("line_seq")
    before = F.last("new_lineno", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("new_lineno", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return lines.withColumn("n", F.coalesce("new_lineno", before, F.greatest(first - 1, F.lit(0)), F.lit(0)))


def deleted_lines(files: DataFrame) -> DataFrame:
    """Lines of deleted files taken from the old source: file_id, line_seq, n, t, c."""
    return files.where("status = 'Deleted'").select("file_id", F.posexplode(X.source_lines(F.col("old_source"))).alias("line_seq", "c")).select("file_id", "line_seq", (F.col("line_seq") + 1).alias("n"), F.lit("del").alias("t"), "c")


def cards(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, card_id, route, change_type, adds, dels, summary of every changed file."""
    latest = files.groupBy("file_id").agg(F.max_by(F.struct("new_path", "old_path", "status", "is_binary"), F.col("ingested_at")).alias("f")).select("file_id", "f.*")
    counted = routed(latest).join(line_counts(lines, ["file_id"]), "file_id", "left")
    path = F.coalesce(F.nullif(F.col("new_path"), F.lit("")), F.col("old_path"))
    adds, dels = F.coalesce("adds", F.lit(0)), F.coalesce("dels", F.lit(0))
    summary = F.when(F.col("route") == "binary", X.binary_summary(path, F.col("status"))).otherwise(X.file_summary(path, F.col("status"), adds, dels))
    out = counted.select("file_id", X.card_id(path).alias("card_id"), "route", X.change_type(F.col("status")).alias("change_type"), adds.alias("adds"), dels.alias("dels"), summary.alias("summary"))
    return out.where("route = 'binary' or adds + dels > 0")


def change_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Contiguous runs of changed lines: run_no from 0, first_seq, last_seq, adds, dels.

    A run ends where a line lies between or the new-side number jumps by more than one.
    """
    order = Window.partitionBy(*keys).orderBy("line_seq")
    changed = gutter(lines, keys).where("kind in ('add', 'del')")
    gap = (F.col("line_seq") - F.lag("line_seq").over(order) > 1) | (F.col("n") - F.lag("n").over(order) > 1)
    runs = changed.withColumn("run_no", F.sum(F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)).over(order))
    return runs.groupBy(*keys, "run_no").agg(F.min("line_seq").alias("first_seq"), F.max("line_seq").alias("last_seq"), F.count_if(F.col("kind") == "add").alias("adds"), F.count_if(F.col("kind") == "del").alias("dels"))


def snippets(lines: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """The first changed lines of each card with their signs, one string."""
    order = Window.partitionBy(*keys).orderBy("line_seq")
    top = lines.where("kind in ('add', 'del')").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most)
    signed = F.struct("__r", F.concat(F.when(F.col("kind") == "add", "+").otherwise("-"), "content").alias("s"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(signed)), lambda x: x["s"]), "\n").alias("snippet"))


def unit_review_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Changed lines as ``n sign+code``, one string per card; cards without any are left out."""
    shown = gutter(lines, keys).where("kind in ('add', 'del')")
    row = F.struct("line_seq", F.concat_ws(" ", F.col("n").cast("string"), F.concat(F.when(F.col("kind") == "add", "+").otherwise("-"), "content")).alias("s"))
    return shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), "\n").alias("changes"))


def duplicate_positions(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """``pos`` from 0 among symbols of one name, null where the name is unique."""
    w = Window.partitionBy(*keys, "name")
    at = F.row_number().over(w.orderBy("start_row", "sym_idx")) - 1
    return symbols.withColumn("pos", F.when(F.count(F.lit(1)).over(w) > 1, at))


def changed_symbols(attributed: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols that hold an added or deleted line."""
    hit = attributed.where("kind in ('add', 'del') and sym_idx is not null").select(*keys, "sym_idx").distinct()
    return symbols.join(hit, [*keys, "sym_idx"], "left_semi")
