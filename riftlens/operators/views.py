"""What a reader of a review sees: aligned rows, folds, anchors, groups, tallies, trees.

Lines are rows (keys, line_seq, kind, content, ...); all windows run within a card.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftlens.functions import text as X
from riftlens.session import grouped_rank

# fixed values: context lines kept beside a change, lines that a fold hides at least, excerpt lines on each side
CONTEXT, LEAST_HIDDEN, EXCERPT = 2, 4, 60


def split_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Side-by-side rows: keys, row_no from 0, left_seq, right_seq.

    Within each run of changed lines the i-th deleted stands beside the i-th added, the longer side alone at its end; a
    context line stands beside itself.
    """
    order = Window.partitionBy(*keys).orderBy("line_seq")
    ctx = F.when(F.col("kind") == "ctx", 1).otherwise(0)
    marked = lines.select(*keys, "line_seq", "kind", F.sum(ctx).over(order).alias("run"))
    at = F.row_number().over(Window.partitionBy(*keys, "run", "kind").orderBy("line_seq"))
    placed = marked.withColumn("i", at)
    cell = placed.groupBy(*keys, "run", F.when(F.col("kind") == "ctx", 0).otherwise(F.col("i")).alias("i")).agg(
        F.min(F.when(F.col("kind").isin("ctx", "del"), F.col("line_seq"))).alias("left_seq"), F.min(F.when(F.col("kind").isin("ctx", "add"), F.col("line_seq"))).alias("right_seq")
    )
    row = F.row_number().over(Window.partitionBy(*keys).orderBy("run", "i")) - 1
    return cell.select(*keys, row.alias("row_no"), "left_seq", "right_seq")


def folds(rows: DataFrame, keys: list[str], row: str = "row_no", expanded: DataFrame | None = None) -> DataFrame:
    """Folded stretches of context: keys, first_row, last_row, hidden.

    ``rows`` has ``is_ctx`` and ``has_thread``.  A run keeps two rows beside a change and none at the ends of the file; it
    is folded where it hides at least four rows, holds no thread and is not among ``expanded`` (keys, first row of a run).
    """
    order = Window.partitionBy(*keys).orderBy(row)
    run = F.sum(F.when(F.col("is_ctx"), 0).otherwise(1)).over(order)
    edge = Window.partitionBy(*keys)
    runs = rows.withColumns({"__run": run, "__first": F.min(row).over(edge), "__last": F.max(row).over(edge)}).where("is_ctx")
    got = runs.groupBy(*keys, "__run").agg(F.min(row).alias("a"), F.max(row).alias("b"), F.bool_or("has_thread").alias("t"), F.first("__first").alias("f"), F.first("__last").alias("l"))
    if expanded is not None:
        got = got.join(expanded.select(*keys, F.col("first_row").alias("a")), [*keys, "a"], "left_anti")
    top = F.when(F.col("a") == F.col("f"), 0).otherwise(CONTEXT)
    bottom = F.when(F.col("b") == F.col("l"), 0).otherwise(CONTEXT)
    hidden = F.col("b") - F.col("a") + 1 - top - bottom
    return got.where(~F.col("t") & (hidden >= LEAST_HIDDEN)).select(*keys, (F.col("a") + top).alias("first_row"), (F.col("b") - bottom).alias("last_row"), hidden.alias("hidden"))


def unit_anchors(units: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Units before the first visible row at or after their anchor (0 stands for the start); later ones are left out.

    An as-of join by one ordered pass: units and rows are merged by line, and each unit takes the next row's number.
    ``units``: keys, unit_idx, anchor_line, start_line; ``rows``: keys, n (the line shown), row_no.
    """
    line = F.when(F.col("anchor_line") == 0, F.col("start_line")).otherwise(F.col("anchor_line"))
    first = rows.groupBy(*keys, "n").agg(F.min("row_no").alias("row_no"))
    u = units.select(*keys, line.alias("n"), F.lit(0).alias("__side"), "unit_idx", F.lit(None).cast("long").alias("row_no"))
    r = first.select(*keys, "n", F.lit(1).alias("__side"), F.lit(None).cast(units.schema["unit_idx"].dataType).alias("unit_idx"), F.col("row_no").cast("long"))
    after = Window.partitionBy(*keys).orderBy("n", "__side").rowsBetween(1, Window.unboundedFollowing)
    merged = u.unionByName(r).withColumn("at_row", F.first("row_no", ignorenulls=True).over(after))
    return merged.where("__side = 0 and at_row is not null").select(*keys, "unit_idx", F.col("n").alias("anchor"), "at_row")


def flatten_order(ordered: DataFrame, cards: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Cards in the given order, first naming counts, unknown ids out, then the unplaced ones in their own order: card_id, pos.

    ``ordered`` has pos and card_id, ``cards`` seq and card_id.
    """
    group = group or []
    first = ordered.groupBy(*group, "card_id").agg(F.min("pos").alias("__p"))
    every = cards.groupBy(*group, "card_id").agg(F.min("seq").alias("__s"))
    joined = every.join(first, [*group, "card_id"], "left")
    order = [F.col("__p").isNull(), F.coalesce("__p", "__s"), F.col("__s"), F.col("card_id")]
    return grouped_rank(joined, group, order, "pos").select(*group, "card_id", F.col("pos").cast("int").alias("pos"))


def cluster_of(cards: DataFrame, layout: DataFrame, state: str) -> DataFrame:
    """Cards with their cluster; once an analysis is done or has fallen back, those without one are Unclustered."""
    joined = cards.join(layout.select("card_id", "cluster_id", "title"), "card_id", "left")
    default = F.when(F.lit(state in ("done", "fallback")) & F.col("cluster_id").isNull(), "Unclustered").otherwise(F.col("title"))
    return joined.withColumn("title", default)


def thread_lines(threads: DataFrame, lines: DataFrame) -> DataFrame:
    """Threads with their reference ``path:n``; n is null where the line is not there."""
    path = F.regexp_replace("card_id", "::__file$", "")
    at = lines.select(F.col("card_id").alias("__c"), F.col("line_seq").alias("__l"), "n")
    joined = threads.join(at, (F.col("card_id") == F.col("__c")) & (F.col("line_seq") == F.col("__l")), "left")
    return joined.select("thread_id", "card_id", F.concat_ws(":", path, F.col("n").cast("string")).alias("reference"))


def thread_regions(threads: DataFrame) -> DataFrame:
    """One row per side and row that a thread covers: thread_id, key ``side:row``; swapped ends are put right."""
    lo, hi = F.least("from_row", "to_row"), F.greatest("from_row", "to_row")
    return threads.select("thread_id", F.explode(F.sequence(lo, hi)).alias("row"), "side").select("thread_id", F.concat_ws(":", "side", F.col("row").cast("string")).alias("key"))


def card_status(threads: DataFrame, turns: DataFrame, verdicts: DataFrame, cards: DataFrame) -> DataFrame:
    """Per card: messages, threads, open threads, status (flag with an open thread, else pass with a verdict, else pending)."""
    said = turns.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"))
    got = threads.join(said, "thread_id", "left").groupBy("card_id").agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.count(F.lit(1)).alias("threads"), F.count_if(~F.col("resolved")).alias("open_threads"))
    passed = verdicts.select("card_id").distinct().withColumn("passed", F.lit(True))
    joined = cards.select("card_id").distinct().join(got, "card_id", "left").join(passed, "card_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(F.coalesce("open_threads", F.lit(0)) > 0, "flag").when(F.coalesce("passed", F.lit(False)), "pass").otherwise("pending")
    return joined.select("card_id", zero("messages"), zero("threads"), zero("open_threads"), status.alias("status"))


def spine_groups(items: DataFrame, keys: list[str], by: str, order: list[str]) -> DataFrame:
    """Consecutive rows of equal ``by``: group_no from 0, first value, size, colour (all, some, none) by ``passed``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(by).over(w).eqNullSafe(F.col(by)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = items.withColumn("__new", new).withColumn("group_no", F.sum("__new").over(w) - 1)
    n, p = F.count(F.lit(1)), F.count_if(F.col("passed"))
    return numbered.groupBy(*keys, "group_no", by).agg(n.alias("size"), F.when(p == n, "all").when(p > 0, "some").otherwise("none").alias("colour"))


def cluster_positions(members: DataFrame, cluster: str = "cluster_id", order: str = "pos") -> DataFrame:
    w = Window.partitionBy(cluster)
    return members.withColumns({"position": F.row_number().over(w.orderBy(order)), "of": F.count(F.lit(1)).over(w)})


def tree(cards: DataFrame) -> DataFrame:
    """Directory roll-up: path, depth, adds, dels, files of every directory; ``cards`` has path, adds, dels."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = cards.select("path", "adds", "dels", F.explode(prefixes).alias("dir"))
    out = each.groupBy("dir").agg(F.sum("adds").alias("adds"), F.sum("dels").alias("dels"), F.countDistinct("path").alias("files"))
    return out.select("dir", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"), "adds", "dels", "files")


def collapsed_tree(cards: DataFrame) -> DataFrame:
    """Directories that are shown: chains of only children without files of their own are one node.

    A directory is drawn into its parent's node where the parent has no files and no other directory; the root stays.
    Out come dir (of the lowest directory of the chain), label (its part of the path), adds, dels, files.
    """
    nodes = tree(cards)
    parent = F.when(F.instr("dir", "/") > 0, F.regexp_replace("dir", r"/[^/]*$", "")).otherwise(F.lit(""))
    dirs = nodes.where("dir <> ''").withColumn("parent", parent)
    children = dirs.groupBy("parent").agg(F.count(F.lit(1)).alias("child_dirs"))
    own = cards.select(F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit("")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("own_files"))
    info = dirs.join(children.withColumnRenamed("parent", "dir"), "dir", "left").join(own.withColumnRenamed("d", "dir"), "dir", "left")
    passing = info.where("coalesce(child_dirs, 0) = 1 and coalesce(own_files, 0) = 0").select("dir")
    # the head of a chain is the highest directory whose parent does not pass through
    shown = info.join(passing, "dir", "left_anti")
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))
    above = shown.select("dir", F.posexplode(ups).alias("i", "up")).join(passing.withColumnRenamed("dir", "up").withColumn("thru", F.lit(True)), "up", "left")
    last_stop = above.where("thru is null and up <> dir").groupBy("dir").agg(F.max("i").alias("stop"))
    joined = shown.join(last_stop, "dir", "left")
    label = F.array_join(F.slice(F.split("dir", "/"), F.coalesce(F.col("stop"), F.lit(-1)) + 2, F.size(F.split("dir", "/"))), "/")
    return joined.select("dir", label.alias("label"), "adds", "dels", "files")


def transcript(turns: DataFrame, assistants: tuple[str, ...] = ("ai", "assistant")) -> DataFrame:
    """Each thread as one text, turns in order, each led by the side that speaks."""
    side = F.when(F.regexp_replace(F.lower("author"), r"[^a-z]", "").isin(*assistants), "Assistant").otherwise("User")
    row = F.struct("msg_seq", F.concat(side, F.lit(": "), F.coalesce("text", F.lit(""))).alias("s"))
    return turns.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), "\n\n").alias("transcript"))


def excerpt(lines: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Lines around an anchor (keys, anchor_seq): all of a short card, else up to sixty on each side, within the card.

    An anchor past the last line stands at the last line, one that is null at the first.
    """
    order = Window.partitionBy(*keys)
    sized = lines.join(anchors, keys).withColumns({"__at": F.row_number().over(order.orderBy("line_seq")) - 1, "__n": F.count(F.lit(1)).over(order)})
    pos = F.least(F.count_if(F.col("line_seq") < F.col("anchor_seq")).over(order), F.col("__n") - 1)
    return sized.withColumn("__pos", pos).where((F.col("__n") <= 2 * EXCERPT + 1) | (F.abs(F.col("__at") - F.col("__pos")) <= EXCERPT)).drop("__at", "__n", "__pos")


def checklist(turns: DataFrame, threads: DataFrame) -> DataFrame:
    """Per review: commands given, of which settled, and a Markdown list of them."""
    asked = turns.where("kind = 'command'").join(threads.select("thread_id", "review_id", "card_id", "resolved"), "thread_id")
    box = F.concat(F.when(F.col("resolved"), "- [x] ").otherwise("- [ ] "), F.coalesce("text", F.lit("")), F.lit(" ("), F.regexp_replace("card_id", "::__file$", ""), F.lit(")"))
    row = F.struct("thread_id", "msg_seq", box.alias("s"))
    return asked.groupBy("review_id").agg(F.count(F.lit(1)).alias("commands"), F.count_if(F.col("resolved")).alias("settled"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), "\n").alias("checklist"))


def viewport(rows: DataFrame, keys: list[str], top: float, bottom: float, overscan: float = 1600.0) -> DataFrame:
    """Rows that a window from ``top`` to ``bottom`` shows, by prefix sums of their heights, with some beyond it.

    From the first row whose lower edge lies below the upper bound, to before the first whose upper edge is at the lower bound,
    one row at least.
    """
    w = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("height").over(w)).withColumn("begin", F.col("end") - F.col("height"))
    below = placed.where(F.col("end") > top - overscan)
    first = F.min("row_no").over(Window.partitionBy(*keys))
    return below.withColumn("__first", first).where((F.col("begin") < bottom + overscan) | (F.col("row_no") == F.col("__first"))).drop("__first")


def widest(lines: DataFrame, keys: list[str], floor: int = 24) -> DataFrame:
    return lines.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(X.cell_width(F.col("content"))), F.lit(0)), F.lit(floor)).alias("width"))


def progress_totals(cards: DataFrame) -> DataFrame:
    """Cards, done cards and done clusters; a cluster is done when all its cards are."""
    per = cards.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("done")).alias("d"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cards"), F.coalesce(F.sum("d"), F.lit(0)).alias("done_cards"), F.count_if(F.col("n") == F.col("d")).alias("done_clusters"))
