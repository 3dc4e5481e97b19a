"""Connected components and ancestry by iterated joins.

Labels shrink to the smallest node of a component by alternating stars: every node links to the smallest node that it
knows of, so paths halve each round and a chain of n nodes needs about log(n) rounds.  Edges and labels stay distributed;
the driver sees one number a round.  Each round is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftlens.session import checkpointed, grouped_rank

SCOPE_SEPARATOR = "\u001f"


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id that a node is linked with, itself where it has no link.

    ``nodes`` has id, ``pairs`` has a and b; pairs that name other nodes, loops and repeated pairs change nothing.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    known = pairs.select("a", "b").where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    edges = checkpointed(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while not edges.isEmpty():
        # large star: neighbours above a node link to the smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its neighbours below link to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = checkpointed(small)
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return ids.join(edges.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def seeds(nodes: DataFrame, pairs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, seed_id, id): components numbered from 1 by their smallest member, within each scope by itself.

    With ``scope``, nodes and pairs carry its columns, and equal ids of two scopes are two nodes.
    """
    scope = scope or []
    if not scope:
        labelled = components(nodes, pairs)
    else:
        within = lambda c: F.concat_ws(SCOPE_SEPARATOR, *scope, c)
        named = nodes.select(*scope, "id").where("id is not null").distinct().withColumn("__node", within("id"))
        found = components(named.select(F.col("__node").alias("id")), pairs.select(within("a").alias("a"), within("b").alias("b")))
        labelled = named.join(found.withColumnRenamed("id", "__node"), "__node").drop("__node")
    roots = grouped_rank(labelled.select(*scope, "component").distinct(), scope, [F.col("component")], "n").select(*scope, "component", F.concat(F.lit("seed-"), F.col("n") + 1).alias("seed_id"))
    return labelled.join(roots, [*scope, "component"]).select(*scope, "seed_id", "id")


def merge_base(parents: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Best common ancestors of commits: (left_id, right_id, base_id), ties to the nearest, then to the smallest id.

    A common ancestor from which another one descends is not a best one.  ``parents`` has id and parent; ``left`` and
    ``right`` hold one column id each and are few.  The frontier moves up one generation a round until it is empty; what
    earlier rounds saw is kept as they wrote it.
    """
    edges = parents.select("id", "parent").where("parent is not null").distinct()

    def ancestry(start: DataFrame) -> DataFrame:
        front = seen = checkpointed(start.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
        depth = 0
        while True:
            depth += 1
            up = front.join(edges, "id").select("start", F.col("parent").alias("id"), F.lit(depth).alias("depth")).distinct()
            front = checkpointed(up.join(seen.select("start", "id"), ["start", "id"], "left_anti"))
            if front.isEmpty():
                return seen
            seen = seen.unionByName(front)

    a, b = ancestry(left), ancestry(right)
    common = checkpointed(a.select(F.col("start").alias("left_id"), "id", F.col("depth").alias("dl")).join(b.select(F.col("start").alias("right_id"), "id", F.col("depth").alias("dr")), "id"))
    # all ancestors of a common ancestor are common, so one that is no best one is a parent of a common one
    passed = common.join(edges, "id").select("left_id", "right_id", F.col("parent").alias("id")).distinct()
    best = common.join(passed, ["left_id", "right_id", "id"], "left_anti")
    return best.groupBy("left_id", "right_id").agg(F.min_by("id", F.struct(F.col("dl") + F.col("dr"), "id")).alias("base_id"))
