"""Layouts: clusters in order with their cards, from a verified proposal or by layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftlens.functions import rules as R
from riftlens.functions import text as X
from riftlens.operators.verify import DEFAULT_TITLE
from riftlens.session import global_rank, grouped_rank

# fixed value: summary of clusters that were made by layers
LAYERED_SUMMARY = "자동 분석에 실패하여 파일 경로·레이어 기준으로 묶은 변경 사항입니다."


def seed_order(members: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per seed: smallest layer (a member's name stands for its path), smallest name, title and rank from 1 within ``group``."""
    group = group or []
    rank = R.layer_rank(F.col("name"), F.col("name"))
    base = X.basename(F.col("name"))
    got = members.groupBy(*group, "seed_id").agg(F.min(rank).alias("layer"), F.min("name").alias("first_name"), F.count("name").alias("n"), F.countDistinct(base).alias("bases"), F.min(base).alias("base"))
    title = F.when(F.col("n") == 0, DEFAULT_TITLE).when(F.col("bases") == 1, F.col("base")).otherwise(F.col("first_name"))
    named = got.select(*group, "seed_id", F.coalesce("layer", F.lit(R.OTHER_LAYER)).alias("layer"), "first_name", title.alias("title"))
    ranked = grouped_rank(named, group, [F.col("layer"), F.coalesce("first_name", F.lit("")), F.col("seed_id")], "rank")
    return ranked.select(*group, "seed_id", "layer", "first_name", "title", (F.col("rank") + 1).cast("int").alias("rank"))


def layered(members: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The layered layout: seed_id, rank, title, pos, card_id; each card in the first seed that has it."""
    group = group or []
    placed = members.join(seed_order(members, group).select(*group, "seed_id", "rank", "title"), [*group, "seed_id"])
    layer = R.layer_rank(F.col("name"), F.col("name"))
    first = Window.partitionBy(*group, "card_id").orderBy("rank", layer, "name")
    once = placed.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    within = Window.partitionBy(*group, "rank").orderBy(layer, "name", "card_id")
    return once.select(*group, "seed_id", "rank", "title", (F.row_number().over(within) - 1).alias("pos"), "card_id")


def label_inputs(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """The members that labels are asked for: cluster_id, member_pos, card_id with their symbols' names, in order; others are out."""
    return members.join(symbols.select("card_id", "name").distinct(), "card_id").select("cluster_id", "member_pos", "card_id", "name")


def assembled(order: DataFrame, members: DataFrame, labels: DataFrame, unclustered: DataFrame | None = None) -> DataFrame:
    """cluster_id, cluster_pos, title, summary, member_pos, flat_pos, card_id of a verified proposal.

    ``order`` is (cluster_id, pos), ``members`` (cluster_id, member_pos, card_id), ``labels`` (cluster_id, title, summary).  A
    cluster stands where the order names it first, those that it leaves out come after it by their ids, and the cards of
    ``unclustered`` (card_id) come last, without a cluster.
    """
    named = order.groupBy("cluster_id").agg(F.min("pos").alias("p"))
    every = members.select("cluster_id").distinct().join(named, "cluster_id", "left")
    placed = global_rank(every, [F.col("p").isNull(), F.col("p"), F.col("cluster_id")], "cluster_pos").drop("p")
    joined = members.join(placed, "cluster_id").join(labels, "cluster_id", "left").withColumn("title", F.coalesce("title", F.lit(DEFAULT_TITLE)))
    if unclustered is not None:
        loose = unclustered.select("card_id").distinct().join(members.select("card_id"), "card_id", "left_anti")
        joined = joined.unionByName(loose, allowMissingColumns=True)
    ranked = global_rank(joined, [F.col("cluster_pos").isNull(), F.col("cluster_pos"), F.col("member_pos"), F.col("card_id")], "flat_pos")
    return ranked.select("cluster_id", F.col("cluster_pos").cast("int").alias("cluster_pos"), "title", "summary", "member_pos", F.col("flat_pos").cast("int").alias("flat_pos"), "card_id")


def folded(cards: DataFrame, layout: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cards with the cluster and the summary that a layout gives them; others keep null."""
    return cards.join(layout.select("card_id", "cluster_id").dropDuplicates(["card_id"]), "card_id", "left").join(summaries.select("card_id", F.col("summary").alias("ai_summary")).dropDuplicates(["card_id"]), "card_id", "left")
