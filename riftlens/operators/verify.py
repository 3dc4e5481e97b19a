"""Checks of groupings, orders and labels that come from outside, against a whitelist of known ids.

Proposals are tables: members (cluster_pos, cluster_id, member_pos, card_id), unclustered (card_id), order (pos,
cluster_id).  Nothing outside is called; without a usable proposal the layered layout stands in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riftlens.functions import text as X
from riftlens.session import global_rank

# fixed values: title and summary that stand in for missing labels
DEFAULT_TITLE, DEFAULT_SUMMARY = "변경 사항", "이 클러스터의 변경 사항입니다."


def unknown_ids(members: DataFrame, unclustered: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Ids in the proposal that are not known; one of them is enough to reject it."""
    named = members.select("card_id").unionByName(unclustered.select("card_id")).distinct()
    return named.join(whitelist.select("card_id").distinct(), "card_id", "left_anti")


def verified_clusters(members: DataFrame) -> DataFrame:
    """Members with each card in the first cluster that names it; emptied clusters are gone."""
    first = Window.partitionBy("card_id").orderBy("cluster_pos", "member_pos")
    return members.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def absorbed(members: DataFrame, unclustered: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Cards that end up unclustered: known ones that no cluster took, named as unclustered or not named at all."""
    return whitelist.select("card_id").unionByName(unclustered.select("card_id")).distinct().join(members.select("card_id"), "card_id", "left_anti")


def verify_clusters(members: DataFrame, unclustered: DataFrame, whitelist: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The verified clustering of each layout (``group``): cluster_id, cluster_pos, member_pos, card_id, cluster_id null for unclustered.

    A layout that names an unknown card anywhere is rejected whole and gives no rows; else each card stays in the first cluster
    that names it, and every known card that no cluster took is unclustered.
    """
    group = group or []
    known = whitelist.select(*group, "card_id").distinct()
    named = members.select(*group, "card_id").unionByName(unclustered.select(*group, "card_id")).distinct()
    strange = named.join(known, [*group, "card_id"], "left_anti")
    if group:
        bad = strange.select(*group).distinct()
        keep = lambda df: df.join(bad, group, "left_anti")
    else:
        bad = strange.agg((F.count(F.lit(1)) > 0).alias("__bad"))
        keep = lambda df: df.join(F.broadcast(bad.where("__bad")), F.lit(True), "left_anti")
    first = Window.partitionBy(*group, "card_id").orderBy("cluster_pos", "member_pos")
    once = keep(members).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    rest = keep(known).join(once.select(*group, "card_id"), [*group, "card_id"], "left_anti")
    return once.select(*group, "cluster_id", "cluster_pos", "member_pos", "card_id").unionByName(rest, allowMissingColumns=True)


def order_problems(order: DataFrame, clusters: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(cluster_id, problem) of an ordering (cluster_id, pos, card_id) held against clusters (cluster_id, card_id)."""
    named = order.join(whitelist.select("card_id").distinct(), "card_id", "left_anti").select("cluster_id", F.lit("unknown card").alias("problem"))
    known = clusters.select("cluster_id").distinct()
    strange = order.join(known, "cluster_id", "left_anti").select("cluster_id", F.lit("unknown cluster").alias("problem"))
    twice = order.groupBy("cluster_id", "card_id").count().where("count > 1").select("cluster_id", F.lit("repeated card").alias("problem"))
    got, want = order.select("cluster_id", "card_id").distinct(), clusters.select("cluster_id", "card_id").distinct()
    here = got.join(known, "cluster_id", "left_semi")
    differs = here.join(want, ["cluster_id", "card_id"], "left_anti").unionByName(want.join(order.select("cluster_id").distinct(), "cluster_id", "left_semi").join(got, ["cluster_id", "card_id"], "left_anti")).select("cluster_id", F.lit("not a permutation").alias("problem"))
    omitted = known.join(order.select("cluster_id"), "cluster_id", "left_anti").select("cluster_id", F.lit("omitted cluster").alias("problem"))
    return named.unionByName(strange).unionByName(twice).unionByName(differs).unionByName(omitted).distinct()


def normalised_order(proposed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, pos): known clusters as proposed, first naming counts, then the missing ones in clustering order.

    ``proposed`` has pos and cluster_id, ``clusters`` has cluster_pos and cluster_id.
    """
    first = proposed.groupBy("cluster_id").agg(F.min("pos").alias("p"))
    every = clusters.groupBy("cluster_id").agg(F.min("cluster_pos").alias("c"))
    ranked = every.join(first, "cluster_id", "left")
    return global_rank(ranked, [F.col("p").isNull(), F.coalesce("p", "c"), F.col("cluster_id")], "pos").select("cluster_id", F.col("pos").cast("int").alias("pos"))


def suspicious(texts: DataFrame, allowed: DataFrame, key: str = "cluster_id", text: str = "text") -> DataFrame:
    """(key, token, pos): words that look like code and whose bases are no allowed names, at their first place."""
    tokens = texts.select(key, F.posexplode(X.identifier_tokens(F.col(text))).alias("pos", "token")).where(X.looks_like_code(F.col("token")))
    tokens = tokens.groupBy(key, "token").agg(F.min("pos").alias("pos"))
    bases = tokens.select(key, "token", F.explode(X.identifier_bases(F.col("token"))).alias("base"))
    names = allowed.select(F.lower("name").alias("__n")).distinct()
    fine = bases.join(names, F.lower("base") == F.col("__n"), "left_semi").select(key, "token").distinct()
    return tokens.join(fine, [key, "token"], "left_anti")


def verified_labels(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every cluster with a title and a summary; blank and missing ones get the defaults."""
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d)).alias(c)
    return clusters.select("cluster_id").distinct().join(labels, "cluster_id", "left").select("cluster_id", blank("title", DEFAULT_TITLE), blank("summary", DEFAULT_SUMMARY))


def verified_suggestions(suggestions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Suggestions (suggestion_id, kind, cluster_ids) that name at least one cluster and only known ones."""
    named = suggestions.select("suggestion_id", F.explode_outer("cluster_ids").alias("cluster_id"))
    bad = named.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_anti").select("suggestion_id").distinct()
    return suggestions.where(F.size("cluster_ids") > 0).join(bad, "suggestion_id", "left_anti")


def whitelisted_summaries(summaries: DataFrame, members: DataFrame) -> DataFrame:
    """(card_id, summary): non-empty summaries of members by the first cluster in flow order that gives one."""
    known = summaries.withColumn("summary", F.trim("summary")).where("summary <> ''").join(members.select("cluster_id", "card_id").distinct(), ["cluster_id", "card_id"], "left_semi")
    return known.groupBy("card_id").agg(F.min_by("summary", F.struct("flow_pos", "cluster_id")).alias("summary"))


def anchored(units: DataFrame) -> DataFrame:
    """Units whose anchor lies outside of them are anchored at their start."""
    ok = (F.col("anchor_line") >= F.col("start_line")) & (F.col("anchor_line") <= F.col("end_line"))
    return units.withColumn("anchor_line", F.when(ok, F.col("anchor_line")).otherwise(F.col("start_line")))


def cacheable(labels: DataFrame) -> DataFrame:
    """layout_id of layouts in which no cluster has the default title or summary."""
    poor = labels.where((F.col("title") == DEFAULT_TITLE) | (F.col("summary") == DEFAULT_SUMMARY)).select("layout_id").distinct()
    return labels.select("layout_id").distinct().join(poor, "layout_id", "left_anti")


def identity_order(members: DataFrame) -> DataFrame:
    """(cluster_id, pos, card_id): members as they were clustered, for clusters in order of their ids."""
    w = Window.partitionBy("cluster_id").orderBy("member_pos")
    return members.select("cluster_id", (F.row_number().over(w) - 1).alias("pos"), "card_id")


def fits_one_call(members: DataFrame, most: int = 48, small: int = 12) -> DataFrame:
    """Per layout: symbols, whether they are few, and whether grouping and order fit into one proposal."""
    n = F.count(F.lit(1))
    return members.groupBy("layout_id").agg(n.alias("symbols"), (n <= small).alias("is_small"), (n <= most).alias("combined_fits"))


def _filled(rows: DataFrame) -> DataFrame:
    """Rows with their empty lists as nulls, which JSON leaves out."""
    lists = [c for c, t in rows.dtypes if t.startswith("array")]
    return rows.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in lists})


def proposal_payload(features: DataFrame) -> DataFrame:
    """(seed_id, payload): a seed's features as JSON; empty lists and nulls are left out."""
    filled = _filled(features)
    return filled.select("seed_id", F.to_json(F.struct(*[c for c in filled.columns if c != "seed_id"])).alias("payload"))


def seeds_payload(features: DataFrame, key: str = "layout_id") -> DataFrame:
    """(key, payload): all seeds of a layout as one JSON object with the list ``seeds``, in order of their ids."""
    filled = _filled(features)
    seed = F.struct(F.col("seed_id"), *[c for c in filled.columns if c not in (key, "seed_id")])
    return filled.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(seed)).alias("seeds"))).alias("payload"))


def clusters_payload(members: DataFrame, key: str = "layout_id") -> DataFrame:
    """(key, payload): the clusters of a layout with their cards, as ordering and labelling ask for them."""
    per = members.groupBy(key, "cluster_id").agg(F.min("cluster_pos").alias("p"), F.transform(F.array_sort(F.collect_list(F.struct("member_pos", "card_id"))), lambda x: x["card_id"]).alias("memberCardIds"))
    cluster = F.struct("p", F.struct(F.col("cluster_id").alias("clusterId"), "memberCardIds").alias("c"))
    return per.groupBy(key).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(cluster)), lambda x: x["c"]).alias("clusters"))).alias("payload"))


# closed shapes of proposal records: every field is required, lists stand where a map would have open names
CLUSTER = "struct<clusterId:string,memberCardIds:array<string>,kind:string>"
CLUSTERING_SHAPE = f"struct<clusters:array<{CLUSTER}>,unclustered:array<string>>"
ORDER_SHAPE = "struct<clusterOrder:array<string>,clusters:array<struct<clusterId:string,orderedCardIds:array<string>>>>"
CLUSTERS_SHAPE = f"struct<clusters:array<{CLUSTER}>,unclustered:array<string>,clusterOrder:array<string>>"
SUGGESTION = "struct<clusterIds:array<string>,reason:string>"
LABELS_SHAPE = f"struct<labels:array<struct<clusterId:string,title:string,summary:string,kind:string,cardSummaries:array<struct<cardId:string,summary:string>>>>,mergeSuggestions:array<{SUGGESTION}>,splitSuggestions:array<{SUGGESTION}>>"
LABEL_SHAPE = "struct<title:string,summary:string,cardSummaries:array<struct<cardId:string,summary:string>>>"
UNITS_SHAPE = "struct<units:array<struct<title:string,why:string,tag:string,startLine:int,endLine:int,anchorLine:int>>>"


def complete(value, kind: T.DataType):
    """Whether a decoded record has all that its closed shape requires, at any depth: no null anywhere."""
    if isinstance(kind, T.StructType):
        whole = value.isNotNull()
        for f in kind.fields:
            whole = whole & complete(value[f.name], f.dataType)
        return F.coalesce(whole, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(value, lambda x: complete(x, kind.elementType)), F.lit(False))
    return value.isNotNull()


def read_proposals(replies: DataFrame, shape: str = CLUSTERS_SHAPE, keys: tuple[str, ...] = ("layout_id",)) -> DataFrame:
    """Replies (keys, reply) that decode to the shape with all of its fields; fences and wrappers are taken off."""
    kind = T.DataType.fromDDL(shape)
    decoded = replies.withColumn("record", F.from_json(X.strip_fence(X.unwrap_json(X.strip_fence(F.col("reply")))), kind))
    return decoded.where(complete(F.col("record"), kind)).select(*keys, "record")


#: How often a proposal is asked for before the default stands in.
ATTEMPTS = 2


def first_usable(requests: DataFrame, replies: DataFrame, shape: str = CLUSTERS_SHAPE) -> DataFrame:
    """(layout_id, attempt, record) of every request: the first of its two replies (layout_id, attempt, reply) that can be read.

    Where neither can, attempt and record are null and the default stands in: the layered layout, the identity order or the
    default labels.
    """
    read = read_proposals(replies.where(F.col("attempt").between(1, ATTEMPTS)), shape, ("layout_id", "attempt"))
    first = read.groupBy("layout_id").agg(F.min("attempt").alias("attempt"), F.min_by("record", "attempt").alias("record"))
    return requests.select("layout_id").distinct().join(first, "layout_id", "left")
