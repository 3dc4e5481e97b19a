"""Relations between changed symbols: reference, ownership and place, as canonical pairs of two grades.

Inputs: ``changed`` (card_id, name, owner, path), ``refs`` (card_id, bucket, ident, in_header), ``imports`` (card_id,
ident).  Output: pairs (a, b, grade) with a < b; a strong pair is not given as a weak one as well.

``scope`` names columns that all inputs carry, such as repository and review: names are looked up, and cards related, within
one scope only, and the scope leads the output.

Members of one owner, and symbols of one file, are all related with each other, n(n-1)/2 pairs for a group of n.  Where only
components are asked for, ``all_pairs=False`` gives a group as n - 1 links to its smallest member, which joins the same cards;
the grades of the pairs that are left are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftlens.functions.rules import is_hub

Scope = list[str] | None


def canonical(df: DataFrame, x: str | Column, y: str | Column, scope: Scope = None) -> DataFrame:
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return df.where(x != y).select(*(scope or []), F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def resolve(idents: DataFrame, changed: DataFrame, scope: Scope = None) -> DataFrame:
    """(card_id, target) for each changed symbol of the name that is referred to; hub names resolve to nothing."""
    scope = scope or []
    names = changed.where(~is_hub(F.col("name"))).select(*scope, F.col("name").alias("ident"), F.col("card_id").alias("target")).distinct()
    return idents.select(*scope, "card_id", "ident").distinct().join(names, [*scope, "ident"]).where("card_id <> target").select(*scope, "card_id", "target")


def _members(df: DataFrame, group: str, scope: list[str]) -> DataFrame:
    return df.where(F.col(group).isNotNull() & (F.col(group) != "")).select(*scope, group, "card_id").distinct()


def group_links(df: DataFrame, group: str, scope: Scope = None) -> DataFrame:
    """Links that join the members of each group as all its pairs would: each member with the smallest one.

    A group of n members gives n - 1 links instead of n(n-1)/2 pairs; no two members come apart, and :func:`group_pairs`
    gives the pairs themselves where they are asked for.
    """
    scope = scope or []
    members = _members(df, group, scope)
    first = members.groupBy(*scope, group).agg(F.min("card_id").alias("first"))
    return canonical(members.join(first, [*scope, group]), "first", "card_id", scope)


def group_pairs(df: DataFrame, group: str, scope: Scope = None) -> DataFrame:
    """All pairs within each group; for groups that are small by nature (members of one type, symbols of one file)."""
    scope = scope or []
    m = _members(df, group, scope)
    both = m.select(*scope, group, F.col("card_id").alias("a")).join(m.select(*scope, group, F.col("card_id").alias("b")), [*scope, group])
    return both.where("a < b").select(*scope, "a", "b").distinct()


def _owned(changed: DataFrame, scope: list[str]) -> DataFrame:
    return changed.where(F.col("owner").isNotNull() & (F.col("owner") != "") & ~is_hub(F.col("owner"))).select(*scope, "card_id", "owner").distinct()


def same_owner(found: DataFrame, changed: DataFrame, scope: Scope = None) -> DataFrame:
    """Those of the pairs (a, b) whose ends share an owner, without the pairs of each owner being spelled out."""
    scope = scope or []
    left = _owned(changed, scope).select(*scope, F.col("card_id").alias("a"), "owner")
    right = _owned(changed, scope).select(*scope, F.col("card_id").alias("b"), "owner")
    return found.select(*scope, "a", "b").join(left, [*scope, "a"]).join(right, [*scope, "b", "owner"]).select(*scope, "a", "b").distinct()


def strong_pairs(changed: DataFrame, refs: DataFrame, all_pairs: bool = True, scope: Scope = None) -> DataFrame:
    scope = scope or []
    calls = canonical(resolve(refs.where("bucket = 'call' or bucket = 'impl' or (bucket = 'type' and in_header)"), changed, scope), "card_id", "target", scope)
    owned = _owned(changed, scope)
    siblings = (group_pairs if all_pairs else group_links)(owned, "owner", scope)
    types = changed.where("owner is null").select(*scope, F.col("name").alias("owner"), F.col("card_id").alias("target")).distinct()
    members = canonical(owned.join(types, [*scope, "owner"]), "card_id", "target", scope)
    return calls.unionByName(siblings).unionByName(members).distinct()


def weak_pairs(changed: DataFrame, refs: DataFrame, imports: DataFrame, all_pairs: bool = True, scope: Scope = None) -> DataFrame:
    scope = scope or []
    imported = canonical(resolve(imports, changed, scope), "card_id", "target", scope)
    inner = canonical(resolve(refs.where("bucket = 'type' and not in_header"), changed, scope), "card_id", "target", scope)
    return imported.unionByName(inner).unionByName((group_pairs if all_pairs else group_links)(changed, "path", scope)).distinct()


def pairs(changed: DataFrame, refs: DataFrame, imports: DataFrame, all_pairs: bool = True, scope: Scope = None) -> DataFrame:
    scope = scope or []
    strong = strong_pairs(changed, refs, all_pairs, scope)
    weak = weak_pairs(changed, refs, imports, all_pairs, scope).join(strong, [*scope, "a", "b"], "left_anti")
    if not all_pairs:
        weak = weak.join(same_owner(weak, changed, scope), [*scope, "a", "b"], "left_anti")
    return strong.withColumn("grade", F.lit("strong")).unionByName(weak.withColumn("grade", F.lit("weak")))


def pairs_within(all_pairs: DataFrame, members: DataFrame, scope: Scope = None) -> DataFrame:
    """Pairs with both ends in one seed: seed_id, a, b, grade; members: (seed_id, card_id)."""
    scope = scope or []
    left = members.select(*scope, "seed_id", F.col("card_id").alias("a"))
    right = members.select(*scope, F.col("seed_id").alias("__s"), F.col("card_id").alias("b"))
    return all_pairs.join(left, [*scope, "a"]).join(right, [*scope, "b"]).where("seed_id = __s").drop("__s")
