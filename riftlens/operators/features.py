"""Features of each seed, gathered from its members, pairs and signals.

Members: (seed_id, pos, card_id); cards: (card_id, path, symbol, kind, change_type, seq); changed: (card_id, name, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftlens.functions import rules as R
from riftlens.session import grouped_rank

# fixed values: kinds of clusters
KINDS = ("flow", "contract", "domain-concept", "shared-foundation", "infra")


def described(members: DataFrame, cards: DataFrame, changed: DataFrame) -> DataFrame:
    """Members with name (changed symbol before card symbol before id), path, kind and change type; the last writer of a card holds."""
    c = cards.groupBy("card_id").agg(F.max_by(F.struct("path", "symbol", "kind", "change_type"), F.col("seq")).alias("c")).select("card_id", "c.*")
    s = changed.groupBy("card_id").agg(F.max_by("name", "seq").alias("changed_name"))
    out = members.join(c, "card_id", "left").join(s, "card_id", "left")
    return out.select("seed_id", "pos", "card_id", F.coalesce("changed_name", "symbol", "card_id").alias("name"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("kind", F.lit("file")).alias("kind"), F.coalesce("change_type", F.lit("modified")).alias("change_type"))


def seed_features(members: DataFrame, strong: DataFrame) -> DataFrame:
    """Per seed: ordered symbols, entry points, contracts, counts, and the guessed kind.

    ``members`` as :func:`described`; ``strong`` has seed_id of every seed that holds a strong pair.
    """
    entry = R.entry_point(F.col("path"), F.col("name"))
    contract = R.contract_candidate(F.col("path"), F.col("name"), F.col("kind"))
    is_contract = (F.lower("kind") == "dto") | R.contract_name(F.col("name"))
    added_type = F.lower("kind").isin("type", "class", "interface") & (F.col("change_type") == "added")
    got = members.groupBy("seed_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("symbols"),
        F.array_sort(F.collect_set(entry)).alias("entrypoints"), F.array_sort(F.collect_set(contract)).alias("contracts"),
        F.count(F.lit(1)).alias("n"), F.count_if(is_contract).alias("contract_n"), F.bool_or(F.lower("kind").isin("config", "migration")).alias("infra"), F.bool_or(added_type).alias("added_type"),
    )
    flow = strong.select("seed_id").distinct().withColumn("has_strong", F.lit(True))
    joined = got.join(flow, "seed_id", "left")
    kind = (
        F.when((F.col("contract_n") * 2 >= F.col("n")) & (F.col("contract_n") > 0), "contract").when(F.col("infra"), "infra")
        .when((F.size("entrypoints") > 0) & F.coalesce("has_strong", F.lit(False)), "flow").when(F.col("added_type"), "domain-concept").otherwise("shared-foundation")
    )
    return joined.select("seed_id", "symbols", "entrypoints", "contracts", "n", kind.alias("kind"))


def file_seeds(cards: DataFrame, seeded: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Cards in no seed become seeds of their own, numbered from 1 in card order: seed_id, card_id, type_hint."""
    scope = scope or []
    rest = cards.join(seeded.select(*scope, "card_id").distinct(), [*scope, "card_id"], "left_anti")
    ranked = grouped_rank(rest, scope, [F.col("seq"), F.col("card_id")], "n")
    return ranked.select(*scope, F.concat(F.lit("file-seed-"), F.col("n") + 1).alias("seed_id"), "card_id", R.file_type_hint(F.col("path")).alias("type_hint"))


def all_seeds(seeded: DataFrame, cards: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Members of symbol seeds and the file seeds of all other cards: scope, seed_id, card_id, type_hint (null for symbol seeds)."""
    files = file_seeds(cards, seeded, scope)
    return seeded.select(*(scope or []), "seed_id", "card_id").unionByName(files, allowMissingColumns=True)


def seed_records(features: DataFrame, members: DataFrame, pairs: DataFrame, tests: DataFrame, deleted: DataFrame, renamed: DataFrame, resigned: DataFrame) -> DataFrame:
    """The whole record of each seed: its features, related tests, signals of its files, and strong and weak pairs within it.

    ``members`` has seed_id, card_id, path; ``pairs`` seed_id, a, b, grade; ``tests`` card_id, name of test symbols; ``deleted``
    path, name; ``renamed`` path, from_name, to_name; ``resigned`` path, name, before, after.  Lists are sorted; a seed without
    any has an empty one.
    """
    here = members.select("seed_id", "card_id", "path").distinct()
    paths = here.select("seed_id", "path").distinct()

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        one = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
        return rows.groupBy("seed_id").agg(F.array_sort(F.collect_set(one)).alias(name))

    out = features
    for part in (
        listed(here.join(tests, "card_id"), "related_tests", "name"), listed(paths.join(deleted, "path"), "deleted_symbols", "path", "name"), listed(paths.join(renamed, "path"), "renames", "path", "from_name", "to_name"),
        listed(paths.join(resigned, "path"), "signature_changes", "path", "name", "before", "after"), listed(pairs.where("grade = 'strong'"), "strong_hints", "a", "b"), listed(pairs.where("grade = 'weak'"), "weak_hints", "a", "b"),
    ):
        name = part.columns[-1]
        out = out.join(part, "seed_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def attach_deleted(deleted: DataFrame, members: DataFrame) -> DataFrame:
    """(seed_id, path, name): deleted symbols go to each seed that holds their path."""
    return deleted.join(members.select("seed_id", "path").distinct(), "path").select("seed_id", "path", "name").distinct()
