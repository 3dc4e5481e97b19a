"""The whole flow from change records to a layered layout, as one lazily built graph of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftlens.functions import rules as R
from riftlens.functions import text as X
from riftlens.operators import cards as cards_ops
from riftlens.operators import components, features, intervals, layout, relations
from riftlens.session import checkpointed
from riftlens.sources import declarations


@dataclass
class Review:
    cards: DataFrame
    changed: DataFrame
    pairs: DataFrame
    seeds: DataFrame
    layout: DataFrame


#: Card ids are paths, so all that goes by cards goes by the review as well.
SCOPE = ["repo_path", "review_id"]


def usable(files: DataFrame) -> DataFrame:
    """Files that may have relations: modified text."""
    return files.where("status = 'Modified' and not is_binary")


def changed_table(files: DataFrame, lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Changed symbols of modified text files: repo_path, review_id, file_id, card_id, sym_idx, name, owner, path, is_test."""
    parsed = declarations.parsed(usable(files)) if parsed is None else parsed
    syms = declarations.symbols_of(parsed)
    hit = cards_ops.changed_symbols(intervals.attribute_lines(lines, syms, ["file_id"]), syms, ["file_id"])
    at = usable(files).select(*SCOPE, "file_id", F.col("new_path").alias("path")).distinct()
    return hit.join(at, "file_id").select(*SCOPE, "file_id", X.card_id(F.col("path")).alias("card_id"), "sym_idx", "name", "owner", "path", R.is_test_symbol(X.language(F.col("path")), F.col("path"), F.col("name")).alias("is_test"))


def referred(changed: DataFrame, parsed: DataFrame) -> DataFrame:
    """The references of changed symbols, by their cards."""
    refs = declarations.references_of(parsed).join(changed.select(*SCOPE, "file_id", "sym_idx", "card_id"), ["file_id", "sym_idx"])
    return refs.select(*SCOPE, "card_id", "bucket", "ident", "in_header").distinct()


def imported(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The names that the files of changed symbols import, by their cards."""
    names = X.imported_names(X.language(F.col("new_path")), F.col("new_source"))
    every = files.select(*SCOPE, X.card_id(F.col("new_path")).alias("card_id"), F.explode(names).alias("ident"))
    return every.join(changed.select(*SCOPE, "card_id").distinct(), [*SCOPE, "card_id"], "left_semi")


def relation_pairs(files: DataFrame, changed: DataFrame, parsed: DataFrame, all_pairs: bool = True) -> DataFrame:
    """Strong and weak pairs of the changed symbols' cards of each review; without ``all_pairs``, links that join the same cards."""
    return relations.pairs(changed, checkpointed(referred(changed, parsed)), imported(files, changed), all_pairs, SCOPE)


def seeded(files: DataFrame, cards: DataFrame, changed: DataFrame, links: DataFrame) -> DataFrame:
    """Seeds of each review: components of its changed symbols' cards, and every other card by itself; repo_path, review_id, seed_id, card_id, name, type_hint."""
    named = components.seeds(changed.select(*SCOPE, F.col("card_id").alias("id")), links, SCOPE).withColumnRenamed("id", "card_id")
    order = files.groupBy("file_id").agg(*(F.first(c).alias(c) for c in (*SCOPE, "file_seq", "new_path")))
    every = cards.select("file_id", "card_id").join(order, "file_id").groupBy(*SCOPE, "card_id").agg(F.min("file_seq").alias("seq"), F.first("new_path").alias("path"))
    found = features.all_seeds(named, every, SCOPE)
    names = changed.groupBy(*SCOPE, "card_id").agg(F.max_by("name", "sym_idx").alias("__name"))
    joined = found.join(names, [*SCOPE, "card_id"], "left")
    # a card without a changed symbol goes by its file's name
    return joined.select(*SCOPE, "seed_id", "card_id", F.coalesce("__name", F.regexp_replace("card_id", "::__file$", "")).alias("name"), "type_hint")


def review(files: DataFrame, lines: DataFrame) -> Review:
    """Everything about the reviews in the tables, each by itself; each source is scanned once."""
    lines = cards_ops.distinct_lines(lines)
    parsed = checkpointed(declarations.parsed(usable(files)))
    changed = checkpointed(changed_table(files, lines, parsed))
    refs = checkpointed(referred(changed, parsed))
    links = relations.strong_pairs(changed, refs, False, SCOPE)
    cards = cards_ops.cards(files, lines)
    seeds = checkpointed(seeded(files, cards, changed, links))
    return Review(cards, changed, relations.pairs(changed, refs, imported(files, changed), scope=SCOPE), seeds, layout.layered(seeds, SCOPE))
