"""Filling containers of fixed capacity: harmonic packing with topped-up bins.

Lengths are parted into reciprocal-capacity classes: class k holds the lengths in (C/(k+1), C/k], and a bin opened for
class k takes exactly k documents of that class.  What a bin leaves free is topped up with documents of higher classes
whose length fits, again in a fixed number per bin.  A *plan* says how many bins have which content; it is made from the
histogram of lengths, which has at most ``capacity`` rows however many documents there are.  Each document then finds
its bin by its rank among the documents of its length: no worker needs to know what another one packs.

Plain harmonic packing leaves up to C/(k+1) of each bin of class k unused, which is a quarter of all space for short
containers; the topping up is what brings that below one per cent.

Defined results
* a text longer than the capacity is cut into pieces of exactly ``capacity`` tokens, each alone in a container, and a
  rest, which is packed like any document; no other text is cut;
* null and empty texts have no tokens, take one token of room and hold their place like any other;
* equal lengths are told apart by ``key`` and piece, so the result does not depend on the partitioning;
* no documents or no specifications give no rows; a null name, or a capacity of null or below 1, is left out; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftlens.llm.tokens import VOCABULARY, token_count
from riftlens.session import checkpointed, salted_rank

PLAN = "spec_name string, size int, rank_from long, rank_to long, per_bin long, bin_from long, slot_from int, at_from int"

#: A plan of at most so many rows (some 40 bytes each) is sent to all workers; a longer one is joined.
BROADCAST_PLAN = 200_000


def harmonic_plan(spec: str, capacity: int, histogram: dict[int, int]) -> Iterable[tuple]:
    """Rows of PLAN: documents of ``size`` with ranks from ``rank_from`` up to before ``rank_to`` go, ``per_bin`` at a time, into the bins from ``bin_from`` on.

    Work and rows follow the number of distinct lengths, not the number of documents.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    used = dict.fromkeys(sizes, 0)
    bins = 0
    while sizes:
        largest = sizes[-1]
        k = capacity // largest
        # the fixed count of class k, from the largest length downwards within the class
        content: dict[int, int] = {}
        room, wanted, at = capacity, k, len(sizes) - 1
        while wanted and at >= 0 and capacity // sizes[at] == k:
            take = min(wanted, left[sizes[at]], room // sizes[at])
            if take:
                content[sizes[at]] = take
                room -= take * sizes[at]
                wanted -= take
            at -= 1
        # the rest of the bin, largest fitting length first
        at = bisect_right(sizes, room) - 1
        while room and at >= 0:
            size = sizes[at]
            take = min(room // size, left[size] - content.get(size, 0))
            if take > 0:
                content[size] = content.get(size, 0) + take
                room -= take * size
            at = min(at - 1, bisect_right(sizes, room) - 1)
        times = min(left[s] // n for s, n in content.items())
        slot = begin = 0
        for size, n in sorted(content.items(), reverse=True):
            yield spec, size, used[size], used[size] + n * times, n, bins, slot, begin
            used[size] += n * times
            left[size] -= n * times
            slot += n
            begin += n * size
        bins += times
        sizes = [s for s in sizes if left[s]] if any(not left[s] for s in content) else sizes


def pack(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document piece and specification: spec_name, container_id, place, key, piece, token_from, n_tokens.

    ``place`` counts from 0 within the container, ``token_from`` is the piece's first token within its document.
    """
    # two short columns; kept, as the text would be counted again for each step below
    sized = checkpointed(docs.select(F.col(key), token_count(F.col(text), vocabulary).alias("__tokens")))
    # the specifications are few (one row per kind of container); each document meets each of them
    spec_rows = [(r[0], int(r[1])) for r in specs.select("spec_name", "capacity_tokens").distinct().collect() if r[0] is not None and r[1] is not None and r[1] >= 1]
    spark = docs.sparkSession
    columns = ["spec_name", "container_id", "place", key, "piece", "token_from", "n_tokens"]
    spec_array = F.array(*[F.struct(F.lit(n).alias("spec_name"), F.lit(c).cast("long").alias("capacity")) for n, c in spec_rows]) if spec_rows else F.from_json(F.lit("[]"), "array<struct<spec_name:string,capacity:long>>")
    each = sized.withColumn("__spec", F.explode(spec_array)).select(key, "__tokens", "__spec.*")
    full = F.floor((F.col("__tokens") / F.col("capacity"))).cast("long")
    each = each.withColumn("__full", F.when(F.col("__tokens") > F.col("capacity"), full).otherwise(F.lit(0).cast("long")))
    rest = F.col("__tokens") - F.col("__full") * F.col("capacity")
    whole = each.where("__full > 0").select("spec_name", key, "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full") - 1)).alias("__piece"))
    whole = whole.select(
        "spec_name", F.concat_ws(":", "spec_name", F.lit("full"), F.col(key).cast("string"), F.col("__piece").cast("string")).alias("container_id"), F.lit(0).alias("place"), key, F.col("__piece").cast("int").alias("piece"), (F.col("__piece") * F.col("capacity")).alias("token_from"), F.col("capacity").alias("n_tokens")
    )
    items = each.where((rest > 0) | (F.col("__full") == 0)).select("spec_name", key, F.col("__full").cast("int").alias("piece"), (F.col("__full") * F.col("capacity")).alias("token_from"), rest.alias("n_tokens"), F.greatest(rest, F.lit(1)).cast("int").alias("size"))
    # bounded by the sum of the capacities
    counts: dict[str, dict[int, int]] = {}
    for r in items.groupBy("spec_name", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["spec_name"], {})[r["size"]] = r["n"]
    plan_rows = [row for name, capacity in spec_rows for row in harmonic_plan(name, capacity, counts.get(name, {}))]
    ranked = salted_rank(items, ["spec_name", "size"], [key, "piece"], "__rank")
    # one row for each length, so a document meets one row and looks up the range that its rank lies in
    part = F.struct("rank_from", "rank_to", "per_bin", "bin_from", "slot_from")
    plan = spark.createDataFrame(plan_rows, PLAN).groupBy("spec_name", "size").agg(F.collect_list(part).alias("__parts"))
    found = F.filter("__parts", lambda x: (F.col("__rank") >= x["rank_from"]) & (F.col("__rank") < x["rank_to"]))
    placed = ranked.join(F.broadcast(plan) if len(plan_rows) <= BROADCAST_PLAN else plan, ["spec_name", "size"]).withColumn("__part", F.element_at(found, 1)).select("*", "__part.*")
    into = F.col("__rank") - F.col("rank_from")
    placed = placed.select(
        "spec_name",
        F.concat_ws(":", "spec_name", (F.col("bin_from") + F.floor(into / F.col("per_bin"))).cast("string")).alias("container_id"),
        (F.col("slot_from") + into % F.col("per_bin")).cast("int").alias("place"),
        key, "piece", "token_from", "n_tokens",
    )
    return placed.unionByName(whole).select(*columns)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per specification: containers, pieces, tokens and the share of the room that is used."""
    per_bin = packed.groupBy("spec_name", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    per_spec = per_bin.groupBy("spec_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    out = per_spec.join(specs.select("spec_name", "capacity_tokens").distinct(), "spec_name")
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
