"""Mixing sources to target token shares by balanced sampling with the cube method.

From the tokens of each source and its cap on repeats follows the largest total T that all shares can be met at.  Source
s then needs ``share * T`` tokens: every document floor(need/has) times, and once more with the inclusion probability
need/has - floor.  The cube method turns these probabilities into a choice: in the flight phase, vectors of
probabilities are moved through the null space of the constraints (number of documents, number of tokens) until all but
two entries are 0 or 1; the landing phase settles the last two where the totals come out nearest, and exchanges one chosen
document where that comes nearer still.

A source is flown in blocks of at most ``block`` documents, each block by one task; the two documents that a block leaves
open go to the next round, so rounds number about log(n) to the base block/2 and no task or driver holds a source.

Defined results
* null and empty texts have no tokens: they keep their inclusion probability but count for no share;
* documents of sources without a target, and targets of sources without tokens, take no part (the latter are reported
  with an actual share of 0); null sources have no target;
* repeats are never above ``max_repeats`` (null counts as 1); equal documents under other keys are other documents;
* no documents or no targets give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftlens.llm.tokens import VOCABULARY, token_count
from riftlens.session import checkpointed

BLOCK = 4096
EPS = 1e-9


def fly(p: list[float], tokens: Sequence[float], rng: random.Random) -> list[int]:
    """Move ``p`` in place to 0 and 1, keeping sum(p) and sum(p * tokens); returns the at most two entries left open."""
    open_: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            open_.append(i)
        else:
            p[i] = float(p[i] > 0.5)
        while len(open_) == 3:
            a, b, c = open_
            u = (tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for j, d in zip(open_, u, strict=True):
                if d:
                    x, y = (1 - p[j]) / abs(d), p[j] / abs(d)
                    up, down = (min(up, x), min(down, y)) if d > 0 else (min(up, y), min(down, x))
            step = up if rng.random() * (up + down) < down else -down
            for j, d in zip(open_, u, strict=True):
                p[j] = min(1.0, max(0.0, p[j] + step * d))
            still = []
            for j in open_:
                if EPS < p[j] < 1 - EPS:
                    still.append(j)
                else:
                    p[j] = float(p[j] > 0.5)
            open_ = still
    return open_


def land(p: list[float], tokens: Sequence[float], open_: Sequence[int]) -> None:
    """Settle the open entries so that the token total comes nearest to its target; then the number of documents."""
    goal, number = sum(p[j] * tokens[j] for j in open_), sum(p[j] for j in open_)
    best = min(range(2 ** len(open_)), key=lambda m: (abs(sum(tokens[j] for k, j in enumerate(open_) if m >> k & 1) - goal), abs(m.bit_count() - number), m))
    for k, j in enumerate(open_):
        p[j] = float(best >> k & 1)


def swap(p: list[float], tokens: Sequence[float], among: Sequence[int], over: float) -> None:
    """Exchange one chosen for one unchosen entry where that brings the token total, ``over`` its target, nearest to it."""
    out = sorted((tokens[j], j) for j in among if p[j] == 0.0)
    best = (abs(over), -1, -1)
    for i in (j for j in among if p[j] == 1.0):
        k = bisect_left(out, (tokens[i] - over, -1))
        for t, j in out[max(0, k - 1) : k + 1]:
            best = min(best, (abs(over - tokens[i] + t), i, j))
    if best[1] >= 0:
        p[best[1]], p[best[2]] = 0.0, 1.0


def _round(level: int, seed: int, blocks: dict[str, int]):
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("__key", kind="stable", ignore_index=True)
        rng = random.Random(zlib.crc32(f"{seed}|{level}|{key}".encode()))
        p, tokens = block["p"].tolist(), block["tokens"].astype(float).tolist()
        goal, among = sum(a * b for a, b in zip(p, tokens, strict=True)), range(len(p))
        open_ = fly(p, tokens, rng)
        if blocks[key[0]] <= 1:
            land(p, tokens, open_)
            swap(p, tokens, among, sum(a * b for a, b in zip(p, tokens, strict=True)) - goal)
        return block.assign(p=p)

    return run


def source_totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


def plan(totals: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[int, float]]:
    """source -> (full repeats, inclusion probability of one more); totals: (docs, tokens), targets: (share, cap)."""
    live = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and totals.get(s, (0, 0))[1] > 0}
    if not live:
        return {}
    whole = min(cap * totals[s][1] / share for s, (share, cap) in live.items())
    out = {}
    for s, (share, cap) in live.items():
        ratio = min(float(cap), share * whole / totals[s][1])
        full = min(cap, math.floor(ratio + 1e-12))
        out[s] = (full, max(0.0, ratio - full))
    return out


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The chosen documents: key, source, tokens, repeats (at least 1)."""
    wanted = {r[0]: (float(r[1]), int(1 if r[2] is None else r[2])) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r[0] is not None and r[1] is not None}
    sized = docs.where(F.col("source").isin(list(wanted))).select(F.col(key).alias("__key"), "source", token_count(F.col(text), vocabulary).alias("tokens"))
    sized = checkpointed(sized)
    # one row per source of the target table
    totals = {r["source"]: (r["docs"], r["tokens"]) for r in source_totals(sized).collect()}
    share = plan(totals, wanted)
    per = F.create_map(*[x for s, (full, p) in share.items() for x in (F.lit(s), F.struct(F.lit(full).alias("full"), F.lit(p).alias("p")))]) if share else F.lit(None).cast("map<string,struct<full:int,p:double>>")
    state = sized.withColumn("__plan", per[F.col("source")]).where("__plan is not null").select("__key", "source", "tokens", F.col("__plan.full").alias("full"), F.col("__plan.p").alias("p"))
    settled = state.where((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS))
    state = state.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
    counts = {s: totals[s][0] for s, (_, p) in share.items() if EPS < p < 1 - EPS}
    level = 0
    while counts:
        blocks = {s: max(1, math.ceil(n / block)) for s, n in counts.items()}
        which = F.create_map(*[x for s, n in blocks.items() for x in (F.lit(s), F.lit(n))])[F.col("source")]
        cut = state.withColumn("__block", F.pmod(F.xxhash64("__key", F.lit(level)), which).cast("int"))
        schema = cut.schema
        flown = checkpointed(cut.groupBy("source", "__block").applyInPandas(_round(level, seed, blocks), schema).drop("__block"))
        settled = settled.unionByName(flown.where((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)))
        state = flown.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
        counts = {s: 2 * blocks[s] for s in counts if blocks[s] > 1}
        level += 1
    repeats = F.col("full") + F.round("p").cast("int")
    return settled.select(F.col("__key").alias(key), "source", "tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, max_repeats, documents and tokens drawn with repeats, and the actual share."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("repeats").alias("draws"), F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    total = got.agg(F.sum("drawn_tokens").alias("__all"))
    out = targets.select("source", "target_share", "max_repeats").distinct().join(got, "source", "left").join(F.broadcast(total))
    zero = F.lit(0).cast("long")
    return out.select("source", "target_share", "max_repeats", *(F.coalesce(c, zero).alias(c) for c in ("docs", "draws", "drawn_tokens", "most_repeats")), F.coalesce(F.col("drawn_tokens") / F.col("__all"), F.lit(0.0)).alias("actual_share"))
