"""Texts cut off by field limits or in transfer.

Three parts, each over all documents:

1. *Lengths.*  Per source and unit (characters, UTF-8 bytes) a right-censored length distribution is fitted by maximum
   likelihood: a hazard that is constant on geometric bins, whose estimate is ends over exposure.  Lengths at a candidate
   limit count as censored, not as ends.  Candidates are windows (one wide for exact limits, wider for limits that step
   back to a character or word end) that hold far more texts than the fit lets expect; candidates and fit are found in turn
   until they agree.  What the fit expects against what is there gives each length its censoring odds.
2. *Endings.*  Each ending has a class: a full stop, a recorded break (never a cut), an excerpt mark, an open bracket or quote, a
   stump (comma, hyphen, broken character), or words.  How often whole and cut texts end in each class is estimated from the
   documents by expectation maximisation, for whole texts per source (but for their broken endings, which are rare by
   definition); a cut falls on a full stop as often as full stops
   come in the texts for each character (a source that steps back to the end of a word cuts there more often; that is left
   out, in favour of whole texts).  For words the corpus tells how
   often the last word ends a text where it follows its two predecessors, and whether longer words that begin with it are
   usual there (a word cut in the middle); these counts leave the text itself out.
3. *Posterior.*  The prior odds of a cut at a limit are its censoring odds, drawn to the share of cut texts that its endings
   show (many whole endings at a window of lengths speak against a limit there); elsewhere they are the odds of a cut
   anywhere.  Times the likelihood ratio of the ending, above 1/2 the text is cut.  So an ordinary ending at a strong limit
   can be a cut, and a broken ending away from any limit as well.

Defined results
* null, empty and blank texts are not cut; null sources are one source;
* copies of a text do not count in its own statistics, so repeated deliveries do not vouch for each other, and get equal
  results;
* a text whose last words are a stage direction is judged by what stands before it; a recorded break (dash and stage
  direction) is complete;
* no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riftlens.session import checkpointed

#: Widths of the windows in which a limit can gather texts: exact, cut back to a character, cut back to a word and marked.
WIDTHS = (1, 4, 24)
#: A window is a limit when it holds this many times what is expected, and this many texts at least.
EXCESS, LEAST = 5.0, 8
#: Whole texts to one that is cut away from any limit, among those that end in words only.
WHOLE = 8.0
#: What stands in for documents where there are few: so many whole texts and so many cut ones that end in each class, and
#: cut and whole texts away from limits.
WHOLE_ENDS = {"stop": 20.0, "words": 1.0}
CUT_ENDS = {"stop": 0.1, "mark": 2.0, "open": 1.0, "stump": 1.0, "words": 6.0}
CUT_ANYWHERE = (1.0, 50.0)
#: Shares of broken endings among whole texts.  They are given: away from limits nothing else tells a whole text that ends
#: broken from a cut one.
BROKEN = {"mark": 0.00002, "open": 0.00002, "stump": 0.00002}
#: Weight, in documents, of all sources together in the likelihoods of one source.
SHARED = 200.0
LIMITS = "source string, unit string, lo long, hi long, odds double"

#: An excerpt mark has at most this many characters, white space within brackets aside.
_MARK = re.compile(r"(?:…|\.\.\.|\[…\]|\(…\)|[(\[](?i:more|continued|cont\.|mehr|weiter|fortsetzung folgt|suite|lire la suite|sigue|continúa|más)[)\]])$")
_CLOSERS = "\"'”“»’)]"
_PAIRED = re.compile(r"[()\[\]«»„“”]")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][\w’'-]*")


def fit(histogram: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Limits (lo, hi, censoring odds) of one source and unit from (length, texts)."""
    if not histogram:
        return []
    counts = dict(histogram)
    lengths = sorted(counts)
    total = sum(counts.values())
    at_risk, left = {}, total
    for n in lengths:
        at_risk[n] = left
        left -= counts[n]
    width = 1.25
    limits: list[tuple[int, int]] = []

    def hazard(limits: list[tuple[int, int]]):
        ends: Counter = Counter()
        exposure: Counter = Counter()
        before = 0
        for n in lengths:
            b = int(math.log(max(n, 1), width))
            here = at_risk[n]
            # texts of length n and more live through (before, n]; the gap is split over the bins that it crosses
            low = before
            while low < n:
                c = int(math.log(max(low + 1, 1), width))
                high = min(n, max(low + 1, int(width ** (c + 1))))
                exposure[c] += here * (high - low)
                low = high
            before = n
            if not any(lo <= n <= hi for lo, hi in limits):
                ends[b] += counts[n]
        # the estimate of an empty bin is drawn to the mean of the bins around it
        def rate(n: int) -> float:
            b = int(math.log(max(n, 1), width))
            near = [(ends[c], exposure[c]) for c in (b - 1, b, b + 1)]
            e, x = near[1]
            around = (sum(p for p, _ in near) + 0.5) / (sum(q for _, q in near) + 1.0)
            return (e + around * max(1.0, x * 0.1)) / (x + max(1.0, x * 0.1))

        return rate

    def expected(rate, lo: int, hi: int) -> float:
        i = bisect_left(lengths, lo)
        start = at_risk[lengths[i]] if i < len(lengths) else 0
        inside = sum(counts[n] for n in range(lo, hi + 1) if n in counts) if hi - lo < 64 else 0
        # those cut within the window are not at risk of ending by themselves there
        return max(start - inside / 2, 0.0) * rate(hi) * (hi - lo + 1)

    for _ in range(6):
        rate = hazard(limits)
        found: list[tuple[float, int, int]] = []
        for w in WIDTHS:
            running, first = 0, 0
            for i, n in enumerate(lengths):
                running += counts[n]
                while lengths[first] <= n - w:
                    running -= counts[lengths[first]]
                    first += 1
                if running < LEAST:
                    continue
                want = expected(rate, n - w + 1, n)
                if running >= EXCESS * want:
                    found.append((running * math.log(running / max(want, 1e-9)) - running + want - 3 * math.log(w), n - w + 1, n))
        # the best windows that do not touch each other, each the most likely among those it overlaps
        chosen: list[tuple[int, int]] = []
        for _, lo, hi in sorted(found, reverse=True):
            if all(hi < a - 64 or lo > b + 64 for a, b in chosen):
                chosen.append((lo, hi))
        if sorted(chosen) == limits:
            break
        limits = sorted(chosen)
    rate = hazard(limits)
    out = []
    for lo, hi in limits:
        held, want = sum(counts[n] for n in range(lo, hi + 1) if n in counts), expected(rate, lo, hi)
        if held >= max(LEAST, EXCESS * want):
            out.append((lo, hi, held / max(want, 1e-6) - 1))
    return out


def measured(docs: DataFrame, text: str, source: str) -> list[Column]:
    """source, length in both units and hash of a text."""
    return [F.col(source).alias("source"), F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("h")]


def limits(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Candidate limits per source and unit: source, unit, lo, hi, odds that a text of such a length was cut.

    Every length is counted exactly; a histogram has at most as many rows as a source has lengths.
    """
    return _limits(docs.where(F.length(text) > 0).select(measured(docs, text, source)))


def _limits(held: DataFrame) -> DataFrame:
    n = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n"))))
    # copies within a source count once; they meet by hash, and no text moves
    each = held.select("source", "chars", "bytes", "h").distinct().select("source", n.alias("x")).select("source", "x.*")
    counted = each.groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("texts"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit(list(zip(pdf["n"].tolist(), pdf["texts"].tolist(), strict=True)))
        head = pdf.iloc[0]
        return pd.DataFrame([(head["source"], head["unit"], *x) for x in found], columns=["source", "unit", "lo", "hi", "odds"])

    return counted.groupBy("source", "unit").applyInPandas(run, LIMITS)


class _Masks(dict):
    """Token -> the token with its digits and its name masked, filled as tokens come; emptied when it has grown large."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        out = self[token] = _NAME.sub("X", _DIGITS.sub("9", token))
        return out


_MASKS = _Masks()
#: A token without white space that is longer than this is as many words of this length as it has.
PIECE = 48
#: What may stand after a name that another name follows, so that both are one.
_JOINED = frozenset(("X", "X.", "X,", "X.,"))


def words(tokens: list[str]) -> list[str]:
    """Words of the tokens of a text: digits masked, runs of capitalised words as one, long tokens in pieces."""
    out: list[str] = []
    before = ""
    for w in map(_MASKS.__getitem__, tokens):
        if len(w) > PIECE:
            out += [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
        elif before in _JOINED and w[0] == "X":
            out[-1] = w
        else:
            out.append(w)
        before = w
    return out


def unclosed(text: str) -> bool:
    """Whether a bracket or a quote that was opened anywhere in the text is open at its end.

    Brackets nest; of quotes the last mark tells.  A “ closes where a „ is open and opens elsewhere.
    """
    depth, guillemet, low, high = 0, False, False, False
    for c in _PAIRED.findall(text):
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c in "«»":
            guillemet = c == "«"
        elif c == "„":
            low = True
        elif c == "“" and not low:
            high = True
        else:
            low = high = False
    return depth > 0 or guillemet or low or high


def ending(text: str | None) -> tuple[str, str, str, str]:
    """(class of the ending, among them blank and break which are never cut, and for words the two words before the last, the last)."""
    body = (text or "").rstrip()
    if not body:
        return "blank", "", "", ""
    inner = body[:-1].rstrip() if body[-1] in ")]" else ""
    if _MARK.search(body[-32:]) or inner.endswith(("...", "…")) and inner.rstrip(".…").rstrip().endswith(("(", "[")):
        return "mark", "", "", ""
    tail, aside = body, False
    while tail and tail[-1] in ")]":
        start = max(tail.rfind("("), tail.rfind("["))
        if start < 0 or max(tail.rfind(")", 0, -1), tail.rfind("]", 0, -1)) > start:
            break
        tail, aside = tail[:start].rstrip(), True
    if not tail:
        return "blank", "", "", ""
    if unclosed(tail):
        return "open", "", "", ""
    if aside and tail[-1] in "–—-":
        return "break", "", "", ""
    if tail.rstrip(_CLOSERS)[-1:] in {".", "!", "?"} or tail[-1] in "”“»’" and tail.rstrip(_CLOSERS + " ")[-1:] in {".", "!", "?"}:
        return "stop", "", "", ""
    if tail[-1] in ",;:–—-/&\ufffd":
        return "stump", "", "", ""
    # tokens are taken from the end until three words stand there that do not go on before them
    n = 8
    while len(rest := tail.rsplit(None, n)) > n and len(words(rest[1:])) < 4:
        n *= 4
    last = words(rest[1:] if len(rest) > n else rest)[-3:]
    return "words", *["^"] * (3 - len(last)), *last


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: Counter = Counter()
        for text in batch["text"]:
            w = ["^", "^", *words(text.split())]
            seen.update(zip(w, w[1:], w[2:]))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["before", "last", "word", "n"])


def _end_counts(ends: DataFrame, used: DataFrame, context: list[str], tag: str) -> DataFrame:
    """Of each open ending: texts that end so, uses of the words, uses with a longer last word; the columns carry ``tag``.

    Words of a context meet endings by (context, beginning of the word), so that a context that half of all texts share
    is spread over as many keys as its words have beginnings.  Contexts without an open ending are left out before.
    """
    e = ends.groupBy(*context, "word").agg(F.sum("ends").alias("ends"))
    u = used.groupBy(*context, "word").agg(F.sum("n").alias("n")).join(e.select(*context).distinct(), context, "left_semi")
    size = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("size")
    begun = u.where("length(word) > 0").select(*context, "word", "n", size)
    # a mark after the word, where it is usual, tells as much as more letters
    on = F.substring("word", F.col("size") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}.,;:!?'’]")
    whole = F.sum(F.when(F.col("size") == F.length("word"), F.col("n")).otherwise(0))
    longer = F.sum(F.when(on, F.col("n")).otherwise(0))
    seen = begun.groupBy(*context, F.substring("word", F.lit(1), F.col("size")).alias("word")).agg(whole.alias("n"), longer.alias("longer"))
    both = e.join(seen, [*context, "word"], "left").fillna(0, ["n", "longer"])
    return both.select(*(F.col(c).alias(f"{c}{tag}") for c in context), F.col("word").alias(f"word{tag}"), F.col("ends").alias(f"ends{tag}"), F.greatest("n", "ends").alias(f"n{tag}"), F.col("longer").alias(f"longer{tag}"))


def word_counts(texts: DataFrame) -> DataFrame:
    """before, last, word, n over the column text.  Texts are read where they lie, once; only counts of words move."""
    return texts.select("text").mapInPandas(_counts, "before string, last string, word string, n long").groupBy("before", "last", "word").agg(F.sum("n").alias("n"))


def end_counts(used: DataFrame, open_ends: DataFrame) -> DataFrame:
    """before, last, word -> texts that end so, uses, uses with a longer last word; after two words (3) and after one (2).

    ``used`` are the word counts, ``open_ends`` has before, last, word of each text with an open ending.
    """
    ends = open_ends.groupBy("before", "last", "word").agg(F.count(F.lit(1)).alias("ends"))
    three = _end_counts(ends, used, ["before", "last"], "3")
    two = _end_counts(ends, used, ["last"], "2")
    both = three.join(two, (F.col("last3") == F.col("last2")) & (F.col("word3") == F.col("word2")))
    return both.select(F.col("before3").alias("before"), F.col("last3").alias("last"), F.col("word3").alias("word"), "ends3", "n3", "longer3", "ends2", "n2", "longer2")


def natural_rate(copies: Column) -> Column:
    """How far an open ending is that of a whole text; the text itself and its copies do not count.

    The estimate from two preceding words backs off to that from one; the more natural of the two holds.
    """
    less = lambda c: F.greatest(F.col(c) - copies, F.lit(0))
    back = (less("ends2") + 0.1) / (less("n2") + F.col("longer2") + 1.0)
    rate = (less("ends3") + back) / (less("n3") + F.col("longer3") + 1.0)
    rate = F.greatest(F.lit(0.001), F.least(F.lit(0.99), F.greatest(rate, back)))
    return rate * WHOLE / (1 + rate * (WHOLE - 1))


def likelihoods(rows: list[tuple[str, float, float, float]], stops: float, rounds: int = 60) -> tuple[dict[str, float], dict[str, float], float]:
    """(share of each ending among whole texts, among cut texts, odds of a cut away from limits), by expectation maximisation.

    ``rows`` are (class, censoring odds, texts, how many of them are cut for their words); the last is used for words only.
    ``stops`` is the share of cuts that fall on a full stop.
    """

    def shares(ends: dict[str, float], fixed: dict[str, float]) -> dict[str, float]:
        total = sum(v for k, v in ends.items() if k not in fixed)
        return {k: v / total * (1 - sum(fixed.values())) for k, v in ends.items()} | fixed

    whole, cut, anywhere = shares(WHOLE_ENDS, BROKEN), shares(CUT_ENDS, {"stop": stops}), CUT_ANYWHERE[0] / CUT_ANYWHERE[1]
    for _ in range(rounds):
        w, c, away = WHOLE_ENDS | dict.fromkeys(BROKEN, 0.0), dict(CUT_ENDS), [*CUT_ANYWHERE]
        for kind, odds, n, by_words in rows:
            ratio = (odds + anywhere) * cut[kind] / whole[kind]
            gone = by_words if kind == "words" else n * ratio / (1 + ratio)
            w[kind] += n - gone
            c[kind] += gone
            if odds <= 0:
                away[0] += gone
                away[1] += n - gone
        whole, cut, anywhere = shares(w, BROKEN), shares(c, {"stop": stops}), away[0] / away[1]
    return whole, cut, anywhere


def at_limit(rows: list[tuple[str, float, float]], odds: float, whole: dict[str, float], cut: dict[str, float], rounds: int = 60) -> tuple[float, float]:
    """(odds of a cut at one limit, share of the cut texts there that carry an excerpt mark) from (class, texts, cut for their words).

    A source that marks its excerpts leaves no bare ends: where all broken endings of a limit are marked, a full stop is whole.
    """
    prior = odds / (1 + odds)
    share, marked = prior, 0.5
    bare = {k: v / (1 - cut["mark"]) for k, v in cut.items() if k != "mark"}
    for _ in range(rounds):
        gone = {}
        for kind, n, by_words in rows:
            c = marked if kind == "mark" else (1 - marked) * bare[kind]
            p = share * c / (share * c + (1 - share) * whole[kind])
            gone[kind] = by_words if kind == "words" else n * p
        total = sum(gone.values())
        share = (total + prior) / (sum(n for _, n, _ in rows) + 1)
        marked = (gone.get("mark", 0.0) + 0.05) / (total + 0.1)
    return share / (1 - share), marked


def posteriors(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, censoring odds of the length, share of natural ends among such endings, posterior that the text was cut."""

    @pandas_udf("struct<kind:string,before:string,last:string,word:string>")
    def end_of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ending(t) for t in texts], columns=["kind", "before", "last", "word"])

    held = docs.where(F.length(F.col(text)) > 0)
    slim = held.select(F.col(key).alias("__key"), *measured(docs, text, source), end_of(text).alias("e"))
    # a few short columns of each text; kept, as several steps start from them
    slim = checkpointed(slim.select("__key", "source", "chars", "bytes", "h", "e.*"))
    open_ends = slim.where("kind = 'words'")
    used = checkpointed(word_counts(held.select(F.col(text).alias("text"))))
    counts = end_counts(used, open_ends)
    copies = open_ends.groupBy("h", "chars").agg(F.count(F.lit(1)).alias("copies"))
    known = open_ends.join(copies, ["h", "chars"]).join(counts, ["before", "last", "word"], "left")
    rated = known.withColumn("natural", F.coalesce(natural_rate(F.col("copies")), F.lit(0.1)))
    columns = ["__key", "source", "chars", "bytes", "h", "kind"]
    every = slim.where("kind <> 'words'").select(*columns, F.lit(None).cast("double").alias("natural")).unionByName(rated.select(*columns, "natural"))
    # a source has a handful of limits; they are gathered into one row per source
    per = _limits(slim).groupBy("source").agg(F.collect_list(F.struct("odds", "unit", "lo", "hi")).alias("limits")).withColumnRenamed("source", "s")
    here = F.filter("limits", lambda x: F.when(x["unit"] == "chars", F.col("chars").between(x["lo"], x["hi"])).otherwise(F.col("bytes").between(x["lo"], x["hi"])))
    judged = every.join(per, every["source"].eqNullSafe(per["s"]), "left").withColumn("limit", F.array_max(here)).drop("limits", "s")
    judged = judged.withColumn("odds", F.coalesce("limit.odds", F.lit(0.0)))
    ratio = (1 - F.col("natural")) / F.greatest("natural", F.lit(1e-9)) * (1 + F.col("odds"))
    judged = checkpointed(judged.withColumn("by_words", ratio / (1 + ratio)))
    once = judged.where("kind not in ('blank', 'break')").groupBy("source", "h", "chars").agg(*(F.first(c).alias(c) for c in ("kind", "odds", "by_words", "limit")))
    cut_words = F.coalesce(F.sum("by_words"), F.lit(0.0)).alias("cut")
    # classes by powers of the odds: a table whose size does not depend on the documents
    level = F.round(F.log2(1 + F.col("odds")) * 2)
    table = once.groupBy("kind", level.alias("level")).agg(F.avg("odds").alias("odds"), F.count(F.lit(1)).alias("n"), cut_words)
    # of all characters, how many are the last of a word with a full stop
    at_stop = F.col("word").rlike(r"[.!?]['”“»’)\]\x22]*$")
    places = used.agg(F.sum(F.col("n") * (F.length("word") + 1)), F.sum(F.when(at_stop, F.col("n")))).first()
    stops = ((places[1] or 0) + 0.1) / ((places[0] or 0) + 10.0)
    whole, cut, anywhere = likelihoods([(r.kind, r.odds, float(r.n), r.cut) for r in table.orderBy("kind", "level").collect()], stops)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        found = at_limit(list(zip(pdf["kind"], pdf["n"].astype(float), pdf["cut"], strict=True)), first["odds"], whole, cut)
        return pd.DataFrame([(first["source"], first["unit"], first["lo"], *found)], columns=["source", "unit", "lo", "at", "marked"])

    seen = once.where("odds > 0").groupBy("source", "limit", "kind").agg(F.count(F.lit(1)).alias("n"), cut_words).select("source", "limit.*", "kind", "n", "cut")
    windows = seen.groupBy("source", "unit", "lo").applyInPandas(weigh, "source string, unit string, lo long, at double, marked double")
    windows = windows.groupBy("source").agg(F.collect_list(F.struct("unit", "lo", "at", "marked")).alias("windows")).withColumnRenamed("source", "s")
    one = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))[F.col("kind")]
    ratio = (F.col("odds") + F.lit(anywhere)) * one(cut) / one(whole)
    left = F.when(F.col("kind") == "words", 1 - F.col("by_words")).otherwise(1 / (1 + ratio))
    own = once.withColumn("left", left).groupBy("source", "kind").agg(F.sum("left").alias("left")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("kind", "left"))).alias("ends"), F.sum("left").alias("all")).withColumnRenamed("source", "o")
    share = (SHARED * one(whole) + F.coalesce(F.try_element_at("ends", F.col("kind")), F.lit(0.0))) / (SHARED + F.coalesce("all", F.lit(0.0)))
    share = F.when(F.col("kind").isin(*BROKEN), one(whole)).otherwise(share)
    out = judged.join(own, judged["source"].eqNullSafe(own["o"]), "left").join(windows, judged["source"].eqNullSafe(windows["s"]), "left")
    out = out.withColumn("w", F.try_element_at(F.filter("windows", lambda x: (x["unit"] == F.col("limit.unit")) & (x["lo"] == F.col("limit.lo"))), F.lit(1)))
    bare = one({k: v / (1 - cut["mark"]) for k, v in cut.items()})
    here = F.when(F.col("kind") == "mark", F.col("w.marked")).otherwise((1 - F.col("w.marked")) * bare)
    away = F.lit(anywhere) * one(cut) / share
    odds = F.when(F.col("w").isNotNull(), F.greatest(F.col("w.at") * here / share, away)).otherwise(away)
    posterior = F.when(F.col("kind").isin("blank", "break"), 0.0).when(F.col("kind") == "words", F.col("by_words")).otherwise(odds / (1 + odds))
    natural = F.when(F.col("kind").isin("blank", "break"), 1.0).when(F.col("kind") == "words", F.col("natural")).otherwise(1 / (1 + away))
    return out.select(F.col("__key").alias(key), "source", "odds", natural.alias("natural"), posterior.alias("posterior"))


def truncated(docs: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    return posteriors(docs, key, **columns).where("posterior > 0.5").select(key).distinct()


def rates(docs: DataFrame) -> DataFrame:
    """Per source: documents, cut documents, their share."""
    cut = posteriors(docs).groupBy("source").agg(F.count_if(F.col("posterior") > 0.5).alias("cut"))
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    out = total.join(cut.withColumnRenamed("source", "s"), total["source"].eqNullSafe(F.col("s")), "left")
    return out.select("source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("documents")).alias("rate"))
