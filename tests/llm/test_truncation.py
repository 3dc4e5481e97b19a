import random

import pytest

from riftlens.llm import truncation as T

NAMES = ["committee", "rapporteur", "coalition", "auditor", "district"]
THINGS = ["harbour dues", "grain reserve", "land register", "bus subsidy", "night train"]


def speech(rng, n):
    return " ".join(f"The {rng.choice(NAMES)} {rng.choice(['has examined', 'will support', 'must explain'])} the {rng.choice(THINGS)} before the summer recess." for _ in range(n))


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        source = rng.choice(["chars", "bytes", "digest", "free", "free"])
        t = speech(rng, max(1, int(rng.lognormvariate(1.6, 0.8))))
        full = t
        if source == "chars":
            t = t[:600]
        elif source == "bytes":
            t = t.replace("The", "Thé")
            full = t
            t = t.encode()[:500].decode("utf-8", "ignore")
        elif source == "digest" and len(t) > 400:
            t = t[:400].rsplit(" ", 1)[0] + rng.choice([" [...]", "…", " (more)"])
        elif source == "free" and rng.random() < 0.08 and len(t) > 80:
            t = t[: rng.randrange(30, len(t) - 20)]
        if rng.random() < 0.2:
            extra = rng.choice(["\n(Laughter)", "\n— Handed in at the table by Deputy Rosmer", " Ayes: 12 Noes: 7", " Motion withdrawn"])
            if t == full:
                t = full = t + extra
        rows.append((i, t, source))
        if t != full and not full.startswith(t + "\n"):
            stops = t.rstrip().endswith((".", ")"))
            if not stops or source == "digest":
                cut.add(i)
    return rows, cut


def test_cut_texts_are_found(spark):
    rows, cut = corpus()
    rows.append((5000, "The rapporteur has examined –\n(The Chair withdraws the floor.)", "free"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r[0] for r in T.truncated(df).collect()}
    assert len(got & cut) / len(cut) >= 0.95
    assert len(got & cut) / len(got) >= 0.95
    assert 5000 not in got
    rates = {r.source: r for r in T.rates(df).collect()}
    assert rates["digest"].rate > rates["free"].rate and sum(r.documents for r in rates.values()) == len(rows)


def test_limits_are_found():
    rng = random.Random(2)
    body = [int(rng.lognormvariate(6, 0.9)) for _ in range(3000)]
    cut = [min(n, 1200) for n in body]
    hist = sorted({n: cut.count(n) for n in cut}.items())
    assert any(lo <= 1200 <= hi for lo, hi, _ in T.fit(hist))
    assert not any(hi < 1100 for _, hi, _ in T.fit(hist))
    assert T.fit(sorted({n: body.count(n) for n in body}.items())) == []
    assert T.fit([]) == [] and T.fit([(0, 5)]) == []


@pytest.mark.parametrize(
    "text, kind",
    [
        (None, "blank"), ("", "blank"), ("  \n", "blank"), ("It is so.", "stop"), ("Is it so?", "stop"), ("He said “so.”", "stop"), ("Il dit « oui. »", "stop"), ("So it goes. (Laughter)\n[Noise]", "stop"), ("So it goes. (" + "Noise " * 1000 + ")", "stop"),
        ("The end –\n(The Chair withdraws the floor.)", "break"), ("(Laughter)", "blank"), ("It is so, and", "words"), ("It is so,", "stump"), ("It goes on …", "mark"), ("It goes [...]", "mark"), ("It goes [ " + " " * 90 + "... ]", "mark"), ("It goes (more)", "mark"),
        ("It is (Laugh", "open"), ("He said “so", "open"), ("the Regieru-", "stump"), ("muss es erkl\ufffd", "stump"),
    ],
)
def test_endings(text, kind):
    assert T.ending(text)[0] == kind


def test_words():
    assert T.words("On 12 May Dr. Ada Lovelace, Chair, spoke (Hear, hear)".split()) == ["X", "9", "X,", "spoke", "(X,", "hear)"]
    assert T.ending("Motion put by Deputy " + "Rosmer " * 100 + "is")[1:] == ("by", "X", "is")


def test_long_tokens_are_words_in_pieces():
    assert T.words(["a", "b" * 100, "c"]) == ["a", "b" * 48, "b" * 48, "bbbb", "c"]
    assert T.ending("a " + "b" * 100)[1:] == ("b" * 48, "b" * 48, "bbbb")


def test_likelihoods_come_from_the_documents():
    # a hundred texts at a strong limit, a few of them with a full stop; many whole texts away from limits
    rows = [("stop", 1000.0, 3.0, 0.0), ("words", 1000.0, 80.0, 80.0), ("open", 1000.0, 17.0, 0.0), ("stop", 0.0, 5000.0, 0.0), ("mark", 0.0, 1.0, 0.0)]
    whole, cut, anywhere = T.likelihoods(rows, 0.02)
    assert cut["stop"] == 0.02 and 0.1 < cut["open"] < 0.25 and whole["stop"] > 0.99 and anywhere < 0.01
    assert T.likelihoods([], 0.02)[0]["stop"] > 0.8
    ends = [("stop", 3.0, 0.0), ("words", 80.0, 80.0), ("open", 17.0, 0.0)]
    odds, marked = T.at_limit(ends, 1000.0, whole, cut)
    assert odds * 0.02 * (1 - marked) / whole["stop"] > 1
    # a source that marks its excerpts, and a window of lengths that is no limit
    odds, marked = T.at_limit([("stop", 3.0, 0.0), ("mark", 97.0, 0.0)], 1000.0, whole, cut)
    assert odds * 0.02 * (1 - marked) / whole["stop"] < 0.2
    odds, marked = T.at_limit([("stop", 60.0, 0.0), ("words", 40.0, 40.0)], 1000.0, whole, cut)
    assert odds < 2


def test_an_ordinary_ending_at_a_strong_limit_is_a_cut(spark):
    # sentences of one length: every seventh cut at the limit falls on the end of a sentence
    rng = random.Random(7)
    rows, at = [], set()
    for i in range(1500):
        t = " ".join(f"{rng.choice(['We', 'You'])} {'v' * rng.randrange(1, 6)} it {rng.randrange(10**6, 10**7)}." for _ in range(max(1, int(rng.lognormvariate(2.2, 0.7)))))
        if len(t) > 250:
            t = t[:250]
            at.add(i)
        rows.append((i, t, "a"))
    got = {r.doc_id: r.posterior for r in T.posteriors(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    stops = [i for i in at if rows[i][1].endswith(".")]
    assert stops and all(got[i] > 0.5 for i in stops)
    assert sum(p > 0.5 for i, p in got.items() if i not in at and len(rows[i][1]) != 250) == 0


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "It is done.", None), (4, "x" * 200_000, "a"), (5, "It is done.", None), (None, "It is done.", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as odds", "'x' as word", "'de' as lang")
    got = {r.doc_id for r in T.truncated(df).collect()}
    assert not got & {1, 2, 3, 5, None}
    assert T.truncated(df.limit(0)).count() == 0 and T.rates(df.limit(0)).count() == 0 and T.limits(df.limit(0)).count() == 0


def test_copies_make_no_limit(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, max(1, int(rng.lognormvariate(1.6, 0.8)))), "a") for i in range(300)]
    vote = "The motion on the harbour dues of the northern district was put to the vote and carried with Ayes: 212 Noes: 97"
    rows += [(1000 + i, vote, "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r for r in T.limits(df).collect() if r.lo <= len(vote) <= r.hi] == []
    assert T.posteriors(df).where("doc_id >= 1000 and odds > 0").count() == 0


def test_limits_of_long_fields_are_found(spark):
    rng = random.Random(2)
    body = [min(int(rng.lognormvariate(10.8, 0.9)), 100_000) for _ in range(3000)]
    assert any(lo <= 100_000 <= hi for lo, hi, _ in T.fit(sorted({n: body.count(n) for n in body}.items())))
    short = [min(int(rng.lognormvariate(4, 0.7)), 50) for _ in range(3000)]
    assert any(lo <= 50 <= hi for lo, hi, _ in T.fit(sorted({n: short.count(n) for n in short}.items())))
    rows = [(i, f"{i} " + "x" * (min(n, 100_000) - len(f"{i} ")), "a") for i, n in enumerate(body[:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.lo, r.hi) for r in T.limits(df).where("unit = 'chars'").collect()]
    assert got and all(lo <= 100_000 <= hi for lo, hi in got)


@pytest.mark.parametrize("text, kind", [("He (who " + "spoke and " * 400 + "went.", "open"), ("«He " + "spoke and " * 400 + "went.", "open"), ("It (the (older) one is so.", "open"), ("„Es ist so“, sagte er. “So” it is.", "stop"), ("a) It is so. (b) So it is.", "stop")])
def test_open_marks_are_seen_over_the_whole_text(text, kind):
    assert T.ending(text)[0] == kind
