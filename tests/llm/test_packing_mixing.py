import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riftlens.llm import mixing, packing, tokens


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=120))
def test_plan_places_everything_once_and_within_capacity(capacity, lengths):
    lengths = [n for n in lengths if n <= capacity]
    histogram = Counter(lengths)
    bins, ranks = defaultdict(list), defaultdict(set)
    for _, size, lo, hi, per, first, slot, at in packing.harmonic_plan("s", capacity, histogram):
        for r in range(lo, hi):
            b = first + (r - lo) // per
            bins[b].append((slot + (r - lo) % per, size))
            assert r not in ranks[size]
            ranks[size].add(r)
    assert {s: len(r) for s, r in ranks.items()} == dict(histogram)
    for content in bins.values():
        assert sum(s for _, s in content) <= capacity
        assert sorted(p for p, _ in content) == list(range(len(content)))
    if lengths:
        # no two bins could be one, but for what one class leaves at its end
        assert len(bins) <= 1.7 * sum(lengths) / capacity + 2


def text(n):
    return " x" * n


def test_packing(spark):
    docs = spark.createDataFrame([(i, text(n), "clash") for i, n in enumerate([5, 5, 3, 2, 25, 10, 0, 1, 7])] + [(99, None, "")], "doc_id long, text string, piece string")
    specs = spark.createDataFrame([("ten", 10), ("ten", 10), ("big", 100), ("none", None), ("zero", 0)], "spec_name string, capacity_tokens int")
    got = packing.pack(docs, specs).collect()
    for name, cap in (("ten", 10), ("big", 100)):
        mine = [r for r in got if r.spec_name == name]
        per_bin, per_doc = defaultdict(list), defaultdict(list)
        for r in mine:
            per_bin[r.container_id].append(r)
            per_doc[r.doc_id].append(r)
        assert set(per_doc) == {*range(9), 99}
        assert all(sum(r.n_tokens for r in b) <= cap and sorted(r.place for r in b) == list(range(len(b))) for b in per_bin.values())
        for d, pieces in per_doc.items():
            pieces.sort(key=lambda r: r.piece)
            assert sum(r.n_tokens for r in pieces) == (0 if d == 99 else [5, 5, 3, 2, 25, 10, 0, 1, 7][d])
            assert len(pieces) == 1 or sum(r.n_tokens for r in pieces) > cap
            assert [r.token_from for r in pieces] == [cap * i for i in range(len(pieces))]
    assert packing.pack(docs.limit(0), specs).count() == 0 and packing.pack(docs, specs.limit(0)).count() == 0
    report = {r.spec_name: r for r in packing.fill_report(packing.pack(docs, specs), specs).collect()}
    assert report["ten"].fullest <= 10 and report["ten"].tokens == 58


def test_packing_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, text(1 + i * 7 % 9)) for i in range(60)], "doc_id long, text string")
    specs = spark.createDataFrame([("s", 12)], "spec_name string, capacity_tokens int")
    a, b = (sorted(map(tuple, packing.pack(docs.repartition(n), specs).collect())) for n in (1, 7))
    assert a == b


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50)), min_size=1, max_size=60), st.integers(0, 9))
def test_flight_keeps_its_sums(units, seed):
    p, t = [u[0] for u in units], [float(u[1]) for u in units]
    want = sum(p), sum(a * b for a, b in zip(p, t, strict=True))
    open_ = mixing.fly(p, t, random.Random(seed))
    assert len(open_) <= 2 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in open_)
    assert sum(p) == pytest.approx(want[0], abs=1e-6) and sum(a * b for a, b in zip(p, t, strict=True)) == pytest.approx(want[1], abs=1e-4)
    mixing.land(p, t, open_)
    assert all(x in (0.0, 1.0) for x in p)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), min_size=2, max_size=30), st.integers(-60, 60))
def test_swap_equals_trying_all(units, over):
    p, t = [float(u[0]) for u in units], [float(u[1]) for u in units]
    want = min([abs(over), *(abs(over - t[i] + t[j]) for i in range(len(p)) for j in range(len(p)) if p[i] and not p[j])])
    before, n = sum(a * b for a, b in zip(p, t, strict=True)), sum(p)
    mixing.swap(p, t, range(len(p)), float(over))
    assert abs(over + sum(a * b for a, b in zip(p, t, strict=True)) - before) == want and sum(p) == n


def test_inclusion_follows_the_probabilities():
    """Landing takes the nearest total, so with few units it leans; over many units it hardly shows."""
    hits = Counter()
    for seed in range(400):
        p, t = [0.3] * 60, [float(5 + i % 17) for i in range(60)]
        mixing.land(p, t, mixing.fly(p, t, random.Random(seed)))
        hits.update(i for i, x in enumerate(p) if x)
    assert all(70 < hits[i] < 170 for i in range(60))


@pytest.mark.parametrize("block", [4, 4096])
def test_mix_meets_shares(spark, block):
    rng = random.Random(4)
    rows = [(i, text(rng.randint(3, 30)), rng.choice(["a"] * 6 + ["b"] * 3 + ["c"])) for i in range(600)]
    docs = spark.createDataFrame([*rows, (900, None, "a"), (901, "", "b"), (902, "x", None), (903, "x", "none")], "doc_id long, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("p", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.0, 1), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, block=block)
    got = mixed.collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} <= {"a", "b", "c"}
    caps = {"a": 1, "b": 2, "c": 3}
    assert all(1 <= r.repeats <= caps[r.source] for r in got)
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert report[s].actual_share == pytest.approx(share, abs=0.01)
    assert report["gone"].actual_share == 0.0


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    assert mixing.mix(docs, targets).count() == 0
    one = spark.createDataFrame([(1, "x y", "a")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.repeats) for r in mixing.mix(one, targets).collect()] == [(1, 1)]
    assert mixing.mix(one, targets.limit(0)).count() == 0


def test_token_counts_round_trip():
    e = tokens.encoding()
    for t in ("", "Ünïcode 한국어 <|endoftext|>", "a" * 5000, "  \n\t x"):
        assert e.decode(e.encode_ordinary(t)) == t and tokens.count(t) == len(e.encode_ordinary(t))
    assert tokens.count(None) == 0
