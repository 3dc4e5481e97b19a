import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riftlens.operators import cards as C
from riftlens.operators import components, features, intervals, layout, relations, signals, store, verify, views
from riftlens.session import global_rank, salted_rank


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def lines(spark, kinds, f="f"):
    out, n, o = [], 0, 0
    for i, k in enumerate(kinds):
        kind = {"+": "add", "-": "del", " ": "ctx"}[k]
        n += kind != "del"
        o += kind != "add"
        out.append((f, i, kind, n if kind != "del" else None, o if kind != "add" else None, f"l{i}"))
    return spark.createDataFrame(out, "file_id string, line_seq int, kind string, new_lineno int, old_lineno int, content string")


def test_gutter_with_a_leading_deletion(spark):
    df = spark.createDataFrame([("f", 0, "del", None), ("f", 1, "ctx", 5), ("f", 2, "del", None), ("f", 3, "add", 6)], "file_id string, line_seq int, kind string, new_lineno int")
    assert [r.n for r in C.gutter(df, ["file_id"]).orderBy("line_seq").collect()] == [4, 5, 5, 6]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("+- ", min_size=1, max_size=25))
def test_gutter_never_falls_and_rows_pair_up(spark, kinds):
    df = lines(spark, kinds)
    ns = [r.n for r in C.gutter(df, ["file_id"]).orderBy("line_seq").collect()]
    assert ns == sorted(ns)
    got = [(r.left_seq, r.right_seq) for r in views.split_rows(df, ["file_id"]).orderBy("row_no").collect()]
    want, dels, adds = [], [], []
    for i, k in enumerate(kinds + "$"):
        if k in " $":
            want += [(dels[j] if j < len(dels) else None, adds[j] if j < len(adds) else None) for j in range(max(len(dels), len(adds)))]
            dels, adds = [], []
            want += [(i, i)] if k == " " else []
        else:
            (dels if k == "-" else adds).append(i)
    assert got == want


def test_folds(spark):
    def run(kinds, threads=()):
        df = lines(spark, kinds).select("file_id", F.col("line_seq").alias("row_no"), (F.col("kind") == "ctx").alias("is_ctx"), F.col("line_seq").isin(*threads, -1).alias("has_thread"))
        return rows(views.folds(df, ["file_id"]), "first_row", "last_row", "hidden")

    assert run("      +        -  ") == [(0, 3, 4), (9, 12, 4)]
    assert run("     +") == []
    assert run("          +", threads=[3]) == []


def test_innermost(spark):
    i = spark.createDataFrame([("f", 0, 0, 10), ("f", 1, 2, 4), ("f", 2, 2, 4), (None, 3, 0, 99)], "f string, sym_idx int, start_row int, end_row int")
    p = spark.createDataFrame([("f", 3), ("f", 7), ("f", 50), (None, 1), ("g", 1)], "f string, row int")
    want = [("f", 3, 1), ("f", 7, 0), ("f", 50, None), ("g", 1, None), (None, 1, 3)]
    for b in (None, 4):
        got = {(r.f, r.row, r.sym_idx) for r in intervals.innermost(p, i, ["f"], bin_rows=b).collect()}
        assert got == (set(want) if b is None else {w for w in want if w[0]} | {(None, 1, 3)})


def test_line_attribution_of_deleted_lines(spark):
    syms = spark.createDataFrame([("f", 0, 0, 1), ("f", 1, 2, 9)], "file_id string, sym_idx int, start_row int, end_row int")
    got = intervals.attribute_lines(lines(spark, " -+ -"), syms, ["file_id"]).orderBy("line_seq").collect()
    assert [r.sym_idx for r in got] == [0, 0, 0, 1, 1]


def find(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("n, edges", [(5, [(0, 1), (1, 2), (4, 4), (3, 9)]), (300, [(i, i + 1) for i in range(299)]), (60, [(random.Random(7).randrange(60), (i * 17) % 60) for i in range(40)])])
def test_components_equal_union_find(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    pairs = spark.createDataFrame([*edges, *edges[:1]], "a long, b long")
    got = dict(components.components(nodes, pairs).collect())
    assert [got[i] for i in range(n)] == find(n, [(a, b) for a, b in edges if a < n and b < n])


def test_seeds_and_merge_base(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    got = rows(components.seeds(nodes, spark.createDataFrame([("b", "c")], "a string, b string")), "seed_id", "id")
    assert got == [("seed-1", "a"), ("seed-2", "b"), ("seed-2", "c"), ("seed-3", "d")]
    parents = spark.createDataFrame([("m", None), ("x", "m"), ("y", "m"), ("z", "y")], "id string, parent string")
    base = components.merge_base(parents, spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("z",)], "id string"))
    assert rows(base, "left_id", "right_id", "base_id") == [("x", "z", "m")]
    # a short edge to an old ancestor: its descendant is the best one though it lies further up
    parents = spark.createDataFrame([("X", None), ("p", "X"), ("q", "p"), ("Y", "q"), ("a1", "Y"), ("a2", "a1"), ("A", "a2"), ("A", "X"), ("b1", "Y"), ("b2", "b1"), ("B", "b2"), ("B", "X")], "id string, parent string")
    base = components.merge_base(parents, spark.createDataFrame([("A",)], "id string"), spark.createDataFrame([("B",)], "id string"))
    assert rows(base, "base_id") == [("Y",)]


def test_seeds_within_a_scope(spark):
    nodes = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a"), ("s", "b"), ("s", "c")], "review_id string, id string")
    pairs = spark.createDataFrame([("s", "a", "c")], "review_id string, a string, b string")
    got = rows(components.seeds(nodes, pairs, ["review_id"]), "review_id", "seed_id", "id")
    assert got == [("r", "seed-1", "a"), ("r", "seed-2", "b"), ("s", "seed-1", "a"), ("s", "seed-1", "c"), ("s", "seed-2", "b")]


def test_relations(spark):
    changed = spark.createDataFrame([("A", "run", "T", "p1"), ("B", "walk", "T", "p2"), ("C", "T", None, "p3"), ("D", "Logger", None, "p4"), ("E", "go", None, "p5"), ("F", "hop", None, "p5")], "card_id string, name string, owner string, path string")
    refs = spark.createDataFrame([("E", "call", "walk", False), ("E", "call", "Logger", False), ("F", "type", "T", False), ("E", "type", "T", True)], "card_id string, bucket string, ident string, in_header boolean")
    imports = spark.createDataFrame([("F", "run"), ("E", "walk")], "card_id string, ident string")
    got = rows(relations.pairs(changed, refs, imports), "a", "b", "grade")
    assert got == rows(relations.pairs(changed, refs, imports, all_pairs=True), "a", "b", "grade")
    assert got == [("A", "B", "strong"), ("A", "C", "strong"), ("A", "F", "weak"), ("B", "C", "strong"), ("B", "E", "strong"), ("C", "E", "strong"), ("C", "F", "weak"), ("E", "F", "weak")]


def test_relations_stay_within_their_scope(spark):
    one = [("A", "run", "T", "p1"), ("B", "walk", "T", "p2"), ("C", "T", None, "p3"), ("E", "go", None, "p5")]
    changed = spark.createDataFrame([(r, *x) for r in "rs" for x in one[: 4 if r == "r" else 2]], "review string, card_id string, name string, owner string, path string")
    refs = spark.createDataFrame([("r", "E", "call", "walk", False), ("s", "A", "call", "T", False)], "review string, card_id string, bucket string, ident string, in_header boolean")
    imports = spark.createDataFrame([("r", "E", "run"), ("s", "B", "go")], "review string, card_id string, ident string")
    got = rows(relations.pairs(changed, refs, imports, scope=["review"]), "review", "a", "b", "grade")
    assert got == [("r", "A", "B", "strong"), ("r", "A", "C", "strong"), ("r", "A", "E", "weak"), ("r", "B", "C", "strong"), ("r", "B", "E", "strong"), ("s", "A", "B", "strong")]


def test_siblings_are_strong_pairs_all_of_them(spark):
    changed = spark.createDataFrame([(c, f"run{c}", "T", f"p{c}") for c in "ABCD"] + [("E", "hop", None, "pE")], "card_id string, name string, owner string, path string")
    refs = spark.createDataFrame([("B", "type", "runC", False), ("E", "type", "runB", False)], "card_id string, bucket string, ident string, in_header boolean")
    imports = spark.createDataFrame([("C", "runD")], "card_id string, ident string")
    got = rows(relations.pairs(changed, refs, imports), "a", "b", "grade")
    assert got == [("A", "B", "strong"), ("A", "C", "strong"), ("A", "D", "strong"), ("B", "C", "strong"), ("B", "D", "strong"), ("B", "E", "weak"), ("C", "D", "strong")]
    links = rows(relations.pairs(changed, refs, imports, all_pairs=False), "a", "b", "grade")
    assert links == [("A", "B", "strong"), ("A", "C", "strong"), ("A", "D", "strong"), ("B", "E", "weak")]


def test_group_links_join_what_all_pairs_join(spark):
    df = spark.createDataFrame([(c, g) for c, g in zip("abcdefgh", "xxxxyyz" + "z", strict=True)] + [("i", None), ("j", "")], "card_id string, owner string")
    nodes = df.select(F.col("card_id").alias("id"))
    links, every = relations.group_links(df, "owner"), relations.group_pairs(df, "owner")
    assert (links.count(), every.count()) == (5, 8)
    assert rows(components.components(nodes, links), "id", "component") == rows(components.components(nodes, every), "id", "component")


def symbols(spark, base, head):
    src = "\n".join
    def side(s, which):  # noqa: E306
        out, at = [], 0
        for i, (name, header, body) in enumerate(s):
            out.append(("f", which, i, name, at, at + len(body) + 1))
            at += len(body) + 2
        return out, src(x for _, h, b in s for x in (h + " {", *b, "}"))

    b, bs = side(base, "base")
    h, hs = side(head, "head")
    s = spark.createDataFrame(b + h, "file_id string, side string, sym_idx int, name string, start_row int, end_row int")
    return signals.normalised(s, spark.createDataFrame([("f", bs, hs)], "file_id string, base_source string, head_source string"))


def test_signals(spark):
    body = ["a();", "b();", "c();", "d();"]
    norm = symbols(spark, [("gone", "fn gone()", ["x();"]), ("old", "fn f()", body), ("part", "fn part()", body[:2]), ("same", "pub fn same(a)", ["s();"])], [("new", "fn new()", body[::-1]), ("other", "fn other()", ["q();"]), ("same", "fn same(a, b)", ["s();"])])
    every = norm.where("side = 'head'").select("file_id", "sym_idx")
    renamed = signals.renames(norm, every)
    assert rows(renamed, "from_name", "to_name", "basis") == [("old", "new", "body")]
    assert rows(signals.deleted(norm, renamed), "name") == [("gone",), ("part",)]
    assert rows(signals.signature_changes(norm), "name", "before", "after") == [("same", "fn same(a)", "fn same(a, b)")]
    assert rows(signals.renames(norm, every.limit(0)), "from_name") == []


def test_verification(spark):
    m = spark.createDataFrame([(0, "c1", 0, "a"), (0, "c1", 1, "b"), (1, "c2", 0, "b")], "cluster_pos int, cluster_id string, member_pos int, card_id string")
    none = spark.createDataFrame([], "card_id string")
    white = spark.createDataFrame([("a",), ("b",), ("z",)], "card_id string")
    assert rows(verify.verified_clusters(m), "cluster_id", "card_id") == [("c1", "a"), ("c1", "b")]
    assert rows(verify.absorbed(m, none, white), "card_id") == [("z",)]
    assert rows(verify.unknown_ids(m, spark.createDataFrame([("q",)], "card_id string"), white), "card_id") == [("q",)]
    order = spark.createDataFrame([(0, "c9"), (1, "c2"), (2, "c2")], "pos int, cluster_id string")
    assert rows(verify.normalised_order(order, m), "cluster_id", "pos") == [("c1", 1), ("c2", 0)]
    texts = spark.createDataFrame([("k", "OrderService.create() uses createOrder and IOError Creates x_y")], "cluster_id string, text string")
    bad = verify.suspicious(texts, spark.createDataFrame([("Create",)], "name string"))
    assert rows(bad, "token") == [("createOrder",), ("x_y",)]
    units = spark.createDataFrame([(1, 5, 9), (1, 5, 3)], "start_line int, end_line int, anchor_line int")
    assert [r.anchor_line for r in verify.anchored(units).collect()] == [1, 3]
    sug = spark.createDataFrame([(1, "merge", ["c1", "c2"]), (2, "merge", ["c1", "no"]), (3, "split", [])], "suggestion_id int, kind string, cluster_ids array<string>")
    assert rows(verify.verified_suggestions(sug, m), "suggestion_id") == [(1,)]


def test_layered_order(spark):
    names = ["OrderRepository", "OrderController", "OrderServiceTest", "OrderEntity", "OrderService"]
    m = spark.createDataFrame([(f"seed-{i}", n, n) for i, n in enumerate(names)], "seed_id string, card_id string, name string")
    assert [r.card_id for r in layout.layered(m).orderBy("rank").collect()] == ["OrderController", "OrderService", "OrderEntity", "OrderRepository", "OrderServiceTest"]


def test_features(spark):
    m = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("t", 0, "c")], "seed_id string, pos int, card_id string")
    cards = spark.createDataFrame([("a", "x/handler.go", "h", "file", "modified", 0), ("b", "y.go", "g", "file", "modified", 1), ("c", "z", "OrderRequest", "file", "added", 2), ("d", "db/migration/1", None, "file", "added", 3)], "card_id string, path string, symbol string, kind string, change_type string, seq int")
    changed = spark.createDataFrame([("a", "first", 0), ("a", "last", 1)], "card_id string, name string, seq int")
    got = features.seed_features(features.described(m, cards, changed), spark.createDataFrame([("s",)], "seed_id string"))
    assert [(r.seed_id, r.symbols, r.kind) for r in got.orderBy("seed_id").collect()] == [("s", ["last", "g"], "flow"), ("t", ["OrderRequest"], "contract")]
    assert rows(features.file_seeds(cards, m), "seed_id", "card_id", "type_hint") == [("file-seed-1", "d", "contract")]


def test_tree(spark):
    cards = spark.createDataFrame([("a/b/c/x", 1, 2), ("a/b/d/y", 3, 0), ("e/f/z", 1, 1), ("top", 1, 0)], "path string, adds int, dels int")
    assert ("a/b", 2, 4, 2, 2) in rows(views.tree(cards), "dir", "depth", "adds", "dels", "files")
    assert rows(views.collapsed_tree(cards), "dir", "label") == [("a/b", "a/b"), ("a/b/c", "c"), ("a/b/d", "d"), ("e/f", "e/f")]


def test_anchor_flatten_cluster_and_status(spark):
    units = spark.createDataFrame([("f", 0, 0, 3), ("f", 1, 9, 1)], "f string, unit_idx int, anchor_line int, start_line int")
    shown = spark.createDataFrame([("f", 2, 0), ("f", 4, 1), ("f", 4, 2)], "f string, n int, row_no int")
    assert rows(views.unit_anchors(units, shown, ["f"]), "unit_idx", "anchor", "at_row") == [(0, 3, 1)]
    cards = spark.createDataFrame([("x",), ("y",)], "card_id string")
    lay = spark.createDataFrame([("x", "c", "T")], "card_id string, cluster_id string, title string")
    assert rows(views.cluster_of(cards, lay, "done"), "card_id", "title") == [("x", "T"), ("y", "Unclustered")]
    assert [r.title for r in views.cluster_of(cards, lay, "pending").orderBy("card_id").collect()] == ["T", None]
    t = spark.createDataFrame([("t", "x::__file", 1)], "thread_id string, card_id string, line_seq int")
    assert rows(views.thread_lines(t, spark.createDataFrame([("x::__file", 1, 7)], "card_id string, line_seq int, n int")), "reference") == [("x:7",)]
    region = spark.createDataFrame([("t", "left", 4, 2)], "thread_id string, side string, from_row int, to_row int")
    assert rows(views.thread_regions(region), "key") == [("left:2",), ("left:3",), ("left:4",)]
    done = spark.createDataFrame([("c", True), ("c", True), ("d", False)], "cluster_id string, done boolean")
    assert rows(views.progress_totals(done), "cards", "done_cards", "done_clusters") == [(3, 2, 1)]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda *r: spark.createDataFrame(list(r), "k string, payload string")
    store.put(spark, path, make(("a", "1"), ("b", "1")), ["k"])
    store.put(spark, path, make(("a", "2"), ("c", "1")), ["k"])
    assert rows(spark.read.parquet(path), "k", "payload") == [("a", "2"), ("b", "1"), ("c", "1")]
    assert rows(store.get(spark, path, k="a"), "payload") == [("2",)]
    assert store.get(spark, str(tmp_path / "none"), k="a").count() == 0
    threads = spark.createDataFrame([("k", "[1]"), ("bad", "{}")], "key string, payload string")
    assert [store.load_threads(threads, k) for k in ("k", "bad", "none")] == ["[1]", "[]", "[]"]
    with pytest.raises(ValueError):
        store.check_threads("{}")
    got = store.read_entries(spark.createDataFrame([('{"a": 1}',), ("{",), ("{}",)], "p string"), "p", "a int", "a")
    assert got.count() == 1
    cards = spark.createDataFrame([("s1", ["b", "a"], [(2, ["y", "x"]), (1, [])]), ("s2", ["a", "b"], [(1, []), (2, ["x", "y"])]), ("s1", ["a"], [])], "seed_id string, x array<string>, p array<struct<n:int,z:array<string>>>")
    assert [r.n for r in store.content_hash(cards).groupBy("card_hash").agg(F.count("*").alias("n")).orderBy("n").collect()] == [1, 2]


def test_store_edges(spark, tmp_path):
    path = str(tmp_path / "made")
    assert store.get(spark, path, "k string, payload string", k="a").columns == ["k", "payload"]
    store.create(spark, path, "k string, payload string")
    store.create(spark, path, "k string, payload string")
    assert store.get(spark, path, k="a").columns == ["k", "payload"] and store.get(spark, path, k="a").count() == 0
    store.put(spark, path, spark.createDataFrame([("a", "1")], "k string, payload string"), ["k"])
    assert rows(store.get(spark, path, k="a"), "payload") == [("1",)]
    # a store that cannot be read is not taken for an empty one
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        store.put(spark, str(bad), spark.createDataFrame([("a", "1")], "k string, payload string"), ["k"])
    threads = str(tmp_path / "threads")
    store.save_threads(spark, threads, "x", "[1]")
    store.save_threads(spark, threads, "y", "[2]")
    store.save_threads(spark, threads, "x", "[3]")
    kept = spark.read.parquet(threads)
    assert [store.load_threads(kept, k) for k in "xyz"] == ["[3]", "[2]", "[]"]
    with pytest.raises(ValueError):
        store.save_threads(spark, threads, "x", "{}")
    visits = spark.createDataFrame([("s", i) for i in range(150)], "session string, at int")
    assert rows(store.history(visits, ["session"]), "at")[0] == (50,)


def test_viewport_bounds(spark):
    df = spark.createDataFrame([("f", i, h) for i, h in enumerate((10, 10, 5000, 10, 10))], "file_id string, row_no int, height int")
    got = lambda t, b, over=0.0: rows(views.viewport(df, ["file_id"], t, b, over), "row_no")
    # edges that only touch are out; one row is shown at least
    assert got(10, 20) == [(1,)] and got(20, 21) == [(2,)] and got(0, 10) == [(0,)] and got(1000, 1001) == [(2,)] and got(5020, 5020) == [(3,)] and got(9000, 9100) == []


def test_excerpt_of_an_anchor_past_the_end(spark):
    df = spark.createDataFrame([("f", i) for i in range(200)], "file_id string, line_seq int")
    around = lambda a: [r.line_seq for r in views.excerpt(df, spark.createDataFrame([("f", a)], "file_id string, anchor_seq int"), ["file_id"]).orderBy("line_seq").collect()]
    assert around(500) == list(range(139, 200)) and around(None) == list(range(0, 61)) and around(100) == list(range(40, 161))


def test_ranks_are_bijections(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = salted_rank(df, ["g"], ["id"], "r", salts=7)
    for r in got.groupBy("g").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b"), F.countDistinct("r").alias("k")).collect():
        assert (r.a, r.b, r.k) == (0, r.n - 1, r.n)
    ranked = global_rank(df, [-F.col("id")], "r").where("id + r <> 999")
    assert ranked.count() == 0


def test_empty_tables(spark):
    empty = lines(spark, " ").limit(0)
    for f in (lambda: C.gutter(empty, ["file_id"]), lambda: C.change_runs(empty, ["file_id"]), lambda: views.split_rows(empty, ["file_id"]), lambda: C.snippets(empty, ["file_id"])):
        assert f().count() == 0
    assert components.components(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusterings_are_rejected_whole(spark):
    m = spark.createDataFrame([("l1", 0, "c1", 0, "a"), ("l1", 1, "c2", 0, "a"), ("l1", 1, "c2", 1, "b"), ("l2", 0, "c1", 0, "a"), ("l2", 0, "c1", 1, "strange"), ("l3", 0, "c1", 0, "b")], "layout_id string, cluster_pos int, cluster_id string, member_pos int, card_id string")
    loose = spark.createDataFrame([("l3", "odd")], "layout_id string, card_id string")
    white = spark.createDataFrame([(x, c) for x in ("l1", "l2", "l3", "l4") for c in "abc"], "layout_id string, card_id string")
    got = rows(verify.verify_clusters(m, loose, white, ["layout_id"]).na.fill("-", ["cluster_id"]), "layout_id", "cluster_id", "card_id")
    assert got == [("l1", "-", "c"), ("l1", "c1", "a"), ("l1", "c2", "b"), ("l4", "-", "a"), ("l4", "-", "b"), ("l4", "-", "c")]
    one = lambda x: (m.where(f"layout_id = '{x}'").drop("layout_id"), loose.limit(0).select("card_id"), white.where(f"layout_id = '{x}'").select("card_id"))
    assert verify.verify_clusters(*one("l1")).count() == 3 and verify.verify_clusters(*one("l2")).count() == 0


def test_assembled_layout(spark):
    order = spark.createDataFrame([("c3", 0), ("c1", 1), ("c3", 2), ("none", 3)], "cluster_id string, pos int")
    members = spark.createDataFrame([("c1", 0, "a"), ("c1", 1, "b"), ("c2", 0, "c"), ("c3", 0, "d")], "cluster_id string, member_pos int, card_id string")
    labels = spark.createDataFrame([("c1", "One", "s")], "cluster_id string, title string, summary string")
    loose = spark.createDataFrame([("z",), ("y",), ("a",)], "card_id string")
    got = [(r.flat_pos, r.cluster_id, r.card_id, r.title) for r in layout.assembled(order, members, labels, loose).orderBy("flat_pos").collect()]
    assert got == [(0, "c3", "d", "변경 사항"), (1, "c1", "a", "One"), (2, "c1", "b", "One"), (3, "c2", "c", "변경 사항"), (4, None, "y", None), (5, None, "z", None)]
    symbols = spark.createDataFrame([("a", "A"), ("d", "D")], "card_id string, name string")
    assert rows(layout.label_inputs(members, symbols), "cluster_id", "card_id", "name") == [("c1", "a", "A"), ("c3", "d", "D")]


def test_seed_records(spark):
    f = spark.createDataFrame([("s1", ["x"]), ("s2", ["y"])], "seed_id string, symbols array<string>")
    members = spark.createDataFrame([("s1", "a", "p1"), ("s1", "b", "p2"), ("s2", "c", "p3")], "seed_id string, card_id string, path string")
    pairs = spark.createDataFrame([("s1", "a", "b", "strong")], "seed_id string, a string, b string, grade string")
    tests = spark.createDataFrame([("b", "TestB"), ("b", "TestA")], "card_id string, name string")
    gone = spark.createDataFrame([("p1", "Old"), ("p9", "No")], "path string, name string")
    renamed = spark.createDataFrame([("p3", "f", "g")], "path string, from_name string, to_name string")
    resigned = spark.createDataFrame([("p2", "h", "x", "y")], "path string, name string, before string, after string")
    got = {r.seed_id: r for r in features.seed_records(f, members, pairs, tests, gone, renamed, resigned).collect()}
    assert got["s1"].related_tests == ["TestA", "TestB"] and [tuple(x) for x in got["s1"].deleted_symbols] == [("p1", "Old")] and [tuple(x) for x in got["s1"].strong_hints] == [("a", "b")]
    assert [tuple(x) for x in got["s2"].renames] == [("p3", "f", "g")] and got["s2"].weak_hints == [] and [tuple(x) for x in got["s1"].signature_changes] == [("p2", "h", "x", "y")]


def test_payloads_and_attempts(spark):
    m = spark.createDataFrame([(1, 1, "c2", 0, "b"), (1, 0, "c1", 1, "z"), (1, 0, "c1", 0, "a")], "layout_id int, cluster_pos int, cluster_id string, member_pos int, card_id string")
    assert rows(verify.clusters_payload(m), "payload") == [('{"clusters":[{"clusterId":"c1","memberCardIds":["a","z"]},{"clusterId":"c2","memberCardIds":["b"]}]}',)]
    f = spark.createDataFrame([(1, "s2", ["a"], []), (1, "s1", [], ["t"])], "layout_id int, seed_id string, symbols array<string>, tests array<string>")
    assert rows(verify.seeds_payload(f), "payload") == [('{"seeds":[{"seed_id":"s1","tests":["t"]},{"seed_id":"s2","symbols":["a"]}]}',)]
    good = '{"units":[{"title":"t","why":"w","tag":"g","startLine":1,"endLine":2,"anchorLine":1}]}'
    replies = spark.createDataFrame([(1, 1, "no"), (1, 2, good), (2, 1, good), (3, 1, '{"units":[{"title":"t"}]}'), (3, 2, "no"), (3, 3, good)], "layout_id int, attempt int, reply string")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "layout_id int")
    got = {r.layout_id: r.attempt for r in verify.first_usable(asked, replies, verify.UNITS_SHAPE).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None}


def test_proposals(spark):
    m = spark.createDataFrame([("c2", 5, "x"), ("c2", 1, "y"), ("c1", 0, "z")], "cluster_id string, member_pos int, card_id string")
    assert rows(verify.identity_order(m), "cluster_id", "pos", "card_id") == [("c1", 0, "z"), ("c2", 0, "y"), ("c2", 1, "x")]
    assert rows(verify.fits_one_call(m.withColumn("layout_id", F.lit(1))), "symbols", "is_small", "combined_fits") == [(3, True, True)]
    f = spark.createDataFrame([("s", ["a"], [], None)], "seed_id string, symbols array<string>, tests array<string>, kind string")
    assert rows(verify.proposal_payload(f), "payload") == [('{"symbols":["a"]}',)]
    good = '{"clusters":[{"clusterId":"c","memberCardIds":["a"],"kind":"flow"}],"unclustered":[],"clusterOrder":["c"]}'
    replies = spark.createDataFrame([(1, good), (2, "```json\n" + good + "\n```"), (3, '{"structured_output":' + good + "}"), (4, '{"clusters":[]}'), (5, "no json"), (6, None)], "layout_id int, reply string")
    assert rows(verify.read_proposals(replies), "layout_id") == [(1,), (2,), (3,)]
