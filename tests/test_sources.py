import pytest
from pyspark.sql import functions as F

from riftlens.sources import declarations as D
from riftlens.sources import snapshots as S
from riftlens.streaming import progress


@pytest.mark.parametrize(
    "lang, source, want",
    [
        ("go", 'package x\n\n// func no() {\nfunc A() {\n\ts := "}"\n}\n\ntype T struct {\n\tn int\n}\n\nfunc (t *T) B(x int) int {\n\treturn x\n}\n', [("A", None, 3, 5), ("T", None, 7, 9), ("B", "T", 11, 13)]),
        ("rust", "impl S {\n    pub fn a(&self) {\n    }\n}\nstruct S {\n    n: u8,\n}\nfn b() {}\n", [("a", "S", 1, 2), ("S", None, 4, 6), ("b", None, 7, 7)]),
        ("java", "class A {\n  int n;\n  public int f(int x) {\n    return g(x);\n  }\n}\n", [("A", None, 0, 5), ("f", "A", 2, 4)]),
        ("kotlin", "class A(val n: Int) {\n    fun f(): Int {\n        return 1\n    }\n}\nobject O {\n}\n", [("A", None, 0, 4), ("f", "A", 1, 3), ("O", None, 5, 6)]),
    ],
)
def test_declarations(lang, source, want):
    syms, _ = D.scan(lang, source)
    assert [(s["name"], s["owner"], s["start_row"], s["end_row"]) for s in syms] == want


def test_sources_that_do_not_hold_together_have_no_symbols():
    assert D.scan("go", "func A() {") is None
    assert D.scan("py", "def a(): pass") is None


def test_references(spark):
    syms, refs = D.scan("java", "class A extends B {\n  C f(D d) {\n    E e = g(d);\n    return e;\n  }\n}\n")
    got = {(r["bucket"], r["ident"], r["sym_idx"], r["in_header"]) for r in refs}
    assert {("impl", "B", 0, True), ("type", "D", 1, True), ("type", "E", 1, False), ("call", "g", 1, False)} <= got
    files = spark.createDataFrame([("f", "a.java", "class A {\n int f() { return 1; }\n}\n"), ("f", "a.java", "class A {\n int f() { return 1; }\n}\n"), ("g", "b.txt", "x"), ("h", "c.go", None)], "file_id string, new_path string, new_source string")
    assert sorted(r.name for r in D.symbols(files).collect()) == ["A", "f"]
    shown = D.card_symbols(D.symbols(files), files).where("name = 'f'").first()
    assert (shown.start_line, shown.decl) == (2, "int f() { return 1; }")


def test_line_diff_gives_both_sides_back():
    old, new = "a\nb\nc\n", "a\nx\nc\nd"
    got = S.diff(old, new)
    assert [c for k, *_, c in got if k != "add"] == ["a", "b", "c"]
    assert [c for k, *_, c in got if k != "del"] == ["a", "x", "c", "d"]
    assert S.diff(None, "") == []


def test_snapshots(spark, tmp_path):
    t = "path string, source string, is_binary boolean"
    old = spark.createDataFrame([("a", "1", False), ("b", "2", False), ("c", "move me", False), ("d", "x", False)], t)
    new = spark.createDataFrame([("a", "1", False), ("b", "3", False), ("e/c", "move me", False), ("n", "new", False)], t)
    got = {(r.new_path, r.old_path, r.status) for r in S.file_diffs(old, new).collect()}
    assert got == {("b", "b", "Modified"), ("e/c", "c", "Modified"), ("d", "d", "Deleted"), ("n", "n", "Added")}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.txt").write_bytes(b"ok\xff")
    (tmp_path / "s" / "y.bin").write_bytes(b"\0\1")
    tree = {r.path: (r.source, r.is_binary) for r in S.read_tree(spark, str(tmp_path / "s")).collect()}
    assert tree == {"x.txt": ("ok�", False), "y.bin": ("", True)}


def test_links(spark):
    row = spark.range(1).select(S.deep_link(F.lit("app://review?repo=%2Fa&base=main&target=x%2Fy")).alias("a"), S.deep_link(F.lit("app://review?repo=a")).alias("b"), S.pull_request(F.lit("https://host/o/n/pull/12")).alias("p"), S.local_branch(F.lit("refs/remotes/origin/x/y")).alias("l")).first()
    assert tuple(row.a) == ("/a", "main", "x/y") and row.b is None and tuple(row.p) == ("o", "n", 12) and row.l == "x/y"
    back = spark.range(1).select(S.deep_link(S.review_link("app", F.lit("/a b"), F.lit("m"), F.lit("t"))).alias("x")).first().x
    assert tuple(back) == ("/a b", "m", "t")


EVENTS = [("k", 3, "clusters", None, None, None), ("k", 1, "static", 7, None, None), ("k", 2, "clustering", None, None, None), ("k", 4, "reviewed", None, "c1", "one"), ("k", 5, "reviewed", None, "c1", "two"), ("k", 6, "noise", None, None, None)]
SCHEMA = "key string, seq int, kind string, files int, id string, chapter string"


def test_progress_in_batch(spark):
    e = spark.createDataFrame(EVENTS + EVENTS[:2], SCHEMA)
    assert tuple(progress.fold(e).first()) == ("k", "review", 7, 1)
    assert tuple(progress.chapters(e).first()) == ("k", "c1", "two")


def test_progress_as_a_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame(EVENTS, SCHEMA).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = progress.stream_fold(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("progress_state").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("progress_state").collect()] == [tuple(r) for r in progress.fold(e).collect()]


def test_verdicts(spark):
    acts = [("s", 1, "pass", "a"), ("s", 2, "pass", "b"), ("s", 3, "undo", None), ("s", 4, "pass", "c"), ("s", 5, "unpass", "a")]
    got = progress.fold_verdicts(spark.createDataFrame(acts, "session string, seq int, kind string, card_id string"))
    assert [r.card_id for r in got.collect()] == ["c"]
    # a card that was passed twice: each undo takes back one pass
    acts = [("s", 1, "pass", "b"), ("s", 2, "pass", "a"), ("s", 3, "pass", "a"), ("s", 4, "undo", None), ("s", 5, "undo", None), ("t", 1, "pass", "x"), ("t", 2, "undo", None), ("u", 1, "undo", None)]
    got = progress.fold_verdicts(spark.createDataFrame(acts, "session string, seq int, kind string, card_id string"))
    assert [tuple(r) for r in got.collect()] == [("s", "b")]


def test_sessions(spark):
    cards = spark.createDataFrame([(s, i, c) for s in ("s", "t") for i, c in enumerate("abcd")], "session string, pos int, card_id string")
    acts = [
        ("s", 1, "pass", None), ("s", 2, "next", None), ("s", 3, "pass", None), ("s", 4, "answered", "th1"), ("s", 5, "answered", "th2"), ("s", 6, "read", "th1"), ("s", 7, "resolve", "th1"), ("s", 8, "resolve", "th2"), ("s", 9, "resolve", "th2"), ("s", 10, "back", None), ("s", 11, "noise", "x"),
        ("e", 1, "pass", None),
    ]
    got = {r.session: r for r in progress.fold_sessions(spark.createDataFrame(acts, "session string, seq int, kind string, target string"), cards).collect()}
    s = got["s"]
    assert (s.at, s.screen, s.back, s.passed, s.unread, s.resolved) == (2, "review", [0, 1], ["a", "c"], ["th2"], ["th1"])
    assert (got["t"].at, got["t"].passed) == (0, []) and (got["e"].passed, got["e"].screen) == ([], "review")
    state = progress.Session(list("abc"))
    for _ in range(3):
        state.act("pass")
    assert state.screen == "summary" and state.at == 2
    state.act("undo")
    assert list(state.passed) == ["a", "b"] and state.at == 2
    state.act("undo")
    assert list(state.passed) == ["a"] and state.at == 1 and state.back == [0, 1, 2]
    for i in range(300):
        state.act("goto", str(i % 2))
    assert len(state.back) == 100
    state.act("goto", "99")
    assert state.at == 2


def test_events_and_gathering(spark):
    files = spark.createDataFrame([("k", 7), ("e", 0)], "key string, files int")
    clusters = spark.createDataFrame([("k", 0, "c1"), ("k", 1, "c2")], "key string, pos int, cluster_id string")
    labels = spark.createDataFrame([("k", "c1", "one", 9), ("k", "c2", "two", 3), ("k", "strange", "x", 1)], "key string, cluster_id string, title string, done_at int")
    events = progress.emitted(files, clusters, labels)
    got = [(r.kind, r.id, r.chapter) for r in events.where("key = 'k'").orderBy("seq").collect()]
    assert got == [("static", None, None), ("clustering", None, None), ("clusters", None, None), ("reviewed", "c2", "two"), ("reviewed", "c1", "one"), ("final", None, None)]
    assert [r.kind for r in events.where("key = 'e'").orderBy("seq").collect()] == ["static", "clustering", "final"]
    assert tuple(progress.fold(events).where("key = 'k'").first()) == ("k", "final", 7, 2)
    results = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 2, "b"), ("k", 3, None)], "key string, request int, answer string")
    assert progress.gathered(results, ["key"], ["request"], "answer").first()["values"] == ["a", "b", None]


def test_resolve(spark):
    refs = spark.createDataFrame([("refs/heads/main", "aaaa1111"), ("refs/tags/main", "bbbb2222"), ("refs/remotes/origin/x", "cccc3333")], "name string, commit_id string")
    commits = spark.createDataFrame([("aaaa1111",), ("bbbb2222",), ("abcd0001",), ("abcd0002",)], "commit_id string")
    revs = spark.createDataFrame([("main",), ("origin/x",), ("bbbb",), ("abcd",), ("abcd0001",), ("none",)], "rev string")
    assert dict(S.resolve(revs, refs, commits).collect()) == {"main": "aaaa1111", "origin/x": "cccc3333", "bbbb": "bbbb2222", "abcd0001": "abcd0001"}


@pytest.fixture
def repo(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    write = lambda p, b: ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_bytes(b))
    git("init", "-q", "-b", "main")
    write("a/svc.go", b"package a\n\nfunc Old() int {\n\treturn 1\n}\n")
    write("gone.txt", b"bye\n")
    write("move.txt", b"same text\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "work")
    write("a/svc.go", b"package a\n\nfunc Old() int {\n\treturn 2\n}\n")
    write("pic.bin", b"\0\1\2")
    (tmp_path / "gone.txt").unlink()
    (tmp_path / "move.txt").rename(tmp_path / "moved.txt")
    git("add", "-A")
    git("commit", "-qm", "two")
    git("checkout", "-q", "main")
    write("later.txt", b"on main only\n")
    git("add", "-A")
    git("commit", "-qm", "three")
    return str(tmp_path)


def test_git_repository(spark, repo):
    from riftlens.plans import review
    from riftlens.sources import git

    assert git.resolve_shas(repo, "main", "work")[0] == git.resolve_commit(repo, "main~1")
    with pytest.raises(ValueError):
        git.resolve_commit(repo, "none")
    names = {r.name: r.is_current for r in git.branches(spark, repo).collect()}
    assert names == {"main": True, "work": False}
    assert {r.path for r in git.tree(spark, repo, "main").collect()} == {"a/svc.go", "gone.txt", "move.txt", "later.txt"}
    files, lines = git.three_dot(spark, repo, "main", "work")
    got = {(r.new_path, r.old_path, r.status, r.is_binary) for r in files.collect()}
    assert got == {("a/svc.go", "a/svc.go", "Modified", False), ("gone.txt", "gone.txt", "Deleted", False), ("moved.txt", "move.txt", "Modified", False), ("pic.bin", "pic.bin", "Added", True)}
    changed = sorted((r.kind, r.content) for r in lines.where("kind <> 'ctx'").collect())
    assert changed == [("add", "\treturn 2"), ("del", "\treturn 1"), ("del", "bye")]
    f = files.withColumns({"file_id": F.col("file_seq").cast("string"), "ingested_at": F.lit(0), "repo_path": F.lit(repo), "review_id": F.lit("r")})
    made = review.review(f, lines.withColumn("file_id", F.col("file_seq").cast("string")))
    assert [(r.card_id, r.summary) for r in made.cards.orderBy("card_id").collect()] == [("a/svc.go::__file", "Updates svc.go: +1 −1 lines."), ("gone.txt::__file", "Removes gone.txt: −1 line."), ("pic.bin::__file", "Adds binary file pic.bin.")]
    # every card is in the layout: that of a changed symbol, then those without one
    assert [(r.card_id, r.rank, r.seed_id) for r in made.layout.orderBy("rank").collect()] == [("a/svc.go::__file", 1, "seed-1"), ("gone.txt::__file", 2, "file-seed-1"), ("pic.bin::__file", 3, "file-seed-2")]


def test_moves_and_copies_by_similarity(spark):
    body = [f"line {i} of the file" for i in range(20)]
    text = lambda *edits: "\n".join(f"changed {i}" if i in edits else x for i, x in enumerate(body)) + "\n"
    other = lambda k: "\n".join(f"{k} speaks of {i}" for i in range(9)) + "\n"
    old = [("a.txt", text()), ("kept.txt", other("kept")), ("gone.txt", other("gone")), ("same.txt", other("same")), ("brace.txt", "}\n" * 50)]
    new = [("b.txt", text(3, 4)), ("kept.txt", other("kept") + "more\n"), ("copy.txt", other("kept") + "and other\n"), ("fresh.txt", other("fresh")), ("moved.txt", other("same"))]
    make = lambda rows: spark.createDataFrame([(p, s, False) for p, s in rows], "path string, source string, is_binary boolean")
    got = {(r.old_path, r.new_path, r.status) for r in S.file_diffs(make(old), make(new)).collect()}
    assert got == {("a.txt", "b.txt", "Modified"), ("kept.txt", "kept.txt", "Modified"), ("kept.txt", "copy.txt", "Modified"), ("gone.txt", "gone.txt", "Deleted"), ("brace.txt", "brace.txt", "Deleted"), ("fresh.txt", "fresh.txt", "Added"), ("same.txt", "moved.txt", "Modified")}
    exact = {(r.old_path, r.new_path, r.status) for r in S.file_diffs(make(old), make(new), None).collect()}
    assert ("a.txt", "a.txt", "Deleted") in exact and ("same.txt", "moved.txt", "Modified") in exact and ("copy.txt", "copy.txt", "Added") in exact
    # the share is that of the larger text, repeated lines with their number
    found = S.similar_files(make(old).select("path", "source"), make(new).select("path", "source"), 0.0).where("old_path = 'a.txt' and new_path = 'b.txt'").first()
    common = sum(len(x) + 1 for i, x in enumerate(body) if i not in (3, 4)) + 1
    assert abs(found.similarity - common / (len(text()) + 1)) < 1e-9
    # many files that share a line do not all meet by it
    crowd = make([(f"c{i}", f"common\nown {i}\n") for i in range(100)])
    assert S.similar_files(crowd.select("path", "source"), crowd.select("path", "source"), 0.5).count() == 100
