import pytest
from pyspark.sql import functions as F

from riftlens.functions import rules as R
from riftlens.functions import text as X


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


def ev(spark, f, *values):
    return one(spark, f(*(F.col(f"v{i}") for i in range(len(values)))), **{f"v{i}": v for i, v in enumerate(values)})


@pytest.mark.parametrize(
    "f, args, want",
    [
        (X.basename, ("a/b/c.go",), "c.go"), (X.basename, ("c.go",), "c.go"), (X.basename_any, ("a\\b\\",), "b"), (X.basename_any, ("/",), "/"), (X.basename_any, (None,), ""),
        (X.middle_path, ("a/b/c/d/e/f",), "a/b/…/e/f"), (X.middle_path, ("a/b/c/d/e",), "a/b/c/d/e"), (X.language, ("x.rs",), "rust"), (X.language, ("x.RS",), None), (X.language, ("Makefile",), None),
        (X.collapse, (" a \t b\n",), "a b"), (X.comment_only, ("  # x",), True), (X.comment_only, ("x // y",), False), (X.plural, (1,), ""), (X.plural, (2,), "s"),
        (X.file_summary, ("a/b.go", "Added", 1, 0), "Adds b.go: +1 line."), (X.file_summary, ("b.go", "Deleted", 0, 3), "Removes b.go: −3 lines."), (X.file_summary, ("b.go", "Modified", 2, 1), "Updates b.go: +2 −1 lines."),
        (X.card_id, ("a",), "a::__file"), (X.line_change_type, (1, 0), "added"), (X.line_change_type, (1, 1), "modified"),
        (X.provisional_title, ("order-item_list API",), "Order Item List API"), (X.identifier_tokens, ("call a.b() and (c) ... d_e.",), ["call", "a.b()", "and", "c", "d_e"]),
        (X.looks_like_code, ("IOError",), False), (X.looks_like_code, ("createOrder",), True), (X.looks_like_code, ("Creates",), False), (X.looks_like_code, ("f()",), True),
        (X.identifier_bases, ("a.b.c()",), ["a.b.c", "a", "c"]), (X.strip_fence, ("```json\n{}\n```",), "{}"), (X.strip_fence, (" x ",), "x"), (X.unwrap_json, ('{"structured_output":{"a":1}}',), '{"a":1}'), (X.unwrap_json, ('{"result":"r"}',), "r"),
        (X.composite_key, ("a", "b"), "a\u001fb"), (X.cell_width, ("a\t한",), 5), (X.font_size, (17,), 13), (X.font_size, (99,), 11), (X.import_like, ('"net/http"',), True), (X.import_like, ('x = "a"',), False),
        (R.layer_rank, ("a/controller/x.go", "x"), 0), (R.layer_rank, ("a/x_test.go", "handleX"), 5), (R.layer_rank, ("a/x", "main"), 0), (R.layer_rank, ("a/x", "y"), 6), (R.layer_rank, ("x.sql", "y"), 4),
        (R.is_hub, ("LOGGER",), True), (R.is_hub, ("Logging",), False), (R.entry_point, ("a/handler/x", "f"), "f (a/handler/x)"), (R.entry_point, ("a", "b"), None), (R.contract_name, ("OrderRequest",), True), (R.contract_name, ("OrderSchema",), False),
        (R.contract_candidate, ("a", "OrderSchema", "file"), "OrderSchema"), (R.file_kind, ("db/migration/x.txt",), "migration"), (R.file_kind, ("Makefile",), "config"), (R.file_kind, ("x.go",), "file"), (R.file_type_hint, ("a.sql",), "contract"),
        (R.is_test_symbol, ("go", "a.go", "TestX"), True), (R.is_test_symbol, ("rust", "a.rs", "TestX"), False), (R.branch_rank, ("main", "x"), 2), (R.branch_rank, ("x", "x"), 0), (R.branch_rank, ("y", None), 100),
        (X.error_class, (401, "m"), "auth"), (X.error_class, (529, "m"), "overloaded"), (X.error_class, (500, "m"), "http:m"),
    ],
)
def test_values(spark, f, args, want):
    assert ev(spark, f, *args) == want


def test_signature_and_body(spark):
    src = "pub(crate) fn  a(x: u8) {\n  // c\n  b();\n\n  a();\n}\n"
    row = spark.range(1).select(X.source_lines(F.lit(src)).alias("l")).select(X.signature(F.col("l"), F.lit(0)).alias("s"), X.body(F.col("l"), F.lit(0), F.lit(5)).alias("b"), F.size("l").alias("n")).first()
    assert (row.s, row.b, row.n) == ("fn a(x: u8)", ["a();", "b();"], 6)


def test_overlap_is_one_sided(spark):
    a, b = F.array(*map(F.lit, "xxy")), F.array(F.lit("x"))
    assert one(spark, X.overlap(a, b)) == pytest.approx(2 / 3)
    assert one(spark, X.overlap(b, a)) == 1.0
    assert one(spark, X.overlap(F.array().cast("array<string>"), a)) == 0.0


@pytest.mark.parametrize(
    "lang, line, want",
    [("rust", "use a::b::C;", ["C"]), ("rust", "use a::{b, c};", []), ("go", '\t"net/http"', ["http"]), ("java", "import static a.B.c;", ["c"]), ("java", "import a.*;", []), ("kotlin", "import a.B as C", ["C"]), ("kotlin", "import a.B", ["B"]), ("go", "import x", [])],
)
def test_imports(spark, lang, line, want):
    assert ev(spark, X.imported_names, lang, line) == want


def test_highlight_and_changed_words(spark):
    assert tuple(ev(spark, X.highlight, "Feature/Login", "login")) == ("Feature/", "Login", "")
    assert tuple(ev(spark, X.highlight, "abc", "")) == ("abc", "", "")
    assert tuple(ev(spark, X.changed_words, "let a = 1;", "let bc = 1;")) == (4, 5, 6)
    assert tuple(ev(spark, X.changed_words, "", "x")) == (0, 0, 1)


def test_segments(spark):
    r = lambda *xs: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in xs))
    got = one(spark, X.segments(F.lit("let abc = 1"), r((0, 3), (4, 7)), r((6, 99))))
    assert [(p.start, p.end, p.text) for p in got] == [(0, 3, "let"), (3, 4, " "), (4, 6, "ab"), (6, 7, "c"), (7, 11, " = 1")]
    assert one(spark, X.segments(F.lit(""), r((0, 3)), r((0, 1)))) == []
