"""The registered queries on the smallest tables, and found cases on labelled tables made here."""

import random
import string

import pytest

from riftlens.llm import handwritten as H
from riftlens.llm import queries as Q
from riftlens.llm import secrets as S

COLUMNS = {"p1_found": ["file_id"], "p2_found": ["thread_id", "question_seq", "defect"], "p3_found": ["file_id"], "p4_found": ["file_id", "line_seq"], "p8_found": ["doc_id"]}


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_does_not_depend_on_the_partitioning(spark, small, name):
    first = Q.queries()[name](spark, small)
    if name in COLUMNS:
        assert first.columns == COLUMNS[name] and first.count() == first.distinct().count()
    got = rows(first)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        # the smallest table has no field limit
        assert (got or name == "p8_limits") and rows(Q.queries()[name](spark, small)) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sql_names_are_queries():
    assert set(Q.oracle_sql()) <= set(Q.queries())


def hand_written(rng, lang):
    """A file of plain code with some variety."""
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    out = []
    for _ in range(rng.randint(3, 8)):
        a, b, c = word(), word(), word()
        body = rng.sample([f"{c} = {a}.{b}({rng.randrange(99)})", f"if {a} > {rng.randrange(9)}", f"{b}.{a}({c}, {a})", f"return {c} + {rng.randrange(99)}", f"{c} += {b}.{a}"], rng.randint(2, 5))
        if lang == "py":
            lines = [f"def {a}({b}, {c}):", f'    """{c.title()} of the {a}."""', *(f"    {x}:\n        {c} = None" if x.startswith("if") else f"    {x}" for x in body), ""]
        else:
            lines = [f"function {a}({b}, {c}) {{", f"  // {c} of the {a}", *(f"  {x.replace('if ', 'if (')}) {{\n    {c} = null;\n  }}" if x.startswith("if") else f"  {x};" for x in body), "}", ""]
        out += lines
    return "\n".join(out)


def test_files_that_are_not_hand_written_are_found(spark):
    rng = random.Random(4)
    upstream = [hand_written(rng, "js") + hand_written(rng, "js") for _ in range(6)]
    banners = ["// Code generated by tool v1. DO NOT EDIT.", "/* @generated by tool */", "// This file was automatically generated from a.schema", "// Generated by tool - do not modify by hand", "// <auto-generated>"]
    files, want = [], set()

    def add(path, text, case):
        files.append((f"f{len(files)}", path, "Added", False, text))
        if case:
            want.add(files[-1][0])

    for i in range(60):
        lang = rng.choice(("py", "js"))
        text = hand_written(rng, lang)
        add(f"src/a{i}.{lang}", text, False)
        add(f"src/b{i}.js", "// generated ids stay stable\n" + hand_written(rng, "js"), False)
        add(f"src/c{i}.js", rng.choice(banners) + "\n" + hand_written(rng, "js"), True)
        if i % 3 == 0:
            copy = rng.choice(upstream).split("\n")
            copy[rng.randrange(len(copy))] = "  // edited here"
            add(f"src/d{i}.js", "\n".join(copy), True)
            add(f"third_party/lib/e{i}.js", hand_written(rng, "js"), True)
            add(f"src/f{i}.js", "".join(hand_written(rng, "js").replace("\n", "").replace("  ", "") for _ in range(3)).replace("// ", "/**/"), True)
            add(f"src/g{i}.py", "TABLE = [\n" + "".join("    " + ", ".join(str(rng.randrange(999)) for _ in range(12)) + ",\n" for _ in range(20)) + "]\n", True)
            add(f"src/h{i}.py", "def t(s):\n" + "".join(f"    if s == {k}: return {rng.randrange(99)}\n" for k in range(40)), True)
    df = spark.createDataFrame(files, "file_id string, new_path string, status string, is_binary boolean, new_source string")
    got = {r.file_id for r in H.not_handwritten(df, spark.createDataFrame([(x,) for x in upstream], "source string")).collect()}
    assert len(got & want) / len(want) >= 0.95, sorted(want - got)
    assert len(got & want) / len(got) >= 0.95, sorted(got - want)


def test_secrets_are_found_among_what_looks_like_them(spark):
    rng = random.Random(9)
    token = lambda n, abc=string.ascii_letters + string.digits: "".join(rng.choice(abc) for _ in range(n)) + "7aQ"
    secret = [
        lambda: f'password = "{token(12)}"', lambda: f"API_KEY={token(24)}", lambda: f'"client_secret": "{token(20)}",', lambda: f"url = 'postgres://app:{token(10)}@db.local/x'", lambda: f'headers["Authorization"] = "Bearer {token(30)}"',
        lambda: f"AWS = 'AKIA{''.join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))}'", lambda: f'pay("sk_live_{token(24)}")', lambda: f"db_password: {token(14)}",
    ]
    plain = [
        lambda: 'password = os.environ["DB_PASSWORD"]', lambda: "API_KEY=${API_KEY}", lambda: '"client_secret": "<your-secret>",', lambda: "url = 'postgres://app:${PASS}@db.local/x'", lambda: "secret = get_secret('team/db')", lambda: 'password_label = "Enter your password"',
        lambda: f'digest = "sha256:{token(40, string.hexdigits.lower())}"', lambda: 'token_name = "session_token"', lambda: 'password = "changeme"', lambda: f"id = '{rng.randrange(10**9)}'", lambda: "passwordField.setText(value)", lambda: '"password": "********",',
    ]
    lines, want = [], set()
    for f in range(40):
        for n in range(12):
            case = rng.random() < 0.4
            text = rng.choice(secret if case else plain)()
            lines.append((f"f{f}", n, rng.choice(("add", "del", "ctx")), text))
            if case:
                want.add((f"f{f}", n))
    got = {(r.file_id, r.line_seq) for r in S.find_in_lines(spark.createDataFrame(lines, "file_id string, line_seq int, kind string, content string")).collect()}
    missed, extra = [x for x in lines if x[:2] in want - got], [x for x in lines if x[:2] in got - want]
    assert len(got & want) / len(want) >= 0.95, missed[:9]
    assert len(got & want) / len(got) >= 0.97, extra[:9]
