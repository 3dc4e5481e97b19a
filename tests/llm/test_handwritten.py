import random

import pytest

from riftlens.llm import handwritten as H

HAND = """package invoice

import (
	"errors"
	"fmt"
)

// Do not edit the crate while a rank is running. Generated ids stay stable across a merge.
func (s *Crate) Rank(x *Crate) ([]Crate, error) {
	banner := "Code generated by tabulon. DO NOT EDIT."
	if x == nil {
		return nil, errors.New("no crate left to rank")
	}
	for i := 0; i < s.Size; i++ {
		s.Count += 115
		fmt.Println(banner, i)
	}
	return nil, nil
}
"""
UPSTREAM = "\n".join(f"func Shift{a}{b}(lattice *{a}, queue {b}) int {{\n\treturn lattice.{b}({i}) + queue.Mix{a}({i * 7})\n}}" for i, (a, b) in enumerate((x, y) for x in ("Trie", "Rope", "Heap", "Ring") for y in ("Arena", "Codec", "Spline", "Tensor", "Bitset")))
MINIFIED = "(function(e){" + "".join(f"e.a{i}=function(t){{for(var n=0;n<t.length;n++)t[n]&&(t[n].r=!{i % 2})}};" for i in range(40)) + "})(this);"


@pytest.fixture(scope="module")
def shelf():
    return H.Upstream([UPSTREAM, UPSTREAM.replace("Shift", "Walk").replace("lattice", "vector"), None, "", UPSTREAM])


def edited(text):
    lines = text.split("\n")
    for i in random.Random(3).sample(range(len(lines)), 2):
        lines[i] = "\t// changed"
    return "\n".join(lines)


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a/x.go", HAND, None), ("generated/x.go", HAND, "generated"), ("a/x.pb.go", HAND, "generated"), ("a/x_pb2.py", "x = 1\n", "generated"), ("src/generator/x.go", HAND, None), ("x.go", HAND + "\n// @generated by gridlex\n", "generated"), ("app/vendor_portal/x.go", HAND, None), ("a/vendor/lib/x.go", HAND, "copied"), ("third_party/x.go", HAND, "copied"), ("src/vendors/lib/x.go", HAND, "copied"), ("src/vendors/x.go", HAND, None), ("a/vendor/x.go", "// Copyright Corvane Works\n// internal use only\n" + HAND, None), ("a/x.go", "// Copyright Corvane Works\n// internal use only\n" + HAND, None),
        ("a/x.go", "// Copyright (c) 2019 The Lib Authors. All rights reserved.\n// SPDX-License-Identifier: MIT\n" + HAND, "copied"), ("deep/own/name.go", "package x\n" + UPSTREAM, "copied"), ("deep/own/name.go", "package x\n" + edited(UPSTREAM), "copied"),
        ("x.go", "// Code generated by protoweave v2. DO NOT EDIT.\n" + HAND, "generated"), ("x.go", "/*\n * Diese Datei wurde von stubsmith automatisch erzeugt. Nicht bearbeiten!\n */\n" + HAND, "generated"), ("x.go", "// Copyright Own\n// @generated by gridlex\n" + HAND, "generated"),
        ("x.go", "// AUTO-GENERATED FILE - changes will be lost\n" + HAND, "generated"), ("x.go", "// Generated from a.schema - do not modify by hand\n" + HAND, "generated"), ("x.go", "// Generated ids stay stable across a merge.\n" + HAND, None),
        ("x.py", "def t(s):\n" + "".join(f"    if s == {i}: return {i * 7 % 40}\n" for i in range(50)) + "    return -1\n", "generated"), ("x.js", MINIFIED, "minified"), ("x.js", "/*! x 1.2 */\n" + MINIFIED, "minified"),
        ("x.py", "DATA = [\n" + "".join("    " + ", ".join(f"0x{(i * 7 + j) % 256:02x}" for j in range(16)) + ",\n" for i in range(30)) + "]\n", "data"), ("x.js", "const helpText = '" + "no lease left to apply, limit reached. " * 60 + "';\n" + "export function f(a) {\n  return a + 1;\n}\n" * 6, None),
        ("x.go", "\x01\x07�#Qz\x1f" * 300, "binary"),
    ],
)
def test_verdicts(shelf, path, text, want):
    found = H.verdict(path, text, shelf)
    assert (found and found[0]) == want


def test_layout_is_measured_against_the_canonical_one():
    by_hand = "function f(a) {\n  g(a);\n  return a;\n}\n"
    m = H.layout("js", by_hand)
    assert (m["lines"], m["canonical"], m["same"]) == (4, 4, 1.0)
    flat = H.layout("js", by_hand.replace("\n", " "))
    assert (flat["lines"], flat["canonical"], flat["same"]) == (1, 4, 0.0)
    rows = "fn t(s: i32) -> i32 {\n    match s {\n" + "".join(f"        {i} => {i * 3},\n" for i in range(40)) + "    }\n}\n"
    m = H.layout("rs", rows)
    assert m["top"] == 40 and m["uniform"] > 0.9 and m["same"] > 0.95
    assert H.by_layout("rs", rows) == "generated" and H.by_layout("rs", rows.replace("\n", " ")) != "generated"
    # layout comes before banners, licences and folders
    assert H.verdict("vendor/a/x.js", MINIFIED, H.Upstream([])) == ("minified", "layout")


def test_similarity_equals_counting_by_hand(shelf):
    text = edited(UPSTREAM)
    own = {g for g in H.shingles(UPSTREAM) if sum(g in H.shingles(s) for s in (UPSTREAM, UPSTREAM.replace("Shift", "Walk").replace("lattice", "vector"))) <= 2}
    assert shelf.similarity(text) == pytest.approx(len(own & H.shingles(text)) / len(own))
    assert H.Upstream([]).similarity(text) == 0.0


def test_on_a_table(spark):
    rows = [
        ("v", "a/vendor/x.go", "Added", False, HAND), ("v", "a/vendor/x.go", "Added", False, HAND), ("h", "a/x.go", "Modified", False, HAND), ("d", "a/vendor/x.go", "Deleted", False, HAND), ("b", "a/vendor/x.go", "Added", True, HAND), ("n", "a/vendor/x.go", "Added", False, None),
        ("e", "a/vendor/x.go", "Added", False, ""), ("p", None, "Added", False, HAND), ("t", "a/vendor/x.txt", "Added", False, HAND), ("s", "a/vendor/x.go", None, None, HAND), ("l", "a/x.js", "Added", False, "x = 1;\n" * 200_000),
    ]
    df = spark.createDataFrame(rows, "file_id string, new_path string, status string, is_binary boolean, new_source string").selectExpr("*", "'clash' as reason")
    up = spark.createDataFrame([("l", None), ("l", UPSTREAM)], "lib_name string, source string")
    assert {r.file_id for r in H.not_handwritten(df, up).collect()} >= {"v", "s", "b"}
    assert {r.file_id for r in H.not_handwritten(df, up).collect()} & {"h", "d", "n", "e", "p", "t"} == set()
    assert H.not_handwritten(df.limit(0), up.limit(0)).count() == 0
    assert H.not_handwritten(df).where("file_id = 'v'").count() == 1


def test_files_flagged_binary_are_found_by_their_flag(spark):
    rows = [("a", "a/x.go", "Added", True, None), ("m", "a/x.java", "Modified", True, ""), ("s", "a/x.py", None, True, None), ("d", "a/x.go", "Deleted", True, ""), ("t", "a/x.bin", "Added", True, None), ("e", "a/x.go", "Added", False, None), ("u", "a/x.go", "Added", None, "")]
    df = spark.createDataFrame(rows, "file_id string, new_path string, status string, is_binary boolean, new_source string")
    assert sorted(map(tuple, H.not_handwritten(df).collect())) == [("a", "binary", "flag"), ("m", "binary", "flag"), ("s", "binary", "flag")]


def test_uniform_lines_mark_files_of_any_length(shelf):
    cases = "".join(f"    if s == {i}: return t{i * 7 % 40}\n" for i in range(9000))
    assert H.layout("py", cases)["top"] == 9000 and H.layout("py", cases)["uniform"] == 1.0
    assert H.verdict("x.py", "def t(s):\n" + cases + "    return -1\n", shelf) == ("generated", "layout")
