import ast
import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from riftlens.llm import grammar, lexing, syntax

GOOD = {
    "go": ['package a\n\nimport "fmt"\n\nfunc (s *T) F(x []int, m map[string]int) (int, error) {\n\tfor i, v := range x {\n\t\tif v > 1 && i != 2 {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch y := m["}"]; y {\n\tcase 1, 2:\n\t\treturn y, nil\n\tdefault:\n\t\tgo func() { fmt.Println(`a\n"`) }()\n\t}\n\treturn T{A: 1}.n, nil\n}\n', "package a\n\ntype I interface {\n\tF(int) error\n}\n\nvar x, y = 1, 'c'\n\nconst (\n\tA = iota\n\tB\n)\n"],
    "java": ['package a.b;\nimport java.util.*;\n@Ann("x")\npublic class A<T extends B> implements C, D {\n  private final List<Map<String, int[]>> x = new ArrayList<>();\n  enum E { ONE, TWO(2) { int f() { return 1; } }; E(int... n) {} }\n  int f(final int a, String... b) throws X {\n    for (int i = 0, j = 1; i < a; i++, j--) { if (i == 1) continue; else break; }\n    for (String s : b) System.out.println(s + "}" + \'{\');\n    try (R r = open()) { x.stream().map(y -> y.get(0)).forEach(this::g); } catch (A | B e) { throw e; } finally { }\n    return a > 1 ? (int) a : b[0].length();\n  }\n}\n'],
    "rs": ['use std::{fmt, io::{self, Read}};\n#[derive(Debug)]\npub struct A<\'a, T: Clone> where T: Copy { pub n: &\'a T }\nimpl<\'a, T> A<\'a, T> {\n    pub fn f(&mut self, x: Vec<u8>) -> Result<Option<i32>, E> {\n        let y = match x.len() { 0 => return Err(E::new("}")), 1 | 2 => { 5 } n if n > 3 => n as i32, _ => -1, };\n        for (i, v) in x.iter().enumerate() { if let Some(z) = v { println!("{}", z?); } else { break; } }\n        let c = |a: i32, b| a + b;\n        Ok(Some(c(1, y)))\n    }\n}\n'],
    "kt": ['package a\n\nimport a.b.C\n\n@Ann("x")\ndata class A(val x: Int, var y: List<String?> = listOf()) : B(x), C {\n    private val z by lazy { 5 }\n    fun f(a: Int?): Int {\n        val s = a?.let { it + 1 } ?: return 0\n        when (s) {\n            1, 2 -> g()\n            in 3..5 -> { h() }\n            else -> throw E("${s}")\n        }\n        for (i in 0 until 3) if (i == 1) continue else g()\n        return list.map { it.x }.filter { x -> x > 1 }.size\n    }\n}\n'],
    "js": ["import { a, b as c } from './x.js';\nexport default class A extends B {\n  static x = 1;\n  async f(a, { b = 1 }, ...c) {\n    const y = a ? [1, ...c] : { a, [b]: 2, get z() { return 1; } };\n    for (const [k, v] of y) if (k) await v; else continue;\n    label: while (true) { break label; }\n    return `x${y}` + /[/]}/g.test(b) ?? c?.d;\n  }\n}\nvar f=function(){return 1},g=(a)=>a*2;\nlet q = 1\nlet r = 2\n"],
    "ts": ["import type { A } from './a';\nexport interface B<T> extends C { x?: number; readonly y: T[]; f(a: string): void }\ntype U = 'a' | { b: number } | ((x: number) => string);\nexport function f<T>(a: T, b?: Map<string, Array<{ n: number }>>): Promise<T> {\n  const x = a as unknown as U;\n  let y: Array<{ name: string }> = [];\n  return new Promise<T>((r) => r(a!));\n}\nenum E { A = 1, B }\nabstract class D { private constructor(readonly x: number) { super(); } }\n"],
    "py": ["import a.b as c\nfrom . import (d,\n  e)\n\n@dec(1)\nasync def f(x: int = 1, *args, y, **kw) -> 'T':\n    \"\"\"doc\"\"\"\n    if (n := len(x)) > 1 and not y: return [i for i in x if i]\n    elif x: pass\n    else:\n        with a as b, c:\n            z = lambda q, *r: {**q, 'k': -1}\n    try:\n        x[1:2, ...] += 3 if y else 4\n    except (A, B) as e:\n        raise E from e\n    finally:\n        del x\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', " [] ", '"x"', "0"],
}
BAD = {
    "go": ["func A() {}\n", "package a\nfunc A() {\n", "package a\nx := 1\n", "package a\n<<<<<<< HEAD\n", "package a\nfunc A() { return ] }\n", 'package a\nvar s = "x\n', "# Title\n"],
    "java": ["int x;\nreturn 1;\n", "class A { void f() { int = 5; } }", "class A { void f() { x.y; } }", "class A {", "class A { }}", "class A { void f() { f() } }"],
    "rs": ["fn f() { let x = ; }", "return 1;", "fn f() { match x { 1 => } }", "fn f( {}", "<<<<<<< a\nfn f() {}", "struct A { x u8 }"],
    "kt": ["return 1\n", "class A { fun f( { } }", "fun f() { val = 1 }", "shipment val x = 1", "class A {\n=======\n}\n"],
    "js": ["return 1;", "function f() {", "let let = ;", "if (x) { return 1; }", "a b c", "export const = 1;", "x = 'a\n'", "<!DOCTYPE html>"],
    "ts": ["interface A { x: }", "return 1;", "const x: = 1;", "function f(a: ) {}", "<<<<<<< ours\nlet a = 1;"],
    "py": ["def f():\nreturn 1\n", "  x = 1\n", "if x\n    y\n", "x = (1\n", "else:\n    x\n", "print 'x'\n", "x = 1\n    y = 2\n", "def f():\n    x\n  y\n", "def f():\n"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "[1 2]", "NaN", "01", '{"a"}', '"a\nb"', "﻿{}", "// c\n{}", "{} {}"],
}


@pytest.mark.parametrize("lang, text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_good_sources_parse(lang, text):
    assert syntax.parses(lang, text)


@pytest.mark.parametrize("lang, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_bad_sources_do_not(lang, text):
    assert not syntax.parses(lang, text)


def exact(lang, text):
    try:
        if lang == "json":
            json.loads(text, parse_constant=lambda x: 1 / 0)
        else:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "x", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
        return True
    except (SyntaxError, ValueError, ZeroDivisionError):
        return False


@pytest.mark.parametrize("lang", ["py", "json"])
def test_cut_and_broken_sources_against_the_real_parser(lang):
    """Truncations and single edits of good sources: at least 95 of 100 verdicts are those of the real parser."""
    rng, same, n = random.Random(5), 0, 0
    for text in GOOD[lang] * 8:
        for _ in range(12):
            at = rng.randrange(len(text) + 1)
            t = rng.choice([text[:at], text[at:], text[:at] + rng.choice(["(", "}", "\n", ",", '"', "x "]) + text[at:], text[:at] + text[at + 3 :]])
            n += 1
            same += syntax.parses(lang, t) == exact(lang, t)
    assert same >= 0.95 * n, (same, n)


def test_every_accepted_pair_is_permissible():
    for lang, texts in GOOD.items():
        allowed = grammar.permissible(lang)
        for t in texts:
            assert {chr(p >> 16) + chr(p & 0xFFFF) for p in syntax.adjacent(lang, grammar.terminate(lang, syntax.class_string(lang, t)))} <= allowed


def test_on_a_table(spark):
    rows = [
        ("good", "r", "a/x.py", False, "x = 1\n"), ("bad", "r", "x.py", False, "x = (\n"), ("bad", "r", "x.py", False, "x = (\n"), ("bin", "r", "x.py", True, "x = ("), ("null", "r", "x.py", False, None), ("empty", "r", "x.py", False, ""),
        ("nopath", "r", None, False, "x = ("), ("noext", "r", "Makefile", False, "x = ("), ("other", "r", "x.txt", False, "x = ("), ("nullbin", "r", "x.py", None, "x = ("), ("dot", "r", "a.py/x", False, "x = ("), ("norepo", None, "x.json", False, "{"),
        ("long", "r", "x.js", False, "x = [" + "1," * 60_000 + "1];\n"), ("deep", "r", "x.json", False, "[" * 300 + "]" * 300),
    ]
    df = spark.createDataFrame(rows, "file_id string, repo_path string, new_path string, is_binary boolean, new_source string").withColumn("lang", F.lit("clash")).withColumn("pair", F.lit(0))
    assert sorted(r[0] for r in syntax.broken(df).collect()) == ["bad", "norepo"]
    rates = {(r.repo_path, r.lang): (r.files, r.broken) for r in syntax.broken_rates(df).collect()}
    assert rates[("r", "py")] == (2, 1) and rates[(None, "json")] == (1, 1)
    assert syntax.broken(df.limit(0)).count() == 0


def test_lexer_splits_whole_text():
    for lang, texts in (GOOD | {"rs": [*GOOD["rs"], "\x00\ufffd'"]}).items():
        for t in texts:
            assert "".join(lexing.tokens(lang, t)) == t


@pytest.mark.parametrize("lang, text", [("js", "for (a; b; c%s) { d(); }"), ("ts", "for (a; b; c%s) { d(); }"), ("java", "class A { void f() { for (g(); g(); g()%s) { d(); } } }"), ("go", "package a\n\nfunc f() {\n\tfor g(); g(); g()%s {\n\t\td()\n\t}\n}\n")])
def test_headers_have_a_fixed_number_of_clauses(lang, text):
    assert syntax.parses(lang, text % "")
    assert not any(syntax.parses(lang, text % more) for more in (";", "; a;", "; a; a;"))
