"""Declarations and references of Go, Java, Rust and Kotlin sources by a bracket-aware scan.

No parser is at hand, so a source is masked (strings and comments blanked, lengths kept), its brackets are matched, and
declarations are read at the places where the language allows them.  A source whose brackets do not match has no symbols,
as one that does not parse has none.  Rows count from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftlens.functions import text as X

_MASK = re.compile(r"""//[^\n]*|/\*(?s:.*?)\*/|r\#"(?s:.*?)"\#|\"\"\"(?s:.*?)\"\"\"|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,9}?)'""")
_NAME = r"[A-Za-z_]\w*"
_DECL = {
    "go": re.compile(rf"(?m)^func\s*(?:\(\s*\w*\s*\*?\s*(?P<owner>{_NAME})[^)]*\)\s*)?(?P<func>{_NAME})\s*[(\[]|^\s*type\s+(?P<type>{_NAME})\s+(?!=)"),
    "rust": re.compile(rf"(?m)\b(?:fn\s+(?P<func>{_NAME})|(?:struct|enum|union)\s+(?P<type>{_NAME})|trait\s+(?P<trait>{_NAME})|mod\s+(?P<mod>{_NAME})|macro_rules!\s*(?P<macro>{_NAME}))"),
    "java": re.compile(rf"(?m)\b(?:class|interface|enum|record)\s+(?P<type>{_NAME})|^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?:[\w.]+(?:<[^;{{}}]*?>)?(?:\[\])*\s+)(?P<func>{_NAME})\s*\([^;{{}}]*\)\s*(?:throws[^{{;]*)?[{{;]"),
    "kotlin": re.compile(rf"(?m)\b(?:class|interface|object)\s+(?P<type>{_NAME})|\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>.?]+\.)?(?P<func>{_NAME})\s*\("),
}
_IMPL = re.compile(rf"\bimpl\b(?:\s*<[^{{]*?>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<type>[\w:]+)")
_CALL = re.compile(rf"\b({_NAME})\s*(?:::<[^>]*>)?\(")
_TYPE = re.compile(r"\b([A-Z]\w*)\b")
_SUPER = {"java": re.compile(r"\b(?:extends|implements)\s+([\w.<>, ]+)"), "kotlin": re.compile(r"\b(?:class|object|interface)\s+\w+[^{:\n]*:\s*([\w.<>(), ]+)"), "rust": _IMPL}
# fixed values: words that are followed by a bracket without being calls
_NO_CALL = frozenset("if for while switch match when catch func fn fun return else synchronized super this new case do in go defer select range".split())
_NO_TYPE = frozenset(("Self",))


def mask(source: str) -> str:
    """Strings and comments as blanks, line ends and length kept."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def _brackets(masked: str) -> dict[int, int] | None:
    """Opening curly bracket -> closing one, or None where brackets of any kind do not match."""
    stack, ends = [], {}
    for m in re.finditer(r"[(){}\[\]]", masked):
        c = m.group()
        if c in "([{":
            stack.append((c, m.start()))
        else:
            if not stack or "([{".index(stack[-1][0]) != ")]}".index(c):
                return None
            o, at = stack.pop()
            if o == "{":
                ends[at] = m.start()
    return None if stack else ends


def scan(lang: str, source: str) -> tuple[list[dict], list[dict]] | None:
    """(symbols, references) of a source, or None where it does not hold together."""
    masked = mask(source)
    ends = _brackets(masked)
    if lang not in _DECL or ends is None:
        return None
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    row = lambda at: bisect_right(starts, at) - 1
    raw = []
    for m in _DECL[lang].finditer(masked):
        kind = next(k for k in ("func", "type", "trait", "mod", "macro") if k in m.groupdict() and m.group(k))
        name_at = m.start(kind)
        if lang == "java" and kind == "func" and re.match(r"\s*(?:return|new|throw|else)\b", m.group()):
            continue
        brace = masked.find("{", m.end() - 1)
        stop = re.compile(r"[;\n]").search(masked, m.end()) if lang == "go" and kind == "type" else re.compile(";").search(masked, m.end() - 1)
        close = ends.get(brace, -1) if brace >= 0 and not (stop and stop.start() < brace) else (stop.start() if stop else m.end())
        if lang == "kotlin" and brace >= 0 and "\n\n" in masked[m.end() : brace]:
            close = m.end()
        first = m.start() + (len(m.group()) - len(m.group().lstrip()))
        raw.append({"name": m.group(kind), "kind": kind, "start": first, "end": max(close, name_at), "decl": name_at, "owner": m.groupdict().get("owner")})
    blocks = []
    if lang == "rust":
        for m in _IMPL.finditer(masked):
            brace = masked.find("{", m.end())
            if brace in ends:
                blocks.append((m.start(), ends[brace], m.group("type").split("::")[-1], m.group("trait")))
    elif lang in ("java", "kotlin"):
        blocks = [(s["start"], s["end"], s["name"], None) for s in raw if s["kind"] == "type"]
    for s in raw:
        if s["owner"] is None and s["kind"] == "func":
            around = [b for b in blocks if b[0] < s["start"] and s["end"] <= b[1]]
            s["owner"] = min(around, key=lambda b: b[1] - b[0])[2] if around else None
    symbols = [{"name": s["name"], "kind": s["kind"], "owner": s["owner"], "start_row": row(s["start"]), "end_row": row(s["end"]), "decl_row": row(s["decl"])} for s in raw]
    symbols.sort(key=lambda s: (s["start_row"], s["end_row"] - s["start_row"], s["name"]))
    for i, s in enumerate(symbols):
        s["sym_idx"] = i

    # the innermost symbol of each row: wider ones are written first and narrower ones over them, of equal ones the first last
    innermost: list[dict | None] = [None] * len(starts)
    for s in sorted(symbols, key=lambda s: (s["start_row"] - s["end_row"], -s["sym_idx"])):
        innermost[s["start_row"] : s["end_row"] + 1] = [s] * (s["end_row"] + 1 - s["start_row"])

    declared = {s["decl"] for s in raw}
    refs = []

    def refer(bucket: str, ident: str, at: int) -> None:
        s = innermost[row(at)]
        if s:
            refs.append({"sym_idx": s["sym_idx"], "bucket": bucket, "ident": ident, "ref_row": row(at), "in_header": row(at) == s["start_row"]})

    for m in _CALL.finditer(masked):
        if m.group(1) not in _NO_CALL and m.start(1) not in declared:
            refer("call", m.group(1), m.start(1))
    header_rows = {s["start_row"] for s in symbols}
    for m in _TYPE.finditer(masked):
        if m.start(1) not in declared and m.group(1) not in _NO_TYPE and (lang != "rust" or row(m.start(1)) in header_rows):
            refer("type", m.group(1), m.start(1))
    if lang in ("java", "kotlin"):
        for m in _SUPER[lang].finditer(masked):
            for t in _TYPE.finditer(m.group(1)):
                refer("impl", t.group(1), m.start(1) + t.start(1))
    for lo, hi, name, trait in blocks if lang == "rust" else ():
        for ident in filter(None, (trait and trait.split("::")[-1],)):
            refs.extend({"sym_idx": s["sym_idx"], "bucket": "impl", "ident": ident, "ref_row": row(lo), "in_header": True} for s in symbols if row(lo) <= s["start_row"] and s["end_row"] <= row(hi) and s["name"] != name)
    seen = set()
    refs = [r for r in refs if (k := tuple(r.values())) not in seen and not seen.add(k)]
    return symbols, refs


SYMBOL = "sym_idx int, name string, kind string, owner string, start_row int, end_row int, decl_row int"
REF = "sym_idx int, bucket string, ident string, ref_row int, in_header boolean"


def parsed(files: DataFrame, source: str = "new_source") -> DataFrame:
    """file_id, symbols, refs of each source that holds together: both from one pass over it.

    Where both are needed, keep this table and take :func:`symbols_of` and :func:`references_of` from it.
    """
    symbol_names, ref_names = ([p.split(" ")[0] for p in x.split(", ")] for x in (SYMBOL, REF))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(f, x) for f, lang, s in b.itertuples(index=False, name=None) if (x := scan(lang, s))]
            rows = [(f, [tuple(r[n] for n in symbol_names) for r in x[0]], [tuple(r[n] for n in ref_names) for r in x[1]]) for f, x in found]
            yield pd.DataFrame(rows, columns=["file_id", "symbols", "refs"])

    held = files.select("file_id", X.language(F.col("new_path")).alias("lang"), F.col(source).alias("source")).where("lang is not null and length(source) > 0").distinct()
    schema = T.StructType([files.schema["file_id"]]).add("symbols", T.ArrayType(T.StructType.fromDDL(SYMBOL))).add("refs", T.ArrayType(T.StructType.fromDDL(REF)))
    return held.mapInPandas(run, schema)


def symbols_of(parsed_files: DataFrame) -> DataFrame:
    """Declarations of each file in order of place, width and name."""
    return parsed_files.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")


def references_of(parsed_files: DataFrame) -> DataFrame:
    """Calls, types and supertypes, each with the innermost symbol that holds it."""
    return parsed_files.select("file_id", F.explode("refs").alias("r")).select("file_id", "r.*")


def symbols(files: DataFrame, source: str = "new_source") -> DataFrame:
    return symbols_of(parsed(files, source))


def references(files: DataFrame, source: str = "new_source") -> DataFrame:
    return references_of(parsed(files, source))


def card_symbols(syms: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols as cards show them: rows from 1 and the trimmed line of the declaration."""
    src = files.select("file_id", X.source_lines(F.col("new_source")).alias("__l")).dropDuplicates(["file_id"])
    return syms.join(src, "file_id").select("file_id", "sym_idx", "name", (F.col("start_row") + 1).alias("start_line"), (F.col("end_row") + 1).alias("end_line"), X.strip(F.get("__l", F.col("decl_row"))).alias("decl"), (F.col("decl_row") + 1).alias("decl_line"))
