"""Files that were not written by hand in the project: minified, generated, data or binary, copied from third parties.

Each file is lexed and emitted again in canonical layout, one statement, block edge or list item a line, and the layout that
it has is compared with that, line by line:

* *minified*: the canonical layout has many times the lines of the original, and those are long;
* *generated*: next to all canonical lines have one shape, over a long run, and the original breaks its lines where they do;
* *data*: literals and their separators are nearly all tokens; *binary*: many characters are no text at all.

Files whose layout is that of hand-written code are then looked at for what layout cannot show:

* *copied*: most word 5-shingles that tell a known upstream file apart are in the file, or the file carries another holder's
  licence header, or it lies under a folder for third-party code and does not claim to be the project's own;
* *generated*: the comment before the first code or after the last is a tool's banner, or its name or folder is one that tools
  give to their products.

The upstream files are a fixed small table; its size is checked before it is sent to the workers, and a larger one is refused.

Defined results
* a file flagged binary is *binary* by its flag, with or without text;
* other files with a null or empty source give no rows, nor do deleted files and other extensions; equal rows count once;
* banner words in strings, in comments between code, and in prose comments do not count;
* an empty or missing upstream table leaves the other tests; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftlens.llm import lexing

CODE = ("go", "java", "rs", "kt", "py", "js", "ts")
#: Share of an upstream file's telling shingles.  One edited word breaks five shingles, so 0.6 of the shingles is a file
#: with about nine words of ten unchanged; unrelated files have next to none of them.
SIMILAR = 0.6
#: Upstream text up to this many characters goes to the workers whole.
UPSTREAM_CHARS = 8_000_000

_WORDS = re.compile(r"\w+")
_HEAD = re.compile(r"""\A﻿?(?:\s+|\#![^\n]*\n|//[^\n]*|/\*(?s:.*?)\*/|\#(?!\[)[^\n]*|["']use strict["'];?)*""")
_FOOT = re.compile(r"""(?:\n[ \t]*(?://[^\n]*|\#[^\n]*|/?\*[^\n]*))+\s*\Z""")
_ANNOTATION = re.compile(r"(?m)^\s*@(?:javax?\.annotation\.(?:processing\.)?)?Generated\b|^\s*#\[(?:automatically_derived|generated)\]")
_BANNER = re.compile(
    r"""(?ix)
    @(?:auto-?)?generated\b | <auto-?generated | \bauto-?generated\b(?!\s+(?:ids?|rows?|names?|keys?|values?|numbers?)\b)
    | \b(?:code|file|source|class|module|this)\s+(?:is|was|has\s+been|were)?\s*(?:auto(?:matically)?[-\s]*)?generated\s+(?:by|from|with|using|on|via)\b
    | \bautomatically\s+generated\b | \bgenerated\s+(?:automatically|code|file)\b | ^[\s/*#-]*generated\s+(?:by|from|with|using|via)\b
    | \bdo\s+not\s+(?:edit|modify|change)\b[^\n]*\b(?:generated|by\s+hand|manually|will\s+be\s+(?:lost|overwritten))\b
    | \bgenerated\b[^\n]*\bdo\s+not\s+(?:edit|modify|change)\b | \bchanges\s+will\s+be\s+(?:lost|overwritten)\b
    | \bautomatisch\s+(?:erzeugt|generiert|erstellt)\b | \bg[ée]n[ée]r[ée]e?\s+automatiquement\b | \bgenerad[oa]\s+autom[áa]ticamente\b
    """,
    re.M,
)
_LICENCE = re.compile(r"(?i)copyright")
_GRANT = re.compile(r"(?i)SPDX-License-Identifier|licen[sc]ed\s+under|permission\s+is\s+hereby|redistribution\s+and\s+use|anyone\s+may\s+use|the\s+[\w.\- ]+\s+(?:authors|contributors|project|developers)\b|\b(?:MIT|Apache|BSD|Mozilla|GNU)\s+(?:public\s+)?licen[sc]e")
_OWN = re.compile(r"(?i)internal\s+use\s+only|proprietary|confidential")
#: Folders for third-party code; those whose name may as well be a matter of the project's own (its vendors, its externals)
#: count only where the file lies in a library's folder under them.
_FOREIGN_PATH = re.compile(
    r"(?i)(?:^|/)(?:(?:vendor|vendored|third[-_]?party|3rd[-_]?party|node_modules|bower_components|pods|carthage|site-packages|jspm_packages|godeps)/|(?:vendors|deps|externals?|extern)/(?:[^/]+/)+[^/]+$)"
)

#: Names and folders that tools give to what they make.
_GENERATED_PATH = re.compile(r"(?:^|/)generated/|(?:_pb2|_pb2_grpc|_generated|\.generated|\.gen|\.g|\.pb)\.[a-z]+$|(?:Grpc|Generated|OuterClass)\.(?:java|kt)$|(?:^|/)zz_generated\.")


def shingles(text: str) -> set[tuple[str, ...]]:
    w = _WORDS.findall(text)
    return set(zip(w, w[1:], w[2:], w[3:], w[4:]))


class Upstream:
    """Shingles that tell upstream files apart (in at most two of them) and how many each file has."""

    def __init__(self, sources: list[str]):
        every = [shingles(s) for s in dict.fromkeys(s for s in sources if s)]
        seen = Counter(g for s in every for g in s)
        self.of: dict[tuple[str, ...], list[int]] = {}
        self.size = [0] * len(every)
        for i, s in enumerate(every):
            own = {g for g in s if seen[g] <= 2} or s
            self.size[i] = len(own)
            for g in own:
                self.of.setdefault(g, []).append(i)

    def similarity(self, text: str) -> float:
        if not self.of:
            return 0.0
        w = _WORDS.findall(text)
        hits = self.of.keys() & set(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if not hits:
            return 0.0
        count: Counter = Counter()
        for g in hits:
            count.update(self.of[g])
        return max(n / self.size[i] for i, n in count.items())


class _Emit(dict):
    """Token -> its text in canonical layout, filled as tokens come: comments and spaces are left out, a line ends after
    ``; { } ,`` and at the line ends that are tokens of the language.  The original's line ends are kept as marks."""

    def __init__(self, lang: str):
        self.lang = lang

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        c = lexing.classes(self.lang, [token])
        if c == "N" or c and _INDENT.match(c):
            out = BREAK if self.lang in FREE else "\n" + BREAK
        elif not c:
            out = BREAK if "\n" in token and token.isspace() else ""
        else:
            out = token + ("\n" if c in ";{}," else " ")
        self[token] = out
        return out


#: Where the original has a line end, in text that is emitted again.
BREAK = "\x01"
_INDENT = re.compile(lexing.INDENTS)
_EMIT = {lang: _Emit(lang) for lang in CODE}
#: Languages whose line ends are spaces.
FREE = ("java", "rs")
_LINE_ENDS = re.compile(r"(?<=[;{},])|N")
_BREAKS = re.compile(f"\n[\n{BREAK}]*")


def layout(lang: str, text: str) -> dict[str, float]:
    """Measures of a file's layout against its canonical one."""
    split = lexing.tokens(lang, text)
    kinds = _INDENT.sub("N", lexing.classes(lang, split))
    if lang in FREE:
        kinds = kinds.replace("N", "")
    emitted = "".join(map(_EMIT[lang].__getitem__, split))
    canonical = sum(1 for line in emitted.replace(BREAK, "").split("\n") if line.strip())
    lines = max(1, sum(1 for line in text.split("\n") if line.strip()))
    # of the canonical line ends, those that the original has as well
    breaks = _BREAKS.findall(emitted)
    same = sum(BREAK in x for x in breaks) / max(1, len(breaks))
    shapes = Counter(x for x in _LINE_ENDS.split(kinds) if len(x) > 2)
    two = [n for _, n in shapes.most_common(2)]
    top = two[0] if two else 0
    # a run of two alternating shapes counts as well as one
    pair = sum(two) if len(two) == 2 and two[1] * 5 >= two[0] * 4 else top
    flat = kinds.replace("N", "")
    total = max(1, len(flat))
    literals = flat.count("s") + flat.count("n")
    rest = total - literals - flat.count(",") - flat.count("P")
    odd = sum(1 for c in text if c < " " and c not in "\n\r\t\f" or c in "�\x7f") if "�" in text or not text.isprintable() else 0
    literal_chars = sum(len(t) for t, k in zip(split, map(lexing.classes, repeat(lang), ([t] for t in split)), strict=True) if k in "sn" and k) if literals * 3 > total else 0
    return {
        "lines": lines, "canonical": canonical, "expansion": canonical / lines, "same": same, "line_length": len(text) / lines, "uniform": pair / max(1, sum(shapes.values())), "top": top,
        "literals": literals, "literal": literals / max(1, literals + rest), "literal_chars": literal_chars / max(1, len(text)), "odd": odd / max(1, len(text)),
    }


def by_layout(lang: str, text: str) -> str | None:
    """What a file's layout against its canonical one shows, or None where it is that of hand-written code."""
    m = layout(lang, text)
    if m["odd"] > 0.05:
        return "binary"
    if m["literals"] >= 40 and m["literal"] >= 0.85 or m["literals"] >= 15 and m["literal"] >= 0.6 and m["literal_chars"] >= 0.75:
        return "data"
    if m["expansion"] >= 6 and m["line_length"] >= 120:
        return "minified"
    if m["top"] >= 20 and m["uniform"] >= 0.75 and m["same"] >= 0.75:
        return "generated"
    return None


def verdict(path: str, text: str, upstream: Upstream) -> tuple[str, str] | None:
    """(why a file is not hand-written here, what shows it), or None."""
    if why := by_layout(lexing.extension(path), text):
        return why, "layout"
    if upstream.similarity(text) >= SIMILAR:
        return "copied", "shingles"
    head = _HEAD.match(text).group()
    own = _OWN.search(head)
    if _LICENCE.search(head) and _GRANT.search(head) and not own:
        return "copied", "licence"
    if _FOREIGN_PATH.search(path) and not own:
        return "copied", "folder"
    foot = _FOOT.search(text)
    if _BANNER.search(head) or foot and _BANNER.search(foot.group()) or _ANNOTATION.search(text):
        return "generated", "banner"
    if _GENERATED_PATH.search(path):
        return "generated", "name"
    return None


def not_handwritten(files: DataFrame, upstream: DataFrame | None = None) -> DataFrame:
    """file_id, reason, shown_by of the files that were not written by hand here."""
    ext = F.element_at(F.split(F.element_at(F.split("new_path", "/"), -1), r"\."), -1)
    text = F.when(~F.coalesce("is_binary", F.lit(False)), F.col("new_source"))
    todo = files.where("coalesce(status, '') <> 'Deleted' and (coalesce(is_binary, false) or length(new_source) > 0)").where(ext.isin(*CODE) & F.col("new_path").contains(".")).select("file_id", "new_path", text.alias("new_source"))
    known: list[str] = []
    if upstream is not None:
        size = upstream.agg(F.coalesce(F.sum(F.length("source")), F.lit(0))).first()[0]
        if size > UPSTREAM_CHARS:
            raise ValueError(f"the upstream table has {size} characters; it is meant to be a small, fixed one (at most {UPSTREAM_CHARS})")
        known = [r[0] for r in upstream.where("source is not null").select("source").orderBy("source").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelf = Upstream(known)
        for batch in batches:
            out = [(f, *why) for f, p, t in batch.itertuples(index=False, name=None) if (why := verdict(p, t, shelf) if t else ("binary", "flag"))]
            yield pd.DataFrame(out, columns=["file_id", "reason", "shown_by"])

    return todo.mapInPandas(run, T.StructType([files.schema["file_id"]]).add("reason", "string").add("shown_by", "string")).distinct()
