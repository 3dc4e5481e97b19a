"""Credentials in source code and configuration: finding their places and masking them.

A dictionary automaton (Aho-Corasick) reads each text once and stops at what may begin a secret.  Token formats, key armor
and connection strings are one deterministic automaton of their grammars (:mod:`riftlens.llm.automata`), which is led on from
there to the end of the secret, however long it is.  Names that hold secrets, authentication schemes and calls say what the
literal after them is for; their short grammars are matched in place.  What is found is a secret only where its value could be
a working one (:func:`secretlike`).

Lines of a diff are scanned in overlapping chunks of a file's lines, each side of the diff for itself, so that a name and
its value may stand on different lines and no task holds a large file.  Places are absolute (file, line), so what two
chunks or both sides find is the same row once.

Defined results
* null and empty lines and texts hold nothing; null kinds count as context; repeated rows count once;
* a key block is found at the line of its opening mark, any other secret where its literal begins, in pieces or whole;
* masking replaces the characters of the secret only: quotes, names and line ends stay, and a text without secrets is
  returned as it is (null stays null);
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from riftlens.llm.automata import Automaton

CHUNK, OVERLAP = 1024, 96

#: Words that end the name of a value that is a secret.
NOUNS = (
    "password", "passwd", "passphrase", "pwd", "pw", "pass", "secret", "token", "credential",
    "apikey", "api_key", "api-key", "api.key", "api key", "accesskey", "access_key", "access-key", "access.key", "access key",
    "signingkey", "signing_key", "signing-key", "signing.key", "privatekey", "private_key", "private-key", "private.key",
    "secretkey", "secret_key", "secret-key", "secret.key", "encryptionkey", "encryption_key", "encryption-key", "encryption.key",
    "masterkey", "master_key", "master-key", "master.key", "authkey", "auth_key", "auth-key", "auth.key", "accountkey", "account_key", "sharedkey", "shared_key",
)
SHORT = frozenset(("pw", "pwd", "pass"))
CALLS = ("authenticate(", "signin(", "sign_in(", "login(", "log_in(", "connect(", "credentials(", "basicauth(", "basic_auth(", "setcredentials(", "bind(", "logon(")
SCHEMES = ("bearer ", "token ", "basic ")
FORMATS = ("akia", "asia", "eyj", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "_live_", "-pat-", "npm_", "aiza")

_PLACEHOLDER = re.compile(
    r"(?i)\$\{|\$\(|\{\{|^\$\w+$|^<.*>$|^\{.*\}$|^%.*%$|%[sd(]|<[\w -]+>|\*{3}|x{4}|\.{3}|…|\bxxx\b|redacted|example|change.?me|change.?it|placeholder|dummy|your[-_ ]|^todo|fixme|^none$|^null$|^n/a$|insert|replace|set[-_ ]me|masked|hidden|fake|sample"
)
_ENV_NAME = re.compile(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$")
_WORDS = re.compile(r"^[A-Za-z]?[a-z]+([-_./ :][A-Za-z]?[a-z]+)*$")
_PATH = re.compile(r"^(?:\w+:)?(?:/?[a-z][a-z0-9_-]*)(?:/[a-z0-9_.-]+)+$")
_CAMEL = re.compile(r"^[a-z]+(?:[A-Z][a-z]+)+$|^(?:[A-Z][a-z]+)+$")

_STRING = r"""(?:[rbuf]{0,2}\#?(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)\#?)"""
_PIECES = re.compile(rf"{_STRING}(?:\s*\+?\s*{_STRING})*")
_PIECE = re.compile(_STRING)
_ASSIGN = re.compile(r"""["'`\]]{0,2}[ \t]*(?:\?)?(?::[ \t]*&?(?:'static[ \t]+)?(?:str|[Ss]tring|String\?|&'static str)[ \t]*=|:=|=>|->|=(?![=>~])|:(?![:=]))\s*(?:\(\s*)?(?:new\s+String\s*\(\s*)?""")
_BARE = re.compile(r"""["'`\]]{0,2}[ \t]*(?:=|:)[ \t]*([^\s"'`,;(){}<>$\[\]]{6,})(?=[ \t]*(?:\r?$|["']))""", re.M)
_PAIR_CALL = re.compile(rf"\s*{_STRING}\s*,\s*(?={_STRING})")
_KEYED_CALL = re.compile(rf"""["']\s*,\s*(?={_STRING})""")
_NAMED = re.compile(r"""[ \t]+(?:is[ \t]+|was[ \t]+)?([`'"])([^`'"\s]{10,})\1""")
_FLAG = re.compile(r"""(?:=|[ \t]+)(['"]?)([^\s'"`]{6,})\1(?=\s|$)""")
_ENV = re.compile(r"=([^\s\"'`$<>(){};,]{6,})(?=[ \t])")
_USER = re.compile(r"""[ \t=]*[\w.@-]+:(['"]?)([^\s'"`$<>]{4,})\1(?=\s|$|['"])""")
_SCHEME_VALUE = re.compile(r"[ ]*([A-Za-z0-9+/=._~\-]{14,})")
_SQL = re.compile(r"(?i)\s+(?:=\s*)?'([^'\n]+)'")
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"""(?:\\[nr]|[\s"'`+,\\]|(?:Proc-Type|DEK-Info|Comment|Version):[^\n]*|^[+\- ]|//|\#)*([A-Za-z0-9+/=]{20,})""")
_RUN = re.compile(r"[A-Za-z0-9+/=]{12,}")
#: The grammars of secrets that show what they are, whatever stands around them.
GRAMMARS = {
    "cloud": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "token": r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|gh[pos]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}|xox[bp]-[\w-]{20,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{35}|[a-z]{2,6}(?:_live_|-pat-)[A-Za-z0-9]{14,}",
    "armor": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    "url": r"""://[^\s/:@"'`<>{}$]*:[^\s@"'`/{}]+@""",
}
_LOGIN_PROSE = re.compile(r"(?i)\s*(?:is|as)\s+`?[\w.@-]+`?\s+(?:with|and|/)\s+`?([^\s`,;]+?)`?[.,;]?(?=\s|$)")


def secretlike(value: str) -> bool:
    """Whether a literal could be a working secret rather than a placeholder, a name, a path or a label."""
    if len(value) < 6 or re.search(r"\s", value) or _PLACEHOLDER.search(value):
        return False
    if _ENV_NAME.match(value) or _WORDS.match(value) or _PATH.match(value) or _CAMEL.match(value) or len(set(value)) < 4:
        return False
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^\sA-Za-z0-9]"))
    return classes >= 2 and not re.fullmatch(r"[0-9.,:/+-]+", value)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("noun", NOUNS), ("call", CALLS), ("scheme", SCHEMES), ("format", FORMATS), ("url", ("://",)), ("armor", ("-----begin ",)), ("sql", ("identified by", "login password", "with password")), ("prose", ("login", "log in", "logged in")), ("user", (" -u ", " --user ", " --user=", " -u'"))):
        for w in words:
            kinds = (*a.get(w, ()), (kind, len(w)))
            a.add_word(w, kinds)
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def grammars() -> Automaton:
    return Automaton(GRAMMARS)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _value_before(text: str, noun: int) -> tuple[int, int] | None:
    """The span of the value in ``value (noun)`` and ``value (the noun)``, the noun at ``noun``."""
    at = noun
    if text[at - 1 : at] == " ":
        at -= 1
        while at and text[at - 1].isascii() and text[at - 1].islower():
            at -= 1
    if at < 2 or text[at - 2 : at] != " (":
        return None
    end = start = at - 2
    while start and not text[start - 1].isspace() and text[start - 1] not in "\"'`()":
        start -= 1
    return (start, end) if end - start >= 10 else None


def _quoted_name(text: str, at: int) -> bool:
    """Whether what stands before ``at`` is the beginning of a quoted name."""
    while at and (_word(text[at - 1]) or text[at - 1] in ".- "):
        at -= 1
    return text[at - 1 : at] in ("'", '"')


def _flagged(text: str, at: int) -> bool:
    """Whether what stands before ``at`` is the beginning of a command-line flag."""
    begin = at
    while begin and (_word(text[begin - 1]) or text[begin - 1] == "-"):
        begin -= 1
    return text[begin : begin + 1] == "-" and begin < at and (begin == 0 or text[begin - 1].isspace())


def _lower(text: str) -> str:
    low = text.lower()
    # a few letters change their length in lower case; offsets must stay
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _literal(text: str, at: int) -> tuple[str, list[tuple[int, int]]] | None:
    """The joined value of the string pieces at ``at`` and the span of each piece's content."""
    m = _PIECES.match(text, at)
    if not m:
        return None
    spans, value = [], []
    for p in _PIECE.finditer(text, m.start(), m.end()):
        raw = p.group()
        q = next(i for i, c in enumerate(raw) if c in "\"'`")
        end = raw.rindex(raw[q])
        spans.append((p.start() + q + 1, p.start() + end))
        value.append(raw[q + 1 : end])
    return "".join(value), spans


def scan(text: str) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(start, kind, spans to mask) of every secret; starts are where the literal or the armor begins."""
    found: dict[int, tuple[str, list[tuple[int, int]]]] = {}

    def keep(kind: str, spans: list[tuple[int, int]], start: int | None = None) -> None:
        found.setdefault(spans[0][0] if start is None else start, (kind, spans))

    for last, kinds in automaton().iter(_lower(text)):
        end = last + 1
        for kind, size in kinds:
            start = end - size
            if kind == "noun":
                after = text[end : end + 1]
                if after.isalnum() or after == "_" or (after == "s" and size > 3):
                    continue
                before = text[start - 1 : start]
                if text[start:end].lower() in SHORT and before.isalnum() and not (text[start].isupper() and before.islower()):
                    continue
                if after == ")" and (span := _value_before(text, start)):
                    if secretlike(value := text[slice(*span)]) and re.search(r"\d", value):
                        keep("token", [span])
                    continue
                m = _ASSIGN.match(text, end)
                if m and (lit := _literal(text, m.end())):
                    value = lit[0]
                    bare = re.sub(r"(?i)^(?:bearer|token|basic)\s+", "", value)
                    if secretlike(bare):
                        keep("password" if "pass" in text[start:end].lower() or "pw" in text[start:end].lower() else "token", lit[1])
                    continue
                if (m := _KEYED_CALL.match(text, end)) and _quoted_name(text, start) and (lit := _literal(text, m.end())):
                    if secretlike(lit[0]) and re.search(r"\d", lit[0]):
                        keep("token", lit[1])
                    continue
                if m := _BARE.match(text, end):
                    value = m.group(1)
                    if secretlike(value) and re.search(r"\d|[^\w.\-]", value) and re.search("[A-Za-z]", value) and not value.endswith((".", ":")):
                        keep("password" if "p" == text[start].lower() else "token", [m.span(1)])
                    continue
                if m := _SQL.match(text, end):
                    if secretlike(m.group(1)):
                        keep("password", [m.span(1)])
                    continue
                if (m := _NAMED.match(text, end)) and secretlike(m.group(2)) and re.search(r"\d", m.group(2)) and (len(m.group(2)) >= 16 or re.search(r"[^\w.\-/]", m.group(2))):
                    keep("token", [m.span(2)])
                    continue
                m = _FLAG.match(text, end) if _flagged(text, start) else _ENV.match(text, end) if text[start].isupper() else None
                if m and secretlike(m.group(m.lastindex)) and re.search(r"\d|[^\w.\-/]", m.group(m.lastindex)):
                    keep("password", [m.span(m.lastindex)])
            elif kind == "user":
                if (m := _USER.match(text, end)) and secretlike(m.group(2)):
                    keep("password", [m.span(2)])
            elif kind == "url":
                if m := grammars().longest(text, start):
                    first, stop = text.index(":", end) + 1, m[1] - 1
                    value, host = text[first:stop], text[stop + 1 : stop + 2]
                    if (_word(host) or host in (".", "[", "-")) and len(value) >= 4 and not _PLACEHOLDER.search(value) and not _ENV_NAME.match(value) and not value.startswith("$") and value.lower() not in ("pass", "password", "passwd", "pwd", "secret"):
                        keep("url", [(first, stop)])
            elif kind == "armor":
                if (m := grammars().longest(text, start)) and (b := _BODY.match(text, m[1])):
                    stop = _ARMOR_END.search(text, m[1])
                    limit = stop.start() if stop else b.end()
                    keep("key", [r.span() for r in _RUN.finditer(text, m[1], max(limit, b.end()))] or [b.span(1)], start)
            elif kind == "scheme":
                before = text[start - 1 : start]
                if not before.isalnum() and (m := _SCHEME_VALUE.match(text, end)) and secretlike(m.group(1)) and re.search(r"\d", m.group(1)) and re.search("[A-Za-z]", m.group(1)) and (before in "\"'`" or text[max(0, start - 2) : start].strip() == ":"):
                    keep("token", [m.span(1)])
            elif kind == "format":
                begin = start
                if text[start:end].lower() in ("_live_", "-pat-"):
                    # the vendor's letters stand before
                    while begin and start - begin < 6 and "a" <= text[begin - 1] <= "z":
                        begin -= 1
                m = grammars().longest(text, begin)
                if m and m[0] in ("cloud", "token") and not _word(text[begin - 1 : begin]) and not (m[0] == "cloud" and _word(text[m[1] : m[1] + 1])) and secretlike(text[begin : m[1]]):
                    keep("token", [(begin, m[1])])
            elif kind == "call":
                if (m := _PAIR_CALL.match(text, end)) and (lit := _literal(text, m.end())) and secretlike(lit[0]) and "://" not in lit[0]:
                    keep("password", lit[1])
            elif kind == "sql":
                if (m := _SQL.match(text, end)) and secretlike(m.group(1)):
                    keep("password", [m.span(1)])
            elif kind == "prose" and (m := _LOGIN_PROSE.match(text, end)):
                if secretlike(m.group(1)) and re.search(r"\d|[^\w.\-]", m.group(1)):
                    keep("password", [m.span(1)])
    out: list[tuple[int, str, list[tuple[int, int]]]] = []
    covered = -1
    for start in sorted(found):
        kind, spans = found[start]
        # what lies within a span that is already masked is part of that secret
        if spans[0][0] < covered and start < covered:
            continue
        out.append((start, kind, spans))
        covered = max(covered, spans[-1][1])
    return out


def masked(text: str | None, mask: str = "REDACTED") -> tuple[str | None, int]:
    """The text with its secrets masked, and how many they are."""
    if not text:
        return text, 0
    hits = scan(text)
    parts, at = [], 0
    for s, e, i, kind in sorted((s, e, i, kind) for _, kind, pieces in hits for i, (s, e) in enumerate(pieces)):
        if s < at:
            continue
        parts += [text[at:s], mask if i == 0 or kind == "key" else ""]
        at = e
    return "".join([*parts, text[at:]]), len(hits)


def redact(text: str | None, mask: str = "REDACTED") -> str | None:
    return masked(text, mask)[0]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows grouped by (file, chunk); the rows come sorted, and a group may reach over several batches."""
    key, rows = None, []
    for batch in batches:
        for f, c, n, kind, content in zip(*(batch[x].tolist() for x in ("file_id", "chunk", "line_seq", "kind", "content")), strict=True):
            if (f, c) != key:
                if rows:
                    yield key, rows
                key, rows = (f, c), []
            rows.append((n, kind, content))
    if rows:
        yield key, rows


def _sides(rows: list[tuple]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(start of each line, its line_seq, its content) of both sides of the diff lines, a line_seq once."""
    sides = [[r for r in rows if r[1] != "del"]]
    if len(sides[0]) < len(rows):
        sides.append([r for r in rows if r[1] != "add"])
    for side in sides:
        starts, lines, numbers, at, seen = [], [], [], 0, None
        for n, _, content in side:
            if n == seen:
                continue
            seen = n
            content = content or ""
            starts.append(at)
            lines.append(content)
            numbers.append(n)
            at += len(content) + 1
        yield starts, numbers, lines


def scan_lines(rows: list[tuple]) -> set[tuple[int, str]]:
    """(line_seq, kind of secret) over both sides of the diff lines (line_seq, kind, content), sorted by line_seq."""
    hits: set[tuple[int, str]] = set()
    for starts, numbers, lines in _sides(rows):
        hits.update((numbers[bisect_right(starts, start) - 1], kind) for start, kind, _ in scan("\n".join(lines)))
    return hits


def line_spans(sides: list[tuple[list[int], list[int], list[str]]], mask: str = "REDACTED") -> tuple[dict[int, set[tuple[int, int, str]]], set[tuple[int, int]]]:
    """line_seq -> (from, to, what stands there instead), and (line_seq, from) of each secret; what both sides have is there once."""
    spans: dict[int, set[tuple[int, int, str]]] = {}
    hits: set[tuple[int, int]] = set()
    for starts, numbers, lines in sides:
        for start, kind, pieces in scan("\n".join(lines)):
            first = bisect_right(starts, start) - 1
            hits.add((numbers[first], start - starts[first]))
            for i, (s, e) in enumerate(pieces):
                put = mask if i == 0 or kind == "key" else ""
                at = bisect_right(starts, s) - 1
                while at < len(starts) and starts[at] < e:
                    a, b = max(s - starts[at], 0), min(e - starts[at], len(lines[at]))
                    if a < b:
                        spans.setdefault(numbers[at], set()).add((a, b, put))
                        put = mask if kind == "key" else ""
                    at += 1
    return spans, hits


def splice(text: str, spans: set[tuple[int, int, str]]) -> str:
    """The text with its spans replaced; spans that overlap are one."""
    parts, at, put = [], 0, ""
    for s, e, p in sorted(spans):
        if s < at:
            put = put or p
        else:
            parts += [put, text[at:s]]
            put = p
        at = max(at, e)
    return "".join([*parts, put, text[at:]])


def find_in_lines(lines: DataFrame) -> DataFrame:
    """file_id, line_seq, kind of secret, over diff lines (file_id, line_seq, kind, content)."""
    own = F.floor(F.col("line_seq") / CHUNK).cast("int")
    into = F.when((F.col("line_seq") % CHUNK < OVERLAP) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = lines.where("line_seq is not null").select("file_id", F.explode(into).alias("chunk"), "line_seq", "kind", "content")
    spread = spread.repartition("file_id", "chunk").sortWithinPartitions("file_id", "chunk", "line_seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (file_id, _), rows in _chunks(batches):
            out.extend((file_id, n, kind) for n, kind in scan_lines(rows))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["file_id", "line_seq", "secret_kind"])
                out = []
        yield pd.DataFrame(out, columns=["file_id", "line_seq", "secret_kind"])

    schema = T.StructType([lines.schema["file_id"]]).add("line_seq", "integer").add("secret_kind", "string")
    return spread.mapInPandas(run, schema).distinct()


def redact_lines(lines: DataFrame) -> DataFrame:
    """file_id, line_seq, kind, redacted, n_secrets (that begin on the line), over diff lines (file_id, line_seq, kind, content).

    A file's lines are read together, so that a value or a key block is masked whole, however many lines it or the other
    side's lines between take.  A line without line_seq has no place in its file and is masked by itself.
    """
    whole = lines.select("file_id", F.lit(0).alias("chunk"), "line_seq", "kind", "content").repartition("file_id").sortWithinPartitions("file_id", "line_seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "line_seq", "kind", "redacted", "n_secrets"]
        out: list[tuple] = []
        for (file_id, _), group in _chunks(batches):
            rows = list(dict.fromkeys((None if n is None or n != n else int(n), kind, content) for n, kind, content in group))
            placed = [r for r in rows if r[0] is not None]
            sides = list(_sides(placed))
            spans, hits = line_spans(sides)
            begin = Counter(n for n, _ in hits)
            read = {n: c for _, numbers, lines in sides for n, c in zip(numbers, lines, strict=True)}
            for n, kind, content in rows:
                if content and n is not None and content == read[n]:
                    out.append((file_id, n, kind, splice(content, spans.get(n, set())), begin[n]))
                else:
                    out.append((file_id, n, kind, *masked(content)))
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=columns).astype({"line_seq": "Int32"})
                    out = []
        yield pd.DataFrame(out, columns=columns).astype({"line_seq": "Int32"})

    schema = T.StructType([lines.schema["file_id"]]).add("line_seq", "integer").add("kind", "string").add("redacted", "string").add("n_secrets", "integer")
    return whole.mapInPandas(run, schema)


def redacted(text: str | Column) -> Column:
    """struct(redacted, n_secrets) of a text column."""

    @pandas_udf("struct<redacted:string,n_secrets:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([masked(t) for t in texts], columns=["redacted", "n_secrets"])

    return run(text)
