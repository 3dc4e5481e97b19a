"""Lexing source text into strings of token classes, one character a token.

A language's lexer is one regular expression that splits the text and one memo that gives each distinct token its class,
so a file costs a C-level split and a table look-up per token.  The class string is what later stages work on: adjacent
pairs, line shapes and bracket reductions are all string operations on it.

Classes: ``i`` name, ``n`` number, ``s`` string, character or regular expression, ``N`` line end, ``E`` not a token of the
language (an unclosed string or comment, a stray character); brackets, ``, ; : .`` stand for themselves; operators and
keywords have the characters of :data:`OPERATORS` and :func:`keyword`.
"""

from __future__ import annotations

import re
from functools import lru_cache

LANGUAGES = ("go", "java", "rs", "kt", "py", "js", "ts", "json")

KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "rs": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "kt": "as break class continue do else import false for fun if in interface is null object package return super this throw true try typealias typeof val var when while",
    "py": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "js": "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null return super switch this throw true try typeof var void while with yield async await of static get set",
}
KEYWORDS["ts"] = KEYWORDS["js"] + " interface type enum namespace declare abstract implements private protected public readonly as is keyof infer unique satisfies"
KEYWORDS["json"] = "true false null"

#: Words that are modifiers in front of a declaration and names elsewhere; their class is ``m``.
SOFT = {"kt": frozenset("private public internal protected override open abstract final sealed data enum annotation inner lateinit const companion suspend inline tailrec operator infix external noinline crossinline reified vararg value expect actual".split())}

#: Operator spellings by class.
OPERATORS = {
    "U": ("++", "--"), "P": ("+", "-"), "!": ("!", "~"), "*": ("*",), "&": ("&",), "<": ("<",), ">": (">",), "|": ("|",),
    "Y": ("&&",), "O": ("||",),
    "B": ("==", "!=", "===", "!==", "<=", ">=", "^", "/", "%", "**", "??", "<<", "?:", "&^", "//"),
    "A": ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "&&=", "||=", "??=", "**=", "&^=", "//="),
    "W": (":=",), "R": ("->", "<-"), "F": ("=>",), "D": ("::",), "T": ("..", "...", "..=", "..<"), "Q": ("!!",),
    "=": ("=",), "?": ("?",), ".": (".", "?."), "@": ("@",), "#": ("#",), "$": ("$",),
}
_OP = {spelling: c for c, group in OPERATORS.items() for spelling in group}


@lru_cache(maxsize=None)
def keyword(word: str) -> str:
    """The class character of a keyword, the same in all languages."""
    words = sorted({w for text in KEYWORDS.values() for w in text.split()})
    return chr(0x100 + words.index(word))


_IDENT = r"[^\W\d]\w*"
_NUMBER = r"0[xX][0-9a-fA-F_]+\w*|0[bB][01_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?\w*"
_DQ = r'"(?:[^"\\\n]|\\.)*+"'
_SQ = r"'(?:[^'\\\n]|\\.)*+'"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*(?s:.*?)\*/"
_TRIPLE = r'"""(?s:(?:[^\\]|\\.)*?)"""'
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*+`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};+~^%<>])|(?<=[=(,:\[!&|?{};+~^%<>] )|(?<=return ))/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_OPS = {
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|&\^",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<",
    "rs": r"<<=|>>=|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<",
    "kt": r"===|!==|\.\.<|\.\.|->|::|\?\.|\?:|!!|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=",
    "js": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|\*\*|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<",
    "py": r"\*\*=|//=|<<=|>>=|\.\.\.|:=|->|\*\*|//|<<|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=",
    "json": r"",
}
_OPS["ts"] = _OPS["js"]

_PATTERNS = {
    "go": rf"[^\S\n]+|{_IDENT}|\n\s*|{_LINE}|{_BLOCK}|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|{_NUMBER}|{_OPS['go']}|.",
    "java": rf"\s+|{_IDENT}|{_LINE}|{_BLOCK}|{_TRIPLE}|{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|{_NUMBER}|{_OPS['java']}|.",
    "rs": rf"""\s+|b?r\#\#"(?s:.*?)"\#\#|b?r\#"(?s:.*?)"\#|b?r"[^"]*"|b?"(?s:(?:[^"\\]|\\.)*+)"|b'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|'{_IDENT}|{_IDENT}|{_LINE}|{_BLOCK}|{_NUMBER}|{_OPS['rs']}|.""",
    "kt": rf"[^\S\n]+|{_IDENT}|\n\s*|{_LINE}|{_BLOCK}|{_TRIPLE}|{_DQ}|`[^`\n]+`|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|{_NUMBER}|{_OPS['kt']}|.",
    "js": rf"[^\S\n]+|[$]?{_IDENT}|[$][\w$]*|\n\s*|{_LINE}|{_BLOCK}|{_REGEX}|{_DQ}|{_SQ}|{_TEMPLATE}|{_NUMBER}|{_OPS['js']}|.",
    "py": rf"""[^\S\n]+|\\\n|(?i:[rbuf]|br|rb|fr|rf)?(?:{_TRIPLE}|'''(?s:(?:[^\\]|\\.)*?)'''|{_DQ}|{_SQ})|{_IDENT}|\r?\n[ \t\f]*|\#[^\n]*|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*|{_NUMBER}|{_OPS['py']}|.""",
    "json": r"""[ \t\r\n]+|"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z_]\w*|(?s:.)""",
}
_PATTERNS["ts"] = _PATTERNS["js"]

_GOOD_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?:[uUlLfFdDjJn]{0,2}|[iuf](?:8|16|32|64|128|size)|_?[iuf](?:8|16|32|64|128|size))$")


#: In Python a line end has the class of the next line's indentation: this base and the width.
INDENT = 0xE800
INDENTS = f"[{chr(INDENT)}-{chr(INDENT + 0x3FF)}]"


def indent(line_end: str) -> str:
    return chr(INDENT + min(0x3FF, len(line_end.lstrip("\r\n").expandtabs(8))))


class _Classes(dict):
    """Token -> class, filled as tokens come; emptied when it has grown large."""

    def __init__(self, lang: str):
        self.lang = lang
        self.words = {w: keyword(w) for w in KEYWORDS[lang].split()}

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:
            self.clear()
        c = self[t] = self.classify(t)
        return c

    def classify(self, t: str) -> str:
        lang, c = self.lang, t[0]
        if lang == "json":
            if c in " \t\r\n":
                return ""
            if c == '"':
                return "s" if len(t) > 1 else "E"
            if c in "-0123456789":
                return "n" if len(t) > 1 or c != "-" else "E"
            return self.words.get(t) or (c if c in "{}[],:" and len(t) == 1 else "E")
        if c == "\n" or t[:2] == "\r\n":
            return indent(t) if lang == "py" else "N"
        if c.isspace():
            return "" if c in " \t\r\f\v\xa0﻿" or lang != "py" else "E"
        if t == "\\\n":
            return ""
        if lang == "py" and c == "#" or lang != "py" and t[:2] == "//":
            return ""
        if lang != "py" and t[:2] == "/*":
            return "E" if len(t) < 4 else ""
        if len(t) > 1 and t[-1] in "\"'`" or t.endswith('"#'):
            return "i" if lang == "kt" and c == "`" else "s"
        if c in "\"'`":
            return "L" if lang == "rs" and c == "'" and len(t) > 1 else "E"
        if c == "/" and len(t) > 1 and t not in _OP:
            return "s"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return "n" if c == "." or _GOOD_NUMBER.match(t) else "E"
        if c.isalpha() or c in "_$":
            if t in SOFT.get(lang, ()):
                return "m"
            return self.words.get(t) or ("$" if t == "$" and lang not in ("js", "ts") else "i")
        if c in "()[]{},;:":
            return c if len(t) == 1 else _OP.get(t, "E")
        if lang == "py" and t in ("!", "$", "?"):
            return "E"
        if lang in ("go", "java", "kt") and c == "#" or c == "\\":
            return "E"
        return _OP.get(t, "E")


_MEMO: dict[str, _Classes] = {}


@lru_cache(maxsize=None)
def splitter(lang: str):
    return re.compile(_PATTERNS[lang]).findall


def tokens(lang: str, text: str) -> list[str]:
    return splitter(lang)(text)


def classes(lang: str, split: list[str]) -> str:
    memo = _MEMO.get(lang)
    if memo is None:
        memo = _MEMO[lang] = _Classes(lang)
    return "".join(map(memo.__getitem__, split))


def class_string(lang: str, text: str) -> str:
    return classes(lang, tokens(lang, text))


def extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1] if "." in name else ""
