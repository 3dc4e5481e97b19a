"""Paths, lines, signatures, identifiers and summaries as Column expressions.

Nulls give null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit separator of composite keys.
KEY_SEPARATOR = "\u001f"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def basename_any(path: Column) -> Column:
    """The last segment after slashes of either kind; trailing ones are taken off; the path itself where nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"[/\\]+$", ""), r"[/\\]"), -1)
    return F.when(last == "", F.coalesce(path, F.lit(""))).otherwise(last)


def middle_path(path: Column, head: int = 2, tail: int = 2) -> Column:
    """First and last segments around an ellipsis; short paths as they are."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    cut = F.concat_ws("/", F.slice(parts, 1, head), F.lit("…"), F.slice(parts, -tail, tail))
    return F.when(F.size(parts) <= head + tail + 1, path).otherwise(cut)


def language(path: Column) -> Column:
    """go, java, rust or kotlin by the text after the last dot; null for others."""
    ext = F.substring_index(path, ".", -1)
    return F.when(~F.contains(path, F.lit(".")), None).when(ext == "go", "go").when(ext == "java", "java").when(ext == "rs", "rust").when(ext == "kt", "kotlin")


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comment_only(text: Column) -> Column:
    return text.rlike(r"^\s*(//|/\*|\*|#)")


def source_lines(source: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(source, r"\r?\n$", ""), r"\r?\n"))


def signature(lines: Column, start_row: Column) -> Column:
    """The header line at a row from 0: collapsed, without one trailing brace and one leading visibility word."""
    line = collapse(F.get(lines, start_row))
    line = F.trim(F.regexp_replace(line, r"\{$", ""))
    return F.trim(F.regexp_replace(line, r"^(pub\(crate\)|pub\(super\)|pub|public|private|protected)(?= |$)", ""))


def body(lines: Column, start_row: Column, end_row: Column) -> Column:
    """Collapsed lines after the header, without empty ones, comments and lone braces; a multiset in sorted order."""
    inner = F.slice(lines, start_row + 2, F.greatest(end_row - start_row, F.lit(0)))
    kept = F.filter(F.transform(inner, collapse), lambda x: (x != "") & ~comment_only(x) & ~x.isin("{", "}"))
    return F.array_sort(kept)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's lines, with multiplicity, that occur in b; 0 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a).cast("double"))


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def file_summary(path: Column, status: Column, adds: Column, dels: Column) -> Column:
    name, minus = basename(path), "−"
    return (
        F.when(status == "Added", F.format_string("Adds %s: +%d line%s.", name, adds, plural(adds)))
        .when(status == "Deleted", F.format_string(f"Removes %s: {minus}%d line%s.", name, dels, plural(dels)))
        .otherwise(F.format_string(f"Updates %s: +%d {minus}%d line%s.", name, adds, dels, plural(adds + dels)))
    )


def binary_summary(path: Column, status: Column) -> Column:
    verb = F.when(status == "Added", "Adds").when(status == "Deleted", "Removes").otherwise("Updates")
    return F.concat(verb, F.lit(" binary file "), basename(path), F.lit("."))


def card_id(path: Column) -> Column:
    return F.concat(path, F.lit("::__file"))


def change_type(status: Column) -> Column:
    return F.when(status == "Added", "added").when(status == "Deleted", "deleted").otherwise("modified")


def line_change_type(adds: Column, dels: Column) -> Column:
    return F.when(dels == 0, "added").when(adds == 0, "deleted").otherwise("modified")


# fixed values: beginnings of import lines
IMPORT_LEADS = ("import ", "import\t", "package ", "use ", "extern crate ", "using ", "namespace ", "#include", "require ", "require_relative ")


def import_like(line: Column) -> Column:
    """Import, package and include lines of the common languages, visibility taken off, and a lone quoted path as Go lists them."""
    t = strip(line)
    bare = F.regexp_replace(t, r"^(pub\(crate\) |pub )", "")
    led = (F.startswith(bare, F.lit("from ")) & F.contains(bare, F.lit(" import ")))
    for lead in IMPORT_LEADS:
        led = led | F.startswith(bare, F.lit(lead))
    quoted = F.endswith(t, F.lit('"')) & (F.regexp_count(t, F.lit('"')) == 2) & ~F.contains(t, F.lit("=")) & ~F.contains(t, F.lit("//"))
    return led | quoted


def imported_names(lang: Column, source: Column) -> Column:
    """Distinct local names that a file's import lines bind, sorted; wildcards and names with blanks are left out."""

    def last(line: Column, mark: str) -> Column:
        return F.element_at(F.split(line, mark), -1)

    def bound(raw: Column) -> Column:
        line = strip(raw)
        rust = last(F.regexp_replace(F.regexp_replace(line, r"^(use )+", ""), r";+$", ""), "::")
        java = last(F.regexp_replace(F.regexp_replace(line, r"^(import )+(static )*", ""), r";+$", ""), r"\.")
        plain = strip(F.regexp_replace(F.regexp_replace(line, r"^(import )+", ""), r";+$", ""))
        kotlin = F.when(F.contains(plain, F.lit(" as ")), strip(F.substring_index(plain, " as ", -1))).otherwise(last(plain, r"\."))
        go = last(F.regexp_replace(line, r'^"+|"+$', ""), "/")
        return (
            F.when((lang == "rust") & F.startswith(line, F.lit("use ")), rust)
            .when((lang == "go") & line.rlike(r'^".*"$') & (F.length(line) > 1), go)
            .when((lang == "java") & F.startswith(line, F.lit("import ")), java)
            .when((lang == "kotlin") & F.startswith(line, F.lit("import ")), kotlin)
        )

    names = F.transform(source_lines(source), lambda x: strip(F.regexp_replace(strip(bound(x)), r"^\{+|\}+$", "")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "") & (x != "*") & ~F.contains(x, F.lit(" ")))))


def provisional_title(text: Column) -> Column:
    """Dashes and underscores to blanks, first letter of each word in upper case, the rest as it is."""
    parts = F.filter(F.split(strip(F.regexp_replace(text, "[-_]", " ")), r"\s+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def identifier_tokens(text: Column) -> Column:
    """Runs of letters, digits, ``_`` and ``.`` with a trailing ``()`` where there is one; outer dots off, empty ones out."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_.]*\(\)|[\p{L}\p{N}_.]+)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\.+|\.+$", "")), lambda x: x != "")


def looks_like_code(token: Column) -> Column:
    return token.rlike(r"[._]|\(\)$|\p{Ll}\p{Lu}")


def identifier_bases(token: Column) -> Column:
    """The token without ``()``, what stands before its first dot and after its last."""
    bare = F.regexp_replace(token, r"\(\)$", "")
    return F.array_distinct(F.array(bare, F.substring_index(bare, ".", 1), F.substring_index(bare, ".", -1)))


def strip_fence(text: Column) -> Column:
    """The inside of a Markdown code fence, or the trimmed text."""
    trimmed = strip(text)
    return F.when(F.startswith(trimmed, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(trimmed, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))).otherwise(trimmed)


def unwrap_json(text: Column) -> Column:
    """``structured_output`` of a wrapper object, else its ``result``, else the text."""
    return F.coalesce(F.get_json_object(text, "$.structured_output"), F.get_json_object(text, "$.result"), text)


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(KEY_SEPARATOR, *parts)


def cell_width(text: Column) -> Column:
    """Columns that a text takes: two for a tab and for full-width characters, one for others."""
    # ranges of full-width characters (fixed values)
    wide = F.regexp_count(text, F.lit(r"[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦\t]"))
    return F.length(text) + wide


def font_size(rows: Column) -> Column:
    return F.when(rows <= 16, 14).when(rows <= 24, 13).when(rows <= 34, 12).otherwise(11)


def highlight(text: Column, query: Column) -> Column:
    """struct(before, hit, after) of the first case-insensitive hit; hit is empty where there is none."""
    at = F.when(query == "", 0).otherwise(F.position(F.lower(query), F.lower(text)))
    cut = lambda a, n: text.substr(a, n)
    return F.struct(
        F.when(at > 0, cut(F.lit(1), at - 1)).otherwise(text).alias("before"), F.when(at > 0, cut(at, F.length(query))).otherwise(F.lit("")).alias("hit"), F.when(at > 0, cut(at + F.length(query), F.length(text))).otherwise(F.lit("")).alias("after")
    )


def changed_words(old: Column, new: Column) -> Column:
    """struct(start, old_end, new_end) of what differs between paired lines: common ends off (our own definition)."""
    shorter = F.least(F.length(old), F.length(new))
    steps = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    head = F.size(F.filter(steps, lambda i: old.substr(F.lit(1), i) == new.substr(F.lit(1), i)))
    tail = F.size(F.filter(steps, lambda i: (i <= shorter - head) & (old.substr(F.length(old) - i + 1, i) == new.substr(F.length(new) - i + 1, i))))
    return F.struct(head.alias("start"), (F.length(old) - tail).alias("old_end"), (F.length(new) - tail).alias("new_end"))


def error_class(status: Column, message: Column) -> Column:
    """Kind of a failed call by its status, with the start of its message where the kind is general."""
    return F.when(status.isin(401, 403), "auth").when(status.isin(429, 529), "overloaded").otherwise(F.concat(F.lit("http:"), F.substring(message, 1, 500)))


def segments(text: Column, tokens: Column, changes: Column) -> Column:
    """The text cut at every bound of token and change ranges: array of struct(start, end, text), empty pieces left out.

    Ranges are struct(start, end) from 0, the end not included; what lies outside of the text is clipped.
    """
    size = F.length(text)
    bounds = lambda rs: F.flatten(F.transform(F.coalesce(rs, F.array().cast("array<struct<start:int,end:int>>")), lambda r: F.array(r["start"], r["end"])))
    every = F.concat(F.array(F.lit(0), size), bounds(tokens), bounds(changes))
    cuts = F.array_sort(F.array_distinct(F.transform(every, lambda x: F.greatest(F.lit(0), F.least(size, x)))))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1))), lambda i: F.struct(F.get(cuts, i - 1).alias("start"), F.get(cuts, i).alias("end"), text.substr(F.get(cuts, i - 1) + 1, F.get(cuts, i) - F.get(cuts, i - 1)).alias("text")))
    return F.filter(pieces, lambda p: p["end"] > p["start"])
