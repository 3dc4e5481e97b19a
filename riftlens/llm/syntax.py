"""Source files that do not parse in the language that their extension names.

Each file is lexed once, into a row with its string of token classes and its distinct adjacent pairs.  The pairs that occur
anywhere are anti-joined with those that the productions of the language let stand together; what is left over is a pair
that no valid file has, and a file that shows one is broken.  The windows of all other files are reduced: bracketed windows
innermost first, each against the productions that it may have, until the whole file is one window that must be a file of
the language (see :mod:`riftlens.llm.grammar`).

The windows are those of one file and are reduced where its row lies: only the distinct pairs, at most the square of the
number of token classes for each language, move between tasks.  A worker matches each distinct window once.

Defined results
* null, empty and binary sources, and files without one of the known extensions, give no rows; equal rows count once;
* undefined and repeated names are no errors in any language; ``return`` outside a function is one in js and ts;
* a leading byte-order mark is white space except in JSON; a file of white space or comments only is whole where the
  language allows it (not in Go and JSON);
* very long and deeply nested files are reduced as any other, window by window; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftlens.llm import grammar, lexing
from riftlens.session import checkpointed

_LINE_END = re.compile(f"N|{lexing.INDENTS}")


def class_string(lang: str, text: str) -> str:
    if lang == "json":
        return lexing.class_string(lang, text)
    return lexing.class_string(lang, ("\n" if lang == "py" else "") + text.lstrip("﻿"))


def adjacent(lang: str, kinds: str) -> list[int]:
    """The distinct adjacent pairs of a class string (with its statement ends) as numbers; line ends are no tokens."""
    pairs = {a + b for a, b in zip(kinds, kinds[1:], strict=False)}
    if lang != "go":
        pairs = {p for p in pairs if not _LINE_END.search(p)}
    return [ord(p[0]) << 16 | ord(p[1]) for p in sorted(pairs)]


def parses(lang: str, text: str) -> bool:
    kinds = grammar.terminate(lang, class_string(lang, text))
    allowed = grammar.permissible(lang)
    return all(chr(p >> 16) + chr(p & 0xFFFF) in allowed for p in adjacent(lang, kinds)) and grammar.grammar(lang).accepts(kinds)


def sources(files: DataFrame) -> DataFrame:
    """file_id, repo_path, lang, new_source of the files that are to be tested."""
    name = F.element_at(F.split("new_path", "/"), -1)
    ext = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))
    held = files.where("not is_binary and length(new_source) > 0").withColumn("lang", ext)
    return held.where(F.col("lang").isin(*lexing.LANGUAGES)).select("file_id", "repo_path", "lang", "new_source")


def judged(files: DataFrame) -> DataFrame:
    """file_id, repo_path, lang, broken_by of each stored row that is to be tested: pair, window, or null where it parses."""
    spark = files.sparkSession
    named = [files.schema["file_id"], files.schema["repo_path"], T.StructField("lang", T.StringType())]

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [grammar.terminate(lang, class_string(lang, t)) for lang, t in zip(batch["lang"], batch["new_source"], strict=True)]
            pairs = [adjacent(lang, k) for lang, k in zip(batch["lang"], kinds, strict=True)]
            yield batch[["file_id", "repo_path", "lang"]].assign(kinds=kinds, pairs=pairs)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by = ["pair" if foreign else None if grammar.grammar(lang).accepts(k) else "window" for lang, k, foreign in zip(batch["lang"], batch["kinds"], batch["foreign"], strict=True)]
            yield batch[["file_id", "repo_path", "lang"]].assign(broken_by=pd.Series(by, dtype="object", index=batch.index))

    lexed = sources(files).mapInPandas(lex, T.StructType([*named]).add("kinds", "string").add("pairs", T.ArrayType(T.IntegerType())))
    lexed = checkpointed(lexed)
    permitted = spark.createDataFrame([(lang, ord(p[0]) << 16 | ord(p[1])) for lang in lexing.LANGUAGES for p in sorted(grammar.permissible(lang))], "lang string, pair int")
    shown = lexed.select("lang", F.explode("pairs").alias("pair")).distinct()
    # both sides of this join and what is left are bounded by the square of the number of token classes, whatever the files
    foreign = shown.join(F.broadcast(permitted), ["lang", "pair"], "left_anti").groupBy("lang").agg(F.collect_list("pair").alias("never"))
    marked = lexed.join(F.broadcast(foreign), "lang", "left").withColumn("foreign", F.coalesce(F.arrays_overlap("pairs", "never"), F.lit(False)))
    rows = marked.select("file_id", "repo_path", "lang", F.when(~F.col("foreign"), F.col("kinds")).alias("kinds"), "foreign")
    return rows.mapInPandas(reduce, T.StructType([*named]).add("broken_by", "string"))


def broken(files: DataFrame) -> DataFrame:
    """file_id of each file that is a syntax error."""
    return judged(files).where("broken_by is not null").select("file_id").distinct()


def broken_rates(files: DataFrame) -> DataFrame:
    """Per repository and language: files, broken files, how many of these by a pair of tokens, and the share of broken files."""
    each = judged(files).groupBy("repo_path", "lang", "file_id").agg(F.count("broken_by").alias("bad"), F.count_if(F.col("broken_by") == "pair").alias("pair"))
    out = each.groupBy("repo_path", "lang").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("bad") > 0).alias("broken"), F.count_if(F.col("pair") > 0).alias("broken_by_pair"))
    return out.withColumn("rate", F.col("broken") / F.col("files"))
