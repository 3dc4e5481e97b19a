"""What happened to symbols between two states of a file: deleted, added, renamed, header changed.

Symbols: (file_id, side 'base' or 'head', sym_idx, name, start_row, end_row); sources: (file_id, base_source, head_source).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftlens.functions import text as X

# fixed value: share of body lines that makes a rename of an unchanged header
RENAME_OVERLAP = 0.6


def guarded(files: DataFrame) -> DataFrame:
    """Files that can be compared: modified text with an old state."""
    return files.where("status = 'Modified' and not is_binary and length(old_source) > 0")


def normalised(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Symbols with their normalised header and body."""
    source = F.when(F.col("side") == "base", F.col("base_source")).otherwise(F.col("head_source"))
    joined = symbols.join(sources, "file_id").withColumn("__lines", X.source_lines(source))
    return joined.withColumns({"sig": X.signature(F.col("__lines"), F.col("start_row")), "body": X.body(F.col("__lines"), F.col("start_row"), F.col("end_row"))}).drop("__lines", "base_source", "head_source")


def one_sided(symbols: DataFrame, side: str, other: str) -> DataFrame:
    """Symbols of one side whose name the other side of the file lacks."""
    there = symbols.where(F.col("side") == other).select("file_id", "name").distinct()
    return symbols.where(F.col("side") == side).join(there, ["file_id", "name"], "left_anti")


def rename_candidates(norm: DataFrame) -> DataFrame:
    """Every acceptable (deleted, added) pair of a file with its basis; what the greedy choice picks from."""
    d = one_sided(norm, "base", "head").select("file_id", F.col("sym_idx").alias("d_idx"), F.col("name").alias("from_name"), F.col("start_row").alias("d_row"), F.col("sig").alias("d_sig"), F.col("body").alias("d_body"))
    a = one_sided(norm, "head", "base").select("file_id", F.col("sym_idx").alias("a_idx"), F.col("name").alias("to_name"), F.col("start_row").alias("a_row"), F.col("sig").alias("a_sig"), F.col("body").alias("a_body"))
    same_body = d.where(F.size("d_body") > 0).join(a.withColumn("d_body", F.col("a_body")).drop("a_body"), ["file_id", "d_body"]).select("file_id", "d_idx", "from_name", "d_row", "a_idx", "to_name", "a_row", F.lit("body").alias("basis"))
    same_sig = d.where("d_sig <> ''").join(a, (d["file_id"] == a["file_id"]) & (F.col("d_sig") == F.col("a_sig"))).where((X.overlap(F.col("d_body"), F.col("a_body")) >= RENAME_OVERLAP) & ~((F.col("d_body") == F.col("a_body")) & (F.size("d_body") > 0)))
    return same_body.unionByName(same_sig.select(d["file_id"], "d_idx", "from_name", "d_row", "a_idx", "to_name", "a_row", F.lit("signature").alias("basis")))


def renames(norm: DataFrame, changed: DataFrame) -> DataFrame:
    """Greedy one-to-one renames: file_id, from_name, to_name, basis.

    Deleted symbols choose in order of place and name, an equal body before an equal header, then the first in place.  A
    choice counts only where the new symbol is a changed one (file_id, sym_idx in ``changed``); otherwise it is lost.
    """
    hit = changed.select("file_id", F.col("sym_idx").alias("a_idx")).distinct().withColumn("changed", F.lit(True))
    cand = rename_candidates(norm).join(hit, ["file_id", "a_idx"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))

    def choose(block: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for _, options in block.sort_values(["d_row", "from_name", "d_idx"], kind="stable").groupby("d_idx", sort=False):
            free = options[~options["a_idx"].isin(taken)].sort_values(["basis", "a_row", "to_name", "a_idx"], kind="stable")
            if len(free) and bool(free.iloc[0]["changed"]):
                best = free.iloc[0]
                taken.add(best["a_idx"])
                out.append((best["file_id"], best["from_name"], best["to_name"], best["basis"]))
        return pd.DataFrame(out, columns=["file_id", "from_name", "to_name", "basis"])

    schema = f"file_id {norm.schema['file_id'].dataType.simpleString()}, from_name string, to_name string, basis string"
    return cand.groupBy("file_id").applyInPandas(choose, schema)


def deleted(norm: DataFrame, renamed: DataFrame) -> DataFrame:
    """Deleted symbols that were not renamed: file_id, name."""
    gone = one_sided(norm, "base", "head").select("file_id", "name").distinct()
    return gone.join(renamed.select("file_id", F.col("from_name").alias("name")), ["file_id", "name"], "left_anti")


def signature_changes(norm: DataFrame) -> DataFrame:
    """Symbols of one name and rank on both sides whose headers differ: file_id, name, before, after.

    A head symbol without a partner of its rank is held against the first of its name.
    """
    rank = F.row_number().over(Window.partitionBy("file_id", "side", "name").orderBy("start_row", "sym_idx"))
    ranked = norm.withColumn("rank", rank)
    base = ranked.where("side = 'base'").select("file_id", "name", "rank", F.col("sig").alias("before"))
    first = base.where("rank = 1").select("file_id", "name", F.col("before").alias("first"))
    head = ranked.where("side = 'head'").select("file_id", "name", "rank", F.col("sig").alias("after"))
    both = head.join(first, ["file_id", "name"]).join(base, ["file_id", "name", "rank"], "left").withColumn("before", F.coalesce("before", "first"))
    return both.where("before <> after and before <> '' and after <> ''").select("file_id", "name", "rank", "before", "after")
