"""Change records from two states of a file set, and branch and range choice.

Snapshots are tables (path, source, is_binary).  The old and the new state are joined on the path; a path on one side only
is an addition or a removal, and an equal text that moved is a rename.  Line differences are made per file, where the
file lies, by Myers' algorithm on lines as Python's difflib has it.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftlens.functions import rules as R
from riftlens.session import checkpointed

LINE = "file_seq long, line_seq int, kind string, new_lineno int, old_lineno int, content string"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """A folder's files as a snapshot; bytes that are no UTF-8 become replacement characters, a zero byte makes it binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            binary = [b"\0" in c[:8000] for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "source": ["" if x else bytes(c).decode("utf-8", "replace") for c, x in zip(b["content"], binary, strict=True)], "is_binary": binary})

    base = root.rstrip("/") + "/"
    out = files.select("path", "content").mapInPandas(decode, "path string, source string, is_binary boolean")
    return out.withColumn("path", F.element_at(F.split("path", base, 2), -1))


#: Share of the larger text that two files must have in common to be a move or a copy (the default of git).
SIMILAR = 0.5
#: Files become candidates by a line that at most so many files have; those without any such line are compared by hash only.
RARE = 32


def similar_files(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(old_path, new_path, similarity) of texts (path, source) that share enough of their lines, by characters.

    Files meet by lines that few files have, so no common line relates all files with each other; the share of a pair that met
    is then counted over all its lines.
    """

    def lines(df: DataFrame) -> DataFrame:
        each = df.where("length(source) > 0").select("path", F.explode(F.split("source", "\n")).alias("x"))
        return each.groupBy("path", F.xxhash64("x").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.first(F.length("x") + 1).alias("size"))

    a, b = lines(left), lines(right)
    rare = a.select("h").unionByName(b.select("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= RARE).select("h")
    old, new = a.select(F.col("path").alias("old_path"), "h", "n", "size"), b.select(F.col("path").alias("new_path"), "h", F.col("n").alias("m"))
    met = old.select("old_path", "h").join(rare, "h").join(new.select("new_path", "h"), "h").select("old_path", "new_path").distinct()
    shared = met.join(old, "old_path").join(new, ["new_path", "h"]).groupBy("old_path", "new_path").agg(F.sum(F.least("n", "m") * F.col("size")).alias("shared"))
    sizes = lambda df, c: df.select(F.col("path").alias(c), (F.length("source") + 1).alias(f"{c}_size"))
    both = shared.join(sizes(left, "old_path"), "old_path").join(sizes(right, "new_path"), "new_path")
    share = F.col("shared") / F.greatest("old_path_size", "new_path_size")
    return both.select("old_path", "new_path", share.alias("similarity")).where(F.col("similarity") >= least)


def best_matches(found: DataFrame, once: bool) -> DataFrame:
    """(old_path, new_path): each new file with its most similar old one; with ``once``, each old file with one new one at most."""
    by = F.struct(-F.col("similarity"), F.col("old_path"))
    best = found.groupBy("new_path").agg(F.min_by("old_path", by).alias("old_path"), F.max("similarity").alias("similarity"))
    if once:
        best = best.groupBy("old_path").agg(F.min_by("new_path", F.struct(-F.col("similarity"), F.col("new_path"))).alias("new_path"))
    return best.select("old_path", "new_path")


def file_diffs(old: DataFrame, new: DataFrame, similar: float | None = SIMILAR) -> DataFrame:
    """new_path, old_path, status, is_binary, new_source, old_source of every path that differs; binary sources are empty.

    A new path whose text equals a removed one, or is ``similar`` to one, is a move; one that is similar to the old text of a
    changed file is a copy; both count as modified.  Without ``similar`` only equal texts are moves.
    """
    o = old.select(F.col("path").alias("old_path"), F.col("source").alias("old_source"), F.col("is_binary").alias("ob"))
    n = new.select(F.col("path").alias("new_path"), F.col("source").alias("new_source"), F.col("is_binary").alias("nb"))
    both = o.join(n, F.col("old_path") == F.col("new_path"), "full").where("old_path is null or new_path is null or old_source <> new_source or ob <> nb")
    removed = both.where("new_path is null and length(old_source) > 0").select("old_path", "old_source", F.sha2("old_source", 256).alias("h"))
    added = both.where("old_path is null and length(new_source) > 0").select("new_path", "new_source", F.sha2("new_source", 256).alias("h"))
    one = lambda df, c: df.groupBy("h").agg(F.min(c).alias(c))
    moved = one(removed, "old_path").join(one(added, "new_path"), "h").select("old_path", "new_path")
    copied = moved.limit(0)
    if similar is not None:
        moved = checkpointed(moved)
        text = lambda df, p, src: df.select(F.col(p).alias("path"), F.col(src).alias("source"))
        gone = removed.join(moved.select("old_path"), "old_path", "left_anti")
        come = added.join(moved.select("new_path"), "new_path", "left_anti")
        alike = best_matches(similar_files(text(gone, "old_path", "old_source"), text(come, "new_path", "new_source"), similar), once=True)
        moved = checkpointed(moved.unionByName(alike))
        come = come.join(moved.select("new_path"), "new_path", "left_anti")
        changed = both.where("old_path is not null and new_path is not null and not ob and not nb")
        copied = checkpointed(best_matches(similar_files(text(changed, "old_path", "old_source"), text(come, "new_path", "new_source"), similar), once=False))
    left = lambda df, c, by: df.join(by.select(F.col(c).alias("__x")), F.col(c) == F.col("__x"), "left_anti")
    # a file that was copied stays on both sides
    rest = left(left(left(both, "old_path", moved), "new_path", moved), "new_path", copied)
    paired = moved.unionByName(copied).join(o, "old_path").join(n, "new_path")
    binary = F.coalesce("nb", F.lit(False)) | F.coalesce("ob", F.lit(False))
    text_of = lambda c: F.when(binary, "").otherwise(F.coalesce(c, F.lit(""))).alias(c)
    status = F.when(F.col("old_path").isNull(), "Added").when(F.col("new_path").isNull(), "Deleted").otherwise("Modified")
    cols = ["old_path", "new_path", "old_source", "new_source", "ob", "nb"]
    return rest.select(cols).unionByName(paired.select(cols)).select(F.coalesce("new_path", "old_path").alias("new_path"), F.coalesce("old_path", "new_path").alias("old_path"), status.alias("status"), binary.alias("is_binary"), text_of("new_source"), text_of("old_source"))


def split_lines(text: str | None) -> list[str]:
    lines = (text or "").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [x.rstrip("\r") for x in lines]


def diff(old: str | None, new: str | None) -> list[tuple[str, int | None, int | None, str]]:
    """(kind, new line number, old line number, content) of the whole file, deleted lines before added ones."""
    a, b = split_lines(old), split_lines(new)
    out: list[tuple[str, int | None, int | None, str]] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out.extend(("ctx", k + x + 1, i + x + 1, a[i + x]) for x in range(j - i))
        else:
            out.extend(("del", None, x + 1, a[x]) for x in range(i, j))
            out.extend(("add", x + 1, None, b[x]) for x in range(k, m))
    return out


def diff_lines(files: DataFrame) -> DataFrame:
    """Line records of each file (file_seq, old_source, new_source); binary files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, i, *r) for f, o, n in b.itertuples(index=False, name=None) for i, r in enumerate(diff(o, n))]
            out = pd.DataFrame(rows, columns=["file_seq", "line_seq", "kind", "new_lineno", "old_lineno", "content"])
            yield out.astype({"new_lineno": "Int32", "old_lineno": "Int32"})

    return files.where("not is_binary").select(F.col("file_seq").cast("long"), "old_source", "new_source").mapInPandas(run, LINE)


def match_delta(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines (old_path, new_path) with the file they belong to: both paths fit, empty ones fit anything, one at least for real."""
    f = files.select("file_seq", F.col("old_path").alias("__o"), F.col("new_path").alias("__n"))
    by_new = lines.where("new_path <> ''").join(f, (F.col("new_path") == F.col("__n")) & ((F.col("old_path") == "") | (F.col("__o") == "") | (F.col("old_path") == F.col("__o"))))
    by_old = lines.where("new_path = '' and old_path <> ''").join(f, F.col("old_path") == F.col("__o"))
    return by_new.unionByName(by_old).groupBy(*lines.columns).agg(F.min("file_seq").alias("file_seq"))


def ranked_branches(branches: DataFrame, group: list[str], current: Column) -> DataFrame:
    """Branches with their place: the current one, then the preferred bases, then the rest by lower-cased name."""
    from pyspark.sql.window import Window

    rank = R.branch_rank(F.col("name"), current)
    w = Window.partitionBy(*group).orderBy(rank, F.lower("name"), "name")
    return branches.select(*group, "name", rank.alias("rank"), (F.row_number().over(w) - 1).alias("place"))


def range_defaults(branches: DataFrame, group: list[str], current: Column) -> DataFrame:
    """Per group: base (first preferred branch that exists, else the first), target (the current one, else the first other)."""
    ranked = ranked_branches(branches, group, current)
    preferred = F.when(F.col("name").isin(*R.PREFERRED_BASES), R.branch_rank(F.col("name"), F.lit(None).cast("string")))
    got = ranked.groupBy(*group).agg(F.min_by("name", F.when(preferred.isNotNull(), preferred)).alias("default"), F.min_by("name", "place").alias("first"), F.max(F.when(F.col("rank") == 0, F.col("name"))).alias("current"))
    base = got.withColumn("base", F.coalesce("default", "first"))
    other = ranked.join(base.select(*group, "base"), group).where("name <> base").groupBy(*group).agg(F.min_by("name", "place").alias("other"))
    joined = base.join(other, group, "left")
    return joined.select(*group, "base", F.when(F.col("current").isNotNull() & (F.col("current") != F.col("base")), F.col("current")).otherwise(F.coalesce("other", "base")).alias("target"))


def deep_link(url: Column) -> Column:
    """struct(repo, base, target) of a review link with all three parameters, else null."""
    part = lambda k: F.parse_url(url, F.lit("QUERY"), F.lit(k))
    place = F.concat_ws("/", F.parse_url(url, F.lit("HOST")), F.regexp_replace(F.parse_url(url, F.lit("PATH")), "^/|/$", ""))
    ok = F.regexp_replace(place, "/$", "").isin("review") & part("repo").isNotNull() & part("base").isNotNull() & part("target").isNotNull()
    return F.when(ok, F.struct(F.url_decode(part("repo")).alias("repo"), F.url_decode(part("base")).alias("base"), F.url_decode(part("target")).alias("target")))


def review_link(scheme: str, repo: Column, base: Column, target: Column) -> Column:
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{scheme}://review?repo="), enc(repo), F.lit("&base="), enc(base), F.lit("&target="), enc(target))


def pull_request(url: Column) -> Column:
    """struct(owner, name, number) of a pull-request address."""
    pat = r"^https?://[^/]+/([^/]+)/([^/]+)/pull/(\d+)"
    return F.when(url.rlike(pat), F.struct(F.regexp_extract(url, pat, 1).alias("owner"), F.regexp_extract(url, pat, 2).alias("name"), F.regexp_extract(url, pat, 3).cast("int").alias("number")))


def local_branch(ref: Column) -> Column:
    """A branch name without its remote's prefix."""
    return F.regexp_replace(ref, r"^(refs/)?(remotes/|heads/)?(origin/)?", "")


def resolve(revisions: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(rev, commit_id) of revisions that are a branch, a remote branch or tag, or the start of exactly one commit id.

    ``refs`` has name and commit_id (peeled), ``commits`` commit_id; a name goes before an id.
    """
    short = F.regexp_replace("name", r"^refs/(heads|tags|remotes)/", "")
    rank = F.when(F.col("name") == F.concat(F.lit("refs/tags/"), short), 1).when(F.startswith("name", F.lit("refs/remotes/")), 2).otherwise(0)
    named = revisions.join(refs.select("name", short.alias("short"), F.col("commit_id").alias("c"), rank.alias("k")), (F.col("rev") == F.col("short")) | (F.col("rev") == F.col("name")))
    by_name = named.groupBy("rev").agg(F.min_by("c", F.struct("k", "name")).alias("commit_id"))
    ids = revisions.where(F.col("rev").rlike("^[0-9a-f]{4,40}$")).join(by_name, "rev", "left_anti")
    # ids are matched on their first four signs, then in full
    known = commits.select(F.col("commit_id").alias("c"), F.substring("commit_id", 1, 4).alias("p"))
    by_id = ids.withColumn("p", F.substring("rev", 1, 4)).join(known, "p").where(F.startswith("c", F.col("rev"))).groupBy("rev").agg(F.min("c").alias("commit_id"), F.countDistinct("c").alias("n")).where("n = 1").drop("n")
    return by_name.unionByName(by_id)
