"""Repositories as sources: trees, branches and three-dot differences through the ``git`` program.

``spark.read.format("git_tree")`` lists a tree once where the query is planned and reads its files in parallel; the
repository must lie where all workers can reach it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from riftlens.session import global_rank
from riftlens.sources import snapshots


def run(repo: str, *args: str, text: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=text, capture_output=True)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def resolve_commit(repo: str, revision: str) -> str:
    """The commit id of a branch, tag or id, peeled."""
    return run(repo, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()


def resolve_shas(repo: str, base: str, target: str) -> tuple[str, str]:
    """(merge base, head) of a range."""
    head = resolve_commit(repo, target)
    return run(repo, "merge-base", resolve_commit(repo, base), head).decode().strip(), head


class _Part(InputPartition):
    def __init__(self, blobs: list[tuple[str, str]]):
        super().__init__(None)
        self.blobs = blobs


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.revision, self.size = options["path"], options.get("revision", "HEAD"), int(options.get("filesPerPartition", "500"))

    def partitions(self) -> list[InputPartition]:
        listed = run(self.repo, "ls-tree", "-r", "-z", "--full-tree", resolve_commit(self.repo, self.revision)).decode("utf-8", "replace")
        blobs = []
        for entry in filter(None, listed.split("\0")):
            meta, path = entry.split("\t", 1)
            _, kind, blob = meta.split(" ")[:3]
            if kind == "blob":
                blobs.append((blob, path))
        return [_Part(blobs[i : i + self.size]) for i in range(0, len(blobs), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        out, at = run(self.repo, "cat-file", "--batch", text="".join(b + "\n" for b, _ in partition.blobs).encode()) if partition.blobs else b"", 0
        for _, path in partition.blobs:
            line = out.index(b"\n", at)
            size = int(out[at:line].split(b" ")[2])
            content = out[line + 1 : line + 1 + size]
            at = line + size + 2
            binary = b"\0" in content[:8000]
            yield path, "" if binary else content.decode("utf-8", "replace"), binary


class GitTree(DataSource):
    """Files of a revision: path, source, is_binary.  Options: path, revision, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, source string, is_binary boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def tree(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").option("revision", revision).load(repo)


def branches(spark: SparkSession, repo: str) -> DataFrame:
    """Local branches: name, is_current (none where the head is detached)."""
    lines = run(repo, "for-each-ref", "--format=%(HEAD)%(refname:short)", "refs/heads").decode().splitlines()
    return spark.createDataFrame([(x[1:], x[0] == "*") for x in lines], "name string, is_current boolean")


def three_dot(spark: SparkSession, repo: str, base: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(files, lines) of what changed on ``target`` since it left ``base``; files are numbered in order of their paths."""
    start, head = resolve_shas(repo, base, target)
    files = snapshots.file_diffs(tree(spark, repo, start), tree(spark, repo, head))
    files = global_rank(files, [F.col("new_path")], "file_seq")
    return files, snapshots.diff_lines(files)
