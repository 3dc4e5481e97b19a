"""Session helpers: table access, checkpoint folder, salted ranks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, executors of a local master share the machine, and
    a temporary folder will do; on any other master the setting is required, as executors would not see each other's disks.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="riftlens-checkpoint-"))
    return df.checkpoint(eager=True)


def salted_rank(df: DataFrame, group: list[str], order: list[str], out: str, salts: int = 256) -> DataFrame:
    """Rank from 0 within ``group`` without one task holding a whole group.

    Rows are spread over ``salts`` slices by a hash of ``order``; each slice is numbered by itself and shifted by the
    sizes of the slices before it.  The rank is a bijection onto 0..n-1 within the group, fixed by the values of
    ``order`` (ties in ``order`` get ranks in no particular order).
    """
    salt, at, base = f"__salt_{out}", f"__at_{out}", f"__base_{out}"
    df = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(*group, salt)
    numbered = df.withColumn(at, F.row_number().over(inner.orderBy(*order)) - 1)
    sizes = df.groupBy(*group, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(base, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return numbered.join(sizes, [*group, salt]).withColumn(out, F.col(at) + F.col(base)).drop(salt, at, base)


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rank from 0 over all rows without sorting them in one task.

    Rows are split into ranges of ``order``, numbered within each, and shifted by the sizes of the ranges before; only these
    sizes, one for each range, meet in one place.  The split is kept by a checkpoint, as a second sampling could differ.
    """
    names = [f"__o{i}_{out}" for i in range(len(order))]
    pid, at, base = f"__pid_{out}", f"__at_{out}", f"__base_{out}"
    keyed = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(*names)
    keyed = checkpointed(keyed.withColumn(pid, F.spark_partition_id()))
    sizes = keyed.groupBy(pid).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(base, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = keyed.withColumn(at, F.row_number().over(Window.partitionBy(pid).orderBy(*names)) - 1)
    return numbered.join(F.broadcast(sizes), pid).withColumn(out, F.col(at) + F.col(base)).drop(pid, at, base, *names)


def grouped_rank(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Rank from 0 within ``group`` by :func:`global_rank`, so that one group may hold any share of the rows; null is a group."""
    if not group:
        return global_rank(df, order, out)
    ranked = global_rank(df, [*map(F.col, group), *order], f"__all_{out}")
    first = ranked.groupBy(*(F.col(g).alias(f"__g_{g}") for g in group)).agg(F.min(f"__all_{out}").alias(f"__first_{out}"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return ranked.join(first, same).withColumn(out, F.col(f"__all_{out}") - F.col(f"__first_{out}")).drop(f"__all_{out}", f"__first_{out}", *(f"__g_{g}" for g in group))
