"""Content hashes and keyed stores of results on Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riftlens.functions import text as X
from riftlens.session import checkpointed

# fixed value: version of stored payloads
SCHEMA_VERSION = 3


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value with its arrays sorted, at any depth, so that their order does not count."""
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.transform(value, lambda x: canonical(x, kind.elementType)))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(canonical(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def content_hash(rows: DataFrame, leave_out: tuple[str, ...] = ("seed_id",), out: str = "card_hash") -> DataFrame:
    """Rows with the SHA-256 over the canonical JSON of their columns, names that do not tell what a card holds left out."""
    parts = [canonical(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in leave_out]
    return rows.withColumn(out, F.sha2(F.to_json(F.struct(F.lit("card").alias("tag"), F.lit(SCHEMA_VERSION).alias("version"), *parts)), 256))


def set_hash(hashes: Column) -> Column:
    """Aggregate: SHA-256 over the sorted hashes of a set."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), "\n"), 256)


def latest(entries: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, "r.*")


def read_entries(entries: DataFrame, payload: str, schema: str, required: str) -> DataFrame:
    """Decoded rows; a payload that does not decode, or lacks ``required``, is a miss like an absent row."""
    # from_json alone would give what stands before the damage
    decoded = entries.withColumn("record", F.when(F.try_parse_json(payload).isNotNull(), F.from_json(payload, schema)))
    return decoded.where(F.col(f"record.{required}").isNotNull())


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a store, or None where there is none; any other failure to read is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def create(spark: SparkSession, path: str, schema: str | T.StructType) -> None:
    """An empty store of a schema, where there is none yet."""
    if stored(spark, path) is None:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        spark.createDataFrame([], T.StructType([*kind.fields, T.StructField("bucket", T.IntegerType())])).write.mode("append").parquet(path)


def put(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Insert or replace: the partitions that the rows touch are written anew, others stay as they are.

    The key is hashed into the partition column, so a write touches few files; there is one writer at a time.
    """
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(64)).cast("int"))
    old = stored(spark, path)
    if old is not None:
        touched = new.select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(new.select(*keys).distinct(), keys, "left_anti")
        new = checkpointed(kept.unionByName(new))
    new.write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(path)


def get(spark: SparkSession, path: str, schema: str | None = None, **key) -> DataFrame:
    """The rows of a key; an absent store has none, of the given ``schema`` (without it, of the key's columns only)."""
    names = list(key)
    probe = spark.range(1).select(*(F.lit(v).alias(k) for k, v in key.items()))
    bucket = probe.select(F.pmod(F.xxhash64(*names), F.lit(64)).cast("int")).first()[0]
    rows = stored(spark, path)
    if rows is None:
        return spark.createDataFrame([], schema) if schema else probe.limit(0)
    found = rows.where(F.col("bucket") == bucket)
    for k, v in key.items():
        found = found.where(F.col(k) == F.lit(v))
    return found.drop("bucket")


def thread_key(repo: Column, base: Column, target: Column) -> Column:
    return X.composite_key(repo, base, target)


def load_threads(store: DataFrame, key: str) -> str:
    """The array stored under a key as JSON text, ``[]`` where there is none or it is no array."""
    row = store.where(F.col("key") == key).select("payload").first()
    text = row[0] if row else None
    import json

    try:
        return text if isinstance(json.loads(text), list) else "[]"
    except (TypeError, ValueError):
        return "[]"


def save_threads(spark: SparkSession, path: str, key: str, payload: str) -> None:
    """Write one key's array; other keys keep theirs, and a payload that is no JSON array is refused."""
    put(spark, path, spark.createDataFrame([(key, check_threads(payload))], "key string, payload string"), ["key"])


def check_threads(payload: str) -> str:
    """The payload, if it is a JSON array; anything else is refused."""
    import json

    if not isinstance(json.loads(payload), list):
        raise ValueError("a thread store keeps arrays only")
    return payload


def history(visits: DataFrame, keys: list[str], at: str = "at", most: int = 100) -> DataFrame:
    """The last steps of each key, as many as are kept, with ``back`` from 0 for the last one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return visits.withColumn("back", F.row_number().over(w) - 1).where(F.col("back") < most)


def recent(visits: DataFrame, most: int = 4) -> DataFrame:
    """The last visited paths, newest first."""
    return visits.groupBy("path").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "path").limit(most)
