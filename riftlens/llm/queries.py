"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riftlens.llm import handwritten, mixing, packing, pairs, secrets, syntax, truncation
from riftlens.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken(table(spark, d, "file_diffs"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rates(table(spark, d, "file_diffs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "thread_turns")).where("defect is not null").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "file_diffs"), table(spark, d, "upstream_files")).select("file_id").distinct()


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "file_diffs"), table(spark, d, "upstream_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_in_lines(table(spark, d, "diff_lines")).select("file_id", "line_seq").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text file with its secrets masked."""
    files = table(spark, d, "file_diffs").where("not is_binary and length(new_source) > 0").select("file_id", "new_source").distinct()
    return files.withColumn("r", secrets.redacted("new_source")).select("file_id", "r.*")


def p4_redacted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every diff line, removed ones included, with its secrets masked."""
    return secrets.redact_lines(table(spark, d, "diff_lines").select("file_id", "line_seq", "kind", "content"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d), table(spark, d, "pack_specs"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.limits(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rates, p2_found, p3_found, p3_reasons, p4_found, p4_redacted, p4_redacted_lines, p6_pack, p6_fill, p7_mix, p7_shares, p8_found, p8_rates, p8_limits)}


def oracle_sql() -> dict[str, str]:
    return {}
