"""Ordered rules on paths and names: layers, entry points, contracts, tests, file kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names too common to relate anything
HUB_NAMES = ("Logger", "log", "DateUtils", "StringUtils", "JsonUtils", "ErrorCode", "BaseResponse", "CommonException", "Objects", "Optional", "Arrays")
# fixed values: preferred base branches, best first
PREFERRED_BASES = ("develop", "main", "master")
# fixed values: layers as (rank, path parts, name parts); the first that fits holds, 6 where none does
LAYERS = (
    (0, ("controller", "handler", "/routes/", "/route/", "/api/", "/endpoints/", "router"), ("controller", "handler")),
    (1, ("service", "usecase", "use_case", "/application/", "app_service"), ("service", "usecase")),
    (2, ("/domain/", "domain", "/model", "entity", "policy", "aggregate", "valueobject"), ("policy", "entity", "aggregate")),
    (3, ("repository", "/repo", "dao", "/store", "persistence", "mapper"), ("repository", "repo", "dao")),
    (4, ("infra", "/config", "config.", "client", "gateway", "adapter", "migration", ".sql", "/.github/", "dockerfile", "caddyfile", ".toml", ".yaml", ".yml"), ("client", "gateway", "adapter", "config")),
)
OTHER_LAYER = 6
# fixed values: marks of tests in paths
TEST_PATHS = ("/test/", "/tests/", "/__tests__/", "_test.", "test_", ".test.", ".spec.")
# fixed values: ends of names that are contracts; a schema is a candidate only
CONTRACT_ENDS = ("request", "response", "dto", "payload", "command", "event")
CANDIDATE_ENDS = (*CONTRACT_ENDS, "schema")
# fixed values: marks of contracts in paths, and ends of such paths
CONTRACT_PATHS, CONTRACT_FILES = ("migration", "/config"), (".sql", "config.go", "config.rs", ".proto")
# fixed values: names and ends of configuration files
CONFIG_NAMES = ("dockerfile", "caddyfile", ".gitignore", ".dockerignore", "makefile")
CONFIG_ENDS = (".toml", ".yaml", ".yml", ".json", ".sh", ".caddy", ".env", ".conf", ".ini", ".lock")
# fixed values: marks of tests in paths of symbols
TEST_SYMBOL_PATHS = ("/test/", "/tests/", "test_", "/__tests__/")
# fixed values: marks of entry points in paths
ENTRY_PATHS = ("controller", "handler", "/routes/", "/route/", "/api/", "/endpoints/", "/router")


def any_part(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def any_end(text: Column, ends: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for e in ends:
        found = found | F.endswith(text, F.lit(e))
    return found


def is_hub(name: Column) -> Column:
    return F.lower(name).isin(*(h.lower() for h in HUB_NAMES))


def layer_rank(path: Column, name: Column) -> Column:
    p, n = F.lower(path), F.lower(name)
    rank = F.when(any_part(p, TEST_PATHS) | n.rlike("^test|(test|tests|spec)$"), 5)
    for k, paths, names in LAYERS:
        extra = (n == "main") | F.startswith(n, F.lit("handle")) if k == 0 else F.lit(False)
        rank = rank.when(any_part(p, paths) | any_part(n, names) | extra, k)
    return rank.otherwise(OTHER_LAYER)


def entry_point(path: Column, name: Column) -> Column:
    """``name (path)`` where a symbol looks like an entry point, else null."""
    p, n = F.lower(path), F.lower(name)
    return F.when(any_part(p, ENTRY_PATHS) | n.rlike("(controller|handler|resource)$|^main$|^handle"), F.concat(name, F.lit(" ("), path, F.lit(")")))


def contract_name(name: Column) -> Column:
    return any_end(F.lower(name), CONTRACT_ENDS)


def contract_candidate(path: Column, name: Column, kind: Column) -> Column:
    """The name of a symbol that looks like a contract, else null."""
    p = F.lower(path)
    at = any_part(p, CONTRACT_PATHS) | any_end(p, CONTRACT_FILES)
    return F.when((F.lower(kind) == "dto") | any_end(F.lower(name), CANDIDATE_ENDS) | at, name)


def file_kind(path: Column) -> Column:
    p = F.lower(path)
    base = F.substring_index(p, "/", -1)
    migration = F.contains(p, F.lit("migration")) | F.contains(p, F.lit("/.sqlx/")) | F.endswith(p, F.lit(".sql"))
    config = base.isin(*CONFIG_NAMES) | F.startswith(base, F.lit("cargo.")) | F.startswith(p, F.lit(".github/")) | F.contains(p, F.lit("/.github/")) | any_end(p, CONFIG_ENDS)
    return F.when(migration, "migration").when(config, "config").otherwise("file")


def file_type_hint(path: Column) -> Column:
    return F.when(file_kind(path) == "migration", "contract").otherwise("infra")


def is_test_symbol(lang: Column, path: Column, name: Column) -> Column:
    p = F.lower(path)
    here = any_part(p, TEST_SYMBOL_PATHS) | F.endswith(p, F.lit("_test.go"))
    named = F.when(lang == "go", F.startswith(name, F.lit("Test"))).when(lang.isin("java", "kotlin"), name.rlike("Tests?$|^test")).otherwise(F.lit(False))
    return here | named


def branch_rank(name: Column, current: Column) -> Column:
    rank = F.when(name.eqNullSafe(current), 0)
    for i, b in enumerate(PREFERRED_BASES):
        rank = rank.when(name == b, i + 1)
    return rank.otherwise(100)
