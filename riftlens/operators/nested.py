"""Deeply nested records to flat tables, by Dewey labels.

Every node of a JSON payload gets an ordinal path identifier such as ``0.2.1``: the label of its parent, a dot, and its
place among its siblings.  A parent's label is the child's label cut at its last dot, so links need no second pass over
the payload.  Nodes are grouped by their schema path (``clusters[].members[]``), and each schema path is one table.

Defined results
* null, empty, damaged or truncated payloads give no nodes;
* a byte-order mark, a Markdown code fence and JSON kept as a JSON string are taken off, at any depth of wrapping;
* names given in snake case are read as camel case;
* a lone value where a list is expected (``list_keys``) is a list of one, null is an empty list;
* an object used as a map (``map_keys``) is a list whose elements carry their key in the field ``@key``;
* repeated rows of the source give repeated nodes; extra columns of the source are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WRAPPERS = ("structured_output", "structuredOutput", "result", "layout")

_FENCE = re.compile(r"\A\s*```[A-Za-z]*[ \t]*\r?\n(.*?)\r?\n?```\s*\Z", re.S)
_SNAKE = re.compile(r"(?<=[A-Za-z0-9])_+([A-Za-z0-9])")


def _nan(_: str) -> None:
    raise ValueError("not strict JSON")


def unwrap(payload: str | None, wrappers: Sequence[str] = WRAPPERS):
    """The record inside its wrapping, or None where the payload is damaged."""
    value = payload
    try:
        # each round takes one wrapping off, so the payload gets shorter
        while True:
            if isinstance(value, str):
                text = value.lstrip("﻿ \t\r\n")
                if m := _FENCE.match(text):
                    text = m.group(1)
                value = json.loads(text, parse_constant=_nan)
            elif isinstance(value, dict) and (inner := next((w for w in wrappers if w in value and isinstance(value[w], str | dict)), None)):
                value = value[inner]
            else:
                break
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict | list) else None


def camel(name: str) -> str:
    return _SNAKE.sub(lambda m: m.group(1).upper(), name)


def label(root, list_keys: frozenset[str], map_keys: frozenset[str], keep_keys: frozenset[str]) -> Iterator[tuple]:
    """(dewey, ordinal, schema_path, value, fields) for every node, parents before children.

    The members of an object named in ``keep_keys`` are data, so their names are not changed.
    """
    stack = [("0", 0, "", None, root, False)]
    while stack:
        dewey, ordinal, path, key, node, raw = stack.pop()
        if isinstance(node, dict):
            fields = {} if key is None else {"@key": key}
            inner = []
            for i, (k, v) in enumerate(node.items()):
                name = k if raw else camel(k)
                if isinstance(v, dict | list) or name in list_keys or name in map_keys:
                    inner.append((i, name, v))
                elif v is not None:
                    fields[name] = v if isinstance(v, str) else json.dumps(v)
            yield dewey, ordinal, path, None, fields
            for i, name, v in reversed(inner):
                here = f"{path}.{name}" if path else name
                if name in map_keys and isinstance(v, dict):
                    stack.extend((f"{dewey}.{i}.{j}", j, f"{here}[]", k, x, False) for j, (k, x) in reversed(list(enumerate(v.items()))))
                elif isinstance(v, list):
                    stack.extend((f"{dewey}.{i}.{j}", j, f"{here}[]", None, x, False) for j, x in reversed(list(enumerate(v))))
                elif name in list_keys or name in map_keys:
                    if v is not None:
                        stack.append((f"{dewey}.{i}.0", 0, f"{here}[]", None, v, False))
                else:
                    stack.append((f"{dewey}.{i}", i, here, None, v, name in keep_keys))
        elif isinstance(node, list):
            yield dewey, ordinal, path, None, {} if key is None else {"@key": key}
            stack.extend((f"{dewey}.{j}", j, f"{path}[]", None, x, False) for j, x in reversed(list(enumerate(node))))
        elif node is not None:
            yield dewey, ordinal, path, node if isinstance(node, str) else json.dumps(node), {} if key is None else {"@key": key}


def dewey_nodes(df: DataFrame, keys: Sequence[str], payload: str, list_keys: Sequence[str] = (), map_keys: Sequence[str] = (), keep_keys: Sequence[str] = (), wrappers: Sequence[str] = WRAPPERS, paths: Sequence[str] | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per node: ``keys``, dewey, parent_dewey, ordinal, schema_path, value (scalars), fields (an object's scalars).

    ``paths`` and ``fields`` name the schema paths and the fields that are wanted, where not all are; the fields are then columns
    of their names instead of a map.
    """
    only = frozenset(paths) if paths is not None else None
    lists, maps, keeps, wraps, keys = frozenset(list_keys), frozenset(map_keys), frozenset(keep_keys), tuple(wrappers), list(keys)
    columns = [*keys, "dewey", "ordinal", "schema_path", "value", *(["fields"] if fields is None else fields)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for *key, text in batch.itertuples(index=False, name=None):
                record = unwrap(text, wraps)
                if record:
                    for dewey, ordinal, path, value, got in label(record, lists, maps, keeps):
                        if only is None or path in only:
                            rows.append((*key, dewey, ordinal, path, value, *([got] if fields is None else map(got.get, fields))))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    picked = df.select(*keys, payload)
    schema = T.StructType([picked.schema[k] for k in keys]).add("dewey", "string").add("ordinal", "integer").add("schema_path", "string").add("value", "string")
    for name in [("fields", T.MapType(T.StringType(), T.StringType()))] if fields is None else [(f, T.StringType()) for f in fields]:
        schema = schema.add(*name)
    nodes = picked.where(F.length(payload) > 2).mapInPandas(run, schema)
    return nodes.withColumn("parent_dewey", F.regexp_replace("dewey", r"\.\d+$", ""))


def flat_table(nodes: DataFrame, schema_path: str, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The table of one schema path: keys, node id, id of the holding record, place, and the named fields.

    An element of a list hangs two labels below the record that holds the list, a plain member one.
    """
    up = r"\.\d+\.\d+$" if schema_path.endswith("[]") else r"\.\d+$"
    table = nodes.where(F.col("schema_path") == schema_path)
    return table.select(*keys, "dewey", F.regexp_replace("dewey", up, "").alias("holder_dewey"), F.col("ordinal").alias("child_pos"), "value", *(F.col("fields")[f].alias(f) for f in fields))


LAYOUT_LISTS = ("clusters", "members", "memberCardIds", "orderedCardIds", "units", "unclustered", "mergeSuggestions", "splitSuggestions", "clusterIds", "clusterOrder")
LAYOUT_MAPS = ("clusters", "cardUnits")


LINK_PATHS = ("", "clusters[]", "clusters[].memberCardIds[]", "clusters[].orderedCardIds[]", "clusters[].members[]", "clusters[].members[].units[]", "cardUnits[]", "cardUnits[][]", "cardUnits[].units[]", "unclustered[]", "mergeSuggestions[]", "mergeSuggestions[].clusterIds[]", "splitSuggestions[]", "splitSuggestions[].clusterIds[]")
LINK_FIELDS = ("id", "clusterId", "cardId", "title", "@key")


def layout_nodes(entries: DataFrame, links_only: bool = False) -> DataFrame:
    """Labelled nodes of stored layouts, or those that links need; ``entries`` has store, entry_id, payload."""
    chosen = {"paths": LINK_PATHS, "fields": LINK_FIELDS} if links_only else {}
    return dewey_nodes(entries, ["store", "entry_id"], "payload", LAYOUT_LISTS, LAYOUT_MAPS, ["cardSummaries"], **chosen)


def layout_links(nodes: DataFrame) -> DataFrame:
    """All parent-child links of stored layouts: store, entry_id, link_kind, parent_id, child_pos, child_id.

    A node is a child under its label cut short, and it may be a holder under its own
    label; holder and children of one label meet in one group of (store, entry, label), which is no larger than one list of
    one record.
    """
    key = ["store", "entry_id"]
    if "fields" in nodes.columns:
        nodes = nodes.withColumns({f: F.col("fields")[f] for f in LINK_FIELDS})
    path = F.col("schema_path")
    two_up = F.regexp_replace("dewey", r"\.\d+\.\d+$", "")
    kind = (
        F.when(path.isin("clusters[].memberCardIds[]", "clusters[].orderedCardIds[]", "clusters[].members[]"), "cluster_card")
        .when(path.isin("cardUnits[].units[]", "cardUnits[][]", "clusters[].members[].units[]"), "card_unit")
        .when(path == "unclustered[]", "unclustered_card")
        .when(path.isin("mergeSuggestions[].clusterIds[]", "splitSuggestions[].clusterIds[]"), "suggestion_cluster")
    )
    child_id = F.when(kind == "card_unit", F.coalesce("title", "value")).otherwise(F.coalesce("value", "cardId", "id", "@key"))
    # a map entry whose value is the list itself holds its elements directly
    holder = F.when(path == "cardUnits[][]", F.col("parent_dewey")).otherwise(two_up)
    parent_id = (
        F.when(path == "clusters[]", F.coalesce("id", "clusterId", "@key"))
        .when(path.isin("cardUnits[]", "clusters[].members[]"), F.coalesce("cardId", "id", "@key"))
        .when(path == "mergeSuggestions[]", F.concat(F.lit("merge#"), F.col("ordinal")))
        .when(path == "splitSuggestions[]", F.concat(F.lit("split#"), F.col("ordinal")))
        .when(path == "", F.lit("__unclustered"))
    )
    none = F.lit(None).cast("string")
    as_child = F.when(kind.isNotNull() & child_id.isNotNull(), F.struct(holder.alias("at"), kind.alias("link_kind"), none.alias("parent_id"), F.col("ordinal").alias("child_pos"), child_id.alias("child_id")))
    as_holder = F.when(parent_id.isNotNull(), F.struct(F.col("dewey").alias("at"), none.alias("link_kind"), parent_id.alias("parent_id"), F.lit(None).cast("int").alias("child_pos"), none.alias("child_id")))
    ends = nodes.select(*key, F.explode(F.array_compact(F.array(as_child, as_holder))).alias("x")).select(*key, "x.*")
    found = ends.withColumn("parent_id", F.max("parent_id").over(Window.partitionBy(*key, "at")))
    return found.where("link_kind is not null and parent_id is not null").select(*key, "link_kind", "parent_id", "child_pos", "child_id").distinct()


def flat_tables(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All tables of the nodes below each other: keys, table_name (the schema path), row_id, parent_id, child_pos, value, fields.

    One pass over the nodes, whatever the number of schema paths: a row's parent is the row that its cut label names, in the
    table of the path before it; an element's list is no row of its own.
    """
    up = F.when(F.col("schema_path").endswith("[]"), F.regexp_replace("dewey", r"\.\d+\.\d+$", "")).otherwise(F.regexp_replace("dewey", r"\.\d+$", ""))
    # the list of lists and the root have no member name between them and their holder
    up = F.when(F.col("schema_path").endswith("[][]"), F.col("parent_dewey")).when(F.col("dewey") == "0", F.lit(None).cast("string")).otherwise(up)
    return nodes.select(*keys, F.when(F.col("schema_path") == "", "record").otherwise(F.col("schema_path")).alias("table_name"), F.col("dewey").alias("row_id"), up.alias("parent_id"), F.col("ordinal").alias("child_pos"), "value", F.to_json("fields").alias("fields"))


def layout_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables of stored layouts; ``dewey`` is each row's id, ``holder_dewey`` the id of its parent row."""
    key = ["store", "entry_id"]
    return {
        "clusters": flat_table(nodes, "clusters[]", ["id", "@key", "title", "summary", "kind", "typeHint"], key),
        "members": flat_table(nodes, "clusters[].members[]", ["cardId", "summary"], key).unionByName(flat_table(nodes, "clusters[].memberCardIds[]", ["cardId", "summary"], key)).unionByName(flat_table(nodes, "clusters[].orderedCardIds[]", ["cardId", "summary"], key)),
        "units": flat_table(nodes, "clusters[].members[].units[]", ["title", "startLine", "endLine", "why", "tag", "anchorLine"], key).unionByName(flat_table(nodes, "cardUnits[].units[]", ["title", "startLine", "endLine", "why", "tag", "anchorLine"], key)).unionByName(flat_table(nodes, "cardUnits[][]", ["title", "startLine", "endLine", "why", "tag", "anchorLine"], key)),
        "merge_suggestions": flat_table(nodes, "mergeSuggestions[]", ["kind", "reason"], key),
        "split_suggestions": flat_table(nodes, "splitSuggestions[]", ["kind", "reason"], key),
        "unclustered": flat_table(nodes, "unclustered[]", ["cardId"], key),
    }
