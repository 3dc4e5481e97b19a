import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riftlens.operators import nested as N

LAYOUT = {
    "clusters": [{"id": "c1", "title": "T", "memberCardIds": ["a", "b"]}, {"id": "c2", "members": [{"cardId": "x", "units": [{"title": "u0"}, {"title": "u1"}]}]}],
    "unclustered": ["z"], "mergeSuggestions": [{"clusterIds": ["c1", "c2"]}], "splitSuggestions": None,
    "cardUnits": {"a": [{"title": "v0"}], "b": []}, "orderedCardIds": ["a"],
}
LINKS = {
    ("cluster_card", "c1", 0, "a"), ("cluster_card", "c1", 1, "b"), ("cluster_card", "c2", 0, "x"), ("card_unit", "x", 0, "u0"), ("card_unit", "x", 1, "u1"),
    ("card_unit", "a", 0, "v0"), ("unclustered_card", "__unclustered", 0, "z"), ("suggestion_cluster", "merge#0", 0, "c1"), ("suggestion_cluster", "merge#0", 1, "c2"),
}


def links(spark, payloads):
    rows = [("s", i, p, "clash") for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "store string, entry_id long, payload string, dewey string")
    out = {}
    few, every = (N.layout_links(N.layout_nodes(df, links_only=x)) for x in (True, False))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.collect()))
    for r in few.collect():
        out.setdefault(r.entry_id, set()).add((r.link_kind, r.parent_id, r.child_pos, r.child_id))
    return out


def snake(x):
    if isinstance(x, dict):
        return {"".join("_" + c.lower() if c.isupper() else c for c in k): snake(v) for k, v in x.items()}
    return [snake(v) for v in x] if isinstance(x, list) else x


def test_wrappings_give_the_same_links(spark):
    plain = json.dumps(LAYOUT)
    units_listed = LAYOUT | {"cardUnits": [{"cardId": "a", "units": [{"title": "v0"}]}]}
    keyed = LAYOUT | {"clusters": {"c1": {"memberCardIds": ["a", "b"]}, "c2": LAYOUT["clusters"][1]}}
    lone = LAYOUT | {"unclustered": "z", "mergeSuggestions": {"clusterIds": ["c1", "c2"]}}
    many = [
        plain, json.dumps(LAYOUT, indent=2), json.dumps(plain), "﻿ " + plain, f"```json\n{plain}\n```", json.dumps({"structured_output": LAYOUT}), json.dumps({"type": "result", "result": plain}),
        json.dumps({"version": 2, "layout": LAYOUT, "meta": {"tries": 1}}), json.dumps(snake(LAYOUT)), json.dumps(units_listed), json.dumps(keyed), json.dumps(lone),
    ]
    got = links(spark, many)
    for i in range(len(many)):
        assert got[i] == LINKS, many[i][:60]


def test_damaged_and_empty_give_nothing(spark):
    plain = json.dumps(LAYOUT)
    assert links(spark, [None, "", "[]", "{}", "null", plain[:-5], "x" * 10, plain + "}", '"' + plain, "NaN"]) == {}


def test_repeated_rows_and_empty_table(spark):
    assert links(spark, []) == {}
    df = spark.createDataFrame([("s", 1, json.dumps(LAYOUT))] * 3, "store string, entry_id long, payload string")
    assert N.layout_links(N.layout_nodes(df)).count() == len(LINKS)


def test_deep_nesting_does_not_crash(spark):
    deep = "[" * 5000 + "]" * 5000
    assert links(spark, [deep, '{"clusters": ' + deep + "}"]) == {}


def test_tables_join_by_cut_labels(spark):
    df = spark.createDataFrame([("s", 1, json.dumps(LAYOUT))], "store string, entry_id long, payload string")
    t = N.layout_tables(N.layout_nodes(df))
    members = t["members"].select(F.col("dewey").alias("member"), "cardId")
    joined = t["units"].join(members, F.col("holder_dewey") == F.col("member"))
    assert {(r.cardId, r.title) for r in joined.select("cardId", "title").collect()} == {("x", "u0"), ("x", "u1")}


VALUE = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("abc_", max_size=4), c, max_size=3), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), VALUE, max_size=4))
def test_labels_are_unique_and_their_parents_exist(record):
    rows = list(N.label(record, frozenset(), frozenset(), frozenset()))
    ids = [r[0] for r in rows]
    assert len(ids) == len(set(ids))
    known = set(ids)
    for dewey in ids:
        up = dewey
        while "." in up and up.rsplit(".", 1)[0] not in known:
            up = up.rsplit(".", 1)[0]
        assert dewey == "0" or "." in up


def test_deep_records_keep_their_lower_part():
    root = {"x": "end"}
    for _ in range(700):
        root = {"a": root}
    got = list(N.label(root, frozenset(), frozenset(), frozenset()))
    assert len(got) == 701 and got[-1][4] == {"x": "end"}


def test_flat_tables_name_each_row_s_parent_and_place(spark):
    text = json.dumps({"clusters": [{"id": "a", "members": [{"cardId": "x"}, {"cardId": "y", "units": [{"title": "t"}]}]}], "cardUnits": {"x": [{"title": "u"}]}, "unclustered": ["z"]})
    df = spark.createDataFrame([("s", 1, text), ("s", 2, None), ("s", 3, "{broken")], "store string, entry_id long, payload string")
    rows = {r.row_id: r for r in N.flat_tables(N.layout_nodes(df), ["store", "entry_id"]).collect()}
    assert {r.entry_id for r in rows.values()} == {1}
    tables = {r.table_name for r in rows.values()}
    assert tables == {"record", "clusters[]", "clusters[].members[]", "clusters[].members[].units[]", "cardUnits[]", "cardUnits[][]", "unclustered[]"}
    for r in rows.values():
        assert r.parent_id is None if r.table_name == "record" else r.table_name.startswith("" if rows[r.parent_id].table_name == "record" else rows[r.parent_id].table_name)
    unit = next(r for r in rows.values() if r.table_name == "clusters[].members[].units[]")
    assert json.loads(rows[unit.parent_id].fields)["cardId"] == "y" and rows[unit.parent_id].child_pos == 1 and json.loads(unit.fields) == {"title": "t"}


def test_wrappings_of_any_depth_are_taken_off():
    text = json.dumps({"clusters": []})
    for _ in range(14):
        text = '{"result": ' + text + "}"
    assert N.unwrap(text) == {"clusters": []}
