"""The registered queries of the core and their SQL for DuckDB, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftlens.functions import rules as R
from riftlens.functions import text as X
from riftlens.operators import cards as C
from riftlens.operators import components, features, intervals, layout, nested, signals, store, verify, views
from riftlens.plans import review as plan
from riftlens.session import checkpointed, table
from riftlens.sources import declarations, snapshots
from riftlens.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- tables as the operators take them


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    return C.distinct_lines(table(spark, d, "diff_lines"))


def files_of(spark: SparkSession, d: str) -> DataFrame:
    """Files once each; what is stored again differs only in when it came."""
    return table(spark, d, "file_diffs").drop("ingested_at").distinct()


def turns_of(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "thread_turns"), ["thread_id", "msg_seq"], "received_at", "text")


LINES = "select distinct file_id, line_seq, kind, new_lineno, old_lineno, content from diff_lines"
FILES = "select distinct file_id, review_id, repo_path, file_seq, new_path, old_path, status, is_binary, new_source, old_source from file_diffs"
TURNS = "select thread_id, msg_seq, arg_max(author, received_at) author, arg_max(text, received_at) text, arg_max(kind, received_at) kind from thread_turns group by all"
GUTTER = """coalesce(new_lineno, last_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between unbounded preceding and 1 preceding),
 greatest(first_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between unbounded preceding and unbounded following) - 1, 0), 0)"""


def _sql_any(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def sql_layer(path: str, name: str) -> str:
    p, n = f"lower({path})", f"lower({name})"
    out = f"case when {_sql_any(p, R.TEST_PATHS)} or regexp_matches({n}, '^test|(test|tests|spec)$') then 5"
    for k, paths, names in R.LAYERS:
        extra = f" or {n} = 'main' or {n} like 'handle%'" if k == 0 else ""
        out += f" when {_sql_any(p, paths)} or {_sql_any(n, names)}{extra} then {k}"
    return out + " else 6 end"


BASE = "string_split({0}, '/')[-1]"

# --- nested records


def layout_entries(spark: SparkSession, d: str) -> DataFrame:
    """Both stores as one: store, entry_id, payload."""
    a = table(spark, d, "cluster_result").select(F.lit("cluster_result").alias("store"), "entry_id", F.col("result_json").alias("payload"))
    b = table(spark, d, "review_layout").select(F.lit("review_layout").alias("store"), "entry_id", F.col("layout_json").alias("payload"))
    return a.unionByName(b)


def _sql_links() -> str:
    """The links by walking each payload from the top, where the operator labels all nodes and cuts the labels."""
    key = lambda j, *names: "coalesce(" + ", ".join(f"nullif(({j} -> '$.{n}')::varchar, 'null')::json" for n in names) + ")"
    text = lambda j, *names: "coalesce(" + ", ".join(f"({j} ->> '$.{n}')" for n in names) + ")"
    scalar = lambda j: f"case when json_type({j}) not in ('OBJECT', 'ARRAY', 'NULL') then {j} ->> '$' end"
    listed = lambda j: f"case when json_type({j}) = 'ARRAY' then json_extract({j}, '$[*]') when {j} is not null then [{j}] end"
    each = lambda src, cols, j: f"select {cols}, unnest({listed(j)}) e, generate_subscripts({listed(j)}, 1) - 1 i from {src} where {j} is not null"
    # a map is a list whose elements carry their keys
    mapped = lambda src, j: f"select s, id, null k, e, i from ({each(f"(select * from {src} where json_type({j}) = 'ARRAY')", 's, id', j)}) union all select s, id, k, json_extract({j}, '$.\"' || k || '\"'), null from (select *, unnest(json_keys({j})) k from {src} where json_type({j}) = 'OBJECT')"
    wrapped = "coalesce(" + ", ".join(f"case when json_type(j, '$.{w}') in ('OBJECT', 'VARCHAR') then j ->> '$.{w}' end" for w in nested.WRAPPERS) + ")"
    blank = "' ' || chr(9) || chr(10) || chr(13) || chr(65279)"
    inner = f"case when json_valid(j) then case json_type(j) when 'VARCHAR' then j ->> '$' when 'OBJECT' then {wrapped} end when regexp_matches(j, '^```') then nullif(regexp_extract(j, '(?s)^```[A-Za-z]*[ \\t]*\\r?\\n(.*?)\\r?\\n?```\\s*$', 1), '') end"
    member = f"coalesce({scalar('e')}, {text('e', 'cardId', 'card_id')}, {text('e', 'id')})"
    unit = f"coalesce({text('e', 'title')}, {scalar('e')})"
    members = " union all ".join(each("c", "s, id, cid", f"m{n}") for n in range(3))
    return f"""with recursive p as (select 'cluster_result' s, entry_id id, result_json j from cluster_result union all select 'review_layout', entry_id, layout_json from review_layout),
 u(s, id, j) as (select s, id, ltrim(j, {blank}) from p where j is not null union all select s, id, ltrim({inner}, {blank}) from u where {inner} is not null),
 r as (select s, id, j::json j from u where {inner} is null and json_valid(j) and json_type(j) = 'OBJECT'),
 g as (select s, id, {key("j", "clusters")} clusters, {key("j", "cardUnits", "card_units")} units, {key("j", "unclustered")} loose, {key("j", "mergeSuggestions", "merge_suggestions")} merges, {key("j", "splitSuggestions", "split_suggestions")} splits from r),
 c as (select s, id, coalesce({text("e", "id")}, {text("e", "clusterId", "cluster_id")}, k) cid, {key("e", "memberCardIds", "member_card_ids")} m0, {key("e", "orderedCardIds", "ordered_card_ids")} m1, {key("e", "members")} m2 from ({mapped("g", "clusters")})),
 mb as ({members}),
 mu as (select s, id, {text("e", "cardId", "card_id", "id")} card, {key("e", "units")} un from ({each("c", "s, id", "m2")}) where json_type(e) = 'OBJECT'),
 cu as (select s, id, coalesce({text("e", "cardId", "card_id", "id")}, k) card, case when json_type(e) = 'ARRAY' then e when json_type(e) = 'OBJECT' then {key("e", "units")} end un from ({mapped("g", "units")})),
 un as ({each("(select * from mu union all select * from cu)", "s, id, card", "un")}),
 sg as (select s, id, 'merge#' || i parent, {key("e", "clusterIds", "cluster_ids")} ids from ({each("g", "s, id", "merges")}) union all select s, id, 'split#' || i, {key("e", "clusterIds", "cluster_ids")} from ({each("g", "s, id", "splits")})),
 l as (select s, id, 'cluster_card' kind, cid parent, i, {member} child from mb union all select s, id, 'card_unit', card, i, {unit} from un union all select s, id, 'unclustered_card', '__unclustered', i, {member} from ({each("g", "s, id", "loose")})
  union all select s, id, 'suggestion_cluster', parent, i, {member} from ({each("sg", "s, id, parent", "ids")}))
 select distinct s store, id entry_id, kind link_kind, parent parent_id, i::int child_pos, child child_id from l where parent is not null and child is not null"""


@query(_sql_links())
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.layout_links(nested.layout_nodes(layout_entries(spark, d), links_only=True))


@query()
def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every flat table, one for each schema path: the row's table, its id, its parent row's id and its place, and its fields."""
    return nested.flat_tables(nested.layout_nodes(layout_entries(spark, d)), ["store", "entry_id"])


@query()
def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Rows and entries of each flat table in each store."""
    return p5_tables(spark, d).groupBy("store", "table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entry_id").alias("n_entries"))


# --- cards and lines


@query(f"""with c as (select file_id, count(*) filter (kind = 'add') adds, count(*) filter (kind = 'del') dels from ({LINES}) group by 1),
 f as (select file_id, coalesce(nullif(new_path, ''), old_path) path, status, is_binary, coalesce(adds, 0) adds, coalesce(dels, 0) dels from (select distinct file_id, new_path, old_path, status, is_binary from file_diffs) left join c using (file_id)),
 g as (select *, case when is_binary then 'binary' when status = 'Deleted' then 'deleted' when status = 'Added' then 'added' else 'modified' end route, {BASE.format("path")} base,
  case when status = 'Added' then adds when status = 'Deleted' then dels else adds + dels end n from f)
 select file_id, path || '::__file' card_id, route, case status when 'Added' then 'added' when 'Deleted' then 'deleted' else 'modified' end change_type, adds, dels,
 case when is_binary then case status when 'Added' then 'Adds' when 'Deleted' then 'Removes' else 'Updates' end || ' binary file ' || base || '.'
  when status = 'Added' then 'Adds ' || base || ': +' || adds || ' line' when status = 'Deleted' then 'Removes ' || base || ': −' || dels || ' line' else 'Updates ' || base || ': +' || adds || ' −' || dels || ' line' end
  || case when is_binary then '' when n = 1 then '.' else 's.' end summary
 from g where route = 'binary' or adds + dels > 0""")
def review_cards(spark: SparkSession, d: str) -> DataFrame:
    return C.cards(table(spark, d, "file_diffs"), lines_of(spark, d))


@query(f"select file_id, line_seq, {GUTTER} n from ({LINES})")
def line_gutter(spark: SparkSession, d: str) -> DataFrame:
    return C.gutter(lines_of(spark, d), ["file_id"]).select("file_id", "line_seq", "n")


@query(f"""select file_id, line_seq, greatest(case when kind = 'del' then coalesce(last_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between unbounded preceding and 1 preceding),
 first_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between 1 following and unbounded following)) else new_lineno end - 1, 0) "row" from ({LINES})""")
def effective_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows on the new side that stand for each line; null (not 0) where the file has no new side."""
    return intervals.effective_rows(lines_of(spark, d), ["file_id"]).select("file_id", "line_seq", F.coalesce("row", F.lit(0)).alias("row"))


@query(f"""with g as (select *, {GUTTER} n from ({LINES})), c as (select * from g where kind in ('add', 'del')),
 r as (select *, case when line_seq - lag(line_seq) over w > 1 or n - lag(n) over w > 1 then 1 else 0 end b from c window w as (partition by file_id order by line_seq)),
 s as (select *, sum(b) over (partition by file_id order by line_seq) run_no from r)
 select file_id, run_no::bigint run_no, min(line_seq) first_seq, max(line_seq) last_seq, count(*) filter (kind = 'add') adds, count(*) filter (kind = 'del') dels from s group by 1, 2""")
def change_runs(spark: SparkSession, d: str) -> DataFrame:
    return C.change_runs(lines_of(spark, d), ["file_id"])


@query(f"""with r as (select *, row_number() over (partition by file_id order by line_seq) r from ({LINES}) where kind in ('add', 'del'))
 select file_id, string_agg(case when kind = 'add' then '+' else '-' end || content, chr(10) order by r) snippet from r where r <= 12 group by 1""")
def snippet_top12(spark: SparkSession, d: str) -> DataFrame:
    return C.snippets(lines_of(spark, d), ["file_id"])


@query(f"""with g as (select *, {GUTTER} n from ({LINES})) select file_id, string_agg(n || ' ' || case when kind = 'add' then '+' else '-' end || content, chr(10) order by line_seq) changes from g where kind in ('add', 'del') group by 1""")
def unit_review_text(spark: SparkSession, d: str) -> DataFrame:
    return C.unit_review_text(lines_of(spark, d), ["file_id"])


@query(f"""with f as (select file_id, regexp_replace(old_source, '\\r?\\n$', '') s from ({FILES}) where status = 'Deleted' and old_source <> ''),
 x as (select file_id, string_split_regex(s, '\\r?\\n') a from f)
 select file_id, (i - 1)::int line_seq, i::int n, 'del' t, a[i] c from (select file_id, a, unnest(range(1, len(a) + 1)) i from x)""")
def deleted_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.deleted_lines(files_of(spark, d).where("old_source <> ''"))


@query(f"select file_id, greatest(max(length(content) + len(regexp_extract_all(content, '[\\x{{1100}}-\\x{{115F}}\\x{{2E80}}-\\x{{A4CF}}\\x{{AC00}}-\\x{{D7A3}}\\x{{F900}}-\\x{{FAFF}}\\x{{FE30}}-\\x{{FE4F}}\\x{{FF00}}-\\x{{FF60}}\\x{{FFE0}}-\\x{{FFE6}}\\t]'))), 24)::int width from ({LINES}) group by 1")
def widest_line(spark: SparkSession, d: str) -> DataFrame:
    return views.widest(lines_of(spark, d), ["file_id"])


@query(f"""with h as (select file_id, line_seq row_no, length(content) + 1 height from ({LINES})), p as (select *, sum(height) over (partition by file_id order by row_no) e from h)
 select file_id, row_no, e::bigint "end" from (select *, min(row_no) over (partition by file_id) f from p where e > 2000 - 1600) where e - height < 3000 + 1600 or row_no = f""")
def viewport_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = lines_of(spark, d).select("file_id", F.col("line_seq").alias("row_no"), (F.length("content") + 1).alias("height"))
    return views.viewport(rows, ["file_id"], 2000, 3000).select("file_id", "row_no", "end")


# --- intervals


@query("""with i as (select o_custkey c, o_orderkey k, datediff('day', date '1990-01-01', o_orderdate::date) s, datediff('day', date '1990-01-01', o_orderdate::date) + (o_orderkey % 5 + 1) * 20 e from orders),
 m as (select p.k, i.k j, row_number() over (partition by p.k order by i.e - i.s, i.k) r from i p join i on p.c = i.c and p.s between i.s and i.e)
 select k o_orderkey, j sym_idx from m where r = 1""")
def innermost_order(spark: SparkSession, d: str) -> DataFrame:
    """The shortest running order of the same customer on each order's day."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    spans = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("sym_idx"), day.alias("start_row"), (day + (F.col("o_orderkey") % 5 + 1) * 20).alias("end_row"))
    points = spans.select("o_custkey", F.col("sym_idx").alias("o_orderkey"), F.col("start_row").alias("row"))
    return intervals.innermost(points, spans, ["o_custkey"]).select("o_orderkey", "sym_idx")


@query()
def line_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines by the innermost declaration that holds them."""
    syms = declarations.symbols(files_of(spark, d).where("not is_binary"))
    got = intervals.attribute_lines(lines_of(spark, d), syms, ["file_id"]).where("kind <> 'ctx'")
    return got.groupBy("file_id", "sym_idx").agg(F.count(F.lit(1)).alias("changed_lines"))


# --- views


def _view_rows(spark: SparkSession, d: str) -> DataFrame:
    at = files_of(spark, d).select("file_id", "review_id", X.card_id(F.col("new_path")).alias("card_id"))
    held = table(spark, d, "threads").where("line_seq is not null").join(at, ["review_id", "card_id"]).select("file_id", "line_seq").distinct().withColumn("has_thread", F.lit(True))
    lines = lines_of(spark, d).join(held, ["file_id", "line_seq"], "left")
    return lines.select("file_id", F.col("line_seq").alias("row_no"), (F.col("kind") == "ctx").alias("is_ctx"), F.coalesce("has_thread", F.lit(False)).alias("has_thread"))


HELD = f"select distinct file_id, t.line_seq, t.thread_id from threads t join ({FILES}) f on t.review_id = f.review_id and t.card_id = f.new_path || '::__file' where t.line_seq is not null"


@query(f"""with l as (select *, sum(case when kind = 'ctx' then 1 else 0 end) over (partition by file_id order by line_seq) run from ({LINES})),
 p as (select *, row_number() over (partition by file_id, run, kind order by line_seq) i from l),
 c as (select file_id, run, case when kind = 'ctx' then 0 else i end i, min(line_seq) filter (kind in ('ctx', 'del')) left_seq, min(line_seq) filter (kind in ('ctx', 'add')) right_seq from p group by 1, 2, 3)
 select file_id, (row_number() over (partition by file_id order by run, i) - 1)::int row_no, left_seq, right_seq from c""")
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return views.split_rows(lines_of(spark, d), ["file_id"])


@query(f"""with h as (select distinct file_id, line_seq from ({HELD})), l as (select l.file_id, l.line_seq r, l.kind = 'ctx' c, h.line_seq is not null t from ({LINES}) l left join h using (file_id, line_seq)),
 n as (select *, sum(case when c then 0 else 1 end) over (partition by file_id order by r) run, min(r) over (partition by file_id) f, max(r) over (partition by file_id) z from l),
 g as (select file_id, run, min(r) a, max(r) b, bool_or(t) t, any_value(f) f, any_value(z) z from n where c group by 1, 2),
 k as (select *, case when a = f then 0 else 2 end tp, case when b = z then 0 else 2 end bt from g)
 select file_id, a + tp first_row, b - bt last_row, b - a + 1 - tp - bt hidden from k where not t and b - a + 1 - tp - bt >= 4""")
def fold_context(spark: SparkSession, d: str) -> DataFrame:
    return views.folds(_view_rows(spark, d), ["file_id"])


@query(f"""with u as (select distinct file_id, thread_id unit_idx, line_seq + 1 anchor from ({HELD})), r as (select file_id, new_lineno n, min(line_seq) row_no from ({LINES}) where kind = 'add' group by 1, 2)
 select u.file_id, unit_idx, anchor, row_no::bigint at_row from u asof join r on u.file_id = r.file_id and r.n >= u.anchor""")
def unit_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The first added line at or after each thread's line."""
    at = files_of(spark, d).select("file_id", "review_id", X.card_id(F.col("new_path")).alias("card_id"))
    units = table(spark, d, "threads").where("line_seq is not null").join(at, ["review_id", "card_id"]).select("file_id", F.col("thread_id").alias("unit_idx"), (F.col("line_seq") + 1).alias("anchor_line"), F.lit(0).alias("start_line")).distinct()
    rows = lines_of(spark, d).where("kind = 'add'").select("file_id", F.col("new_lineno").alias("n"), F.col("line_seq").alias("row_no"))
    return views.unit_anchors(units, rows, ["file_id"])


SIDE = "case when regexp_replace(lower(author), '[^a-z]', '', 'g') in ('ai', 'assistant') then 'Assistant' else 'User' end"


def _sided(spark: SparkSession, d: str) -> DataFrame:
    return turns_of(spark, d).withColumn("side", F.when(F.regexp_replace(F.lower("author"), "[^a-z]", "").isin("ai", "assistant"), "Assistant").otherwise("User"))


@query(f"""with t as (select *, {SIDE} side, coalesce(kind = 'question', false) q from ({TURNS})), n as (select *, case when lag(side) over w = side then 0 else 1 end b from t window w as (partition by thread_id order by msg_seq)),
 g as (select *, sum(b) over (partition by thread_id order by msg_seq) - 1 g from n)
 select thread_id, g::bigint group_no, side, count(*) size, case when count(*) filter (q) = count(*) then 'all' when count(*) filter (q) > 0 then 'some' else 'none' end colour from g group by 1, 2, 3""")
def spine_groups(spark: SparkSession, d: str) -> DataFrame:
    items = _sided(spark, d).withColumn("passed", F.coalesce(F.col("kind") == "question", F.lit(False)))
    return views.spine_groups(items, ["thread_id"], "side", ["msg_seq"])


@query(f"""with m as (select thread_id, count(*) n from ({TURNS}) group by 1), t as (select card_id, coalesce(sum(n), 0)::bigint messages, count(*) threads, count(*) filter (not resolved) open_threads from threads left join m using (thread_id) group by 1),
 c as (select new_path || '::__file' card_id, bool_or(status = 'Added') p from file_diffs group by 1)
 select card_id, coalesce(messages, 0) messages, coalesce(threads, 0) threads, coalesce(open_threads, 0) open_threads, case when coalesce(open_threads, 0) > 0 then 'flag' when p then 'pass' else 'pending' end status from c left join t using (card_id)""")
def thread_status(spark: SparkSession, d: str) -> DataFrame:
    """Cards by their threads; files that are new count as passed."""
    files = table(spark, d, "file_diffs").withColumn("card_id", X.card_id(F.col("new_path")))
    return views.card_status(table(spark, d, "threads"), turns_of(spark, d), files.where("status = 'Added'"), files)


@query(f"select thread_id, string_agg({SIDE} || ': ' || coalesce(text, ''), chr(10) || chr(10) order by msg_seq) transcript from ({TURNS}) group by 1")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return views.transcript(turns_of(spark, d))


@query(f"""select review_id, count(*) commands, count(*) filter (resolved) settled, string_agg(case when resolved then '- [x] ' else '- [ ] ' end || coalesce(text, '') || ' (' || regexp_replace(card_id, '::__file$', '') || ')', chr(10) order by thread_id, msg_seq) checklist
 from ({TURNS}) t join threads using (thread_id) where t.kind = 'command' group by 1""")
def command_checklist(spark: SparkSession, d: str) -> DataFrame:
    return views.checklist(turns_of(spark, d), table(spark, d, "threads"))


@query(f"""with a as (select file_id, min(line_seq) s from ({HELD}) group by 1), l as (select l.file_id, line_seq, s, row_number() over w - 1 i, count(*) over (partition by l.file_id) n from ({LINES}) l join a using (file_id) window w as (partition by l.file_id order by line_seq)),
 p as (select *, least(count(*) filter (line_seq < s) over (partition by file_id), n - 1) p from l)
 select file_id, line_seq from p where n <= 121 or abs(i - p) <= 60""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Lines around the first thread of each file."""
    at = files_of(spark, d).select("file_id", "review_id", X.card_id(F.col("new_path")).alias("card_id"))
    anchors = table(spark, d, "threads").where("line_seq is not null").join(at, ["review_id", "card_id"]).groupBy("file_id").agg(F.min("line_seq").alias("anchor_seq"))
    return views.excerpt(lines_of(spark, d), anchors, ["file_id"]).select("file_id", "line_seq")


@query(f"""with c as (select file_id, any_value(new_path) path from ({FILES}) group by 1), n as (select c.path, count(*) filter (kind = 'add') adds, count(*) filter (kind = 'del') dels from c left join ({LINES}) using (file_id) group by c.file_id, c.path),
 x as (select path, adds, dels, string_split(path, '/') s from n), e as (select path, adds, dels, array_to_string(s[1:i], '/') dir from (select *, unnest(range(0, len(s))) i from x))
 select dir, (case when dir = '' then 0 else len(string_split(dir, '/')) end)::int depth, sum(adds)::bigint adds, sum(dels)::bigint dels, count(distinct path) files from e group by 1""")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return views.tree(_tree_cards(spark, d))


def _tree_cards(spark: SparkSession, d: str) -> DataFrame:
    counts = C.line_counts(lines_of(spark, d), ["file_id"])
    files = files_of(spark, d).groupBy("file_id").agg(F.first("new_path").alias("path"))
    return files.join(counts, "file_id", "left").select("path", F.coalesce("adds", F.lit(0)).alias("adds"), F.coalesce("dels", F.lit(0)).alias("dels"))


@query(f"""with c as (select file_id, any_value(new_path) path from ({FILES}) group by 1), n as (select c.path, count(*) filter (kind = 'add') adds, count(*) filter (kind = 'del') dels from c left join ({LINES}) using (file_id) group by c.file_id, c.path),
 x as (select path, adds, dels, string_split(path, '/') s from n), e as (select path, adds, dels, array_to_string(s[1:i], '/') dir from (select *, unnest(range(0, len(s))) i from x)),
 t as (select dir, sum(adds)::bigint adds, sum(dels)::bigint dels, count(distinct path) files from e where dir <> '' group by 1),
 k as (select case when contains(dir, '/') then regexp_replace(dir, '/[^/]*$', '') else '' end dir, count(*) dirs from t group by 1), o as (select distinct case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end dir from n),
 thru as (select t.dir from t join k using (dir) where k.dirs = 1 and dir not in (select dir from o)), shown as (select *, string_split(dir, '/') s from t where dir not in (select dir from thru)),
 stops as (select dir, max(i) i from (select dir, s, unnest(range(1, len(s))) i from shown) where array_to_string(s[1:i], '/') not in (select dir from thru) group by 1)
 select dir, array_to_string(s[coalesce(i, 0) + 1:], '/') label, adds, dels, files from shown left join stops using (dir)""")
def tree_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return views.collapsed_tree(_tree_cards(spark, d))


@query("""with o as (select card_id, min(thread_id) p from threads group by 1), c as (select new_path || '::__file' card_id, min(file_id) s from file_diffs group by 1)
 select card_id, (row_number() over (order by p is null, coalesce(p, s), s, card_id) - 1)::int pos from c left join o using (card_id)""")
def flatten_order(spark: SparkSession, d: str) -> DataFrame:
    """Cards in the order of their first thread, then the rest in file order."""
    ordered = table(spark, d, "threads").select("card_id", F.col("thread_id").alias("pos"))
    cards = table(spark, d, "file_diffs").select(X.card_id(F.col("new_path")).alias("card_id"), F.col("file_id").alias("seq"))
    return views.flatten_order(ordered, cards)


@query("select thread_id, card_id, row_number() over (partition by card_id order by opened_at, thread_id)::int position, count(*) over (partition by card_id) \"of\" from threads")
def thread_positions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "threads").withColumn("pos", F.struct("opened_at", "thread_id"))
    return views.cluster_positions(t, "card_id", "pos").select("thread_id", "card_id", "position", "of")


# --- scalars and rules

PATHS = f"select distinct new_path p, {BASE.format('new_path')} b from file_diffs"


@query(f"""with x as ({PATHS}), y as (select *, list_filter(string_split(p, '/'), lambda s: s <> '') s, lower(p) q, lower(b) n from x)
 select p path, b base, case when len(s) <= 5 then p else array_to_string(s[1:2] || ['…'] || s[-2:], '/') end middle, p || '::__file' card_id,
 case when not contains(p, '.') then null when p like '%.go' then 'go' when p like '%.java' then 'java' when p like '%.rs' then 'rust' when p like '%.kt' then 'kotlin' end lang,
 case when contains(q, 'migration') or contains(q, '/.sqlx/') or q like '%.sql' then 'migration' when n in ('dockerfile', 'caddyfile', '.gitignore', '.dockerignore', 'makefile') or starts_with(n, 'cargo.') or starts_with(q, '.github/') or contains(q, '/.github/') or regexp_matches(q, '\\.(toml|yaml|yml|json|sh|caddy|env|conf|ini|lock)$') then 'config' else 'file' end file_kind,
 {sql_layer("p", "b")} layer,
 case when {_sql_any("q", R.ENTRY_PATHS)} or regexp_matches(n, '(controller|handler|resource)$|^main$|^handle') then b || ' (' || p || ')' end entry,
 array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(b, '[-_]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') title from y""")
def path_scalars(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    base = X.basename(p)
    return table(spark, d, "file_diffs").select(F.col("new_path").alias("path")).distinct().select(
        "path", base.alias("base"), X.middle_path(p).alias("middle"), X.card_id(p).alias("card_id"), X.language(p).alias("lang"), R.file_kind(p).alias("file_kind"), R.layer_rank(p, base).alias("layer"), R.entry_point(p, base).alias("entry"), X.provisional_title(base).alias("title")
    )


@query(f"""with l as (select file_id, case when new_path like '%.go' then 'go' when new_path like '%.java' then 'java' when new_path like '%.rs' then 'rust' when new_path like '%.kt' then 'kotlin' end lang, trim(unnest(string_split(new_source, chr(10))), chr(32) || chr(9) || chr(13)) x from ({FILES}) where new_source <> ''),
 s as (select file_id, case when lang = 'rust' and starts_with(x, 'use ') then string_split(regexp_replace(regexp_replace(x, '^(use )+', ''), ';+$', ''), '::')[-1]
  when lang = 'go' and regexp_matches(x, '^".*"$') and length(x) > 1 then string_split(regexp_replace(x, '^"+|"+$', '', 'g'), '/')[-1]
  when lang = 'java' and starts_with(x, 'import ') then string_split(regexp_replace(regexp_replace(x, '^(import )+(static )*', ''), ';+$', ''), '.')[-1]
  when lang = 'kotlin' and starts_with(x, 'import ') then case when contains(x, ' as ') then trim(string_split(x, ' as ')[-1]) else string_split(regexp_replace(regexp_replace(x, '^(import )+', ''), ';+$', ''), '.')[-1] end end i from l),
 t as (select file_id, trim(regexp_replace(trim(i), '^\\{{+|\\}}+$', '', 'g')) ident from s where i is not null)
 select distinct file_id, ident from t where ident <> '' and ident <> '*' and not contains(ident, ' ')""")
def import_names(spark: SparkSession, d: str) -> DataFrame:
    files = files_of(spark, d).where("new_source <> ''")
    return files.select("file_id", F.explode(X.imported_names(X.language(F.col("new_path")), F.col("new_source"))).alias("ident")).distinct()


@query(f"""with t as (select thread_id, msg_seq, unnest(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_.]*\\(\\)|[\\p{{L}}\\p{{N}}_.]+)', 1)) w from ({TURNS}) where text is not null),
 u as (select distinct thread_id, msg_seq, regexp_replace(w, '^\\.+|\\.+$', '', 'g') token from t), c as (select *, regexp_replace(token, '\\(\\)$', '') b from u where regexp_matches(token, '[._]|\\(\\)$|\\p{{Ll}}\\p{{Lu}}')),
 a as (select distinct lower({BASE.format('new_path')}) n from file_diffs)
 select thread_id, count(*) flagged, string_agg(distinct token, ' ' order by token) tokens from c where token <> '' and lower(b) not in (select n from a) and lower(string_split(b, '.')[1]) not in (select n from a) and lower(string_split(b, '.')[-1]) not in (select n from a) group by 1""")
def suspicious_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words in answers that look like code and name no file of ours."""
    texts = turns_of(spark, d).where("text is not null").withColumn("cluster_id", F.struct("thread_id", "msg_seq"))
    allowed = table(spark, d, "file_diffs").select(X.basename(F.col("new_path")).alias("name")).distinct()
    got = verify.suspicious(texts, allowed)
    return got.groupBy(F.col("cluster_id.thread_id").alias("thread_id")).agg(F.count(F.lit(1)).alias("flagged"), F.array_join(F.array_sort(F.collect_set("token")), " ").alias("tokens"))


# --- relations and components


@query(f"""with recursive f as (select distinct file_id, review_id, repo_path, file_seq, new_path from file_diffs),
 e as (select file_id a, lead(file_id) over (partition by review_id order by file_seq, file_id) b, string_split(new_path, '/')[1] x, lead(string_split(new_path, '/')[1]) over (partition by review_id order by file_seq, file_id) y from f),
 g as (select a, b from e where x = y union all select b, a from e where x = y), r(id, m) as (select file_id, file_id from f union select g.b, r.m from r join g on g.a = r.id)
 select id, min(m) component from r group by 1""")
def file_components(spark: SparkSession, d: str) -> DataFrame:
    """Files of a review that follow each other within one top folder, as components."""
    f = table(spark, d, "file_diffs").select("file_id", "review_id", "repo_path", "file_seq", "new_path").distinct()
    w = Window.partitionBy("review_id").orderBy("file_seq", "file_id")
    top = F.substring_index("new_path", "/", 1)
    pairs = f.select(F.col("file_id").alias("a"), F.lead("file_id").over(w).alias("b"), top.alias("x"), F.lead(top).over(w).alias("y")).where("x = y").select("a", "b")
    return components.components(f.select(F.col("file_id").alias("id")), pairs)


@query()
def relation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Strong and weak pairs of the changed symbols' cards of each review."""
    files, lines = files_of(spark, d), lines_of(spark, d)
    parsed = checkpointed(declarations.parsed(plan.usable(files)))
    return plan.relation_pairs(files, checkpointed(plan.changed_table(files, lines, parsed)), parsed)


@query()
def review_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layered layout of the seeds of each review; every card of the review is in it."""
    return plan.review(files_of(spark, d).withColumn("ingested_at", F.lit(0)), lines_of(spark, d)).layout


# --- signals


def _sides(spark: SparkSession, d: str) -> DataFrame:
    files = signals.guarded(files_of(spark, d))
    base = declarations.symbols(files, "old_source").withColumn("side", F.lit("base"))
    head = declarations.symbols(files, "new_source").withColumn("side", F.lit("head"))
    sources = files.select("file_id", F.col("old_source").alias("base_source"), F.col("new_source").alias("head_source"))
    return signals.normalised(base.unionByName(head), sources)


def _renames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The symbols of both states, and the renames to symbols that hold a changed line."""
    norm = checkpointed(_sides(spark, d))
    files = signals.guarded(files_of(spark, d))
    head = norm.where("side = 'head'").select("file_id", "sym_idx", "start_row", "end_row")
    changed = C.changed_symbols(intervals.attribute_lines(lines_of(spark, d).join(files.select("file_id").distinct(), "file_id", "left_semi"), head, ["file_id"]), head, ["file_id"])
    return norm, signals.renames(norm, changed)


@query()
def symbol_renames(spark: SparkSession, d: str) -> DataFrame:
    return _renames(spark, d)[1]


@query()
def deleted_symbols(spark: SparkSession, d: str) -> DataFrame:
    return signals.deleted(*_renames(spark, d))


@query()
def signature_changes(spark: SparkSession, d: str) -> DataFrame:
    return signals.signature_changes(_sides(spark, d))


@query()
def declared_symbols(spark: SparkSession, d: str) -> DataFrame:
    return declarations.symbols(files_of(spark, d).where("not is_binary"))


@query()
def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    return declarations.references(files_of(spark, d).where("not is_binary")).groupBy("file_id", "bucket").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("ident").alias("idents"))


_COUNT = "case when coalesce({0}, '') = '' then 0 else len(string_split(regexp_replace({0}, '\\n$', ''), chr(10))) end"


@query(f"""with f as (select file_id, {_COUNT.format("new_source")} n, {_COUNT.format("old_source")} o from ({FILES}) where not is_binary) select file_id, n - o growth, n new_lines, o old_lines from f where n + o > 0""")
def rediff(spark: SparkSession, d: str) -> DataFrame:
    """Line records made anew from both sources, counted."""
    files = files_of(spark, d).where("not is_binary")
    numbered = files.select("file_id", F.xxhash64("file_id").alias("file_seq"), "old_source", "new_source").distinct()
    made = snapshots.diff_lines(numbered).join(numbered.select("file_seq", "file_id"), "file_seq")
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return made.groupBy("file_id").agg((n("add") - n("del")).alias("growth"), n("add", "ctx").alias("new_lines"), n("del", "ctx").alias("old_lines"))


# --- features, verification, layout

KIND_OF = """case when contains(lower(new_path), 'migration') or contains(lower(new_path), '/.sqlx/') or ends_with(lower(new_path), '.sql') then 'migration'
 when regexp_matches(lower(new_path), '\\.(toml|yaml|yml|json|sh|caddy|env|conf|ini|lock)$|(^|/)(dockerfile|caddyfile|\\.gitignore|\\.dockerignore|makefile)$|(^|/)cargo\\.[^/]*$|(^|/)\\.github/') then 'config'
 when ends_with(new_path, '.java') or ends_with(new_path, '.kt') then 'class' else 'file' end"""
MEMBERS = f"select distinct review_id seed_id, repo_path, file_seq pos, new_path card_id, {BASE.format('new_path')} name, new_path path, {KIND_OF} kind, case status when 'Added' then 'added' when 'Deleted' then 'deleted' else 'modified' end change_type from file_diffs"


def _kind(path: Column) -> Column:
    """The kind of a file; those that hold one class by their language are classes."""
    k = R.file_kind(path)
    return F.when((k == "file") & X.language(path).isin("java", "kotlin"), "class").otherwise(k)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_diffs").select(F.col("review_id").alias("seed_id"), "repo_path", F.col("file_seq").alias("pos"), F.col("new_path").alias("card_id"), X.basename(F.col("new_path")).alias("name"), F.col("new_path").alias("path"), _kind(F.col("new_path")).alias("kind"), X.change_type(F.col("status")).alias("change_type")).distinct()


_ENTRY = f"""case when {_sql_any("q", R.ENTRY_PATHS)} or regexp_matches(n, '(controller|handler|resource)$|^main$|^handle') then name || ' (' || path || ')' end"""
_CONTRACT = f"""case when {" or ".join(f"ends_with(n, '{x}')" for x in R.CANDIDATE_ENDS)} or {_sql_any("q", R.CONTRACT_PATHS)} or {" or ".join(f"ends_with(q, '{x}')" for x in R.CONTRACT_FILES)} then name end"""


@query(f"""with m as ({MEMBERS}), e as (select *, lower(path) q, lower(name) n from m), x as (select *, {_ENTRY} entry, {_CONTRACT} contract from e), t as (select distinct review_id seed_id from threads where not resolved),
 g as (select seed_id, string_agg(name, ',' order by pos, name) symbols, string_agg(distinct entry, ',' order by entry) entrypoints, string_agg(distinct contract, ',' order by contract) contracts, count(*) n, count(*) filter ({" or ".join(f"ends_with(n, '{x}')" for x in R.CONTRACT_ENDS)}) c,
  bool_or(kind in ('config', 'migration')) infra, bool_or(kind = 'class' and change_type = 'added') added from x group by 1)
 select seed_id, symbols, coalesce(entrypoints, '') entrypoints, coalesce(contracts, '') contracts, n, case when c * 2 >= n and c > 0 then 'contract' when infra then 'infra' when coalesce(entrypoints, '') <> '' and seed_id in (select seed_id from t) then 'flow' when added then 'domain-concept' else 'shared-foundation' end kind from g""")
def seed_features(spark: SparkSession, d: str) -> DataFrame:
    """Reviews as seeds; those with an open thread count as linked."""
    members = _members(spark, d)
    got = features.seed_features(members, table(spark, d, "threads").where("not resolved").select(F.col("review_id").alias("seed_id")))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return got.select("seed_id", joined("symbols"), joined("entrypoints"), joined("contracts"), "n", "kind")


@query(f"""with m as ({MEMBERS}), l as (select *, {sql_layer("name", "name")} l, {BASE.format("name")} b from m), g as (select repo_path, seed_id, min(l) layer, min(name) first_name, count(distinct b) k, min(b) b from l group by 1, 2)
 select repo_path, seed_id, layer, first_name, case when k = 1 then b else first_name end title, row_number() over (partition by repo_path order by layer, first_name, seed_id)::int rank from g""")
def layer_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.seed_order(_members(spark, d), ["repo_path"])


@query(f"""with m as ({MEMBERS}), l as (select *, {sql_layer("name", "name")} l from m), g as (select repo_path, seed_id, min(l) layer, min(name) f, count(distinct {BASE.format("name")}) k, min({BASE.format("name")}) b from l group by 1, 2),
 o as (select *, case when k = 1 then b else f end title, row_number() over (partition by repo_path order by layer, f, seed_id) rank from g), p as (select l.*, rank, title, row_number() over (partition by repo_path, card_id order by rank, l, name) r from l join o using (repo_path, seed_id))
 select repo_path, seed_id, rank::int rank, title, (row_number() over (partition by repo_path, rank order by l, name, card_id) - 1)::int pos, card_id from p where r = 1""")
def layer_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.layered(_members(spark, d).select("repo_path", "seed_id", "card_id", "name"), ["repo_path"])


PROPOSED = "select card_id, review_id cluster_id, min(opened_at) o, min(thread_id) t from threads group by 1, 2"


@query(f"""with w as (select distinct new_path || '::__file' card_id from file_diffs), m as (select *, row_number() over (partition by card_id order by cluster_id, o, t) r from ({PROPOSED}))
 select w.card_id, coalesce(cluster_id, '__unclustered') cluster_id from w left join (select * from m where r = 1) m using (card_id)""")
def verify_proposal(spark: SparkSession, d: str) -> DataFrame:
    """Threads propose clusters (their reviews); every known card ends in its first one or unclustered."""
    white = table(spark, d, "file_diffs").select(X.card_id(F.col("new_path")).alias("card_id")).distinct()
    proposed = table(spark, d, "threads").groupBy("card_id", F.col("review_id").alias("cluster_id")).agg(F.min("opened_at").alias("o"), F.min("thread_id").alias("t"))
    members = verify.verified_clusters(proposed.withColumns({"cluster_pos": F.col("cluster_id"), "member_pos": F.struct("o", "t")}))
    rest = verify.absorbed(members, white.limit(0), white)
    return members.join(white, "card_id", "left_semi").select("card_id", "cluster_id").unionByName(rest.select("card_id", F.lit("__unclustered").alias("cluster_id")))


@query("""with w as (select new_path || '::__file' card_id, review_id cluster_id from file_diffs group by 1, 2), o as (select card_id, review_id cluster_id from threads), k as (select distinct cluster_id from w),
 d as (select distinct * from o)
 select cluster_id, 'unknown cluster' problem from (select distinct cluster_id from d where cluster_id not in (select cluster_id from k))
 union select cluster_id, 'repeated card' from o group by cluster_id, card_id having count(*) > 1
 union select cluster_id, 'not a permutation' from ((select cluster_id, card_id from d where cluster_id in (select cluster_id from k) except select cluster_id, card_id from w) union all (select cluster_id, card_id from w where cluster_id in (select cluster_id from d) except select cluster_id, card_id from d))
 union select cluster_id, 'omitted cluster' from k where cluster_id not in (select cluster_id from d)
 union select cluster_id, 'unknown card' from d where card_id not in (select card_id from w)""")
def verify_order(spark: SparkSession, d: str) -> DataFrame:
    """Threads as an ordering of each review's cards: what is wrong with it."""
    clusters = table(spark, d, "file_diffs").select(X.card_id(F.col("new_path")).alias("card_id"), F.col("review_id").alias("cluster_id")).distinct()
    order = table(spark, d, "threads").select("card_id", F.col("review_id").alias("cluster_id"))
    return verify.order_problems(order, clusters, clusters)


@query("""with c as (select review_id cluster_id, min(opened_at) p from reviews group by 1), o as (select review_id cluster_id, min(thread_id) t from threads group by 1)
 select cluster_id, (row_number() over (order by t is null, coalesce(t, strftime(p, '%Y-%m-%d %H:%M:%S')), cluster_id) - 1)::int pos from c left join o using (cluster_id)""")
def normalised_order(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "reviews").select(F.col("review_id").alias("cluster_id"), F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss").alias("cluster_pos"))
    return verify.normalised_order(table(spark, d, "threads").select(F.col("review_id").alias("cluster_id"), F.col("thread_id").alias("pos")), clusters)


# --- stores and hashes


@query("""with c as (select review_id, sha256('{"tag":"card","version":3,"path":"' || new_path || '","status":"' || status || '"}') h from (select distinct review_id, new_path, status from file_diffs))
 select review_id, count(*) cards, sha256(string_agg(h, chr(10) order by h)) set_hash from c group by 1""")
def set_hashes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_diffs").select("review_id", F.col("new_path").alias("path"), "status").distinct()
    h = store.content_hash(f, ("review_id",))
    return h.groupBy("review_id").agg(F.count(F.lit(1)).alias("cards"), store.set_hash(F.col("card_hash")).alias("set_hash"))


@query("select repo_path, merge_base_sha, card_hash, schema_ver, arg_max(entry_id, (created_at, entry_id)) entry_id, max(created_at) created_at from cluster_result group by all")
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The entry of each key that a read would find."""
    got = store.latest(table(spark, d, "cluster_result"), ["repo_path", "merge_base_sha", "card_hash", "schema_ver"], "created_at", "entry_id")
    return got.select("repo_path", "merge_base_sha", "card_hash", "schema_ver", "entry_id", "created_at")


@query("select repo_path path, max(opened_at) \"at\" from reviews group by 1 order by 2 desc, 1 limit 4")
def recent_repositories(spark: SparkSession, d: str) -> DataFrame:
    return store.recent(table(spark, d, "reviews").select(F.col("repo_path").alias("path"), F.col("opened_at").alias("at")))


# --- branches

BRANCHES = "select distinct repo_path, unnest([base_branch, target_branch]) name from reviews"
RANK = "case when name = current then 0 when name = 'develop' then 1 when name = 'main' then 2 when name = 'master' then 3 else 100 end"


def _branches(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reviews")
    names = r.select("repo_path", F.explode(F.array("base_branch", "target_branch")).alias("name")).where("name is not null").distinct()
    now = r.groupBy("repo_path").agg(F.max_by("target_branch", F.struct("opened_at", "target_branch")).alias("current"))
    return names.join(now, "repo_path")


NOW = "select repo_path, arg_max(target_branch, (opened_at, target_branch)) current from reviews group by 1"


@query(f"""with b as (select * from ({BRANCHES}) join ({NOW}) using (repo_path) where name is not null)
 select repo_path, name, {RANK} rank, (row_number() over (partition by repo_path order by {RANK}, lower(name), name) - 1)::int place from b""")
def branch_rank(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.ranked_branches(_branches(spark, d), ["repo_path"], F.col("current"))


@query(f"""with b as (select *, {RANK} rank from ({BRANCHES}) join ({NOW}) using (repo_path) where name is not null), p as (select *, row_number() over (partition by repo_path order by rank, lower(name), name) place from b),
 g as (select repo_path, any_value(current) current, coalesce(arg_min(name, case name when 'develop' then 1 when 'main' then 2 when 'master' then 3 end) filter (name in ('develop', 'main', 'master')), arg_min(name, place)) base from p group by 1),
 o as (select p.repo_path, arg_min(name, place) other from p join g using (repo_path) where name <> base group by 1)
 select repo_path, base, case when current is not null and current <> base then current else coalesce(other, base) end target from g left join o using (repo_path)""")
def range_defaults(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.range_defaults(_branches(spark, d), ["repo_path"], F.col("current"))


# --- progress

KIND = "case event_type when 'view' then 'static' when 'click' then 'clustering' when 'purchase' then 'clusters' when 'signup' then 'reviewed' else 'final' end"


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "static").when(F.col("event_type") == "click", "clustering").when(F.col("event_type") == "purchase", "clusters").when(F.col("event_type") == "signup", "reviewed").otherwise("final")
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), k.cast("int").alias("files"), k.alias("id"), F.col("event_type").alias("chapter"))


EVENTS = f"select user_id \"key\", event_id seq, {KIND} kind, (props::json ->> 'k')::int files, props::json ->> 'k' id from events"


@query(f"""select "key", arg_max(case kind when 'static' then 'static' when 'clustering' then 'clustering' when 'clusters' then 'review' when 'final' then 'final' end, seq) filter (kind <> 'reviewed') phase,
 arg_max(files, seq) filter (kind = 'static' and files is not null) files, count(distinct id) filter (kind = 'reviewed') reviewed from ({EVENTS}) group by 1""")
def progress_reduce(spark: SparkSession, d: str) -> DataFrame:
    return progress.fold(_events(spark, d))


@query(f"""select "key", id, coalesce(arg_max('signup', seq), '') chapter from ({EVENTS}) where kind = 'reviewed' group by 1, 2""")
def reviewed_chapters(spark: SparkSession, d: str) -> DataFrame:
    return progress.chapters(_events(spark, d))


@query("select user_id, max(event_id) request_no, arg_max(event_type, event_id) event_type from events group by 1")
def newest_results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("request_no"), "event_type")
    return progress.newest_only(e, ["user_id"])


def _all() -> None:
    """Register the queries of the other modules, which build on those above."""
    from riftlens import domain_queries, symbol_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
