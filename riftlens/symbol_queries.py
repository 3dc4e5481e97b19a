"""Queries over symbols that are read off single lines, so that SQL can read them as well.

What a declaration is, is kept simple here (a keyword and a name; a top-level one ends at the next line that begins with a
closing bracket, an inner one before the next declaration); everything after that is the operators' own work: attribution of
lines and references to the innermost symbol, relations, components, seeds, layouts, signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftlens.functions import rules as R
from riftlens.functions import text as X
from riftlens.operators import cards as C
from riftlens.operators import features, intervals, layout, relations, signals
from riftlens.plans import review as plan
from riftlens.queries import FILES, LINES, files_of, lines_of, query, sql_layer
from riftlens.session import checkpointed

DECLARED = r"(?:func |func \(\w+ \*?\w+\) |fn |fun |def |function |class |struct |interface |type )(\w+)"
RECEIVER = r"func \(\w+ \*?(\w+)\)"
CALLED, TYPED = r"(\w+)\(", r"\b([A-Z]\w*)\b"
IMPORTED = r"^(?:import|use) (?:.*\W)?(\w+)\W*$"


def _source_lines(files: DataFrame, source: str) -> DataFrame:
    keys = ["file_id", "repo_path", "review_id", "new_path"]
    return files.where(F.length(source) > 0).select(*keys, F.posexplode(F.split(source, "\n")).alias("row", "line"))


def line_symbols(files: DataFrame, source: str = "new_source") -> DataFrame:
    """file_id, repo_path, review_id, new_path, sym_idx, name, owner, start_row, end_row."""
    w = Window.partitionBy("file_id").orderBy("row")
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    name = F.nullif(F.regexp_extract("line", DECLARED, 1), F.lit(""))
    inner = F.substring("line", 1, 1).isin(" ", "\t")
    rows = _source_lines(files, source).withColumns({"name": name, "inner": inner})
    rows = rows.withColumns({
        "close": F.min(F.when(F.startswith("line", F.lit("}")), F.col("row"))).over(after), "next": F.min(F.when(F.col("name").isNotNull(), F.col("row"))).over(after),
        "last": F.max("row").over(Window.partitionBy("file_id")), "outer": F.last(F.when(~F.col("inner"), F.col("name")), True).over(before),
    }).where("name is not null")
    owner = F.coalesce(F.nullif(F.regexp_extract("line", RECEIVER, 1), F.lit("")), F.when(F.col("inner"), F.col("outer")))
    end = F.when(F.col("inner"), F.coalesce(F.col("next") - 1, F.col("last"))).otherwise(F.coalesce("close", "last"))
    return rows.select("file_id", "repo_path", "review_id", "new_path", (F.row_number().over(w) - 1).alias("sym_idx"), "name", owner.alias("owner"), F.col("row").alias("start_row"), end.alias("end_row"))


def line_references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, sym_idx, bucket, ident, ref_row, in_header: names before a bracket and capitalised names, by innermost symbol."""
    rows = _source_lines(files, "new_source").select("file_id", "row", "line")
    of = lambda bucket, pattern: rows.select("file_id", "row", F.lit(bucket).alias("bucket"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("ident"))
    found = intervals.innermost(of("call", CALLED).unionByName(of("type", TYPED)).distinct(), symbols, ["file_id"])
    starts = symbols.select("file_id", "sym_idx", "start_row")
    return found.where("sym_idx is not null").join(starts, ["file_id", "sym_idx"]).select("file_id", "sym_idx", "bucket", "ident", F.col("row").alias("ref_row"), (F.col("row") == F.col("start_row")).alias("in_header"))


USABLE = f"select * from ({FILES}) where status = 'Modified' and not is_binary"


def _sql_symbols(name: str, files: str, source: str) -> str:
    inner = "left(line, 1) in (' ', chr(9))"
    w = "over (partition by file_id order by \"row\" rows between {})"
    after, before = w.format("1 following and unbounded following"), w.format("unbounded preceding and 1 preceding")
    return f"""{name}_l as (select file_id, repo_path, review_id, new_path, unnest(string_split({source}, chr(10))) line, generate_subscripts(string_split({source}, chr(10)), 1) - 1 "row" from ({files}) where length({source}) > 0),
 {name}_n as (select *, nullif(regexp_extract(line, '{DECLARED}', 1), '') name, {inner} "inner" from {name}_l),
 {name}_w as (select *, min(case when starts_with(line, '}}') then "row" end) {after} "close", min(case when name is not null then "row" end) {after} "next", max("row") over (partition by file_id) "last",
  last_value(case when not "inner" then name end ignore nulls) {before} "outer" from {name}_n),
 {name} as (select file_id, repo_path, review_id, new_path, (row_number() over (partition by file_id order by "row") - 1)::int sym_idx, name, coalesce(nullif(regexp_extract(line, '{RECEIVER}', 1), ''), case when "inner" then "outer" end) owner,
  "row" start_row, case when "inner" then coalesce("next" - 1, "last") else coalesce("close", "last") end end_row from {name}_w where name is not null)"""


_ROW = """greatest(case when kind = 'del' then coalesce(last_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between unbounded preceding and 1 preceding),
 first_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between 1 following and unbounded following)) else new_lineno end - 1, 0)"""

SYMBOLS = f"""with recursive {_sql_symbols("s", USABLE, "new_source")},
 lr as (select *, {_ROW} r from ({LINES})),
 hit as (select lr.file_id, line_seq, kind, sym_idx, row_number() over (partition by lr.file_id, line_seq order by end_row - start_row, sym_idx) k from lr join s on s.file_id = lr.file_id and r between start_row and end_row),
 att as (select * from hit where k = 1),
 ch as (select s.*, new_path || '::__file' card_id from s where exists (select 1 from att where att.file_id = s.file_id and att.sym_idx = s.sym_idx and kind in ('add', 'del')))"""
REFS = f"""{SYMBOLS},
 rw as (select distinct file_id, "row", 'call' bucket, unnest(regexp_extract_all(line, '{CALLED}', 1)) ident from s_l union select distinct file_id, "row", 'type', unnest(regexp_extract_all(line, '{TYPED}', 1)) from s_l),
 rh as (select rw.*, s.sym_idx, "row" = start_row in_header, row_number() over (partition by rw.file_id, "row", bucket, ident order by end_row - start_row, s.sym_idx) k from rw join s on s.file_id = rw.file_id and "row" between start_row and end_row),
 rf as (select * from rh where k = 1)"""
_HUB = "(" + ", ".join(f"'{h.lower()}'" for h in R.HUB_NAMES) + ")"
PAIRS = f"""{REFS},
 cr as (select distinct ch.repo_path, ch.review_id, ch.card_id, bucket, ident, in_header from rf join ch using (file_id, sym_idx)),
 im as (select distinct l.repo_path, l.review_id, l.new_path || '::__file' card_id, regexp_extract(line, '{IMPORTED}', 1) ident from s_l l where regexp_matches(line, '{IMPORTED}') and exists (select 1 from ch where ch.file_id = l.file_id)),
 nm as (select distinct repo_path, review_id, name ident, card_id target from ch where lower(name) not in {_HUB}),
 ow as (select distinct repo_path, review_id, card_id, owner from ch where owner is not null and owner <> '' and lower(owner) not in {_HUB}),
 st0 as (select repo_path, review_id, card_id x, target y from cr join nm using (repo_path, review_id, ident) where bucket = 'call' or in_header
  union select p.repo_path, p.review_id, p.card_id, q.card_id from ow p join ow q on p.repo_path = q.repo_path and p.review_id = q.review_id and p.owner = q.owner
  union select repo_path, review_id, o.card_id, t.card_id from ow o join (select repo_path, review_id, name owner, card_id from ch where owner is null) t using (repo_path, review_id, owner)),
 st as (select distinct repo_path, review_id, least(x, y) a, greatest(x, y) b from st0 where x <> y),
 wk0 as (select repo_path, review_id, card_id x, target y from im join nm using (repo_path, review_id, ident) union select repo_path, review_id, card_id, target from cr join nm using (repo_path, review_id, ident) where bucket = 'type' and not in_header),
 wk as (select distinct repo_path, review_id, least(x, y) a, greatest(x, y) b from wk0 where x <> y except select * from st)"""
CARDS = f"""cc as (select file_id, count(*) filter (kind in ('add', 'del')) n from ({LINES}) group by 1),
 cd as (select repo_path, review_id, coalesce(nullif(new_path, ''), old_path) || '::__file' card_id, min(file_seq) seq from ({FILES}) left join cc using (file_id) where is_binary or coalesce(n, 0) > 0 group by 1, 2, 3)"""
SEEDS = f"""{PAIRS}, {CARDS},
 nd as (select distinct repo_path, review_id, card_id from ch), eg as (select * from st union all select repo_path, review_id, b, a from st),
 re(repo_path, review_id, id, m) as (select repo_path, review_id, card_id, card_id from nd union select re.repo_path, re.review_id, eg.b, re.m from re join eg on eg.repo_path = re.repo_path and eg.review_id = re.review_id and eg.a = re.id),
 cp as (select repo_path, review_id, id card_id, min(m) c from re group by all),
 ss as (select repo_path, review_id, 'seed-' || dense_rank() over (partition by repo_path, review_id order by c) seed_id, card_id, cast(null as varchar) type_hint from cp),
 fs as (select repo_path, review_id, 'file-seed-' || row_number() over (partition by repo_path, review_id order by seq, card_id) seed_id, card_id,
  case when contains(lower(card_id[:-9]), 'migration') or contains(lower(card_id[:-9]), '/.sqlx/') or ends_with(lower(card_id[:-9]), '.sql') then 'contract' else 'infra' end type_hint from cd where not exists (select 1 from cp where cp.repo_path = cd.repo_path and cp.review_id = cd.review_id and cp.card_id = cd.card_id)),
 al as (select * from ss union all select * from fs),
 sn as (select al.*, coalesce(ln.name, al.card_id[:-9]) name from al left join (select repo_path, review_id, card_id, arg_max(name, sym_idx) name from ch group by all) ln using (repo_path, review_id, card_id))"""


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usable files, their symbols, and the changed ones with their cards."""
    files = plan.usable(files_of(spark, d))
    syms = line_symbols(files)
    hit = C.changed_symbols(intervals.attribute_lines(lines_of(spark, d), syms, ["file_id"]), syms, ["file_id"])
    return files, syms, hit.withColumn("card_id", X.card_id(F.col("new_path"))).withColumn("path", F.col("new_path"))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changed symbols, their references, and what their files import, kept as relations and components both start from them."""
    files, syms, changed = _changed(spark, d)
    changed = checkpointed(changed)
    refs = line_references(files, syms).join(changed.select(*plan.SCOPE, "file_id", "sym_idx", "card_id"), ["file_id", "sym_idx"])
    lines = _source_lines(files, "new_source").join(changed.select("file_id").distinct(), "file_id", "left_semi").where(F.col("line").rlike(IMPORTED))
    imports = lines.select(*plan.SCOPE, X.card_id(F.col("new_path")).alias("card_id"), F.regexp_extract("line", IMPORTED, 1).alias("ident")).distinct()
    return changed, checkpointed(refs.select(*plan.SCOPE, "card_id", "bucket", "ident", "in_header").distinct()), imports


def _seeds(spark: SparkSession, d: str, inputs: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    files = files_of(spark, d)
    cards = C.cards(files.withColumn("ingested_at", F.lit(0)), lines_of(spark, d))
    changed, refs, _ = inputs
    return plan.seeded(files, cards, changed, relations.strong_pairs(changed, refs, False, plan.SCOPE))


@query(f"{SYMBOLS} select file_id, sym_idx, name, count(*) filter (kind = 'add') adds, count(*) filter (kind = 'del') dels from att join ch using (file_id, sym_idx) group by all")
def symbol_changes(spark: SparkSession, d: str) -> DataFrame:
    """Added and deleted lines of each changed symbol, lines attributed to the innermost one."""
    files, syms, changed = _changed(spark, d)
    lines = intervals.attribute_lines(lines_of(spark, d), syms, ["file_id"])
    return C.line_counts(lines.join(changed.select("file_id", "sym_idx", "name"), ["file_id", "sym_idx"]), ["file_id", "sym_idx", "name"]).drop("lines")


@query(f"{SYMBOLS}, g as (select *, row_number() over (partition by file_id, name order by start_row, sym_idx) - 1 p, count(*) over (partition by file_id, name) n from s) select file_id, sym_idx, name, case when n > 1 then p::int end pos from g")
def repeated_names(spark: SparkSession, d: str) -> DataFrame:
    """Place among the symbols of one name in a file, where there are several."""
    return C.duplicate_positions(line_symbols(plan.usable(files_of(spark, d))), ["file_id"]).select("file_id", "sym_idx", "name", "pos")


@query(f"{SYMBOLS}, f as (select distinct lr.file_id, r, min(s.sym_idx) over (partition by lr.file_id, r) k from lr join s on s.file_id = lr.file_id and r between start_row and end_row where kind <> 'ctx') select file_id, count(distinct k) >= 2 complex from f group by 1")
def complex_cards(spark: SparkSession, d: str) -> DataFrame:
    """Whether the changed lines of a file lie in several outermost symbols."""
    return intervals.complex_flags(lines_of(spark, d), line_symbols(plan.usable(files_of(spark, d))), ["file_id"])


@query(f"{REFS} select file_id, sym_idx, bucket, count(*) refs, count(distinct ident) idents, count(*) filter (in_header) in_header from rf group by all")
def owned_references(spark: SparkSession, d: str) -> DataFrame:
    """References of each symbol, attributed to the innermost one."""
    files = plan.usable(files_of(spark, d))
    refs = line_references(files, line_symbols(files))
    return refs.groupBy("file_id", "sym_idx", "bucket").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("ident").alias("idents"), F.count_if("in_header").alias("in_header"))


SUPER = r"\b(?:impl|implements|extends|class|struct)\b"
_CLOSE = "min(case when starts_with(line, '}') then \"row\" end) over (partition by file_id order by \"row\" rows between 1 following and unbounded following)"


@query(f"""{SYMBOLS}, il as (select file_id, "row", line, {_CLOSE} b from s_l), ir as (select distinct file_id, "row", b, unnest(regexp_extract_all(line, '{TYPED}', 1)) ident from il where regexp_matches(line, '{SUPER}')),
 ih as (select ir.*, sym_idx, "row" = start_row in_header, row_number() over (partition by ir.file_id, "row", ident order by end_row - start_row, sym_idx) k from ir join s on s.file_id = ir.file_id and "row" between start_row and end_row)
 select file_id, file_id || ':' || "row" || ':' || ident ref_id, sym_idx, in_header from ih where k = 1
 union all select ir.file_id, ir.file_id || ':' || "row" || ':' || ident, s.sym_idx, true from ir join s on s.file_id = ir.file_id and start_row >= "row" and end_row <= b where not exists (select 1 from ih where ih.file_id = ir.file_id and ih."row" = ir."row")""")
def supertype_references(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised names on lines of types and implementations: with the innermost symbol, else with every one in the block below."""
    files = plan.usable(files_of(spark, d))
    after = Window.partitionBy("file_id").orderBy("row").rowsBetween(1, Window.unboundedFollowing)
    lines = _source_lines(files, "new_source").withColumn("block_end", F.min(F.when(F.startswith("line", F.lit("}")), F.col("row"))).over(after)).where(F.col("line").rlike(SUPER))
    refs = lines.select("file_id", "row", F.col("row").alias("block_start"), "block_end", F.explode(F.regexp_extract_all("line", F.lit(TYPED), F.lit(1))).alias("ident")).distinct()
    refs = refs.withColumn("ref_id", F.concat_ws(":", "file_id", F.col("row").cast("string"), "ident"))
    return intervals.attribute_impls(refs, line_symbols(files), ["file_id"]).select("file_id", "ref_id", "sym_idx", "in_header")


@query(f"{PAIRS} select *, 'strong' grade from st union all select *, 'weak' from wk")
def name_relations(spark: SparkSession, d: str) -> DataFrame:
    """Strong and weak pairs of each review's changed symbols: by reference, by owner, by owner type, by import."""
    return relations.pairs(*_inputs(spark, d), scope=plan.SCOPE)


@query(f"{SEEDS} select repo_path, review_id, seed_id, card_id, name, type_hint from sn")
def review_seeds(spark: SparkSession, d: str) -> DataFrame:
    """All seeds of each review: components of the cards with changed symbols, and every other card by itself."""
    return _seeds(spark, d, _inputs(spark, d))


@query(f"{SEEDS}, p as (select *, 'strong' grade from st union all select *, 'weak' from wk) select p.repo_path, p.review_id, x.seed_id, p.a, p.b, p.grade from p join sn x on p.repo_path = x.repo_path and p.review_id = x.review_id and p.a = x.card_id join sn y on p.repo_path = y.repo_path and p.review_id = y.review_id and p.b = y.card_id and x.seed_id = y.seed_id")
def seed_relations(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that lie within one seed."""
    inputs = _inputs(spark, d)
    return relations.pairs_within(relations.pairs(*inputs, scope=plan.SCOPE), _seeds(spark, d, inputs), plan.SCOPE).select(*plan.SCOPE, "seed_id", "a", "b", "grade")


_LAYER = sql_layer("name", "name")


@query(f"""{SEEDS}, ml as (select *, {_LAYER} l, string_split(name, '/')[-1] bn from sn), g as (select repo_path, review_id, seed_id, min(l) l, min(name) f, count(distinct bn) k, min(bn) b from ml group by 1, 2, 3),
 o as (select *, case when k = 1 then b else f end title, row_number() over (partition by repo_path, review_id order by l, f, seed_id) rank from g)
 select ml.repo_path, ml.review_id, ml.seed_id, o.rank::int rank, title, (row_number() over (partition by ml.repo_path, ml.review_id, o.rank order by ml.l, name, card_id) - 1)::int pos, card_id from ml join o using (repo_path, review_id, seed_id)""")
def seed_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layered layout of the seeds of each review."""
    return layout.layered(_seeds(spark, d, _inputs(spark, d)), plan.SCOPE).select(*plan.SCOPE, "seed_id", "rank", "title", "pos", "card_id")


# --- what happened to symbols between both states

GUARDED = f"select * from ({FILES}) where status = 'Modified' and not is_binary and length(old_source) > 0"
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_COMMENT = r"^(//|/\*|\*|#)"


def _sql_normalised() -> str:
    sig = _CLEAN.format("coalesce(lines[start_row + 1], '')")
    sig = rf"trim(regexp_replace({sig}, '\{{$', ''))"
    sig = rf"trim(regexp_replace({sig}, '^(pub\(crate\)|pub\(super\)|pub|public|private|protected)( |$)', ''))"
    clean = _CLEAN.format("x")
    body = f"list_sort(list_filter(list_transform(lines[start_row + 2:end_row + 1], lambda x: {clean}), lambda x: x <> '' and not regexp_matches(x, '{_COMMENT}') and x not in ('{{', '}}')))"
    part = lambda side, n, source: f"select '{side}' side, {n}.*, string_split(regexp_replace(g.{source}, '\\r?\\n$', ''), chr(10)) lines from {n} join ({GUARDED}) g using (file_id)"
    return f"""with {_sql_symbols("o", GUARDED, "old_source")}, {_sql_symbols("s", GUARDED, "new_source")}, u as ({part("base", "o", "old_source")} union all {part("head", "s", "new_source")}),
 nz as (select side, file_id, sym_idx, name, start_row, {sig} sig, {body} body from u)"""


NORMALISED = _sql_normalised()


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    files = signals.guarded(files_of(spark, d))
    both = line_symbols(files, "old_source").withColumn("side", F.lit("base")).unionByName(line_symbols(files, "new_source").withColumn("side", F.lit("head")))
    sources = files.select("file_id", F.col("old_source").alias("base_source"), F.col("new_source").alias("head_source"))
    return signals.normalised(both.drop("repo_path", "review_id", "new_path", "owner"), sources)


@query(f"{NORMALISED} select side, file_id, sym_idx, name, sig, array_to_string(body, chr(10)) body from nz")
def symbol_texts(spark: SparkSession, d: str) -> DataFrame:
    """Headers and bodies of the symbols of both states in the form in which they are compared."""
    return _normalised(spark, d).select("side", "file_id", "sym_idx", "name", "sig", F.array_join("body", "\n").alias("body"))


@query(f"{NORMALISED} select distinct side, file_id, name from nz n where not exists (select 1 from nz m where m.side <> n.side and m.file_id = n.file_id and m.name = n.name)")
def lone_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that only one state of a file declares: deleted and added ones."""
    norm = _normalised(spark, d)
    return signals.one_sided(norm, "base", "head").unionByName(signals.one_sided(norm, "head", "base")).select("side", "file_id", "name").distinct()


@query(f"""{NORMALISED}, r as (select *, row_number() over (partition by file_id, side, name order by start_row, sym_idx) k from nz), b as (select * from r where side = 'base'), h as (select * from r where side = 'head'),
 p as (select h.file_id, h.name, h.k, coalesce(b.sig, f.sig) bef, h.sig aft from h join b f on f.file_id = h.file_id and f.name = h.name and f.k = 1 left join b on b.file_id = h.file_id and b.name = h.name and b.k = h.k)
 select file_id, name, k::int rank, bef "before", aft "after" from p where bef <> aft and bef <> '' and aft <> ''""")
def header_changes(spark: SparkSession, d: str) -> DataFrame:
    """Headers that differ between the states, symbols of one name paired by their rank."""
    return signals.signature_changes(_normalised(spark, d))


_OVERLAP = "case when len(d.body) = 0 then 0.0 else len(list_filter(d.body, lambda x: list_contains(a.body, x)))::double / len(d.body) end"


@query(f"""{NORMALISED}, lone as (select * from nz n where not exists (select 1 from nz m where m.side <> n.side and m.file_id = n.file_id and m.name = n.name)), d as (select * from lone where side = 'base'), a as (select * from lone where side = 'head')
 select d.file_id, d.name from_name, a.name to_name, case when len(d.body) > 0 and d.body = a.body then 'body' else 'signature' end basis from d join a using (file_id) where (len(d.body) > 0 and d.body = a.body) or (d.sig <> '' and d.sig = a.sig and {_OVERLAP} >= {signals.RENAME_OVERLAP})""")
def rename_options(spark: SparkSession, d: str) -> DataFrame:
    """Deleted and added symbols of a file that may be one, by equal bodies or by equal headers and like bodies."""
    return signals.rename_candidates(_normalised(spark, d)).select("file_id", "from_name", "to_name", "basis")


@query(f"""with lost as (select file_id, name from ({NORMALISED} select distinct file_id, name from nz n where side = 'base' and not exists (select 1 from nz m where m.side = 'head' and m.file_id = n.file_id and m.name = n.name)))
 select review_id seed_id, new_path path, name from lost join (select distinct file_id, review_id, new_path from ({FILES})) using (file_id)""")
def seeds_of_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Deleted names with each review that holds their file, reviews standing for seeds."""
    files = files_of(spark, d).select("file_id", F.col("review_id").alias("seed_id"), F.col("new_path").alias("path")).distinct()
    gone = signals.one_sided(_normalised(spark, d), "base", "head").select("file_id", "name").distinct().join(files.select("file_id", F.concat_ws("\u001f", "seed_id", "path").alias("path")), "file_id")
    held = files.withColumn("path", F.concat_ws("\u001f", "seed_id", "path"))
    return features.attach_deleted(gone, held).select("seed_id", F.substring_index("path", "\u001f", -1).alias("path"), "name")
