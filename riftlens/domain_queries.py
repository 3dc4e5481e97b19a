"""Queries of the remaining operators over the domain tables: scalars, links, sources, clusterings, labels, stores, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftlens.functions import rules as R
from riftlens.functions import text as X
from riftlens.operators import cards as C
from riftlens.operators import features, intervals, layout, store, verify, views
from riftlens.queries import BASE, FILES, LINES, TURNS, files_of, lines_of, query, turns_of
from riftlens.session import global_rank, table
from riftlens.sources import snapshots
from riftlens.streaming import progress


def _any(text: str, parts: tuple[str, ...], test: str = "contains") -> str:
    return "(" + " or ".join(f"{test}({text}, '{p}')" for p in parts) + ")"


# --- scalars

_T = "trim(content, ' ' || chr(9) || chr(10) || chr(13))"
_BARE = rf"regexp_replace({_T}, '^(pub\(crate\) |pub )', '')"


@query(rf"""with c as (select distinct content from ({LINES}) where content is not null)
 select content, trim(regexp_replace(content, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g')) collapsed, regexp_matches(content, '^\s*(//|/\*|\*|#)') comment_only,
 {_any(_BARE, tuple(x for x in X.IMPORT_LEADS if "\t" not in x), "starts_with")} or starts_with({_BARE}, 'import' || chr(9)) or (starts_with({_BARE}, 'from ') and contains({_BARE}, ' import '))
  or (ends_with({_T}, '"') and len(regexp_extract_all({_T}, '"')) = 2 and not contains({_T}, '=') and not contains({_T}, '//')) import_like,
 array_to_string(list_filter(list_transform(regexp_extract_all(content, '([\p{{L}}\p{{N}}_.]*\(\)|[\p{{L}}\p{{N}}_.]+)', 1), lambda x: regexp_replace(x, '^\.+|\.+$', '', 'g')), lambda x: x <> ''), ' ') tokens from c""")
def line_scalars(spark: SparkSession, d: str) -> DataFrame:
    """What the line functions say of every distinct line."""
    c = F.col("content")
    lines = lines_of(spark, d).where("content is not null").select("content").distinct()
    return lines.select("content", X.collapse(c).alias("collapsed"), X.comment_only(c).alias("comment_only"), X.import_like(c).alias("import_like"), F.array_join(X.identifier_tokens(c), " ").alias("tokens"))


_P, _N = "lower(new_path)", f"lower({BASE.format('new_path')})"
_LANG = "case when not contains(new_path, '.') then null when ends_with(new_path, '.go') then 'go' when ends_with(new_path, '.java') then 'java' when ends_with(new_path, '.rs') then 'rust' when ends_with(new_path, '.kt') then 'kotlin' end"


@query(rf"""with f as (select distinct new_path, {_LANG} lang, {BASE.format("new_path")} name from file_diffs where new_path is not null)
 select new_path, case when regexp_replace(new_path, '[/\\]+$', '') = '' then new_path else regexp_extract(regexp_replace(new_path, '[/\\]+$', ''), '[^/\\]*$') end last_segment,
 {_any(_P, R.TEST_SYMBOL_PATHS)} or ends_with({_P}, '_test.go') or case lang when 'go' then starts_with(name, 'Test') when 'java' then regexp_matches(name, 'Tests?$|^test') when 'kotlin' then regexp_matches(name, 'Tests?$|^test') else false end is_test,
 case when {_any(_N, R.CANDIDATE_ENDS, "ends_with")} or {_any(_P, R.CONTRACT_PATHS)} or {_any(_P, R.CONTRACT_FILES, "ends_with")} then name end contract, {_any(_N, R.CONTRACT_ENDS, "ends_with")} contract_name,
 case when contains({_P}, 'migration') or contains({_P}, '/.sqlx/') or ends_with({_P}, '.sql') then 'contract' else 'infra' end type_hint, lower(name) in ({", ".join(f"'{h.lower()}'" for h in R.HUB_NAMES)}) is_hub,
 new_path || chr(31) || name composite from f""")
def path_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the rules say of every path."""
    p = F.col("new_path")
    f = table(spark, d, "file_diffs").where("new_path is not null").select("new_path").distinct().withColumns({"lang": X.language(p), "name": X.basename(p)})
    n = F.col("name")
    return f.select(
        "new_path", X.basename_any(p).alias("last_segment"), R.is_test_symbol(F.col("lang"), p, n).alias("is_test"), R.contract_candidate(p, n, F.lit("file")).alias("contract"), R.contract_name(n).alias("contract_name"),
        R.file_type_hint(p).alias("type_hint"), R.is_hub(n).alias("is_hub"), X.composite_key(p, n).alias("composite"),
    )


#: White space of any kind, which is what the functions take for blanks.
_BLANK = "[\\s\\p{Z}\\x{85}]"
_TRIMMED = f"regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@query(rf"""with t as (select distinct text from ({TURNS}) where text is not null), s as (select text, {_TRIMMED} t, position('the' in lower(text)) p from t)
 select text, case when starts_with(t, '```') then regexp_replace(regexp_replace(regexp_replace(t, '^```[A-Za-z]*\s*', ''), '\s*```$', ''), '^\s+|\s+$', '', 'g') else t end unfenced,
 case when p > 0 then left(text, p - 1) else text end "before", case when p > 0 then text[p:p + 2] else '' end hit, case when p > 0 then text[p + 3:] else '' end "after",
 case when length(text) <= 16 then 14 when length(text) <= 24 then 13 when length(text) <= 34 then 12 else 11 end font,
 case when length(text) % 5 = 0 then 'auth' when length(text) % 5 = 1 then 'overloaded' else 'http:' || left(text, 500) end error_class from s""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Fences, the first hit of a search, font sizes and error classes, with every text of a turn."""
    t = F.col("text")
    texts = turns_of(spark, d).where("text is not null").select("text").distinct()
    status = F.element_at(F.array(*map(F.lit, (401, 529, 500, 404, 400))), (F.length(t) % 5 + 1).cast("int"))
    return texts.withColumn("h", X.highlight(t, F.lit("The"))).select("text", X.strip_fence(t).alias("unfenced"), "h.before", "h.hit", "h.after", X.font_size(F.length(t)).alias("font"), X.error_class(status, t).alias("error_class"))


@query(f"""with l as (select *, sum(case when kind = 'ctx' then 1 else 0 end) over (partition by file_id order by line_seq) run from ({LINES})), p as (select *, row_number() over (partition by file_id, run, kind order by line_seq) i from l where kind <> 'ctx'),
 b as (select o.file_id, o.line_seq, o.content o, n.content n, least(length(o.content), length(n.content)) m from p o join p n on o.file_id = n.file_id and o.run = n.run and o.i = n.i and o.kind = 'del' and n.kind = 'add'),
 h as (select *, len(list_filter(range(1, m + 1), lambda i: left(o, i) = left(n, i))) h from b), t as (select *, len(list_filter(range(1, m + 1), lambda i: i <= m - h and right(o, i) = right(n, i))) t from h)
 select file_id, line_seq, h::int start, (length(o) - t)::int old_end, (length(n) - t)::int new_end from t""")
def changed_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where a deleted line and the added one beside it differ."""
    lines = lines_of(spark, d)
    rows = views.split_rows(lines, ["file_id"]).where("left_seq <> right_seq")
    side = lambda c, n: lines.select("file_id", F.col("line_seq").alias(c), F.col("content").alias(n))
    both = rows.join(side("left_seq", "o"), ["file_id", "left_seq"]).join(side("right_seq", "n"), ["file_id", "right_seq"])
    return both.select("file_id", F.col("left_seq").alias("line_seq"), X.changed_words(F.col("o"), F.col("n")).alias("x")).select("file_id", "line_seq", "x.*")


@query(f"""with c as (select file_id, line_seq, content, length(content) n, greatest(length(content) - length(ltrim(content)), 0) k from ({LINES}) where content is not null),
 b as (select *, list_sort(list_distinct([0, n, least(k, n), least(k + 4, n), least(8, n)])) q from c)
 select file_id, line_seq, len(q) - 1 pieces, array_to_string(list_transform(range(1, len(q)), lambda i: content[q[i] + 1:q[i + 1]]), '|') cut from b""")
def cut_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines cut at the bounds of a token (four characters from the first one on) and of a change (from eight on)."""
    c, n = F.col("content"), F.length("content")
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
    k = n - F.length(F.ltrim("content"))
    got = X.segments(c, span(k, k + 4), span(F.lit(8), n))
    return lines_of(spark, d).where("content is not null").select("file_id", "line_seq", F.size(got).cast("long").alias("pieces"), F.array_join(F.transform(got, lambda p: p["text"]), "|").alias("cut"))


# --- sources and links


@query(rf"""with r as (select distinct repo_path, coalesce(base_branch, '') base, target_branch target from reviews)
 select repo_path, base, target, 'app://review?repo=' || url_encode(repo_path) || '&base=' || url_encode(base) || '&target=' || url_encode(target) link, repo_path back_repo, target back_target,
 regexp_replace('refs/remotes/origin/' || target, '^(refs/)?(remotes/|heads/)?(origin/)?', '') local, regexp_extract(repo_path, '([^/]+)/[^/]+$', 1) "owner", length(target)::int number from r""")
def review_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of reviews there and back, branches without their remote, pull-request addresses read."""
    r = table(spark, d, "reviews").select("repo_path", F.coalesce("base_branch", F.lit("")).alias("base"), F.col("target_branch").alias("target")).distinct()
    link = snapshots.review_link("app", F.col("repo_path"), F.col("base"), F.col("target"))
    parts = F.split("repo_path", "/")
    address = F.concat(F.lit("https://host.example/"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1), F.lit("/pull/"), F.length("target").cast("string"))
    out = r.withColumn("link", link).withColumns({"back": snapshots.deep_link(F.col("link")), "pull": snapshots.pull_request(address)})
    return out.select("repo_path", "base", "target", "link", F.col("back.repo").alias("back_repo"), F.col("back.target").alias("back_target"), snapshots.local_branch(F.concat(F.lit("refs/remotes/origin/"), "target")).alias("local"), F.col("pull.owner").alias("owner"), F.col("pull.number").alias("number"))


@query("""with r as (select distinct 'refs/heads/' || target_branch name, arg_max(head_sha, (opened_at, head_sha)) commit_id from reviews group by 1), c as (select distinct head_sha id from reviews union select distinct merge_base_sha from reviews),
 q as (select distinct target_branch rev from reviews union select distinct left(head_sha, 10) from reviews union select 'no-such-branch'),
 n as (select rev, commit_id from q join r on name = 'refs/heads/' || rev), s as (select rev, min(id) commit_id, count(distinct id) k from q join c on starts_with(id, rev) where regexp_matches(rev, '^[0-9a-f]{4,40}$') and rev not in (select rev from n) group by 1)
 select * from n union all select rev, commit_id from s where k = 1""")
def resolved_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Branches and short commit ids to commits."""
    r = table(spark, d, "reviews")
    refs = r.groupBy(F.concat(F.lit("refs/heads/"), "target_branch").alias("name")).agg(F.max_by("head_sha", F.struct("opened_at", "head_sha")).alias("commit_id"))
    commits = r.select(F.col("head_sha").alias("commit_id")).union(r.select("merge_base_sha")).distinct()
    revs = r.select(F.col("target_branch").alias("rev")).union(r.select(F.substring("head_sha", 1, 10))).union(spark.range(1).select(F.lit("no-such-branch"))).distinct()
    return snapshots.resolve(revs, refs, commits).select("rev", "commit_id")


@query(f"""with f as (select review_id, new_path p, old_source o, new_source n, is_binary, status from ({FILES}) where old_path is null or old_path = '' or old_path = new_path),
 g as (select review_id, p, any_value(o) o, any_value(n) n, bool_or(is_binary) b, any_value(status) s, count(*) k from f group by 1, 2)
 select review_id || '/' || p new_path, s status, b is_binary, case when b then '' else coalesce(n, '') end new_source, case when b then '' else coalesce(o, '') end old_source from g
 where k = 1 and (s <> 'Modified' or coalesce(o, '') <> coalesce(n, '')) and not (s = 'Added' and exists (select 1 from g h where h.s = 'Deleted' and h.k = 1 and h.o = g.n and h.o <> '')) and not (s = 'Deleted' and exists (select 1 from g h where h.s = 'Added' and h.k = 1 and h.n = g.o and h.n <> ''))""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """The files of both states of all reviews, held against each other: what was added, deleted and modified (moves left out)."""
    f = files_of(spark, d).where("old_path is null or old_path = '' or old_path = new_path")
    path = F.concat_ws("/", "review_id", "new_path")
    once = f.withColumn("path", path).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("path"))).where("k = 1")
    old = once.where("status <> 'Added'").select("path", F.coalesce("old_source", F.lit("")).alias("source"), "is_binary")
    new = once.where("status <> 'Deleted'").select("path", F.coalesce("new_source", F.lit("")).alias("source"), "is_binary")
    return snapshots.file_diffs(old, new, None).where("new_path = old_path").select("new_path", "status", "is_binary", "new_source", "old_source")


@query(f"""with f as (select file_id, coalesce(new_path, '') n, coalesce(old_path, '') o, row_number() over (order by file_id) - 1 k from ({FILES})), l as (select distinct n, o from f),
 m as (select l.n, l.o, min(k) file_seq from l join f on (l.n = f.n or (l.n = '' and l.o = f.o)) and (l.o = '' or f.o = '' or l.o = f.o) and (l.n <> '' or l.o <> '') group by 1, 2) select n new_path, o old_path, file_seq from m""")
def delta_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """The file that a pair of paths belongs to."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    files = global_rank(files_of(spark, d).select("file_id", empty("new_path"), empty("old_path")), [F.col("file_id")], "file_seq")
    lines = files.select("new_path", "old_path").distinct()
    return snapshots.match_delta(lines, files)


# --- clusterings: reviews stand for clusters, repositories for layouts

_CARD = "review_id || '/' || new_path"
_MEMBERS = f"select distinct repo_path layout_id, review_id cluster_id, file_seq member_pos, {_CARD} card_id, status from ({FILES})"
_LABELS = "select review_id cluster_id, any_value(repo_path) layout_id, min(target_branch) title, min(base_branch) summary from reviews group by 1"


def _members(spark: SparkSession, d: str) -> DataFrame:
    f = files_of(spark, d)
    return f.select(F.col("repo_path").alias("layout_id"), F.col("review_id").alias("cluster_id"), F.col("file_seq").alias("member_pos"), F.concat_ws("/", "review_id", "new_path").alias("card_id"), "status", "new_path").distinct()


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").groupBy(F.col("review_id").alias("cluster_id")).agg(F.first("repo_path").alias("layout_id"), F.min("target_branch").alias("title"), F.min("base_branch").alias("summary"))


def _threads(spark: SparkSession, d: str) -> DataFrame:
    card = F.concat_ws("/", "review_id", F.regexp_replace("card_id", "::__file$", ""))
    return table(spark, d, "threads").select("thread_id", "review_id", card.alias("card_id"), "line_seq", "resolved", "opened_at")


_THREADS = "select thread_id, review_id, review_id || '/' || regexp_replace(card_id, '::__file$', '') card_id, line_seq, resolved, opened_at from threads"


@query(f"""with m as ({_MEMBERS}), l as ({_LABELS}) select c.cluster_id, coalesce(nullif(trim(title), ''), '{verify.DEFAULT_TITLE}') title, coalesce(nullif(trim(summary), ''), '{verify.DEFAULT_SUMMARY}') summary from (select distinct cluster_id from m) c left join l using (cluster_id)""")
def label_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Every review that has files with a title and a summary: its branches, or the defaults where one is missing."""
    return verify.verified_labels(_labels(spark, d).drop("layout_id"), _members(spark, d))


@query(f"""with l as ({_LABELS}) select layout_id from l group by 1 having count(*) filter (coalesce(nullif(trim(summary), ''), '{verify.DEFAULT_SUMMARY}') = '{verify.DEFAULT_SUMMARY}' or coalesce(nullif(trim(title), ''), '{verify.DEFAULT_TITLE}') = '{verify.DEFAULT_TITLE}') = 0""")
def cache_guard(spark: SparkSession, d: str) -> DataFrame:
    """Repositories all of whose reviews have labels of their own."""
    labels = _labels(spark, d)
    return verify.cacheable(verify.verified_labels(labels.drop("layout_id"), labels).join(labels.select("cluster_id", "layout_id"), "cluster_id"))


_WHITE = f"select distinct repo_path layout_id, {_CARD} card_id from ({FILES}) where status <> 'Deleted'"


@query(f"""with w as ({_WHITE}), t as (select f.repo_path layout_id, t.* from ({_THREADS}) t join (select distinct repo_path, review_id from file_diffs) f using (review_id)),
 p as (select layout_id, review_id cluster_id, card_id, min(thread_id) o from t where resolved group by 1, 2, 3), u as (select distinct layout_id, card_id from t where not resolved),
 bad as (select distinct layout_id from (select layout_id, card_id from p union select layout_id, card_id from u) x where not exists (select 1 from w where w.layout_id = x.layout_id and w.card_id = x.card_id)),
 k as (select *, row_number() over (partition by layout_id, card_id order by cluster_id, o) r from p where layout_id not in (select layout_id from bad))
 select layout_id, cluster_id, card_id from k where r = 1 union all select layout_id, null, card_id from w where layout_id not in (select layout_id from bad) and not exists (select 1 from k where k.layout_id = w.layout_id and k.card_id = w.card_id)""")
def verify_clusterings(spark: SparkSession, d: str) -> DataFrame:
    """Settled threads propose clusters, open ones unclustered cards; a repository in which one stands at a deleted file is rejected."""
    white = _members(spark, d).where("status <> 'Deleted'").select("layout_id", "card_id")
    t = _threads(spark, d).join(_members(spark, d).select("layout_id", F.col("cluster_id").alias("review_id")).distinct(), "review_id")
    m = t.where("resolved").groupBy("layout_id", F.col("review_id").alias("cluster_id"), "card_id").agg(F.min("thread_id").alias("member_pos")).withColumn("cluster_pos", F.col("cluster_id"))
    return verify.verify_clusters(m, t.where("not resolved").select("layout_id", "card_id"), white, ["layout_id"]).select("layout_id", "cluster_id", "card_id")


@query(f"""with m as ({_MEMBERS}), k as (select * from m where status <> 'Deleted'), o as (select review_id cluster_id, min(thread_id) p from threads group by 1), l as ({_LABELS}),
 c as (select cluster_id, row_number() over (order by p is null, p, cluster_id) - 1 cluster_pos from (select distinct cluster_id from k) left join o using (cluster_id)),
 j as (select k.cluster_id, cluster_pos, coalesce(title, '{verify.DEFAULT_TITLE}') title, summary, member_pos, card_id from k join c using (cluster_id) left join l using (cluster_id)),
 u as (select distinct card_id from m where status = 'Deleted' and card_id not in (select card_id from k)),
 a as (select * from j union all by name select card_id from u)
 select cluster_id, cluster_pos::int cluster_pos, title, summary, member_pos, (row_number() over (order by cluster_pos is null, cluster_pos, member_pos, card_id) - 1)::int flat_pos, card_id from a""")
def layout_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Reviews in the order of their first threads, those without any after them, their files as members; deleted files come last."""
    m = _members(spark, d).drop("layout_id", "new_path")
    members = m.where("status <> 'Deleted'").drop("status")
    order = table(spark, d, "threads").select(F.col("review_id").alias("cluster_id"), F.col("thread_id").alias("pos"))
    return layout.assembled(order, members, _labels(spark, d).drop("layout_id"), m.where("status = 'Deleted'").select("card_id"))


@query(f"""with m as ({_MEMBERS}) select cluster_id, (row_number() over (partition by cluster_id order by member_pos, card_id) - 1)::int pos, card_id from (select distinct cluster_id, member_pos, card_id from m)""")
def identity_orders(spark: SparkSession, d: str) -> DataFrame:
    """The cards of each review as they come."""
    m = _members(spark, d).select("cluster_id", F.struct("member_pos", "card_id").alias("member_pos"), "card_id").distinct()
    return verify.identity_order(m)


@query(f"""with m as (select distinct layout_id, card_id from ({_MEMBERS})) select layout_id, count(*) symbols, count(*) <= 12 is_small, count(*) <= 48 combined_fits from m group by 1""")
def call_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the cards of a repository fit into one proposal."""
    return verify.fits_one_call(_members(spark, d).select("layout_id", "card_id").distinct())


@query(f"""with m as (select distinct layout_id, cluster_id, member_pos, card_id from ({_MEMBERS})), c as (select layout_id, cluster_id, list(card_id order by member_pos, card_id) ids from m group by 1, 2)
 select layout_id, cast(to_json({{'clusters': list({{'clusterId': cluster_id, 'memberCardIds': ids}} order by cluster_id)}}) as varchar) payload from c group by 1""")
def clusters_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What is sent to have a repository's clusters ordered."""
    m = _members(spark, d).select("layout_id", "cluster_id", F.col("cluster_id").alias("cluster_pos"), "member_pos", "card_id").distinct()
    return verify.clusters_payload(m)


@query(f"""with m as (select distinct cluster_id, card_id from ({_MEMBERS}) where status <> 'Deleted'), s as (select t.review_id cluster_id, t.card_id, trim(u.text) s from ({_THREADS}) t join ({TURNS}) u using (thread_id)), k as (select * from s semi join m using (cluster_id, card_id) where s <> ''),
 l as (select card_id, min(cluster_id) c from k group by 1) select card_id, min(s) summary from k join l on k.card_id = l.card_id and k.cluster_id = l.c group by 1""".replace("select card_id, min(s) summary from k", "select k.card_id, min(s) summary from k"))
def card_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The first text about each card that is no deleted file, from the first review that has one."""
    said = _threads(spark, d).join(turns_of(spark, d).select("thread_id", "text"), "thread_id")
    s = said.groupBy(F.col("review_id").alias("cluster_id"), "card_id").agg(F.min(F.nullif(F.trim("text"), F.lit(""))).alias("summary"), F.min("review_id").alias("flow_pos"))
    return verify.whitelisted_summaries(s, _members(spark, d).where("status <> 'Deleted'"))


@query(f"""with g as (select *, coalesce(new_lineno, last_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between unbounded preceding and 1 preceding), greatest(first_value(new_lineno ignore nulls) over (partition by file_id order by line_seq rows between unbounded preceding and unbounded following) - 1, 0), 0) n from ({LINES})),
 u as (select file_id, min(line_seq) a, max(line_seq) b from g where kind <> 'ctx' group by 1), f as (select distinct file_id, review_id, new_path from file_diffs), t as (select thread_id, file_id, t.line_seq from threads t join f on t.review_id = f.review_id and t.card_id = f.new_path || '::__file' where t.line_seq is not null)
 select thread_id, file_id, a start_line, b end_line, case when line_seq between a and b then line_seq else a end anchor_line from t join u using (file_id)""")
def anchored_units(spark: SparkSession, d: str) -> DataFrame:
    """The changed stretch of a thread's file, anchored at the thread where that lies within it."""
    changed = lines_of(spark, d).where("kind <> 'ctx'").groupBy("file_id").agg(F.min("line_seq").alias("start_line"), F.max("line_seq").alias("end_line"))
    at = files_of(spark, d).select("file_id", "review_id", X.card_id(F.col("new_path")).alias("card_id")).distinct()
    t = table(spark, d, "threads").where("line_seq is not null").join(at, ["review_id", "card_id"]).select("thread_id", "file_id", F.col("line_seq").alias("anchor_line"))
    return verify.anchored(t.join(changed, "file_id")).select("thread_id", "file_id", "start_line", "end_line", "anchor_line")


@query(f"""with m as (select distinct card_id, cluster_id from ({_MEMBERS})), p as (select card_id, min(cluster_id) cluster_id from m where cluster_id in (select review_id from threads) group by 1), l as ({_LABELS}), c as (select distinct card_id from m)
 select card_id, cluster_id, coalesce(l.title, case when cluster_id is null then 'Unclustered' end) title from c left join p using (card_id) left join l using (cluster_id)""")
def cluster_titles(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their cluster's title; cards of reviews without threads have none."""
    m = _members(spark, d)
    placed = m.join(table(spark, d, "threads").select(F.col("review_id").alias("cluster_id")).distinct(), "cluster_id", "left_semi").groupBy("card_id").agg(F.min("cluster_id").alias("cluster_id"))
    lay = placed.join(_labels(spark, d).select("cluster_id", "title"), "cluster_id", "left")
    return views.cluster_of(m.select("card_id").distinct(), lay, "done").select("card_id", "cluster_id", "title")


@query(f"""with g as (select f.review_id, f.new_path || '::__file' card_id, l.line_seq, l.new_lineno n from ({LINES}) l join (select distinct file_id, review_id, new_path from file_diffs) f using (file_id)), k as (select review_id || '/' || card_id card_id, line_seq, min(n) n from g group by 1, 2)
 select thread_id, t.review_id || '/' || t.card_id card_id, regexp_replace(t.review_id || '/' || t.card_id, '::__file$', '') || coalesce(':' || n, '') reference from threads t left join k on k.card_id = t.review_id || '/' || t.card_id and k.line_seq = t.line_seq""")
def thread_references(spark: SparkSession, d: str) -> DataFrame:
    """Threads with the path and the line that they are about."""
    card = F.concat_ws("/", "review_id", "card_id")
    at = files_of(spark, d).select("file_id", F.concat_ws("/", "review_id", X.card_id(F.col("new_path"))).alias("card_id")).distinct()
    lines = lines_of(spark, d).join(at, "file_id").groupBy("card_id", "line_seq").agg(F.min("new_lineno").alias("n"))
    return views.thread_lines(table(spark, d, "threads").withColumn("card_id", card), lines)


@query("select thread_id, coalesce(side, '') || ':' || unnest(range(line_seq, line_seq + 3)) \"key\" from threads where line_seq is not null")
def thread_spans(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a thread of three lines covers, its ends given the wrong way round."""
    t = table(spark, d, "threads").where("line_seq is not null").select("thread_id", F.coalesce("side", F.lit("")).alias("side"), (F.col("line_seq") + 2).alias("from_row"), F.col("line_seq").alias("to_row"))
    return views.thread_regions(t)


@query(f"""with c as (select distinct cluster_id, card_id, status <> 'Added' done from ({_MEMBERS})), p as (select cluster_id, count(*) n, count(*) filter (done) k from c group by 1) select sum(n)::bigint cards, sum(k)::bigint done_cards, count(*) filter (n = k) done_clusters from p""")
def loader_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cards, done cards, done clusters; added files are not done."""
    return views.progress_totals(_members(spark, d).select("cluster_id", "card_id", (F.col("status") != "Added").alias("done")).distinct())


@query(f"""with c as (select distinct repo_path, review_id, new_path from file_diffs) select repo_path, count(distinct new_path) files from c group by 1""")
def file_totals(spark: SparkSession, d: str) -> DataFrame:
    """Distinct files of each repository."""
    return C.file_counts(files_of(spark, d), ["repo_path"])


@query(f"""with m as ({_MEMBERS}), p as (select card_id, min(cluster_id) cluster_id from m where status <> 'Deleted' group by 1), s as (select t.card_id, min(nullif(trim(u.text), '')) s from ({_THREADS}) t join ({TURNS}) u using (thread_id) group by 1)
 select distinct m.card_id, p.cluster_id, s.s ai_summary, 'done' analysis from m left join p using (card_id) left join s using (card_id)""")
def folded_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the cluster and the summary that a layout gives them."""
    m = _members(spark, d)
    lay = m.where("status <> 'Deleted'").groupBy("card_id").agg(F.min("cluster_id").alias("cluster_id"))
    said = _threads(spark, d).join(turns_of(spark, d).select("thread_id", "text"), "thread_id").groupBy("card_id").agg(F.min(F.nullif(F.trim("text"), F.lit(""))).alias("summary"))
    return layout.folded(m.select("card_id").distinct(), lay, said).withColumn("analysis", F.lit("done"))


@query(f"""with m as (select distinct cluster_id seed_id, member_pos pos, card_id from ({_MEMBERS})), c as (select {_CARD} card_id, arg_max(new_path, file_seq) path, arg_max(status, file_seq) status from ({FILES}) group by 1), h as (select card_id, arg_max(text, thread_id || '/' || msg_seq) s from ({_THREADS}) t join ({TURNS}) u using (thread_id) where text is not null group by 1)
 select seed_id, pos, m.card_id, coalesce(s, {BASE.format("path")}, m.card_id) name, path, 'file' kind, lower(status) change_type from m join c using (card_id) left join h using (card_id)""")
def described_members(spark: SparkSession, d: str) -> DataFrame:
    """Members with the name that the last writer gave them (a thread's last text before the file's name), path, kind and change."""
    f = files_of(spark, d).select(F.concat_ws("/", "review_id", "new_path").alias("card_id"), F.col("new_path").alias("path"), X.basename(F.col("new_path")).alias("symbol"), F.lit("file").alias("kind"), F.lower("status").alias("change_type"), F.col("file_seq").alias("seq"))
    said = _threads(spark, d).join(turns_of(spark, d).where("text is not null"), "thread_id").select("card_id", F.col("text").alias("name"), F.concat_ws("/", "thread_id", F.col("msg_seq").cast("string")).alias("seq"))
    m = _members(spark, d).select(F.col("cluster_id").alias("seed_id"), F.col("member_pos").alias("pos"), "card_id").distinct()
    return features.described(m, f, said)


@query(f"""with m as (select layout_id, cluster_id, member_pos, card_id from ({_MEMBERS})), s as (select distinct card_id, {BASE.format("card_id")} name from ({_MEMBERS}) where status = 'Modified') select distinct cluster_id, member_pos, card_id, name from m join s using (card_id)""")
def label_requests(spark: SparkSession, d: str) -> DataFrame:
    """The members that labels are asked for: those of modified files."""
    m = _members(spark, d)
    symbols = m.where("status = 'Modified'").select("card_id", X.basename(F.col("card_id")).alias("name"))
    return layout.label_inputs(m.select("cluster_id", "member_pos", "card_id").distinct(), symbols)


# --- stores


@query("""with p as (select entry_id, result_json j from cluster_result) select entry_id from p where json_valid(j) and json_type(j) = 'OBJECT' and json_type(j, '$.clusterOrder') = 'ARRAY'""")
def readable_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that decode and have an order of clusters; damaged ones are misses."""
    return store.read_entries(table(spark, d, "cluster_result"), "result_json", "clusterOrder array<string>", "clusterOrder").select("entry_id")


@query("""with v as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) - 1 back from events) select user_id, event_id, back::int back from v where back < 100""")
def step_history(spark: SparkSession, d: str) -> DataFrame:
    """The last hundred steps of each user."""
    return store.history(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query(f"""with c as (select review_id, list_sort(list(distinct new_path)) paths from file_diffs group by 1) select review_id, sha256('{{"tag":"card","version":{store.SCHEMA_VERSION},"paths":' || cast(to_json(paths) as varchar) || '}}') card_hash from c""")
def list_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of lists: their order, which is none here, does not count."""
    c = table(spark, d, "file_diffs").groupBy("review_id").agg(F.collect_set("new_path").alias("paths"))
    return store.content_hash(c, ("review_id",)).select("review_id", "card_hash")


@query("""select repo_path || chr(31) || coalesce(base_branch, '') || chr(31) || target_branch "key", count(*) reviews from (select distinct * from reviews) group by 1""")
def thread_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys under which threads are stored, with the reviews that share one."""
    key = store.thread_key(F.col("repo_path"), F.coalesce("base_branch", F.lit("")), F.col("target_branch"))
    return table(spark, d, "reviews").distinct().groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("reviews"))


# --- events


@query(f"""with f as (select repo_path "key", count(distinct new_path)::int files from file_diffs group by 1), c as (select distinct repo_path "key", review_id cluster_id from file_diffs),
 l as (select c."key", review_id cluster_id, min(thread_id) title, min(epoch(opened_at))::bigint done_at from threads join c on c.cluster_id = threads.review_id group by 1, 2),
 e as (select "key", 0 n, 0 "at", 'static' kind, files, cast(null as varchar) id, cast(null as varchar) chapter from f union all select "key", 1, 0, 'clustering', null, null, null from f union all select distinct "key", 2, 0, 'clusters', null, null, null from c
  union all select "key", 3, done_at, 'reviewed', null, cluster_id, title from l union all select "key", 4, 0, 'final', null, null, null from f)
 select "key", row_number() over (partition by "key" order by n, "at", id) - 1 seq, kind, files, id, chapter from e""")
def emitted_events(spark: SparkSession, d: str) -> DataFrame:
    """The events that an analysis of each repository sends."""
    t = table(spark, d, "file_diffs")
    files = t.groupBy(F.col("repo_path").alias("key")).agg(F.countDistinct("new_path").cast("int").alias("files"))
    clusters = t.select(F.col("repo_path").alias("key"), F.col("review_id").alias("cluster_id")).distinct().withColumn("pos", F.col("cluster_id"))
    labels = table(spark, d, "threads").join(clusters.drop("pos"), F.col("cluster_id") == F.col("review_id")).groupBy("key", "cluster_id").agg(F.min("thread_id").alias("title"), F.min(F.unix_timestamp("opened_at")).alias("done_at"))
    return progress.emitted(files, clusters, labels)


@query(f"""select thread_id, string_agg(coalesce(text, '-'), chr(10) order by msg_seq) answers from ({TURNS}) group by 1""")
def gathered_answers(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each thread, as they came more than once and in any order, in the order of their places."""
    got = progress.gathered(turns_of(spark, d), ["thread_id"], ["msg_seq"], "text")
    return got.select("thread_id", F.array_join("values", "\n", "-").alias("answers"))
