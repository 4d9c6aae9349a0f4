"""Unit names, search rounds, ingestion states, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog.registry import normal, q, query
from spindrift.functions import text
from spindrift.operators import announcements, documents, ingestion, names, resolution, search, sitegraph, sources
from spindrift.plans.views import NOW, view

DIRECTORY = [("the", "unit the"), ("thethe", "unit double"), ("tion", "unit tion"), ("tion and", "unit joint"), ("that", "unit that"), ("reer", "unit reer"), ("er th", "unit reer")]
SCOPED = {"unit the", "unit joint"}
_PATTERN = q(resolution.pattern([a for a, _ in DIRECTORY]))
_KNOWN = "(values " + ", ".join(f"({q(a)}, {q(u)})" for a, u in DIRECTORY) + ") k(alias, unit)"
_MENTIONS = f"(select doc_id, unnest(list_distinct(regexp_extract_all(text, {_PATTERN}))) as alias from d_docs)"


@query(f"select doc_id, unit, min(alias) as alias from {_MENTIONS} join {_KNOWN} using (alias) group by all")
def alias_mentions(spark, sf_dir):
    return resolution.units(view(spark, sf_dir, "d_docs"), "doc_id", "text", DIRECTORY)


@query(
    f"""
    with u as (select doc_id, count(distinct unit) as n, min(unit) as unit from {_MENTIONS} join {_KNOWN} using (alias) group by doc_id)
    select d.doc_id, case when n > 1 then 'ambiguous' when n = 1 then case when u.unit in ('unit the', 'unit joint') then 'scoped' else 'unverified' end
             when regexp_matches(text, '(?i)[a-zA-Z0-9_]+ing') then 'unknown' else 'none' end as status, case when n = 1 then u.unit end as unit
    from d_docs d left join u on d.doc_id = u.doc_id"""
)
def unit_resolution(spark, sf_dir):
    return resolution.resolution(view(spark, sf_dir, "d_docs"), "doc_id", "text", DIRECTORY, SCOPED, "ing")


_ANY = "(select string_agg(alias, '|' order by length(alias) desc, alias) as p from d_names)"


@query(f"select doc_id, alias, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, p)) as alias from documents, {_ANY}) group by all")
def unit_mentions(spark, sf_dir):
    """How often whole texts name the units of a registry, by one automaton."""
    own = names.names_of(view(spark, sf_dir, "d_names"))
    found = names.mentions(view(spark, sf_dir, "documents").select("doc_id", "text"), "text", own).select("doc_id", F.explode("mentions").alias("m"))
    return found.groupBy("doc_id", "m.alias").agg(F.count("*").alias("n"))


@query(
    rf"""
    with m as (select doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(' || p || ')', '⟦\1⟧', 'g') as t from documents, {_ANY}), d as (select list('⟦' || alias || '⟧|' || unit) as d from d_names)
    select doc_id, md5(list_reduce(list_prepend(t, d), lambda x, y: replace(x, split_part(y, '|', 1), split_part(y, '|', 2)))) as text_md5 from m, d"""
)
def alias_normalize(spark, sf_dir):
    """Whole texts with each name replaced by its unit."""
    return names.normalized(view(spark, sf_dir, "documents").select("doc_id", "text"), "text", view(spark, sf_dir, "d_names")).select("doc_id", F.md5(F.col("normal").cast("binary")).alias("text_md5"))


@query("select unit, list_sort(list(distinct alias))::varchar as aliases from (select unit, alias from d_names union all select unit, lower(alias) from d_names) group by unit")
def alias_groups(spark, sf_dir):
    table = view(spark, sf_dir, "d_names")
    out = resolution.aliases_by_unit(table.select("unit", "alias").union(table.select("unit", F.lower("alias"))))
    return out.select("unit", F.concat(F.lit("["), F.array_join("aliases", ", "), F.lit("]")).alias("aliases"))


# Questions about units, one for each document, of all kinds; the registry comes from the table's sources.

_UNIT = "case doc_id % 12 when 0 then source when 3 then '' when 4 then '外星系' when 7 then source when 10 then source when 11 then 'nowhere' end"
_ASKED = """case doc_id % 12 when 1 then concat('請問', source, '的公告') when 2 then concat(source, ' 和 src3 的公告') when 3 then '今天天氣' when 5 then '外星學系最新公告' when 6 then ' 外星學系在哪' when 7 then '月球中心的消息' when 8 then concat(source, '學系公告') when 9 then '校內獎學金' when 10 then '獎學金說明' end"""


def _directory(spark, sf_dir):
    own = view(spark, sf_dir, "documents").where("source is not null").selectExpr("source as unit", "cast(substring(source, 4) as int) as n").distinct()
    lists = own.where("n not in (5, 15)").selectExpr("concat('list-', unit) as name", "unit", "n % 4 <> 0 as enabled").union(own.where("n = 7").selectExpr("concat('extra-', unit)", "unit", "true"))
    units = own.where("n % 2 = 0").selectExpr("unit", "n % 10 <> 8 as enabled", "case n % 6 when 0 then 'listing' when 2 then 'scoped' else 'unsupported' end as strategy", "concat('list-', unit) as source_name")
    routes = spark.createDataFrame([("校內獎學金", "list-src1"), ("獎學金說明", "list-src2")], "alias string, source string")
    return names.Directory(own.select(F.col("unit").alias("alias"), "unit"), lists, units, routes)


@query(
    """
    with d as (select doc_id, source, doc_id % 12 as k, cast(substr(source, 4) as integer) as n from documents where source is not null),
         b as (select *, case when n % 2 = 0 then case when n % 10 = 8 or n % 6 = 4 then 'known_unit_without_verified_site' when n % 6 = 2 then 'known_unit_with_scoped_search' when n % 4 <> 0 then 'known_unit_with_listing' else 'known_unit_without_verified_site' end
                              when n in (5, 15) then 'known_unit_without_verified_site' when n = 7 then 'ambiguous' else 'known_unit_with_listing' end as own from d),
         s as (select *, case when k in (0, 1) then own when k = 2 then case when source = 'src3' then own else 'ambiguous' end when k in (3, 6) then 'none' when k in (4, 5, 8, 11) then 'unknown' when k = 7 then 'ambiguous' when k = 9 then 'known_unit_with_listing' else case when source = 'src2' then 'known_unit_with_listing' else 'ambiguous' end end as status from b)
    select doc_id, status, case k when 0 then source when 1 then '請問' || source || '的公告' when 2 then source || ' 和 src3 的公告' when 3 then '今天天氣' when 4 then '外星系' when 5 then '外星學系' when 6 then '外星學系在哪' when 7 then source when 8 then source || '學系' when 9 then '校內獎學金' when 10 then source else 'nowhere' end as requested,
           case when k in (0, 1, 2) and status <> 'ambiguous' then source when k = 9 then 'src1' when k = 10 and status <> 'ambiguous' then 'src2' end as unit,
           case when status <> 'ambiguous' then '' when k in (0, 1) then source when k = 2 then array_to_string(list_sort([source, 'src3']), ',') when k = 7 then source || ',月球中心' else array_to_string(list_sort([source, 'src2']), ',') end as candidates,
           case when status <> 'known_unit_with_listing' then null when k = 9 then 'list-src1' when k = 10 then 'list-src2' else 'list-' || source end as source
    from s"""
)
def unit_resolved(spark, sf_dir):
    """What each question is about: status, requested unit, candidates and source."""
    asked = view(spark, sf_dir, "documents").where("source is not null").selectExpr("doc_id", f"{_UNIT} as unit", f"{_ASKED} as query")
    return names.resolved(asked, "doc_id", "unit", "query", _directory(spark, sf_dir)).select("doc_id", "status", "requested", "unit", F.array_join("candidates", ",").alias("candidates"), "source")


_KINDS = {"announcement": ["tion"], "document": ["reer", "thor"], "homepage": ["home", "is"]}


@query("select doc_id, case when regexp_matches(lower(title), 'tion') then 'announcement' when regexp_matches(lower(title), 'reer|thor') then 'document' when regexp_matches(lower(title), 'home|is') then 'homepage' else 'general' end as intent, trim(regexp_replace(regexp_replace(lower(title), '(tion|the)', ' ', 'g'), '\\s+', ' ', 'g')) as topic from d_docs")
def question_intent(spark, sf_dir):
    t = F.col("title")
    return view(spark, sf_dir, "d_docs").select("doc_id", resolution.intent(t, _KINDS).alias("intent"), resolution.topic(t, ["the", "tion"]).alias("topic"))


_REG = "(select concat('u', cast(page_id % 40 as string)) as unit, case when page_id % 5 = 0 then concat('u', cast(page_id as string)) end as parent, concat('a', cast(page_id % 70 as string)) as alias from d_pages)"


@query(
    f"""
    select 'repeated unit' as fault, unit as name from {_REG} group by unit having count(*) > 1
    union all select 'shared alias', alias from {_REG} group by alias having count(distinct unit) > 1
    union all select 'unknown parent', unit from {_REG} where parent is not null and parent not in (select unit from {_REG})"""
)
def registry_faults(spark, sf_dir):
    rows = view(spark, sf_dir, "d_pages").selectExpr("concat('u', cast(page_id % 40 as string)) as unit", "case when page_id % 5 = 0 then concat('u', cast(page_id as string)) end as parent", "concat('a', cast(page_id % 70 as string)) as alias")
    return resolution.registry_faults(rows.select("unit", "parent"), rows.select("unit", "alias"))


_OWN = "(page_id * 37 % 101) / 100.0::double"
_TURNS, _PER_HOST, _DEEP, _MOST = 5, 2, 2, 12


def _turn(k: int) -> str:
    return f"""
        p{k} as materialized (select search, {k} as turn, page_id, score, depth, host, own from (
            select o.*, d.host, d.own, row_number() over (partition by o.search order by o.score desc, o.page_id) as r from o{k} o join (select page_id, host, {_OWN} as own from d_pages) d using (page_id)
              left join (select search, host, count(*) as n from v{k} group by all) h on h.search = o.search and h.host = d.host where coalesce(h.n, 0) < {_PER_HOST}) where r = 1),
        v{k + 1} as materialized (select * from v{k} union all select search, page_id, host from p{k}),
        x{k} as materialized (select *, row_number() over (partition by search, known order by position, page_id) as place from (
            select p.search, l.target_page_id as page_id, least(1.0::double, max(l.score) + 0.3::double * p.own) as score, p.depth + 1 as depth, min(l.position) as position, exists (select 1 from f{k} f where f.search = p.search and f.page_id = l.target_page_id) as known
              from p{k} p join s l on l.source_page_id = p.page_id where p.depth < {_DEEP} group by p.search, l.target_page_id, p.own, p.depth) q where not exists (select 1 from v{k + 1} v where v.search = q.search and v.page_id = q.page_id)),
        y{k} as materialized (select x.* from x{k} x join (select search, {_MOST} - count(*) as room from f{k} group by search) f on f.search = x.search where known or place <= room),
        f{k + 1} as materialized (select search, page_id from f{k} union all select search, page_id from y{k} where not known),
        o{k + 1} as materialized (select search, page_id, max(score) as score, arg_max(depth, (score, age)) as depth from (
            select search, page_id, score, depth, 1 as age from o{k} o where not exists (select 1 from v{k + 1} v where v.search = o.search and v.page_id = o.page_id) union all select search, page_id, score, depth, 0 from y{k}) group by search, page_id)"""


@query(
    f"""
    with s as (select source_page_id, target_page_id, position, length(anchor_text) * 7 % 50 / 100.0::double as score from d_links),
         o0 as materialized (select unit as search, page_id, max({_OWN}) as score, 0 as depth from d_pages where page_type = 'unit_homepage' or page_id < 20 group by all), f0 as (select search, page_id from o0), v0 as (select search, page_id, '' as host from o0 limit 0), {", ".join(_turn(k) for k in range(_TURNS))}
    select search, turn, page_id, round(score, 9) as score, depth from ({" union all ".join(f"select search, turn, page_id, score, depth from p{k}" for k in range(_TURNS))})"""
)
def best_first(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages").withColumn("own", F.col("page_id") * 37 % 101 / F.lit(100.0))
    links = view(spark, sf_dir, "d_links").select("source_page_id", "target_page_id", "position", (F.length("anchor_text") * 7 % 50 / F.lit(100.0)).alias("score"))
    seeds = pages.where("page_type = 'unit_homepage' or page_id < 20").select(F.col("unit").alias("search"), "page_id", F.col("own").alias("score"))
    found = search.best_first(pages, links, seeds, _TURNS, _PER_HOST, _DEEP, _MOST)
    return found.select("search", "turn", "page_id", F.round("score", 9).alias("score"), "depth")


_LEX = "(page_id * 13 % 97) / 100.0::double"


@query(f"select count(distinct url) as strong, count(distinct url) >= 5 as enough from d_pages where {_LEX} >= 0.25 and failure_count < 5 and unit in ('src3', 'src4', 'src8') and case page_type when 'official_document' then {_LEX} >= 0.45 else true end")
def candidate_sufficiency(spark, sf_dir):
    lexical = F.col("page_id") * 13 % 97 / F.lit(100.0)
    rows = view(spark, sf_dir, "d_pages").where(search.strong(lexical, F.col("failure_count"), F.col("unit").isin("src3", "src4", "src8"), F.col("page_type"), {"announcement"}, scoped=True))
    return rows.agg(F.countDistinct("url").alias("strong")).withColumn("enough", F.col("strong") >= 5)


@query(f"select count(distinct url) as strong, count(distinct url) >= 5 as enough from d_pages where {_LEX} >= 0.25 and failure_count < 5 and case page_type when 'unit_homepage' then page_id = 7 when 'announcement_listing' then false else true end")
def unscoped_sufficiency(spark, sf_dir):
    lexical = F.col("page_id") * 13 % 97 / F.lit(100.0)
    rows = view(spark, sf_dir, "d_pages").where(search.strong(lexical, F.col("failure_count"), F.lit(True), F.col("page_type"), {"homepage", "document"}, scoped=False, root=F.col("page_id") == 7))
    return rows.agg(F.countDistinct("url").alias("strong")).withColumn("enough", F.col("strong") >= 5)


_VISITS = "(select unit, case page_id % 3 when 0 then 'success' when 1 then 'failure' else 'unattempted' end as state, (page_id * 37 % 101) / 100.0::double as score from d_pages)"


@query(
    f"""
    select *, case when successes = 0 then case when failures > 0 then 'failed' end when successes >= 2 and coalesce(best_success, 0) >= 0.75 then null
                   when best_failure > coalesce(best_success, 0) + 0.15 then 'partial' end as warning
    from (select count(*) filter (state = 'success' and score >= 0.18) as successes, count(*) filter (state = 'failure' and score >= 0.18) as failures, count(*) filter (state = 'failure' and score < 0.18) as other_failures,
                 max(score) filter (state = 'success') as best_success, max(score) filter (state = 'failure') as best_failure, max(score) filter (state = 'unattempted') as best_unattempted
          from {_VISITS} where not (state = 'success' and score > 0.5))"""
)
def search_diagnostics(spark, sf_dir):
    state = F.when(F.col("page_id") % 3 == 0, "success").when(F.col("page_id") % 3 == 1, "failure").otherwise("unattempted")
    rows = view(spark, sf_dir, "d_pages").select(state.alias("state"), (F.col("page_id") * 37 % 101 / F.lit(100.0)).alias("score")).where("not (state = 'success' and score > 0.5)")
    c = F.col
    return search.diagnostics(rows).withColumn("warning", search.warning(c("successes"), c("failures"), c("best_success"), c("best_failure"), c("best_unattempted"), F.lit(False)))


@query("select page_id from d_pages where (page_id * 37 % 101) / 100.0::double >= 0.18 or unit = 'src1' and page_type = 'announcement_listing' and page_id % 4 > 0")
def relevance_gate(spark, sf_dir):
    score = F.col("page_id") * 37 % 101 / F.lit(100.0)
    return view(spark, sf_dir, "d_pages").where(search.relevant(score, F.col("unit") == "src1", F.col("page_type"), F.col("page_id") % 4)).select("page_id")


_FETCH = "case page_id % 6 when 0 then 304 when 1 then 500 when 5 then null else 200 end"


@query(
    f"""
    select page_id, case when s = 304 then 'unchanged' when s is null or s <> 200 then 'failed' when page_id % 7 = 0 then 'skipped' when page_id % 11 = 0 then 'ingestion_failed'
             when page_id % 3 = page_id % 5 then 'unchanged' else 'changed' end as outcome
    from (select page_id, {_FETCH} as s from d_pages)"""
)
def crawl_outcome(spark, sf_dir):
    p = F.col("page_id")
    kind = F.when(p % 7 == 0, "application/pdf").otherwise("text/HTML; charset=utf-8")
    return view(spark, sf_dir, "d_pages").select("page_id", ingestion.outcome(F.expr(_FETCH), kind, (p % 3).cast("string"), (p % 5).cast("string"), p % 11 == 0).alias("outcome"))


@query(
    f"""
    select page_id, case when hit then coalesce(case when page_id % 4 = 0 then 'new' end, title) else title end as title, case when hit then cast(page_id % 3 as string) else cast(page_id % 5 as string) end as content_hash,
           case when hit and page_id % 3 <> page_id % 5 then 'success' when hit then 'unchanged' else crawl_status end as crawl_status, case when hit then 0 else failure_count end as failure_count,
           case when hit then {NOW} else last_success_s end as last_success_s
    from (select *, page_id % 2 = 0 as hit from d_pages)"""
)
def after_fetch(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages").withColumn("content_hash", (F.col("page_id") % 5).cast("string"))
    fetched = pages.where("page_id % 2 = 0").selectExpr("page_id", "cast(page_id % 3 as string) as new_hash", "case when page_id % 4 = 0 then 'new' end as new_title")
    return ingestion.after_fetch(pages, fetched, NOW)


@query(
    """
    select page_id, case when page_type in ('announcement_listing', 'announcement_detail') then s not in ('success', 'partial') or l not in ('success', 'incomplete') or page_id % 2 <> page_id % 4 else s <> 'success' end or page_id % 9 = 0 as needed
    from (select *, case page_id % 3 when 0 then 'success' when 1 then 'partial' else 'failed' end as s, case page_id % 5 when 0 then 'failed' else 'success' end as l from d_pages)"""
)
def ingestion_needed(spark, sf_dir):
    p = F.col("page_id")
    state = F.when(p % 3 == 0, "success").when(p % 3 == 1, "partial").otherwise("failed")
    lists = F.when(p % 5 == 0, "failed").otherwise("success")
    return view(spark, sf_dir, "d_pages").select("page_id", ingestion.needed(F.col("page_type"), state, lists, (p % 2).cast("string"), (p % 4).cast("string"), p % 9 != 0).alias("needed"))


@query(
    """
    select page_id, case e when 'begin' then 'running' when 'complete' then case when s = 'running' then 'success' else s end when 'fail' then case when s = 'running' then 'failed' else s end else s end as state
    from (select page_id, case when page_id % 2 = 0 then 'running' else 'pending' end as s, case page_id % 4 when 0 then 'begin' when 1 then 'complete' when 2 then 'fail' else 'other' end as e from d_pages)"""
)
def ingestion_state(spark, sf_dir):
    p = F.col("page_id")
    event = F.when(p % 4 == 0, "begin").when(p % 4 == 1, "complete").when(p % 4 == 2, "fail").otherwise("other")
    return view(spark, sf_dir, "d_pages").select("page_id", ingestion.advanced(F.when(p % 2 == 0, "running").otherwise("pending"), event).alias("state"))


@query(
    """
    with r as (select canonical_url, 'document' as discovery_source, 3 as w, title from d_docs where is_current union all select replace(canonical_url, '/a/', '/d/'), 'announcement', 2, title from d_announcements union all select base_url, 'source', 1, name from d_sources)
    select canonical_url, arg_max(discovery_source, (w, title)) as discovery_source, arg_max(title, (w, title)) as title from r group by canonical_url"""
)
def bootstrap_import(spark, sf_dir):
    docs = view(spark, sf_dir, "d_docs").where("is_current")
    ann = view(spark, sf_dir, "d_announcements").withColumn("canonical_url", F.replace("canonical_url", F.lit("/a/"), F.lit("/d/")))
    sources = view(spark, sf_dir, "d_sources").select(F.col("base_url").alias("canonical_url"), F.col("name").alias("title"))
    return ingestion.imported([("document", 3, docs), ("announcement", 2, ann), ("source", 1, sources)])


@query(
    f"""
    with c as (select cast(page_id % 50 as string) as cache_key, cast(page_id as string) as payload, {NOW} - page_id * 7 % 1000 as written_s, {NOW} - page_id * 7 % 1000 + 500 as expires_s from d_pages),
         l as (select * from c qualify row_number() over (partition by cache_key order by written_s desc, payload desc) = 1)
    select cache_key, payload, expires_s - {NOW} as seconds_left from l where expires_s > {NOW} and cast(cache_key as integer) % 3 = 0"""
)
def cache_lookup(spark, sf_dir):
    rows = view(spark, sf_dir, "d_pages").selectExpr("page_id", "cast(page_id % 50 as string) as cache_key", "cast(page_id as string) as payload", f"{NOW} - page_id * 7 % 1000 as written_s", f"{NOW} - page_id * 7 % 1000 + 500 as expires_s")
    cache = ingestion.cache_put(rows.where("page_id % 2 = 0").drop("page_id"), rows.where("page_id % 2 = 1").drop("page_id"))
    keys = spark.range(0, 50, 3).select(F.col("id").cast("string").alias("cache_key"))
    return ingestion.cache_get(cache, keys, NOW)


@query("select page_type, count(*) as pages, count(*) filter (is_active and is_indexable and crawl_status not in ('blocked', 'excluded')) as eligible, sum(failure_count) as failures from d_pages group by page_type")
def registry_audit(spark, sf_dir):
    rows = view(spark, sf_dir, "d_pages")
    fine = sitegraph.eligible(rows).groupBy("page_type").agg(F.count("*").alias("eligible"))
    return rows.groupBy("page_type").agg(F.count("*").alias("pages"), F.sum("failure_count").alias("failures")).join(fine, "page_type", "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))


_CONF = "(select name, base_url || '/new' as base_url, 45 as interval_minutes from d_sources where first_doc % 2 = 0 union all select 'extra', 'https://extra', 45)"


def _configured(spark, sf_dir):
    known = view(spark, sf_dir, "d_sources").where("first_doc % 2 = 0").selectExpr("name", "base_url || '/new' as base_url", "45 as interval_minutes")
    return known.union(spark.createDataFrame([("extra", "https://extra", 45)], known.schema))


@query(f"select coalesce(c.name, s.name) as name, coalesce(c.base_url, s.base_url) as base_url, coalesce(c.interval_minutes, s.interval_minutes) as interval_minutes, s.last_success_s from d_sources s full join {_CONF} c on s.name = c.name")
def source_merge(spark, sf_dir):
    return sources.merged(view(spark, sf_dir, "d_sources"), _configured(spark, sf_dir))


@query(f"select name from d_sources where name not in (select name from {_CONF})")
def source_unconfigured(spark, sf_dir):
    return sources.unconfigured(view(spark, sf_dir, "d_sources"), _configured(spark, sf_dir))


@query("select s.name, case when s.name in ('src1', 'src2') then null else greatest(s.last_success_s, c.at) end as last_success_s from d_sources s left join (select source as name, max(last_crawled_s) as at from d_announcements where id % 3 = 0 group by source) c on s.name = c.name")
def source_refresh(spark, sf_dir):
    crawls = view(spark, sf_dir, "d_announcements").where("id % 3 = 0").selectExpr("source as name", "last_crawled_s as crawled_s")
    return sources.forced(sources.refreshed(view(spark, sf_dir, "d_sources"), crawls), ["src1", "src2"]).select("name", "last_success_s")


_SHOWN = "concat('see ', url, case page_id % 4 when 0 then ', or ' when 1 then '。 x' when 2 then ' ，y' else '' end, '  (12345678-abcd-1234-1234-1234567890AB) ok')"
_KEPT = ["https://example.com/", "https://the.example.com/en/1"]


@query(
    f"""
    with s as (select page_id, page_id % 4 as v, case when url in ({", ".join(map(q, _KEPT))}) then url else '' end as kept, url from pages where regexp_matches(url, '^https?://[A-Za-z0-9./_?=&-]*[A-Za-z0-9/_=&-]$'))
    select page_id, trim(regexp_replace(case when v in (1, 2) then rtrim('see ' || kept) else 'see ' || kept end || case v when 0 then ', or ' when 1 then '。 x' when 2 then '，y' else '' end || ' ok', '[ \t]{{2,}}', ' ', 'g')) as shown from s"""
)
def output_sanitize(spark, sf_dir):
    plain = view(spark, sf_dir, "pages").where(F.rlike("url", F.lit("^https?://[A-Za-z0-9./_?=&-]*[A-Za-z0-9/_=&-]$")))
    return plain.select("page_id", text.sanitized(F.expr(_SHOWN), _KEPT).alias("shown"))


_QUESTION = "concat(case doc_id % 5 when 0 then '請問 ' when 1 then '幫我查詢' when 2 then '想知道一下' else '' end, case doc_id % 7 when 0 then '最新公告' when 1 then '有哪些公告？' when 2 then '獎學金公告' when 3 then '通知一下' else substring(text, 1, 5) end)"


@query(f"""select doc_id, case when doc_id % 7 in (0, 1, 3) then doc_id % 5 <> 2 else false end as generic, case doc_id % 6 when 0 then doc_id % 1000 when 1 then 23 when 2 then 110 when 3 then null when 4 then 7 else 0 end::integer as told from d_docs where text is not null""")
def generic_requests(spark, sf_dir):
    told = "case doc_id % 6 when 0 then cast(doc_id % 1000 as string) when 1 then '二十三' when 2 then '百十' when 3 then '三百零五' when 4 then '七' else '零十' end"
    rows = view(spark, sf_dir, "d_docs").where("text is not null").select("doc_id", F.expr(_QUESTION).alias("question"), F.expr(told).alias("n"))
    return rows.select("doc_id", text.is_generic(F.col("question")).alias("generic"), text.count_of(F.col("n")).alias("told"))


_ROLE = "case page_id % 3 when 0 then '/p/403-1-2.php' when 1 then '/P/406-1-2.php' else '/x' end"


@query(
    f"""
    select page_id, case when i > 0 and (page_id % 2 = 0 or i >= 2 or page_id % 3 = 0) then 'listing'
             when i = 0 and title <> '' and length(title) >= 40 and (page_id % 7 = 0 or page_id % 3 = 1 and page_id % 4 > 0) then 'detail' else 'other' end as role, left({normal("case when title <> '' then title || chr(10) || 'x ' || title else 'x ' || title end")}, 50) as body
    from (select *, page_id % 5 % 3 as i from d_pages)"""
)
def page_role(spark, sf_dir):
    p = F.col("page_id")
    role = documents.page_role(p % 5 % 3, p % 2 == 0, p % 7 == 0, F.expr(_ROLE), F.col("title"), F.col("title"), F.when(p % 4 > 0, F.lit(1)))
    return view(spark, sf_dir, "d_pages").select("page_id", role.alias("role"), documents.page_body(F.col("title"), F.concat(F.lit("x "), F.col("title")), 50).alias("body"))


@query(
    """
    with a as (select canonical_url, title, case when id % 7 > 0 then published_day end as published_day, cast(null as varchar) as body from d_announcements where id % 3 <> 1), b as (select canonical_url, case when id % 5 > 0 then title || '!' end as title, case when id % 4 = 0 then published_day + 1 end as published_day, body from d_announcements where id % 2 = 0)
    select coalesce(b.canonical_url, a.canonical_url) as canonical_url, coalesce(b.title, a.title) as title, coalesce(b.published_day, a.published_day) as published_day, md5(b.body) as body_md5, coalesce(b.published_day, a.published_day) is null as undated
    from a full join b on a.canonical_url = b.canonical_url"""
)
def listing_details(spark, sf_dir):
    rows = view(spark, sf_dir, "d_announcements")
    lists = rows.where("id % 3 <> 1").selectExpr("canonical_url", "title", "case when id % 7 > 0 then published_day end as published_day", "cast(null as string) as body")
    pages = rows.where("id % 2 = 0").selectExpr("canonical_url", "case when id % 5 > 0 then concat(title, '!') end as title", "case when id % 4 = 0 then published_day + 1 end as published_day", "body")
    return announcements.with_details(lists, pages).select("canonical_url", "title", "published_day", F.md5(F.col("body").cast("binary")).alias("body_md5"), "undated")


@query("select source, string_agg(lang, ',' order by first) as langs from (select source, lang, min(doc_id) as first from documents where lang is not null group by source, lang) group by source")
def ordered_langs(spark, sf_dir):
    first = view(spark, sf_dir, "documents").where("lang is not null").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    listed = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first", "lang"))).alias("l"))
    return listed.select("source", F.array_join(text.ordered_distinct(F.col("l.lang")), ",").alias("langs"))


@query("select doc_id, round(cast('0x' || substr(sha256(text), 1, 2) as integer) / 127.5::double - 1, 9) as first, round(cast('0x' || substr(sha256(text), 63, 2) as integer) / 127.5::double - 1, 9) as last from documents where text is not null")
def hash_embedding(spark, sf_dir):
    v = text.hash_embedding(F.col("text"), 32)
    return view(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.round(v[0], 9).alias("first"), F.round(v[31], 9).alias("last"))


@query("select alias as unit, alias from d_names union select alias, substr(alias, 1, length(alias) - 2) || 'xx' from d_names where ends_with(alias, 'er') union select alias, substr(alias, 1, length(alias) - 3) from d_names where ends_with(alias, 'ion')")
def derived_aliases(spark, sf_dir):
    return resolution.derived(view(spark, sf_dir, "d_names").select("alias", F.col("alias").alias("unit")), {"er": "xx", "ion": ""})
