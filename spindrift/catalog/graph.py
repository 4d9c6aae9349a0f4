"""Urls, pages, links, frontier, candidates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spindrift.catalog.registry import q, query, sim
from spindrift.functions import text, urls
from spindrift.operators import crawling, sitegraph
from spindrift.plans.views import view

# The rules of urls in DuckDB SQL, over a column url.
U_AUTH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
U_HOST = f"rtrim(lower(regexp_replace(regexp_replace({U_AUTH}, '^.*@', ''), ':[0-9]*$', '')), '.')"
U_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/')"
U_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
U_PARAMS = f"list_filter(string_split({U_QUERY}, '&'), lambda p: p <> '')"
_TAIL = "case when {0} <> '' then '?' || {0} else '' end"
CANONICAL = f"'https://' || {U_HOST} || regexp_replace({U_PATH}, '%2[Cc]', ',', 'g') || {_TAIL.format(U_QUERY)}"
_DOCUMENT = r"regexp_matches({0}, '(?i)\.(pdf|doc|docx|odt|xls|xlsx)$')"
RESOURCE = rf"regexp_matches({U_PATH}, '(?i)\.(7z|avi|css|csv|doc|docx|gif|gz|ico|jpeg|jpg|js|mov|mp3|mp4|odt|pdf|png|ppt|pptx|rar|svg|tar|tif|tiff|txt|webp|xls|xlsx|xml|zip)$')"
_KEYS = f"list_transform({U_PARAMS}, lambda p: regexp_extract(lower(p), '^([^=]*)', 1))"
_SEGMENTS = f"list_filter(string_split(lower({U_PATH}), '/'), lambda s: s <> '')"
_RUN = f"len(list_filter(range(1, len({_SEGMENTS}) - 2), lambda i: {_SEGMENTS}[i] = {_SEGMENTS}[i + 1] and {_SEGMENTS}[i] = {_SEGMENTS}[i + 2] and {_SEGMENTS}[i] = {_SEGMENTS}[i + 3])) > 0"
TRAP = f"""(length({U_QUERY}) > 512 or len({_KEYS}) > 6 or len(list_distinct({_KEYS})) < len({_KEYS}) or len({_SEGMENTS}) > 32 or {_RUN} or
  list_has_any({_KEYS}, ['fbclid', 'gclid', 'jsessionid', 'phpsessid', 'redirect', 'return', 'session', 'sessionid', 'sid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term']))"""
_BELOW = "({0} = '{1}' or ends_with({0}, '.{1}'))"
ALLOWED = f"(regexp_matches(url, '(?i)^https://') and not contains({U_AUTH}, '@') and regexp_matches({U_AUTH}, '^[^:]+(:(443)?)?$') and ({_BELOW.format(U_HOST, 'example.net')} or {_BELOW.format(U_HOST, 'example.com')}))"
_ROOTS = ["example.net", "example.com"]


@query(f"select page_id, {CANONICAL} as canonical from d_urls")
def url_canonical(spark, sf_dir):
    return view(spark, sf_dir, "d_urls").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


_PY_DECODE = "coalesce(case when not regexp_matches({0}, '%([^0-9a-fA-F]|[0-9a-fA-F][^0-9a-fA-F]|.?$)') then url_decode(replace({0}, '+', ' ')) end, {0})"
_PAIRS = f"list_sort(list_transform({U_PARAMS}, lambda p: {{'k': {_PY_DECODE.format("regexp_extract(p, '^([^=]*)', 1)")}, 'v': {_PY_DECODE.format("regexp_extract(p, '^[^=]*=(.*)', 1)")}}}))"
_PLUS = "replace(url_encode({0}), '%20', '+')"
_FRONT_QUERY = f"array_to_string(list_transform({_PAIRS}, lambda p: {_PLUS.format('p.k')} || '=' || {_PLUS.format('p.v')}), '&')"
FRONTIER = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || {U_HOST} || {U_PATH} || {_TAIL.format(_FRONT_QUERY)}"


@query(f"select page_id, {FRONTIER} as canonical from d_urls")
def url_frontier(spark, sf_dir):
    return view(spark, sf_dir, "d_urls").select("page_id", urls.frontier_canonical(F.col("url")).alias("canonical"))


@query(rf"select page_id, regexp_replace({CANONICAL}, '(?i)^(https://[^/?#]+)/p/(?:404|406)-(\d+)-(\d+)(?:,[^/?]+)?\.php(\?|$)', '\1/p/content-\2-\3.php\4') as identity from d_urls")
def url_identity(spark, sf_dir):
    return view(spark, sf_dir, "d_urls").select("page_id", urls.content_identity(F.col("url")).alias("identity"))


@query(f"select page_id from d_urls where {_BELOW.format(U_HOST, 'example.com')}")
def url_host_scope(spark, sf_dir):
    rows = view(spark, sf_dir, "d_urls").select("page_id", urls.host(F.col("url")).alias("host"))
    return urls.in_scope_table(rows, spark.sql("select * from values ('Example.com.'), (' '), ('www.example.com'), ('a.b.c') as t(host)")).select("page_id")


@query(f"select page_id, {TRAP} as trap from d_urls")
def url_trap(spark, sf_dir):
    return view(spark, sf_dir, "d_urls").select("page_id", urls.is_trap(F.col("url")).alias("trap"))


@query(f"select page_id from d_urls where {ALLOWED}")
def url_allowed(spark, sf_dir):
    return view(spark, sf_dir, "d_urls").where(urls.is_allowed(F.col("url"), _ROOTS)).select("page_id")


@query(f"select page_id, {RESOURCE} as resource, {_DOCUMENT.format(U_PATH)} as document, regexp_matches(url, '(?i)^https?://') and not contains(url, '#') and not {RESOURCE} and not {TRAP} and {_BELOW.format(U_HOST, 'example.net')} as bounded from d_urls")
def url_bounded(spark, sf_dir):
    u = F.col("url")
    return view(spark, sf_dir, "d_urls").select("page_id", urls.is_resource(u).alias("resource"), urls.is_document(u).alias("document"), urls.is_bounded(u, ["example.net"]).alias("bounded"))


_FOLLOW = f"select page_id, case when {ALLOWED} and not {TRAP} and (not {RESOURCE} or {_DOCUMENT.format(U_PATH)}) then {FRONTIER.replace(U_PATH, f"regexp_replace({U_PATH}, '%2[Cc]', ',', 'g')")} end as target from d_urls"


@query(_FOLLOW)
def url_target(spark, sf_dir):
    return view(spark, sf_dir, "d_urls").select("page_id", urls.target(F.col("url"), _ROOTS, documents=True).alias("target"))


_ANCHOR = "case page_id % 5 when 0 then '最新公告' when 1 then ' ' when 2 then '通知 list' else 'more' end"
_LINK_TYPE = "case when regexp_matches({0}, '公告|通知|訊息') then 'announcement' when {1} then 'document' when trim({0}) <> '' then 'content' else 'unknown' end"


@query(f"select page_id, {_LINK_TYPE.format(_ANCHOR, _DOCUMENT.format(U_PATH))} as link_type, case when page_id % 3 = 0 or page_id % 7 = 1 then 'announcement_listing' when page_id % 3 = 1 then 'announcement_detail' else 'general_page' end as page_type from d_urls")
def url_types(spark, sf_dir):
    p = F.col("page_id")
    role = F.when(p % 3 == 0, "listing").when(p % 3 == 1, "detail").otherwise("other")
    return view(spark, sf_dir, "d_urls").select("page_id", urls.link_type(F.expr(_ANCHOR), F.col("url")).alias("link_type"), urls.page_type(role, F.when(p % 7 == 1, 2).otherwise(0)).alias("page_type"))


_SEEN = "select page_id % 40 as source_page_id, page_id as position, url, case page_id % 4 when 0 then '' when 1 then ' 公告 ' else 'more' end as anchor_text, cast(page_id % 4 as int) as depth, page_id % 11 = 0 as listed from d_urls union all select page_id % 40, page_id + 1000000, url, 'again', cast(page_id % 4 as int), false from d_urls"


@query(
    f"""
    with s as (select *, page_id_of(position) as page_id from (select source_page_id, position, url, trim(anchor_text) as anchor_text, depth, listed from ({_SEEN}))),
         t as (select s.*, case when depth < 3 then f.target end as target from s left join ({_FOLLOW}) f on s.page_id = f.page_id),
         k as (select *, case when listed then 'announcement' else {_LINK_TYPE.format("anchor_text", _DOCUMENT.format("regexp_extract(coalesce(target, ''), '^[^?]*')"))} end as own from t),
         n as (select *, row_number() over (partition by source_page_id, target order by position) as n, coalesce(min_by(own, position) filter (anchor_text <> '') over w, min_by(own, position) filter (own <> 'unknown') over w, 'unknown') as link_type from k
               window w as (partition by source_page_id, target))
    select link_type as category, case when depth >= 3 then 'max_depth' when target is null then 'policy' when n > 1 then 'duplicate' else 'kept' end as reason, count(*) as links from n group by all""".replace("page_id_of(position)", "case when position >= 900000 then position - 1000000 else position end")
)
def link_outcomes(spark, sf_dir):
    seen = view(spark, sf_dir, "d_urls")
    one = seen.selectExpr("page_id % 40 as source_page_id", "page_id as position", "url", "case page_id % 4 when 0 then '' when 1 then ' 公告 ' else 'more' end as anchor_text", "cast(page_id % 4 as int) as depth", "page_id % 11 = 0 as listed")
    two = seen.selectExpr("page_id % 40", "page_id + 1000000", "url", "'again'", "cast(page_id % 4 as int)", "false")
    return sitegraph.link_outcomes(sitegraph.recorded_links(one.union(two), _ROOTS))


@query(
    """
    select source_page_id, target_page_id, coalesce(arg_min(anchor_text, position) filter (anchor_text <> ''), '') as anchor_text,
           coalesce(arg_min(link_type, position) filter (link_type <> 'unknown'), 'unknown') as link_type, max(seen_s) as last_seen_s
    from (select source_page_id, target_page_id, anchor_text, link_type, position, seen_s from d_links
          union all select source_page_id, target_page_id, 'again', 'content', position + 1000000000, seen_s + 7 from d_links where (source_page_id + target_page_id) % 3 = 0
          union all select source_page_id, target_page_id, '', 'unknown', position - 1000000000, seen_s - 7 from d_links where target_page_id % 2 = 0) group by 1, 2"""
)
def link_merge(spark, sf_dir):
    rows = view(spark, sf_dir, "d_links").select("source_page_id", "target_page_id", "anchor_text", "link_type", "position", "seen_s")
    later = rows.where("(source_page_id + target_page_id) % 3 = 0").selectExpr("source_page_id", "target_page_id", "'again'", "'content'", "position + 1000000000", "seen_s + 7")
    earlier = rows.where("target_page_id % 2 = 0").selectExpr("source_page_id", "target_page_id", "''", "'unknown'", "position - 1000000000", "seen_s - 7")
    return sitegraph.merged_links(rows.union(later).union(earlier))


def _rank_sql(c: str, table: dict) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " else 0 end"


_RANKS = {"official_unit": 100, "existing_document": 95, "existing_announcement": 95, "existing_source": 85, "configured_seed": 80, "manual": 60, "official_search": 50, "internal_link": 30}
_STORED = "select *, case when page_id % 7 > 2 then cast(page_id % 7 as string) end as content_hash from {0}"
_FOUND = "select *, case when not untitled then in_title end as title, concat('in', cast(page_id % 3 as string)) as unit, cast(page_id % 4 as string) as content_hash, case when page_id % 3 > 0 then cast(1700000000 as bigint) end as next_crawl_s from {0}"
_OLD = "case when c.page_id is null then i.{0} when i.page_id is null then c.{0} when {1} then i.{0} else {2} end as {0}"


def _pick(name: str, takes: str, otherwise: str = "") -> str:
    return _OLD.format(name, takes, otherwise or f"c.{name}")


@query(
    f"""
    with i as (select *, {_rank_sql("discovery_source", _RANKS)} as sr, case when is_indexable then 'discovered' else 'excluded' end as crawl_status, is_indexable as is_active from ({_FOUND.format("d_pages_in")})),
         c as (select *, {_rank_sql("discovery_source", _RANKS)} as sr from ({_STORED.format("(select * replace (case when page_id % 4 = 3 then 'unknown' else page_type end as page_type, case when page_id % 6 = 1 then null else title end as title, case when page_id % 9 = 0 then null else unit end as unit) from d_pages)")}))
    select coalesce(c.page_id, i.page_id) as page_id, {_pick("title", "i.title is not null and (coalesce(c.title, '') = '' or c.crawl_status not in ('success', 'unchanged') and i.sr >= c.sr)")},
           {_pick("unit", "c.unit is null")}, {_pick("content_hash", "c.content_hash is null")},
           {_pick("page_type", "c.page_type = 'unknown' or c.page_type = 'general_page' and i.page_type in ('unit_homepage', 'announcement_listing', 'announcement_detail', 'official_document')")},
           {_pick("discovery_source", "i.sr > c.sr")}, coalesce(c.crawl_status, i.crawl_status) as crawl_status, greatest(c.crawl_priority, i.crawl_priority) as crawl_priority, least(c.minimum_depth, i.minimum_depth) as minimum_depth,
           case when c.page_id is null or i.page_id is not null and c.next_crawl_s is null then coalesce(i.next_crawl_s, 1700050030) else c.next_crawl_s end as next_crawl_s,
           {_pick("is_active", "i.sr >= c.sr")}, {_pick("is_indexable", "i.sr >= c.sr", "c.is_indexable and i.is_indexable")},
           case when c.page_id is null then 'created' when i.page_id is null then 'kept' else 'updated' end as outcome
    from c full join i on c.page_id = i.page_id"""
)
def page_merge(spark, sf_dir):
    odd = {"page_type": "case when page_id % 4 = 3 then 'unknown' else page_type end", "title": "case when page_id % 6 <> 1 then title end", "unit": "case when page_id % 9 <> 0 then unit end"}
    current = spark.sql(_STORED.format("{t}"), t=view(spark, sf_dir, "d_pages")).withColumns({k: F.expr(v) for k, v in odd.items()})
    return sitegraph.merged_pages(current, spark.sql(_FOUND.format("{t}"), t=view(spark, sf_dir, "d_pages_in")), 1_700_050_000, 30)


@query(
    f"""
    select source_page_id, position from (select l.source_page_id, l.position, row_number() over (partition by l.source_page_id order by {_rank_sql("p.page_type", sitegraph.TYPES)} desc, l.position) as n
      from d_links l join d_pages p on l.target_page_id = p.page_id) where n <= 3"""
)
def page_link_cap(spark, sf_dir):
    links = view(spark, sf_dir, "d_links").join(view(spark, sf_dir, "d_pages").select(F.col("page_id").alias("target_page_id"), "page_type"), "target_page_id")
    return sitegraph.per_page(links, 3).select("source_page_id", "position")


_KNOWN = "(select * from d_pages where discovery_source <> 'internal_link')"


@query(
    f"""
    with p as (select host, count(*) as pending from {_KNOWN} where is_active and is_indexable and crawl_status in ('discovered', 'queued', 'failed', 'fetching') group by host),
         a as (select min(l.position) as position, d.host, d.is_indexable, d.discovery_source <> 'internal_link' as known from d_links l join d_pages d on l.target_page_id = d.page_id group by d.page_id, d.host, d.is_indexable, known),
         h as (select a.position, host, coalesce(pending, 0) as pending, row_number() over (partition by host order by a.position) as n from a left join p using (host) where not known and is_indexable)
    select position, host from a where known or not is_indexable
    union all select position, host from (select position, host from h where n <= 8 - pending order by position limit greatest(0, 500 - coalesce((select sum(pending) from p), 0)))"""
)
def frontier_caps(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages")
    known = pages.where("discovery_source <> 'internal_link'")
    targets = pages.select(F.col("page_id").alias("target"), "host", "is_indexable", (F.col("discovery_source") != "internal_link").alias("known"))
    arrivals = sitegraph.arrived(view(spark, sf_dir, "d_links").select(F.col("target_page_id").alias("target"), "position")).join(targets, "target")
    pending = crawling.waiting(known).groupBy("host").agg(F.count("*").alias("pending"))
    return sitegraph.frontier(arrivals, pending, 8, 500).select("position", "host")


TERMS = sitegraph.weighted_terms("the thing and of", ["reer thor", "The  thing and of"], ["tion", "文件"])


def _or(parts) -> str:
    return "(" + " or ".join(parts) + ")"


def _most(c: str) -> str:
    return "greatest(0.0, " + ", ".join(f"{sim(c, t)} * {w}::double" for t, w in TERMS) + ")"


def _like(c: str, least: float) -> str:
    return _or(f"{sim(c, t)} >= {max(least, 0.3)}" for t, _ in TERMS)


def _holds(c: str) -> str:
    return "coalesce(" + _or(f"{c} ilike '%{v}%'" for v in dict.fromkeys(v for t, _ in TERMS for v in (t, "-".join(t.split())))) + ", false)"


@query(
    f"""
    with a as (select target_page_id as page_id, max({_most("anchor_text")}) as anchor, bool_or({_like("anchor_text", 0.1)}) as anchored from d_links
               where {_like("anchor_text", 0.1)} or {_holds("anchor_text")} group by 1),
         r as (select p.*, coalesce(a.anchor, 0) as anchor, coalesce(a.anchored, false) as anchored, a.page_id is not null as linked
               from d_pages p left join a on p.page_id = a.page_id where is_active and is_indexable and crawl_status not in ('blocked', 'excluded')),
         r2 as (select * from r where regexp_matches(host, '(^|\\.)(example\\.net|example\\.com|example\\.org)$')),
         s as (select *, round(least(1.0, greatest({_most("title")}, {_most("path")}, anchor) * 0.65 + case when {_holds("title")} then 0.28 else 0 end + case when {_holds("path")} then 0.12 else 0 end
                        + case when anchored then 0.10 else 0 end + case when {_holds("unit")} then 0.12 else 0 end), 9) as lexical,
                    round(greatest(0.0, least(1.0, case when unit = 'src3' then 0.35::double else 0 end + case when host = 'tionsh.example.net' then 0.25 else 0 end + case when page_id = 7 then 0.25 else 0 end + case when page_type = 'official_document' then 0.34 else 0 end + least(crawl_priority, 100) / 1000.0::double
                        + case when last_success_s is not null then 0.05 else 0 end - least(failure_count, 5) * 0.04)), 9) as structural
               from r2 where {_like("title", 0.18)} or {_like("path", 0.22)} or {_holds("title")} or {_holds("path")} or anchored or linked and {_holds("unit")} or page_type in ('unit_homepage', 'announcement_listing'))
    select page_id, lexical, structural, round(lexical * 0.75 + structural * 0.25, 9) as final,
           row_number() over (order by round(lexical * 0.75 + structural * 0.25, 9) desc, lexical desc, structural desc, minimum_depth, failure_count, last_success_s desc nulls last, page_id) as rank
    from s qualify rank <= 20"""
)
def site_candidates(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages").withColumn("url", F.when(F.col("page_id") == 7, "https://home/").otherwise(F.col("url")))
    return sitegraph.candidates(pages, view(spark, sf_dir, "d_links"), TERMS, "src3", ("tionsh.example.net",), homepage="https://home/", allowed=["example.net", "example.com", "example.org"])


def _grams(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z㐀-鿿]+', '', 'g')"
    parts = " || ".join(f"list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, cast(i as integer), {n}))" for n in (2, 3, 4))
    return f"case when length({t}) = 1 then [{t}] else list_distinct({parts}) end"


def _jac(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0)"


ASKED = "the thing of reer"


@query(f"select page_id, round({_jac(_grams('title'), _grams(q(ASKED)))}, 9) as jaccard from d_pages")
def ngram_jaccard(spark, sf_dir):
    return view(spark, sf_dir, "d_pages").select("page_id", F.round(text.jaccard(text.char_ngrams(F.col("title")), text.char_ngrams(F.lit(ASKED))), 9).alias("jaccard"))


_PAGE_KEY = r"regexp_replace(lower(coalesce(title, '')), '\s+', '', 'g')"


@query(f"select page_id, round((cast(contains({_PAGE_KEY}, 'tion') as integer) + cast(contains({_PAGE_KEY}, 'reerthor') as integer)) / 2.0::double, 9) as coverage, contains({_PAGE_KEY}, 'thing') or contains('thing', {_PAGE_KEY}) as phrase from d_pages")
def concept_coverage(spark, sf_dir):
    return view(spark, sf_dir, "d_pages").select("page_id", F.round(text.coverage(F.coalesce("title", F.lit("")), ["tion", "reer thor"]), 9).alias("coverage"), text.contains_either(F.coalesce("title", F.lit("")), ["thing"]).alias("phrase"))


_COS = "list_inner_product(embedding::double[], v::double[]) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(v::double[], v::double[])))"
_ASKED = ["the thing of reer", "and of"]
_CONCEPTS = ["tion", "reer thor"]


def _letters(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z㐀-鿿]+', '', 'g')"


def _alike(x: str) -> str:
    return "greatest(" + ", ".join(_jac(_grams(x), _grams(q(a))) for a in _ASKED) + ")"


def _says(x: str) -> str:
    return "cast(" + " or ".join(f"contains({_letters(x)}, '{re.sub('[^0-9a-z]', '', a)}')" for a in _ASKED) + " as integer)"


def _has(x: str) -> str:
    return "(" + " + ".join(f"cast(contains({_letters(x)}, '{c.replace(' ', '')}') as integer)" for c in _CONCEPTS) + ") / 2.0::double"


def _both(x: str) -> str:
    return f"greatest({_alike(x)}, {_has(x)})"


# Case folding makes ss of ß, which lower case does not.
_FETCHED = """
    select page_id, url, path, title, concat_ws(' ', title, unit) as headings, substring(title || ' thing of ' || repeat(raw || ' ', 3), 1, 300) as body, case when page_id % 3 > 0 then unit || ' reer' end as anchor_text,
           page_id % 5 / 5.0::double as parent, page_id % 7 / 7.0::double as discovery, minimum_depth as depth
    from (select * replace (replace(title, 'ß', 'ss') as title, replace(url_decode(path), 'ß', 'ss') as path), path as raw from d_pages)"""


def _fetched(spark, sf_dir):
    p = view(spark, sf_dir, "d_pages")
    body = F.substring(F.concat(F.col("title"), F.lit(" thing of "), F.repeat(F.concat("path", F.lit(" ")), F.lit(3))), 1, 300)
    anchor = F.when(F.col("page_id") % 3 > 0, F.concat("unit", F.lit(" reer")))
    return p.select("page_id", "url", "title", F.array("title", "unit").alias("headings"), body.alias("body"), anchor.alias("anchor_text"), (F.col("page_id") % 5 / 5.0).alias("parent"), (F.col("page_id") % 7 / 7.0).alias("discovery"), F.col("minimum_depth").alias("depth"))


@query(
    f"""
    select page_id, round(greatest(0.0, least(1.0, (0.16 * {_says("coalesce(anchor_text, '') || ' ' || path")} + 0.10 * {_both("anchor_text")} + 0.05 * {_both("path")} + 0.10 * parent + 0.05 * discovery)::double / 0.46 - 0.03::double * depth)), 7) as score
    from ({_FETCHED})"""
)
def candidate_scores(spark, sf_dir):
    return sitegraph.candidate_scores(_fetched(spark, sf_dir), _ASKED, _CONCEPTS).select("page_id", F.round("score", 7).alias("score"))


@query(
    f"""
    select page_id, round(greatest(0.0, least(1.0, (0.16 * greatest({_says("title")}, {_says("headings")}, {_says("body")}) + 0.14 * {_both("title")} + 0.10 * {_both("headings")} + 0.10 * {_both("anchor_text")} + 0.05 * {_both("path")} + 0.08 * {_has("body")}
           + 0.13 * greatest({_alike("body")}, {_both("title")}, {_both("headings")}, {_both("anchor_text")}, {_both("path")}) + 0.16 * greatest(0.0, least(1.0, {_COS})) + 0.10 * parent + 0.05 * discovery)::double / 1.07 - 0.03::double * depth)), 7) as score
    from ({_FETCHED}) join embeddings on page_id = vec_id, (select embedding as v from embeddings order by vec_id limit 1)"""
)
def page_scores(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("asked"))  # one row
    rows = _fetched(spark, sf_dir).join(e, F.col("page_id") == F.col("vec_id")).join(F.broadcast(first)).withColumnRenamed("embedding", "vector")
    return sitegraph.page_scores(rows, _ASKED, _CONCEPTS, F.col("asked")).select("page_id", F.round("score", 7).alias("score"))


@query("select page_id, row_number() over (order by score desc, published_day is not null desc, published_day desc, page_id) as rank from (select page_id, page_id % 4 / 4.0::double as score, case when page_id % 3 > 0 then page_id % 50 end as published_day from pages) qualify rank <= 30")
def page_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = view(spark, sf_dir, "pages").selectExpr("page_id", "page_id % 4 / 4.0D as score", "case when page_id % 3 > 0 then page_id % 50 end as published_day")
    place = Window.orderBy(F.desc("score"), F.desc(F.col("published_day").isNotNull()), F.desc("published_day"), "page_id")
    return sitegraph.page_order(rows, 30).select("page_id", F.row_number().over(place).cast("long").alias("rank"))


@query("select page_id, round(greatest(0.2, 1 - (row_number() over (order by crawl_priority desc, page_id) - 1) / 50.0::double), 9) as decay from d_pages qualify row_number() over (order by crawl_priority desc, page_id) <= 40")
def rank_decay(spark, sf_dir):
    from pyspark.sql import Window

    top = view(spark, sf_dir, "d_pages").orderBy(F.desc("crawl_priority"), "page_id").limit(40)
    place = F.row_number().over(Window.orderBy(F.desc("crawl_priority"), "page_id")) - 1
    return top.select("page_id", F.round(F.greatest(F.lit(0.2), F.lit(1.0) - place / F.lit(50.0)), 9).alias("decay"))
