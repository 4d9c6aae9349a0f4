"""Retrieval, announcements, completeness, conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spindrift.catalog.registry import likeness, normal, q, query, sim, tri
from spindrift.functions import text, vectors
from spindrift.operators import announcements as ann
from spindrift.operators import completeness, conversation, postings, retrieval, similarity, vectorindex
from spindrift.plans.views import NOW, view
from spindrift.sources.sinks import shared

QUERIES = ["the and of that", "and reer thor edtionnt", "thing with the on"]
CONCEPTS = ["tion", "reer thor", "zzz"]
SCOPE = retrieval.Scope(homepage="https://src3.example.org/d/3", unit="src5", hosts=("src7.example.org",), general="src9")
HOST = "lower(regexp_extract(canonical_url, '^https?://([^/?#]+)', 1))"
BOOST = "case when canonical_url = 'https://src3.example.org/d/3' then 0.40 when unit = 'src5' then 0.24 when canonical_url in ('https://src7.example.org', 'https://src7.example.org/') or starts_with(canonical_url, 'https://src7.example.org/') then 0.18 else 0.0 end"


def keyword_sql(term: str, boost: str = "0.0") -> str:
    return f"""
        select *, row_number() over (order by round(score + {boost}, 12) desc, chunk_id) as rank
        from (select chunk_id, document_id, title, content, unit, canonical_url, greatest({sim("content", term)}, {sim("title", term)}) as score from d_chunks where is_current)
        where score >= 0.08 qualify rank <= 60"""


@query(f"select chunk_id, document_id, round(score, 9) as score, rank from ({keyword_sql(QUERIES[0])})")
def keyword_topk(spark, sf_dir):
    top = retrieval.keyword_lists(view(spark, sf_dir, "d_chunks"), QUERIES[:1])
    return top.select("chunk_id", "document_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"select chunk_id, round(score, 9) as score, rank from ({keyword_sql(QUERIES[0], BOOST)})")
def scope_boost_rank(spark, sf_dir):
    top = retrieval.keyword_lists(view(spark, sf_dir, "d_chunks"), QUERIES[:1], SCOPE)
    return top.select("chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


COSINE = "list_inner_product({a}::double[], {b}::double[]) / (sqrt(list_inner_product({a}::double[], {a}::double[])) * sqrt(list_inner_product({b}::double[], {b}::double[])))"


def embedded(spark, sf_dir, name="d_windows"):
    """Chunks without texts, each with the vector that its document's number falls on, and the first vector, which asks."""
    e = view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = e.orderBy("vec_id").first()
    chunks = view(spark, sf_dir, name).select("chunk_id", "document_id", "canonical_url", "unit", "is_current")
    return chunks.join(e, F.pmod("document_id", F.lit(max(1, e.count()))) == F.col("vec_id")), vectors.literal(list(first.embedding) if first else [])


def nearest_chunks(spark, sf_dir, asked: dict, scope=None):
    """`retrieval.vector_lists` over all chunks: those of a document share its vector, url and unit, so documents are ranked
    first, and only the chunks of those that can win are made."""
    e = view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = view(spark, sf_dir, "documents").selectExpr("doc_id * 1000000 as chunk_id", "doc_id as document_id", "concat('https://', source, '.example.org/d/', cast(doc_id as string)) as canonical_url", "source as unit", "doc_id % 7 <> 0 as is_current")
    own = docs.join(e, F.pmod("document_id", F.lit(max(1, e.count()))) == F.col("vec_id"))
    lists = retrieval.vector_lists(own, asked, scope)
    won = lists.select("document_id", "list", "score")
    texts = view(spark, sf_dir, "documents").join(F.broadcast(lists.select(F.col("document_id").alias("doc_id")).distinct()), "doc_id", "left_semi")  # at most LIST a list
    return retrieval.best_of(view(spark, sf_dir, "d_windows", documents=texts).join(F.broadcast(won), "document_id"), scope)


VECTOR_SQL = f"""
    select *, row_number() over (order by score desc, chunk_id) as rank
    from (select c.*, round({COSINE.format(a="e.embedding", b="(select embedding from embeddings order by vec_id limit 1)")}, 12) as score
          from d_chunks c join embeddings e on document_id % (select count(*) from embeddings) = vec_id where is_current)
    qualify rank <= 60"""


@query(f"select chunk_id, round(score, 9) as score, rank from ({VECTOR_SQL})")
def vector_topk(spark, sf_dir):
    first = view(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return nearest_chunks(spark, sf_dir, {0: vectors.literal(list(first.embedding) if first else [])}).select("chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""
    select v.vec_id as list, chunk_id, rank from (select vec_id, embedding as v from embeddings order by vec_id limit 3) v,
      lateral (select chunk_id, row_number() over (order by round({COSINE.format(a="e.embedding", b="v.v")}, 12) desc, chunk_id) as rank from d_chunks c join embeddings e on document_id % (select count(*) from embeddings) = e.vec_id where is_current) t
    where rank <= 60"""
)
def vector_queries(spark, sf_dir):
    chunks, _ = embedded(spark, sf_dir)
    asked = view(spark, sf_dir, "embeddings").orderBy("vec_id").limit(3).select(F.col("vec_id").alias("list"), F.col("embedding").alias("vector"))
    return retrieval.vector_table(chunks, asked).select("list", "chunk_id", F.col("rank").cast("long").alias("rank"))


def fused(spark, sf_dir, scope=None):
    first = view(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    asked = {len(QUERIES): vectors.literal(list(first.embedding) if first else [])}
    lists = retrieval.keyword_lists(view(spark, sf_dir, "d_chunks"), QUERIES, scope).unionByName(nearest_chunks(spark, sf_dir, asked, scope))
    lists = retrieval.held(lists, len(QUERIES) + 1)
    own = lists.select(F.col("document_id").alias("doc_id")).distinct()
    texts = view(spark, sf_dir, "documents").join(F.broadcast(own), "doc_id", "left_semi")
    return retrieval.fuse(lists, len(QUERIES) + 1, view(spark, sf_dir, "d_chunks", documents=texts), QUERIES, CONCEPTS, scope)


# The same lists from written indexes.

#: Files by gram and blocks of rows, for tables as small as these.
_BUCKETS, _BLOCKS = 16, 2


def _index_path(spark, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"select chunk_id, document_id, round(score, 9) as score, rank from ({keyword_sql(QUERIES[0])})")
def keyword_index(spark, sf_dir):
    """`keyword_topk` from an index of trigrams: only the files of the query's grams are read."""
    chunks = view(spark, sf_dir, "d_chunks").where("is_current")
    both = F.array(F.struct((F.col("chunk_id") * 2).alias("id"), F.col("content").alias("text")), F.struct((F.col("chunk_id") * 2 + 1).alias("id"), F.col("title").alias("text")))
    path = _index_path(spark, "grams")
    postings.build(chunks.select(F.inline(both)), path, _BUCKETS, _BLOCKS)
    index = postings.load(spark, path)
    least = postings.bound(index, QUERIES[0], 2 * retrieval.LIST, retrieval.LEAST_SIMILARITY, _BUCKETS)
    found = postings.matches(index, QUERIES[0], least, _BUCKETS).groupBy(F.shiftright("id", 1).alias("chunk_id")).agg(F.max("likeness").alias("score"))
    rows = found.select(F.lit(0).alias("list"), "score", "chunk_id", F.expr("chunk_id div 1000000").alias("document_id"))
    return retrieval.best_of(rows).select("chunk_id", "document_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""
    with e as (select vec_id, embedding from embeddings where len(embedding) = 64), a as (select vec_id as list, embedding as v from e where vec_id % 100 = 0)
    select list, vec_id, score, rank from (select list, vec_id, round({COSINE.format(a="e.embedding", b="a.v")}, 9) as score, row_number() over (partition by list order by round({COSINE.format(a="e.embedding", b="a.v")}, 12) desc, vec_id) as rank from a, e) where rank <= 10"""
)
def vector_index_exact(spark, sf_dir):
    """Every hundredth vector against all, from vectors by cell, all cells read."""
    return _neighbours(spark, sf_dir, True)


@query()
def vector_index(spark, sf_dir):
    """The same from the nearest cells only; tests measure the recall."""
    return _neighbours(spark, sf_dir, False)


def _neighbours(spark, sf_dir, every):
    rows = view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells, path = vectorindex.learned(rows, "vec_id"), _index_path(spark, "cells")
    vectorindex.build(rows, cells, path)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("vector"))
    found = vectorindex.search(spark, path, cells, asked, "vec_id", 10, every)
    return found.select("list", "vec_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


KEY = r"regexp_replace(lower({x}), '\s+', '', 'g')"
_COVER = " + ".join(f"cast(contains({KEY.format(x='title || chr(32) || content || chr(32) || unit')}, {q(''.join(c.lower().split()))}) as integer)" for c in CONCEPTS)
_TITLE = " or ".join(f"contains({KEY.format(x='title')}, {q(''.join(x.lower().split()))}) or contains({q(''.join(x.lower().split()))}, {KEY.format(x='title')})" for x in QUERIES)


def fused_sql(boost: str = "0.0") -> str:
    union = " union all ".join(f"select chunk_id, document_id, title, content, unit, canonical_url, score, rank from ({keyword_sql(x, boost)})" for x in QUERIES)
    vector = VECTOR_SQL.replace("order by score desc", f"order by round(score + {boost}, 12) desc")
    return f"""
        select chunk_id, document_id, title, content, unit, canonical_url,
               greatest(0.0, least(1.0, max(greatest(0.0, least(1.0, score))) * 0.72 + least(1.0, sum(1.0::double / (60 + rank)) * 61 / 4) * 0.20
                 + ({_COVER}) / {len(CONCEPTS)}::double * 0.06 + cast({_TITLE} as integer) * 0.02)) as score
        from ({union} union all select chunk_id, document_id, title, content, unit, canonical_url, score, rank from ({vector}))
        group by chunk_id, document_id, title, content, unit, canonical_url"""


@query(f"select chunk_id, round(score + 1e-9, 5) as score from ({fused_sql()})")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("chunk_id", F.round(F.col("score") + 1e-9, 5).alias("score"))


SCOPED_SQL = f"""
    select chunk_id, document_id, content, round(case when rtrim(canonical_url, '/') = 'https://src3.example.org/d/3' then greatest(score, 0.99) when unit = 'src5' then least(1.0, score + 0.18)
           when {HOST} = 'src7.example.org' then least(1.0, score + 0.14) when unit = 'src9' then score else score * 0.72 end + 1e-9, 7) as score
    from ({fused_sql(BOOST)})"""


@query(f"select document_id, chunk_id, score from (select *, row_number() over (partition by document_id order by score desc, chunk_id) as n from ({SCOPED_SQL})) where n = 1 order by score desc, chunk_id limit 20")
def best_chunk_per_doc(spark, sf_dir):
    scored = fused(spark, sf_dir, SCOPE).withColumn("score", F.round(F.col("score") + 1e-9, 7))
    return retrieval.best_per_document(scored, 20).select("document_id", "chunk_id", "score")


@query(f"select count(*) as reliable, count(*) >= 2 as stop from ({SCOPED_SQL}) where score >= 0.2 and length(trim(content)) >= 160")
def reliable_evidence(spark, sf_dir):
    return retrieval.enough(fused(spark, sf_dir, SCOPE).withColumn("score", F.round(F.col("score") + 1e-9, 7)), score=0.2)


@query(f"select case when score >= 0.75 then 'high' when score >= 0.55 then 'medium' else 'low' end as confidence, count(*) as n from ({SCOPED_SQL}) group by 1")
def confidence_buckets(spark, sf_dir):
    return fused(spark, sf_dir, SCOPE).withColumn("score", F.round(F.col("score") + 1e-9, 7)).groupBy(retrieval.confidence(F.col("score")).alias("confidence")).agg(F.count("*").alias("n"))


# Announcements


def _ann(order: str, where: str = "true", cols: str = "id, published_day") -> str:
    return f"select {cols}, row_number() over (order by {order}) as rank from d_announcements where source not ilike '%src1%' and {where} qualify rank <= 50"


def _listed(spark, sf_dir, sort, **kw):
    rows = ann.selected(view(spark, sf_dir, "d_announcements"), hidden="src1", **kw)
    return ann.ordered(rows, sort, 50).withColumn("rank", F.col("rank").cast("long"))


@query(_ann("published_day desc, last_crawled_s desc, id", "published_day between 30 and 300 and unit ilike '%src2%'"))
def ann_newest(spark, sf_dir):
    return _listed(spark, sf_dir, "newest", unit="src2", day_from=30, day_to=300).select("id", "published_day", "rank")


@query(_ann("published_day, last_crawled_s desc, id"))
def ann_oldest(spark, sf_dir):
    return _listed(spark, sf_dir, "oldest").select("id", "published_day", "rank")


_REL = f"round(greatest({sim('title', QUERIES[0])}, {sim('body', QUERIES[0])}), 9)"


@query(f"select id, relevance, row_number() over (order by relevance desc, published_day desc, last_crawled_s desc, id) as rank from (select *, {_REL} as relevance from d_announcements where source not ilike '%src1%') where relevance >= 0.1 qualify rank <= 50")
def ann_relevance(spark, sf_dir):
    return _listed(spark, sf_dir, "relevance", query=QUERIES[0]).select("id", "relevance", "rank")


@query("select id, row_number() over (order by published_day desc, id % 7 * 1000 + id, id) as rank from d_announcements where id % 5 = 0 qualify rank <= 50")
def ann_snapshot_order(spark, sf_dir):
    rows = view(spark, sf_dir, "d_announcements")
    snapshot = rows.where("id % 5 = 0").select("canonical_url", F.expr("id % 7 * 1000 + id").alias("position"))
    return ann.ordered(ann.selected(rows, snapshot=snapshot), "newest", 50, snapshot=True).select("id", F.col("rank").cast("long").alias("rank"))


@query("select id, published_day from d_announcements where (title ilike '%the%' or body ilike '%the%') and unit = 'unit src4' order by published_day desc, id desc limit 10 offset 10")
def ann_page(spark, sf_dir):
    return ann.page(ann.matching(view(spark, sf_dir, "d_announcements"), "the", "unit src4"), 2, 10).select("id", "published_day")


@query("select count(*) as total from d_announcements where (title ilike '%the%' or body ilike '%the%') and unit = 'unit src4'")
def ann_total(spark, sf_dir):
    return ann.matching(view(spark, sf_dir, "d_announcements"), "the", "unit src4").agg(F.count("*").alias("total"))


def _key(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '\s+', '', 'g'))"


@query(
    f"""
    with recursive f as (select id, rank, canonical_url as u, {_key("title")} || '|' || published_day || '|' || {_key("unit")} as t from ({_ann("published_day desc, last_crawled_s desc, id", cols="*")}) where rank <= 20),
         k as (select 0::bigint as rank, cast(null as bigint) as id, false as stays, []::varchar[] as us, []::varchar[] as ts
               union all select rank, id, ok, case when ok then list_append(us, u) else us end, case when ok then list_append(ts, t) else ts end
               from (select f.*, k.us, k.ts, not (list_contains(k.us, f.u) or list_contains(k.ts, f.t)) as ok from k join f on f.rank = k.rank + 1))
    select id, rank from k where stays order by rank limit 10"""
)
def ann_dedup(spark, sf_dir):
    return ann.without_repeats(_listed(spark, sf_dir, "newest"), 10).select("id", "rank")


_INC = """select canonical_url, case when id % 2 = 0 then title else concat(title, ' new') end as title, case when id % 10 = 3 then null else published_day + 1 end as published_day,
                 case when id % 4 = 0 then concat(body, ' more') when id % 4 = 1 then substring(body, 1, 20) else body end as body, case when id % 6 = 0 then 'short' end as warning,
                 case when id % 4 = 1 and id % 8 <> 1 then 20 end as completeness, last_crawled_s + 5 as last_crawled_s from {0} where id % 3 <> 1"""
_CUR = "select canonical_url, title, published_day, body, warning, last_crawled_s from {0} where id % 5 <> 0"


@query(
    f"""
    with inc as ({_INC.format("d_announcements")}), cur as ({_CUR.format("d_announcements")}),
         j as (select c.canonical_url as cu, i.canonical_url as iu, c.title as ct, i.title as it, c.published_day as cp, i.published_day as ip, c.body as cb, i.body as ib, c.warning as cw, i.warning as iw, c.last_crawled_s as cl, i.last_crawled_s as il,
                      nc, ni, coalesce(c.canonical_url is not null and i.completeness is not null and length(trim(c.body)) > i.completeness, false) or i.canonical_url is null as stays
               from (select *, {normal("title || chr(10) || body")} as nc from cur) c full join (select *, {normal("title || chr(10) || body")} as ni from inc) i on c.canonical_url = i.canonical_url)
    select coalesce(iu, cu) as canonical_url, case when stays then ct else it end as title, case when stays then cp else ip end as published_day, sha256(case when stays then cb else ib end) as body_hash,
           case when stays then cw else iw end as warning, greatest(il, coalesce(cl, il)) as crawled_s_in, case when iu is null then null when cu is null then 'created' when stays or ni = nc then 'unchanged' else 'updated' end as outcome
    from j""".replace("greatest(il, coalesce(cl, il)) as crawled_s_in", "coalesce(il, cl) as last_crawled_s")
)
def ann_merge(spark, sf_dir):
    rows = view(spark, sf_dir, "d_announcements")
    cur, inc = (spark.sql(sql.format("{rows}"), rows=rows) for sql in (_CUR, _INC))
    return ann.merged(cur, inc).select("canonical_url", "title", "published_day", F.sha2(F.col("body").cast("binary"), 256).alias("body_hash"), "warning", "last_crawled_s", "outcome")


@query(
    """
    with obs as (select source as name, canonical_url, id % 50 as position, 1700020000 + id % 3 * 1000 as crawled_s from d_announcements),
         newest as (select name, max(crawled_s) as crawled_s from obs group by name),
         u as (select name, crawled_s, canonical_url, min(position) as position from obs join newest using (name, crawled_s) group by all),
         l as (select name, crawled_s, string_agg(canonical_url, ',' order by position, canonical_url) as urls from u group by all)
    select s.name, greatest(s.last_success_s, l.crawled_s) as last_success_s, case when l.crawled_s >= s.last_success_s then md5(urls) end as urls_md5
    from d_sources s left join l using (name)"""
)
def source_snapshot(spark, sf_dir):
    obs = view(spark, sf_dir, "d_announcements").selectExpr("source as name", "canonical_url", "id % 50 as position", "1700020000 + id % 3 * 1000 as crawled_s")
    out = ann.snapshot_commit(view(spark, sf_dir, "d_sources"), obs)
    return out.select("name", "last_success_s", F.md5(F.array_join("urls", ",").cast("binary")).alias("urls_md5"))


@query(f"select name from d_sources where {NOW} - last_success_s >= interval_minutes * 60")
def due_sources(spark, sf_dir):
    return ann.due_sources(view(spark, sf_dir, "d_sources"), NOW).select("name")


# Completeness

_AGES = "count(*) filter (age <= {soft}) as fresh, count(*) filter (age > {soft} and age <= {hard}) as soft_stale, count(*) filter (age is null or age > {hard}) as hard_stale, count(*) filter (lease_expires_s > {now} or ingestion_lease_expires_s > {now}) as active_refresh"
_ASKING = "concat('src', cast(doc_id % 20 as {text}))"


def _asked_docs(spark, sf_dir):
    """Documents as evidence for a unit's question, some of several versions of a url."""
    return view(spark, sf_dir, "d_docs").where("unit is not null").selectExpr(f"{_ASKING.format(text='string')} as asking", "case when doc_id % 8 = 1 then replace(canonical_url, cast(doc_id as string), cast(doc_id - 1 as string)) else canonical_url end as canonical_url", "doc_id", "is_current", "unit", f"{_ASKING.format(text='string')} as scope_unit")


_DOC_FACTS = f"""
    select asking, count(*) filter (one) as documents, count(*) filter (not is_current) as superseded, count(page_type) filter (one) as with_page, count(*) filter (one and unit = asking) as exact_scope,
           case when count(*) filter (one) = count(*) filter (one and page_type = 'unit_homepage') then count(*) filter (one) else 0 end as homepage_only, case when count(*) filter (one) = count(*) filter (one and page_type = 'announcement_listing') then count(*) filter (one) else 0 end as listing_only,
           {_AGES.format(soft=21600, hard=86400, now=NOW).replace("filter (", "filter (one and (").replace(") as", ")) as")},
           count(*) filter (one and content_hash = ingestion_content_hash) as in_sync, count(*) filter (one and ingestion_status = 'pending') as pending, count(*) filter (one and ingestion_status in ('failed', 'partial')) as failed, count(*) filter (one and announcement_ingestion_status = 'incomplete') as incomplete
    from (select d.*, p.* exclude (canonical_url), {NOW} - p.last_success_s as age, is_current and row_number() over (partition by asking, canonical_url, is_current order by doc_id) = 1 as one
          from (select {_ASKING.format(text="varchar")} as asking, case when doc_id % 8 = 1 then replace(canonical_url, cast(doc_id as varchar), cast(doc_id - 1 as varchar)) else canonical_url end as canonical_url, doc_id, is_current, unit from d_docs where unit is not null) d left join d_known_pages p using (canonical_url))
    group by asking"""


@query(_DOC_FACTS)
def doc_facts(spark, sf_dir):
    return completeness.document_facts(_asked_docs(spark, sf_dir), view(spark, sf_dir, "d_known_pages"), NOW, "asking")


_ANN_FACTS = f"""
    with r as (select concat('src', cast(a.id % 20 as varchar)) as asking, a.canonical_url, a.source, a.warning, a.last_crawled_s + 60000 as crawled_s, s.unit as s_unit, list_contains(s.canonical_urls, a.canonical_url) as listed, p.* exclude (canonical_url), p.canonical_url is not null as paged, {NOW} - (a.last_crawled_s + 40000 - a.id * 90) as age
               from d_announcements a join d_snapshots s on s.name = a.source left join d_known_pages p using (canonical_url)),
         n as (select asking, count(*) as documents, count(*) filter (s_unit = 'unit ' || asking) as exact_scope, {_AGES.format(soft=5400, hard=21600, now=NOW)},
                      count(*) filter (coalesce(ingestion_status = 'pending', false) or coalesce(announcement_ingestion_status = 'pending', false)) as pending,
                      count(*) filter (not (coalesce(ingestion_status = 'pending', false) or coalesce(announcement_ingestion_status = 'pending', false)) and (warning is not null or coalesce(ingestion_status in ('failed', 'partial'), false) or coalesce(announcement_ingestion_status in ('failed', 'partial'), false))) as failed,
                      count(*) filter (announcement_ingestion_status = 'incomplete') as incomplete from r where listed group by asking),
         a as (select asking, count(*) filter (paged and content_hash = ingestion_content_hash and ingestion_status in ('success', 'partial') and announcement_ingestion_status in ('success', 'incomplete', 'not_applicable')) as in_sync from r group by asking),
         c as (select asking, count(*) as sources, count(*) filter ({NOW} - last_success_s <= 5400) as fresh_sources from (select unnest([name, 'src' || (cast(substr(name, 4) as integer) + 1) % 20]) as asking, last_success_s from d_snapshots) group by asking)
    select a.asking, coalesce(n.documents, 0) as documents, coalesce(exact_scope, 0) as exact_scope, coalesce(fresh, 0) as fresh, coalesce(soft_stale, 0) as soft_stale, coalesce(hard_stale, 0) as hard_stale, coalesce(active_refresh, 0) as active_refresh, in_sync, coalesce(pending, 0) as pending, coalesce(failed, 0) as failed,
           coalesce(incomplete, 0) as incomplete, coalesce(sources, 0) as sources, coalesce(fresh_sources, 0) as fresh_sources, round(coalesce(fresh_sources::double / nullif(sources, 0), 0), 9) as coverage
    from a left join n using (asking) left join c using (asking)"""


@query(_ANN_FACTS)
def ann_facts(spark, sf_dir):
    rows = view(spark, sf_dir, "d_announcements").selectExpr("concat('src', cast(id % 20 as string)) as asking", "canonical_url", "source", "concat('unit src', cast(id % 20 as string)) as scope_unit", "last_crawled_s + 40000 - id * 90 as last_crawled_s", "warning")
    sources = view(spark, sf_dir, "d_snapshots").withColumn("keys", F.expr("array(name, concat('src', cast((cast(substring(name, 4) as int) + 1) % 20 as string)))"))
    return completeness.announcement_facts(rows, sources, view(spark, sf_dir, "d_known_pages"), NOW, "asking")


_EVIDENCE = "(select unit, doc_id * 37 % 101 / 50.0::double - 1 as score, text as content from d_docs)"


@query(
    f"""
    select unit, count(*) filter (score >= 0.58 and length(trim(content)) >= 160) as strong, greatest(0, max(score)) as top_score,
           round(greatest(0, max(score)) - coalesce(greatest(0, max(score) filter (n = 2)), 0), 9) as margin
    from (select *, row_number() over (partition by unit order by score desc) as n from {_EVIDENCE}) group by unit"""
)
def evidence_quality(spark, sf_dir):
    rows = view(spark, sf_dir, "d_docs").select("unit", (F.col("doc_id") * 37 % 101 / F.lit(50.0) - 1).alias("score"), F.col("text").alias("content"))
    return completeness.evidence_quality(rows, "unit")


_CASES = """
    select doc_id, case doc_id % 5 when 0 then 'topic' when 1 then 'scoped_topic' when 2 then 'announcement' when 3 then 'keyword_announcement' else 'latest' end as intent,
           doc_id % 31 <> 0 as ok, case when doc_id % 29 = 0 then 1 else 0 end as active_refresh, case when doc_id % 23 = 0 then 1 else 0 end as homepage_only,
           case when doc_id % 19 = 0 then 1 else 0 end as listing_only, doc_id % 4 as documents, case when doc_id % 17 = 0 then 1 else 0 end as incomplete,
           doc_id % 3 as exact_scope, case when doc_id % 13 = 0 then 1 else 0 end as hard_stale, case when doc_id % 11 = 0 then 1 else 0 end as pending,
           case when doc_id % 37 = 0 then 1 else 0 end as failed, doc_id % 6 as in_sync, case when doc_id % 14 = 0 then 1 else 0 end as soft_stale, doc_id % 3 as sources,
           doc_id % 10 / {ten} as coverage, doc_id % 5 as fresh, doc_id % 7 as evidence, doc_id % 4 as strong, doc_id % 21 / {twenty} as top_score, doc_id % 9 / {hundred} as margin,
           doc_id % 5 / {two} as seconds_left
    from {docs}"""


def _cases(ten: str, docs: str) -> str:
    return _CASES.format(docs=docs, **{k: ten.format(v) for k, v in (("ten", 10), ("twenty", 20), ("hundred", 100), ("two", 2))})


def _decided(facts: str, key: str) -> str:
    """DuckDB SQL of the decision over facts."""
    return f"""
    with f as ({facts}), t as (
      select *, intent in ('topic', 'scoped_topic') as topic, intent not in ('topic', 'scoped_topic') as lst, intent = 'keyword_announcement' as kw,
             intent not in ('topic', 'scoped_topic') and evidence > 0 and documents > 0 as usable, coverage < 0.60 as low, margin >= 0.04 as lead from f
    ), r as (
      select *, case when not ok then 'L facts_query_failed' when active_refresh > 0 then 'W active_refresh_in_progress' when homepage_only > 0 and topic then 'L homepage_only_for_topic_query'
        when listing_only > 0 and topic then 'L missing_listing_coverage' when documents = 0 and topic then 'L site_map_only_without_document'
        when incomplete > 0 and intent in ('announcement', 'keyword_announcement') then 'W terminal_incomplete' when documents = 0 then 'L missing_listing_coverage'
        when intent = 'scoped_topic' and exact_scope = 0 then 'L missing_unit_coverage' when hard_stale > 0 and intent = 'latest' then 'L recent_query_requires_freshness'
        when hard_stale > 0 then 'R hard_stale' when pending > 0 or topic and in_sync < 1 then 'R relevant_ingestion_pending' when failed > 0 then 'R relevant_ingestion_failed'
        when soft_stale > 0 then 'R stale_but_usable' when lst and sources > 1 and low then 'R insufficient_source_coverage'
        when intent in ('latest', 'announcement') and usable and fresh > 0 then 'U fresh_announcement_snapshot' when lst and low then 'R insufficient_source_coverage'
        when strong = 0 and kw and usable and fresh > 0 then 'R weak_but_usable_announcement_evidence' when strong = 0 then 'L weak_retrieval_score'
        when intent in ('scoped_topic', 'announcement') and exact_scope > 0 and top_score >= 0.82 and fresh > 0 and (in_sync > 0 or intent = 'announcement' and documents > 0) then 'U exact_scoped_match'
        when strong >= 2 and fresh > 0 and (lead or strong > 1) then 'U fresh_strong_evidence' when not lead and kw and usable and fresh > 0 then 'R ambiguous_but_usable_announcement_evidence'
        when not lead then 'L insufficient_score_margin' when kw and usable and fresh > 0 then 'R sparse_but_usable_announcement_evidence' else 'L insufficient_result_count' end as d from t
    )
    select {key}, substr(d, 3) as reason, case when d[1] = 'L' and seconds_left < 2 then 'deadline_insufficient' end as "limit", greatest(0.0, least(1.0, top_score)) as confidence,
           case substr(d, 1, 1) when 'U' then 'use_db' when 'R' then 'use_db_and_schedule_refresh' when 'W' then 'use_db_with_incomplete_warning'
             else case when seconds_left < 2 then 'use_db_with_incomplete_warning' else 'use_bounded_live_fallback' end end as action
    from r"""


@query(_decided(_cases("{}.0::double", "documents"), "doc_id"))
def completeness_decision(spark, sf_dir):
    facts = spark.sql(_cases("{}D", "{documents}"), documents=view(spark, sf_dir, "documents"))
    return completeness.decision(facts).select("doc_id", "action", "reason", "limit", "confidence")


_QUALITY = """(select asking, count(*) filter (score >= 0.58 and length(trim(content)) >= 160) as strong, greatest(0, max(score)) as top_score, round(greatest(0, max(score)) - coalesce(greatest(0, max(score) filter (n = 2)), 0), 9) as margin, count(*) as evidence
    from (select *, row_number() over (partition by asking order by score desc) as n from (select concat('src', cast(doc_id % 20 as varchar)) as asking, doc_id * 37 % 101 / 50.0::double - 1 as score, text as content from d_docs)) group by asking)"""
_SHARED = "documents, exact_scope, fresh, soft_stale, hard_stale, active_refresh, in_sync, pending, failed, incomplete"


@query(
    _decided(
        f"""select a.*, q.* exclude (asking), true as ok, 10.0::double as seconds_left from (
              select asking, unnest(['topic', 'scoped_topic']) as intent, {_SHARED}, homepage_only, listing_only, 0 as sources, case when documents > 0 then 1.0::double else 0.0::double end as coverage from ({_DOC_FACTS})
              union all select asking, unnest(['announcement', 'keyword_announcement', 'latest']), {_SHARED}, 0, 0, sources, coverage from ({_ANN_FACTS})) a join {_QUALITY} q using (asking)""",
        "asking, intent",
    )
)
def answer_decisions(spark, sf_dir):
    """What to do about a question of each kind to each unit, from facts over the stored rows."""
    shared_cols = _SHARED.split(", ")
    of = lambda kinds: F.explode(F.array(*map(F.lit, kinds))).alias("intent")
    docs = doc_facts(spark, sf_dir)
    a = docs.select("asking", of(completeness.TOPICS), *shared_cols, "homepage_only", "listing_only", F.lit(0).cast("long").alias("sources"), F.when(F.col("documents") > 0, 1.0).otherwise(0.0).alias("coverage"))
    none = F.lit(0).cast("long")
    b = ann_facts(spark, sf_dir).select("asking", of(completeness.LISTS), *shared_cols, none.alias("homepage_only"), none.alias("listing_only"), "sources", "coverage")
    told = view(spark, sf_dir, "d_docs").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("asking"), (F.col("doc_id") * 37 % 101 / F.lit(50.0) - 1).alias("score"), F.col("text").alias("content"))
    quality = completeness.evidence_quality(told, "asking").join(told.groupBy("asking").agg(F.count("*").alias("evidence")), "asking")
    facts = a.unionByName(b).join(quality, "asking").withColumn("ok", F.lit(True)).withColumn("seconds_left", F.lit(10.0))
    return completeness.decision(facts).select("asking", "intent", "action", "reason", "limit", "confidence")


# Conversations

_PERSONAL = r"(?i)(?:密碼|password|cookie|學號|成績|身分證|session\s*[:=]|token\s*[:=])|(?:^|[^\p{L}\p{N}_])[A-Z][12]\d{8}(?:$|[^\p{L}\p{N}_])|(?:^|[^\p{L}\p{N}_])\d{8,10}(?:$|[^\p{L}\p{N}_])"


_EVENTS = """select conv_id, turn, case when turn % 4 = 2 then 'tool' else role end as role, case when turn % 4 = 2 then concat('["', cast(turn as {0}), '", "', coalesce(text, ''), '"]') when (conv_id + turn) % 6 = 0 then '' else text end as text from """


@query(
    f"""
    with e as ({_EVENTS.replace("{0}", "varchar")} conversations),
         r as (select conv_id, turn, role, case when regexp_matches(coalesce(text, ''), {q(_PERSONAL)}) then '[已隱去可能的個人或敏感資料]' else coalesce(text, '') end as content from e where role in ('user', 'assistant')),
         s as (select conv_id, substr('最近工具結果摘要：[' || string_agg(text, ', ' order by turn) || ']', 1, 500) as content from (select *, row_number() over (partition by conv_id order by turn desc, role) as n from e where role = 'tool') where n <= 2 group by conv_id),
         n as (select *, row_number() over w as n, coalesce(sum(length(content)) over (partition by conv_id order by turn desc, role rows between unbounded preceding and 1 preceding), 0) as before from r where content <> '' window w as (partition by conv_id order by turn desc, role)),
         l as (select n.*, 3000 - coalesce(length(s.content), 0) - before as room from n left join s using (conv_id) where n <= 12)
    select conv_id, turn, role, substr(content, 1, cast(room as bigint)) as content from l where room > 0 union all select conv_id, null, 'developer', content from s"""
)
def context_window(spark, sf_dir):
    events = spark.sql(_EVENTS.replace("{0}", "string") + "{rows}", rows=view(spark, sf_dir, "conversations"))
    return conversation.context(events, chars=3000, tool_chars=500)


@query("select conv_id, max(turn) + 1 as next_turn from conversations group by conv_id")
def next_sequence(spark, sf_dir):
    return conversation.next_sequence(view(spark, sf_dir, "conversations"))


@query(
    """
    select conv_id, turn, role from conversations
    union all
    select c.conv_id, t.top + row_number() over (partition by c.conv_id order by c.turn), c.role
    from conversations c join (select conv_id, max(turn) as top from conversations group by conv_id) t using (conv_id) where c.turn < 2"""
)
def turns_appended(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations")
    new = rows.where("turn < 2").select("conv_id", F.col("turn").alias("position"), "role", "text")
    return conversation.appended(rows, new).select("conv_id", "turn", "role")


@query(
    """
    with s as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) >= 86400000000, true) as new from events),
         n as (select *, sum(new::integer) over (partition by user_id order by ts range unbounded preceding) as session from s)
    select user_id, cast(session as bigint) as session, min(ts) as begins, max(ts) as ends, count(*) as events from n group by user_id, session"""
)
def session_ttl(spark, sf_dir):
    return conversation.sessions(view(spark, sf_dir, "events"))


@query(
    """
    with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
         r as (select distinct user_id, 0::bigint as n, cast(null as bigint) as event_id, false as allowed, []::bigint[] as kept from e
               union all select user_id, n, event_id, len(k) < 3, case when len(k) < 3 then list_append(k, us) else k end
               from (select e.*, list_filter(r.kept, lambda x: x > e.us - 21600000000) as k from r join e on e.user_id = r.user_id and e.n = r.n + 1))
    select user_id, event_id, allowed from r where n > 0"""
)
def rate_limit(spark, sf_dir):
    return conversation.rate_limited(view(spark, sf_dir, "events"), 3, 6 * 3600)


@query(f"select event_type, count(*) as n from events where not exists (select 1 from d_pages where page_id = user_id and lease_expires_s > {NOW}) group by event_type")
def without_live_lease(spark, sf_dir):
    leased = view(spark, sf_dir, "d_pages").where(F.col("lease_expires_s") > NOW).select(F.col("page_id").alias("user_id"))
    return conversation.without(view(spark, sf_dir, "events"), leased, "user_id").groupBy("event_type").agg(F.count("*").alias("n"))


_T = likeness("a.g", "b.g")


@query(
    f"""
    with a as (select item_id, {tri("substring(text, 1, 60)")} as g from benchmark), b as (select chunk_id, {tri("title")} as g from d_chunks)
    select item_id, chunk_id, round({_T}, 9) as likeness from a, b where {_T} >= 0.3"""
)
def similar_titles(spark, sf_dir):
    chunks = view(spark, sf_dir, "d_chunks").select("chunk_id", "title")
    items = view(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 60).alias("asked"))
    pairs = similarity.similar_texts(items.select("asked"), chunks.select("title"), 0.3)
    return items.join(pairs, items.asked == pairs.left).join(chunks, F.col("right") == chunks.title).select("item_id", "chunk_id", F.round("likeness", 9).alias("likeness"))
