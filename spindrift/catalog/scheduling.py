"""Due pages, leases, status, streaks, delays."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from spindrift.catalog.registry import query
from spindrift.functions import schedule
from spindrift.operators import attempts, crawling
from spindrift.plans.views import NOW, view

LIVE = f"coalesce(lease_expires_s > {NOW}, false)"
_BUSY = f"(select count(*) from d_pages b where b.host = d_pages.host and coalesce(b.lease_expires_s > {NOW}, false) and b.is_active)"
_DUE = f"""
    select page_id, host, row_number() over (partition by host order by crawl_priority desc, next_crawl_s nulls first, minimum_depth, failure_count, page_id) as host_rank,
           crawl_priority, next_crawl_s, minimum_depth, failure_count, busy
    from (select *, {_BUSY} as busy from d_pages) where is_active and is_indexable and crawl_status not in ('blocked', 'excluded') and next_crawl_s <= {NOW} and not {LIVE} and minimum_depth <= 3
      and not regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '(?i)\\.(7z|avi|css|csv|docx?|gif|gz|ico|jpe?g|js|mov|mp3|mp4|odt|pdf|png|pptx?|rar|svg|tar|tiff?|txt|webp|xlsx?|xml|zip)$')
      and busy < {{active}}"""


@query(f"select page_id, host, host_rank from ({_DUE.format(active=2)}) where host_rank <= least(2, 2 - busy) order by host_rank, crawl_priority desc, next_crawl_s, minimum_depth, failure_count, page_id limit 60")
def due_claims(spark, sf_dir):
    return crawling.due(view(spark, sf_dir, "d_pages"), NOW, 60, per_host=2, active=2).select("page_id", "host", F.col("host_rank").cast("long").alias("host_rank"))


@query(
    f"""
    with c as (select page_id from ({_DUE.format(active=1)}) where host_rank <= 1 order by host_rank, crawl_priority desc, next_crawl_s, minimum_depth, failure_count, page_id limit 20)
    select page_id, case when page_id in (select page_id from c) then 'me' else lease_owner end as lease_owner, case when page_id in (select page_id from c) then {NOW + 300} else lease_expires_s end as lease_expires_s,
           case when page_id in (select page_id from c) then sha256(page_id || '|me|{NOW}') end as lease_token
    from d_pages"""
)
def lease_claim(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages")
    return crawling.claimed(pages, crawling.due(pages, NOW, 20), "me", NOW, 300).select("page_id", "lease_owner", "lease_expires_s", "lease_token")


@query(f"select page_id, case when lease_owner = 'worker' || page_id % 2 and {LIVE} and (page_id // 10) % 3 <> 1 then 'success' else 'lease_lost' end as outcome from d_pages")
def lease_finish(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages").withColumn("lease_token", F.expr("concat('t', page_id div 10 % 3)"))
    told = F.expr("case when page_id div 10 % 3 = 1 then 'stale' else concat('t', page_id div 10 % 3) end")
    reports = pages.select("page_id", F.concat(F.lit("worker"), (F.col("page_id") % 2).cast("string")).alias("lease_owner"), told.alias("lease_token"), F.lit("success").alias("outcome"))
    return crawling.finished(pages, reports, NOW)


@query(f"select page_id, case when page_id % 2 = 0 and not {LIVE} and crawl_status not in ('blocked', 'excluded') then least({NOW} + page_id, coalesce(next_crawl_s, {NOW} + page_id)) else next_crawl_s end as next_crawl_s from d_pages")
def schedule_pages(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages")
    wanted = pages.where("page_id % 2 = 0").select("page_id", (F.col("page_id") + NOW).alias("run_at_s"))
    return crawling.scheduled(pages, wanted, NOW).select("page_id", "next_crawl_s")


_OPEN = f"is_active and is_indexable and crawl_status not in ('blocked', 'excluded') and not {LIVE}"


@query(
    f"""
    select count(*) filter ({_OPEN} and next_crawl_s <= {NOW}) as due, count(*) filter ({_OPEN}) as pending, count(*) filter ({LIVE}) as leased, count(*) filter (crawl_status = 'failed') as failed, count(*) filter (crawl_status = 'blocked') as blocked,
           count(*) filter (page_hash is not null and (ingestion_status in ('pending', 'failed') or announcement_ingestion_status in ('pending', 'failed'))) as ingestion_pending,
           count(*) filter (page_hash is not null and announcement_ingestion_status = 'incomplete') as ingestion_incomplete, count(distinct lease_owner) filter ({LIVE}) as workers, min(next_crawl_s) filter ({_OPEN}) as next_due_s
    from d_pages"""
)
def crawl_status(spark, sf_dir):
    return crawling.status(view(spark, sf_dir, "d_pages").withColumnRenamed("page_hash", "content_hash"), NOW)


# A log of attempts: events of one user are rows about one page. Rows that are no claim speak with the token of the claim
# before them, or of the one before that.
_LOG = """
    select user_id as page_id, epoch_s as at_s, event_id as seq, event, case when event = 'claim' then mine else coalesce(case when event_id % 7 = 0 then older else newer end, 'none') end as token, 3600 * (1 + event_id % 9) as seconds,
           case when event = 'complete' then case when event_id % 2 = 0 then 'success' else 'unchanged' end else case event_id % 3 when 0 then 'failed' when 1 then 'blocked' else 'excluded' end end as status, epoch_s + 86400 as next_s,
           case event_id % 4 when 0 then true when 1 then false when 2 then event_id % 8 = 2 end as changed, cast(case when event_id % 4 = 1 then 304 else 200 end as int) as http_status, event_id % 3 = 2 as deactivate
    from (select *, lag(mine, 1) {ignore} over (partition by user_id order by ts, event_id) as newer, lag(mine, 2) {ignore} over (partition by user_id order by ts, event_id) as older
          from (select *, case when event = 'claim' then concat('t', cast(event_id as {text})) end as mine
                from (select *, case when event_id % 5 < 2 then 'claim' when event_id % 5 = 2 then 'renew' when event_id % 5 = 3 then 'complete' else 'fail' end as event, cast({epoch} as bigint) as epoch_s from {events}) e) e) e"""
_OWNED = "*, case when token = 'none' then 'nobody' else concat('w', cast(cast(substr(token, 2) as bigint) % 3 as {text})) end as owner"


def _spelled(sql: str, dialect: str, events: str) -> str:
    own = {"spark": {"ignore": "ignore nulls", "text": "string", "epoch": "unix_seconds(cast(ts as timestamp))"}, "duck": {"ignore": "", "text": "varchar", "epoch": "floor(epoch(ts))"}}[dialect]
    if dialect == "duck":
        sql = sql.replace("lag(mine, 1) {ignore}", "lag(mine, 1 ignore nulls)").replace("lag(mine, 2) {ignore}", "lag(mine, 2 ignore nulls)")
    return sql.format(events=events, **own)


def attempt_log(spark, sf_dir):
    rows = spark.sql(_spelled(_LOG, "spark", "{events}"), events=view(spark, sf_dir, "events"))
    return rows.selectExpr(*_spelled(_OWNED.replace("*, ", ""), "spark", "").split("|"), *rows.columns)


_FOLD = f"""
    log as (select *, row_number() over (partition by page_id order by at_s, seq) as n from (select {_spelled(_OWNED, "duck", "")} from ({_spelled(_LOG, "duck", "events")}))),
    fold as (
      select distinct page_id, 0::bigint as n, false as accepted, cast(null as varchar) as lo, cast(null as varchar) as lt, cast(null as bigint) as le, 'discovered' as crawl_status, 0 as failure_count, 0 as changed_streak, 0 as unchanged_streak, cast(null as bigint) as next_crawl_s, cast(null as bigint) as last_success_s, true as is_active from log
      union all
      select page_id, n, ok, case when not ok then lo when event = 'claim' then owner when event = 'renew' then lo end, case when not ok then lt when event = 'claim' then token when event = 'renew' then lt end,
             case when not ok then le when event in ('claim', 'renew') then at_s + seconds end, case when not ok or event = 'renew' then crawl_status when event = 'claim' then 'fetching' else status end,
             case when ok and event = 'complete' then 0 when ok and event = 'fail' then failure_count + 1 else failure_count end, case when ok and event = 'complete' and changed is not null then case when changed then changed_streak + 1 else 0 end else changed_streak end,
             case when ok and event = 'complete' and changed is not null then case when changed then 0 else unchanged_streak + 1 end else unchanged_streak end, case when ok and event in ('complete', 'fail') then next_s else next_crawl_s end,
             case when ok and event = 'complete' then at_s else last_success_s end, is_active and not (ok and event = 'fail' and deactivate)
      from (select l.*, f.lo, f.lt, f.le, f.crawl_status, f.failure_count, f.changed_streak, f.unchanged_streak, f.next_crawl_s, f.last_success_s, f.is_active,
                   case when l.event = 'claim' then not coalesce(f.le > l.at_s, false) else coalesce(f.le > l.at_s and f.lo = l.owner and f.lt = l.token, false) end as ok
            from fold f join log l on l.page_id = f.page_id and l.n = f.n + 1))"""


@query(f"with recursive {_FOLD} select page_id, lo as lease_owner, lt as lease_token, le as lease_expires_s, crawl_status, failure_count, changed_streak, unchanged_streak, next_crawl_s, last_success_s, is_active from fold qualify row_number() over (partition by page_id order by n desc) = 1")
def attempt_states(spark, sf_dir):
    """The states of pages after a log of claims, renewals, ends and failures."""
    return attempts.states(attempts.replayed(attempt_log(spark, sf_dir)))


@query(
    f"""
    with recursive {_FOLD},
         r as (select l.*, f.accepted from log l join fold f using (page_id, n)),
         c as (select page_id, token, owner, n, at_s from r where event = 'claim' and accepted),
         e as (select c.page_id, c.token, arg_min(r.at_s, r.n) as finished_s,
                      arg_min(case when not r.accepted then 'lease_lost' when r.event = 'complete' then case when r.changed then 'success_changed' when r.http_status = 304 then 'not_modified' else 'success_unchanged' end
                                   when r.status = 'blocked' then 'blocked' when r.deactivate then 'excluded' else 'failed_transient' end, r.n) as outcome
               from c join r on r.page_id = c.page_id and r.token = c.token and r.owner = c.owner and r.n > c.n and r.event <> 'claim' and not (r.event = 'renew' and r.accepted) group by all)
    select c.page_id, c.token, c.owner, c.at_s as started_s, e.finished_s, coalesce(e.outcome, 'running') as outcome, e.finished_s - c.at_s as seconds from c left join e on e.page_id = c.page_id and e.token = c.token"""
)
def attempt_replay(spark, sf_dir):
    """What came of every attempt of the log."""
    return attempts.attempts(attempts.replayed(attempt_log(spark, sf_dir)))


OUTCOMES = ["success_changed", "success_unchanged", "not_modified", "failed_transient", "failed_permanent", "lease_lost"]


@query(
    f"""
    select o as outcome, count(attempt_id) as attempts from (select unnest({OUTCOMES}) as o) left join d_attempts on o = outcome and started_at >= (select max(ts) - interval 10 day from events) group by o"""
)
def attempt_histogram(spark, sf_dir):
    attempts = view(spark, sf_dir, "d_attempts")
    latest = attempts.agg(F.max("started_at")).first()[0]
    since = F.lit((latest or datetime.datetime(2024, 1, 1)) - datetime.timedelta(days=10)).cast("timestamp_ntz")
    return crawling.histogram(attempts, since, OUTCOMES)


@query(
    """
    with r as (select *, first(content_changed) over w as now, row_number() over w as n from d_attempts window w as (partition by page_id order by started_at desc, attempt_id desc)),
         b as (select page_id, min(n) as n from r where content_changed <> now group by page_id)
    select r.page_id, any_value(now) as changed, count(*) as streak from r left join b using (page_id) where r.n < coalesce(b.n, 1000000000) group by r.page_id"""
)
def streaks(spark, sf_dir):
    return crawling.streaks(view(spark, sf_dir, "d_attempts"))


@query("select host, count(*) as pending from d_pages where is_active and is_indexable and crawl_status in ('discovered', 'queued', 'failed', 'fetching') group by rollup (host)")
def host_pending(spark, sf_dir):
    return crawling.host_pending(view(spark, sf_dir, "d_pages"))


@query("select page_id, max(started_at) as watermark, arg_max(outcome, (started_at, attempt_id)) as outcome from d_attempts group by page_id")
def monotone_watermark(spark, sf_dir):
    return crawling.monotone_watermark(view(spark, sf_dir, "d_attempts"))


_TYPE = "case page_type when 'unit_homepage' then 0.75 when 'announcement_listing' then 0.75 when 'announcement_detail' then 0.85 when 'search_result' then 1.25 else 1.0 end::double"
_PRIO = "greatest(0.25, 1 - greatest(crawl_priority, 0) / 200.0::double)"
_OFTEN, _SELDOM = "1 / (1 + 0.10::double * least(changed_streak, 10))", "(1 + 0.25::double * least(unchanged_streak, 10))"


_STATE = "url || '|page_type=' || page_type || '|changed=' || {0} || '|changed_streak=' || changed_streak || '|unchanged_streak=' || unchanged_streak || '|failure_count=' || failure_count || '|priority=' || crawl_priority || '|outcome=' || {1}"


def _jitter(identity: str, delay: str, most: str) -> str:
    unit = f"(cast('0x' || substr(sha256({identity}), 1, 16) as ubigint)::double / 18446744073709551616::double)"
    return f"least({most}, greatest(60.0, {delay} * (1 + ({unit} * 2 - 1) * 0.10::double)))"


@query(
    f"""
    select page_id, round({_jitter(_STATE.format("case when page_id % 2 = 0 then 'True' else 'False' end", "'success'"), "d", "604800.0")}, 6) as delay_s
    from (select *, least(604800.0, greatest(60.0, case when page_id % 2 = 0 then 3600 * {_TYPE} * {_PRIO} * {_OFTEN} else 7200 * {_TYPE} * {_PRIO} * {_SELDOM} end)) as d from d_pages)"""
)
def next_due_success(spark, sf_dir):
    return crawling.after_success(view(spark, sf_dir, "d_pages"))


@query(
    f"""
    with p as (select *, case when http_status in (404, 410) and failure_count >= 3 then 'excluded' when http_status in (401, 403) then 'blocked'
                             when http_status between 400 and 499 and http_status not in (404, 410, 429) then 'excluded' else 'failed' end as action,
                      least(86400.0, greatest(60.0, 60 * pow(2.0, greatest(failure_count - 1, 0)) * {_TYPE} * {_PRIO} * case when least(changed_streak, 10) >= least(unchanged_streak, 10) then {_OFTEN} else {_SELDOM} end)) as d,
                      case when http_status in (429, 503) and regexp_matches(retry_after, '^[0-9]+$') then least(86400.0, greatest(60.0, try_cast(retry_after as double))) end as told from d_pages)
    select page_id, action, case when action = 'failed' then round(coalesce(told, {_jitter(_STATE.format("'None'", "'failure:' || coalesce(cast(http_status as varchar), 'unknown')"), "d", "86400.0")}), 6) end as delay_s from p"""
)
def failure_policy(spark, sf_dir):
    return crawling.after_failure(view(spark, sf_dir, "d_pages"))


@query(f"select case when age is null or age > 86400 then 'hard_stale' when age > 21600 then 'soft_stale' else 'fresh' end as freshness, count(*) as n from (select {NOW} - last_success_s - 40000 as age from d_pages) group by 1")
def freshness(spark, sf_dir):
    age = F.lit(NOW) - F.col("last_success_s") - 40000
    return view(spark, sf_dir, "d_pages").groupBy(schedule.freshness(age, 21600, 86400).alias("freshness")).agg(F.count("*").alias("n"))


_WANTED = "(select distinct 'u' || page_id % 60 as request, canonical_url from (select page_id, url as canonical_url from d_pages union all select page_id + 1, url from d_pages where page_id % 4 = 0) where page_id % 60 <> 7)"
_FINE = f"(select distinct url as canonical_url from d_pages where {_OPEN} and not coalesce(lease_expires_s > {NOW} + 50000, false) and not regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '(?i)\\.(7z|avi|css|csv|docx?|gif|gz|ico|jpe?g|js|mov|mp3|mp4|odt|pdf|png|pptx?|rar|svg|tar|tiff?|txt|webp|xlsx?|xml|zip)$'))"
_NAMED = "(select distinct 'u' || first_doc * 7 % 60 as request, name from d_sources)"


@query(
    f"""
    with q as (select 'u' || r as request from range(60) t(r)),
         w as (select request, count(*) as urls, count(f.canonical_url) as pages from {_WANTED} w left join {_FINE} f using (canonical_url) group by request),
         n as (select request, count(*) as names, count(*) filter (name not in ('src3', 'src8')) as sources from {_NAMED} group by request),
         t as (select q.request, coalesce(urls, 0) as urls, coalesce(pages, 0) as pages, coalesce(names, 0) as names, coalesce(sources, 0) as sources from q left join w using (request) left join n using (request))
    select request, urls + names > 0 as requested, urls + names = 0 or (urls + names <= 6 and pages = urls and sources = names) as accepted, urls + names as targets, case when urls + names > 6 then 0 else pages + sources end as scheduled,
           case when urls + names = 0 then 'stale' when urls + names > 6 then 'refresh_target_limit_exceeded' when pages < urls then 'page_schedule_incomplete' when sources < names then 'source_schedule_incomplete' else 'stale' end as reason from t"""
)
def refresh_acceptance(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages").withColumn("canonical_url", F.col("url")).withColumn("ingestion_lease_expires_s", F.col("lease_expires_s") - 50_000)
    wanted = pages.select("page_id", "canonical_url").union(pages.where("page_id % 4 = 0").select(F.col("page_id") + 1, "canonical_url")).where("page_id % 60 <> 7").selectExpr("concat('u', page_id % 60) as request", "canonical_url")
    sources = view(spark, sf_dir, "d_sources")
    requests = spark.range(60).selectExpr("concat('u', id) as request", "'stale' as reason")
    return crawling.accepted(requests, wanted, sources.selectExpr("concat('u', first_doc * 7 % 60) as request", "name"), pages, sources.where("name not in ('src3', 'src8')"), NOW, 6)


_OUTCOME = "case outcome when 'failed_transient' then case when attempt_id % 3 = 0 then 'blocked' when attempt_id % 3 = 1 then 'lease_lost' else 'failed' end when 'not_modified' then 'lease_not_acquired' when 'success_changed' then 'changed' else case when attempt_id % 5 = 0 then 'skipped' else 'unchanged' end end"


@query(
    f"""
    with r as (select page_id, {_OUTCOME} as o from d_attempts), s as (select page_id, count(*) filter (o in ('failed', 'blocked', 'lease_lost')) as failed, count(*) filter (o = 'changed') as changed, count(*) filter (o in ('unchanged', 'lease_not_acquired')) as unchanged from r group by page_id)
    select count(*) as sources_attempted, count(*) filter (failed = 0) as sources_succeeded, count(*) filter (failed > 0) as sources_failed, cast(sum(changed) as bigint) as changed, cast(sum(unchanged) as bigint) as unchanged, cast(sum(failed) as bigint) as failed,
           case when count(*) filter (failed > 0) > 0 then 'failed' else 'completed' end as status from s"""
)
def attempt_report(spark, sf_dir):
    rows = view(spark, sf_dir, "d_attempts").selectExpr("page_id as source", f"{_OUTCOME} as outcome").groupBy("source", "outcome").agg(F.count("*").alias("n"))
    return crawling.report(rows)
