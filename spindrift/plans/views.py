"""The tables that operators work on, derived from the test tables.

Each view is one SELECT that Spark and DuckDB both read; {name} stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from spindrift.functions import text
from spindrift.shipping import ship

#: The moment that stands for now, in epoch seconds.
NOW = 1_700_050_000

VIEWS = {
    "d_docs": """
        select doc_id, text, lang, source as unit, concat('https://', source, '.example.org/d/', cast(doc_id as string)) as canonical_url,
               substring(text, 1, 60) as title, cast(doc_id % 365 as int) as published_day, doc_id % 7 <> 0 as is_current
        from {documents}""",
    "d_versions": """
        select concat('https://example.org/v/', cast(doc_id % 200 as string)) as canonical_url, doc_id as seq,
               case when doc_id % 3 = 0 then 'same' else text end as body
        from {documents}""",
    # Windows of 400 characters, 320 apart, that cover a text; one where there is none.
    "d_chunks": """
        select doc_id * 1000000 + seq as chunk_id, doc_id as document_id, {content} as content, substring(text, 1, 60) as title,
               source as unit, concat('https://', source, '.example.org/d/', cast(doc_id as string)) as canonical_url, doc_id % 7 <> 0 as is_current
        from (select *, {windows} from {documents}) t""",
    # The same without contents, of which only the length of a text is needed.
    "d_windows": """
        select doc_id * 1000000 + seq as chunk_id, doc_id as document_id, source as unit, concat('https://', source, '.example.org/d/', cast(doc_id as string)) as canonical_url, doc_id % 7 <> 0 as is_current
        from (select *, {numbers} as seq from {documents}) t""",
    "d_sources": """
        select source as name, concat('https://', source, '.example.org') as base_url, min(doc_id) as first_doc, count(*) as docs,
               1700000000 + 1000 * (min(doc_id) % 60) as last_success_s, cast(60 + min(doc_id) % 3 * 30 as int) as interval_minutes
        from {documents} where source is not null group by source""",
    # A registry of names: the first two words of texts, each standing for a unit.
    "d_names": """
        select alias, concat('unit ', cast(min(item_id) as string)) as unit from (select item_id, regexp_extract(text, '^[^A-Za-z]*([A-Za-z]+ [A-Za-z]+)', 1) as alias from {benchmark}) b where alias <> '' group by alias""",
    # The latest lists of sources, which leave out a third of their announcements.
    "d_snapshots": """
        select source as name, concat('unit ', source) as unit, 1700000000 + 1000 * (min(doc_id) % 60) as last_success_s, {listed_urls} as canonical_urls
        from {documents} where source is not null group by source""",
    # Pages of documents and announcements, by the ids of documents.
    "d_known_pages": """
        select concat('https://', source, '.example.org/', case when doc_id % 2 = 0 then 'd/' else 'a/' end, cast(doc_id as string)) as canonical_url, case when doc_id % 40 < 2 then 'unit_homepage' when doc_id % 10 = 5 then 'announcement_listing' else 'official_document' end as page_type,
               1700050000 - doc_id * 733 % 200000 as last_success_s, case when doc_id % 11 <> 0 then cast(doc_id % 4 as string) end as content_hash, case when doc_id % 13 <> 0 then cast(doc_id % 4 + case when doc_id % 5 = 0 then 1 else 0 end as string) end as ingestion_content_hash,
               case doc_id % 6 when 0 then 'pending' when 1 then 'failed' when 2 then 'partial' when 3 then null else 'success' end as ingestion_status,
               case doc_id % 7 when 0 then 'pending' when 1 then 'failed' when 2 then 'incomplete' when 3 then 'not_applicable' when 4 then null else 'success' end as announcement_ingestion_status,
               case when doc_id % 17 = 0 then 1700000000 + doc_id * 31 % 100000 end as lease_expires_s, case when doc_id % 19 = 0 then 1700000000 + doc_id * 37 % 100000 end as ingestion_lease_expires_s
        from {documents} where source is not null and doc_id % 9 <> 4""",
    "d_announcements": """
        select doc_id as id, source, concat('unit ', source) as unit, concat('https://', source, '.example.org/a/', cast(doc_id as string)) as canonical_url,
               substring(text, 1, 40) as title, text as body, cast(doc_id * 7 % 365 as int) as published_day,
               1700000000 + doc_id * 60 as last_crawled_s, case when doc_id % 9 = 0 then 'incomplete' end as warning
        from {documents}""",
    "d_pages": """
        select page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host,
               coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') as path,
               regexp_extract(html, '<title>([^<]*)</title>', 1) as title, concat('src', cast(page_id % 20 as string)) as unit,
               case page_id % 7 when 0 then 'unit_homepage' when 1 then 'announcement_listing' when 2 then 'announcement_detail'
                    when 3 then 'official_document' when 4 then 'search_result' else 'general_page' end as page_type,
               case page_id % 11 when 0 then 'blocked' when 1 then 'excluded' when 2 then 'failed' when 3 then 'discovered' when 4 then 'queued' when 5 then 'fetching' when 6 then 'unchanged' else 'success' end as crawl_status,
               cast(page_id * 13 % 120 as int) as crawl_priority, cast(page_id % 6 as int) as failure_count, cast(page_id % 5 as int) as minimum_depth,
               page_id % 9 <> 0 as is_active, page_id % 8 <> 0 as is_indexable,
               case when page_id % 6 <> 0 then 1700000000 + page_id * 7919 % 100000 end as next_crawl_s,
               case when page_id % 10 = 0 then 1700000000 + page_id * 31 % 100000 end as lease_expires_s,
               case when page_id % 10 = 0 then concat('worker', cast(page_id % 3 as string)) end as lease_owner,
               case when page_id % 3 <> 0 then 1700000000 - page_id * 733 % 200000 end as last_success_s,
               case page_id % 4 when 0 then 'official_unit' when 1 then 'configured_seed' when 2 then 'internal_link' else 'existing_document' end as discovery_source,
               cast(page_id % 13 as int) as changed_streak, cast(page_id * 3 % 14 as int) as unchanged_streak,
               case page_id % 8 when 0 then null when 1 then 404 when 2 then 403 when 3 then 500 when 4 then 429 when 5 then 418 when 6 then 410 else 503 end as http_status,
               case page_id % 5 when 0 then '120' when 1 then 'soon' when 2 then '5' else null end as retry_after,
               case page_id % 5 when 0 then 'pending' when 1 then 'failed' else 'done' end as ingestion_status,
               case page_id % 9 when 0 then 'pending' when 1 then 'failed' when 2 then 'incomplete' when 3 then 'success' end as announcement_ingestion_status,
               case when page_id % 12 <> 5 then sha256(html) end as page_hash
        from {pages}""",
    # The urls of pages, and odd ones that take every branch of the url rules.
    "d_urls": """
        select page_id, url from {pages} union all select * from (values
          (-1, 'https://EXAMPLE.com./p/404-1000-23.php?Lang=zh'), (-2, 'https://www.example.com/p/406-1000-23,r12.php'), (-3, 'https://example.com/p/405-1000-23.php'),
          (-4, 'https://example.com/a%2cb%2C.html?x=1%2C2&b=2&a=%20z+y'), (-5, 'http://example.net/'), (-6, 'https://example.net:443/x#part'), (-7, 'https://example.net:8443/x'),
          (-8, 'https://user@example.net/x'), (-9, 'https://example.net/file.TIFF'), (-10, 'https://example.net/robots.txt'), (-11, 'https://example.net/feed.xml?x'), (-12, 'https://example.net/a.bmp'),
          (-13, 'https://example.net/form.DOCX'), (-14, 'https://example.net/?GCLID=1'), (-15, 'https://example.net/?ref=1'), (-16, 'https://example.net/?a=1&A=2'), (-17, 'https://example.net/?a&b&c&d&e&f'),
          (-18, 'https://example.net/?a&b&c&d&e&f&g'), (-19, 'https://example.net/x/X/x/X/y'), (-20, 'https://example.net/x/x/x/y/x'), (-21, concat('https://example.net', repeat('/a/b', 16))),
          (-22, concat('https://example.net', repeat('/a/b', 16), '/c')), (-23, concat('https://example.net/?q=', repeat('x', 510))), (-24, concat('https://example.net/?q=', repeat('x', 511))),
          (-25, 'ftp://example.net/x'), (-26, 'https://badexample.net/'), (-27, 'no url'), (-28, 'https://example.net?b=&a=%zz&&c'), (-29, 'https://sub.example.net/?redirect=1'), (-30, cast(null as varchar(9)))) odd(page_id, url)""",
    "d_pages_in": """
        select case when page_id % 5 = 0 then page_id + 1000000 else page_id end as page_id, concat('in ', cast(page_id as string)) as in_title,
               page_id % 3 = 0 as untitled, url, case page_id % 3 when 0 then 'existing_announcement' when 1 then 'official_search' else 'official_unit' end as discovery_source,
               cast(page_id * 17 % 120 as int) as crawl_priority, cast(page_id * 3 % 7 as int) as minimum_depth, page_id % 2 = 0 as is_indexable,
               case page_id % 4 when 0 then 'general_page' when 1 then 'announcement_detail' when 2 then 'search_result' else 'official_document' end as page_type
        from {pages} where page_id % 2 = 0 or page_id % 5 = 0""",
    "d_links": """
        select page_id as source_page_id, (page_id * 7 + k) % (select count(*) from {pages}) as target_page_id, k, page_id * 6 + k as position,
               case when (page_id + k) % 4 = 0 then '' else substring(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 30) end as anchor_text,
               case when k % 3 = 0 then 'unknown' when k % 3 = 1 then 'navigation' else 'content' end as link_type, 1700000000 + page_id * 10 + k as seen_s
        from {pages} cross join {six}""",
    # Pages with marks of many kinds, made of those of the table.
    "d_marked": """
        select page_id, url, replace(replace(html, '<head>', concat('<head>', case page_id % 5 when 0 then '<meta property="og:title" content="OG &amp;  &quot;x&quot;"><meta property="article:published_time" content="2024-02-30">'
                   when 1 then '<META name=title content=" Named  title "><meta name="date" content="2023-12-05T01:02">' when 2 then '<meta property="og:title" content="">' else '' end)),
                 '<article>', concat(case page_id % 4 when 0 then '<div hidden>Secret</div>' when 1 then '<div class="x meditor">Only<br>this 113/2/3 text</div>' when 2 then '<main>Main <b>text</b><aside>no</aside></main>' else '' end, '<article>')) as html
        from {pages}""",
    # Lists of announcements, one for each source and 400 documents: a row of each document, of all kinds that rows come in.
    "d_lists": """
        select min(doc_id) as page_id, concat('https://', source, '.example.org/list/', cast(min(doc_id) as string)) as url,
               concat('<!DOCTYPE html><title>List</title><body><nav><a href="/">Home</a></nav><div class="', case when min(doc_id) % 5 = 0 then 'other' else 'news list' end, '">', {rows_in_order}, '</div></body>') as html
        from (select doc_id, coalesce(source, 'none') as source, case doc_id % 12
                when 0 then concat('<div class="row listBS"><div class="mtitle"><a href="/p/406-1-', id, '.php">', t, '</a></div></div>')
                when 1 then concat('<div class="row listBS"><div class="mtitle"><a href="https://', coalesce(source, 'none'), '.EXAMPLE.org/p/', id, '.php?a=%2c#top">', t, '</a><div><i class="mdate">2024-', m, '-', d, '</i><p class="mdetail">Some  <b>words</b></p></div></div></div>')
                when 2 then concat('<div class="row listBS"><span class="date">113年', m, '月', d, '日</span> <p class="mtitle"><a title="Full" href="x/', id, '">', t, '</a></p></div>')
                when 3 then concat('<div class="row listBS"><i class="mdate">2024-13-45</i><div class="mtitle"><a href="/p/', id, '">', t, '</a></div></div>')
                when 4 then concat('<div class="row listBS"><i class="mdate">2024-', m, '-', d, '</i><div class="mtitle"><a href="javascript:go(', id, ')">', t, '</a></div></div>')
                when 5 then concat('<div class="row listBS"><div class="mtitle"><a href="/q/', id, '">Undated</a></div></div><div class="row listBS"><div class="mtitle"><a href="/q/', id, '">', t, '</a></div><i class="mdate">2023/', m, '/', d, '</i></div>')
                when 6 then concat('<div class="row listBS"><i class="mdate">2024-', m, '-', d, '</i><div class="mtitle"><a href="https://elsewhere.test/', id, '">', t, '</a></div></div>')
                when 7 then concat('<div class="row listBS"><i class="mdate">2024-', m, '-', d, '</i><div class="mtitle"><a href="/f/', id, '.pdf">', t, '</a></div></div>')
                when 8 then concat('<div class="row listBS"><i class="mdate">2024-', m, '-', d, '</i><div class="mtitle"><a href="http://', coalesce(source, 'none'), '.example.org/r/', id, '">', t, '</a></div></div>')
                when 9 then concat('<div class="row listBS"><div class="mtitle"><a href="/s/', id, '">', t, '</a></div><time datetime="2022-', m, '-', d, 'T08:00">2021-1-1</time></div>')
                when 10 then concat('<table class="listTB"><tbody><tr><td data-th="日期">2022/', m, '/', d, '</td><td><a href="../t/', id, '">', t, '</a></td><td data-th="內容">Sum &lt;', id, '&gt;</td></tr></tbody></table>')
                else concat('<div class="module"><div class="d-txt">In <span class="mtitle"><a href="/u/', id, '">', t, '</a></span> <i class="mdate">2020.', m, '.', d, '</i></div></div>') end as row
              from (select *, cast(doc_id as string) as id, lpad(cast(1 + doc_id % 12 as string), 2, '0') as m, lpad(cast(1 + doc_id % 28 as string), 2, '0') as d, concat('Note ', cast(doc_id as string), ' &amp; ', trim(regexp_replace(substring(text, 1, 30), '[^A-Za-z]+', ' '{all}))) as t from {documents}) r) l
        group by source, doc_id - doc_id % 400""",
    # Pages of the site's own search, one for each document: a form and two results, of all kinds.
    "d_searches": """
        select doc_id as page_id, concat('https://', coalesce(source, 'none'), '.example.org/find/') as url,
               concat('<body><form action="/other"><input name="q"></form>',
                 case when doc_id % 7 = 0 then '' else concat('<form action="', case doc_id % 5 when 0 then 'https://elsewhere.test/s' when 1 then '' else 'go?x=1' end, '" method="', case doc_id % 6 when 0 then 'put' when 1 then 'POST' else 'get' end,
                   '"><input type="hidden" name="tok" value="', cast(doc_id as string), '"><input type=hidden name=m><input name="SchKey">', case when doc_id % 4 = 0 then '' else '<select name="SchType"><option value="">All<option value="1">One<option value="2">Two</select>' end, '</form>') end,
                 case when doc_id % 8 = 0 then '<div>' else '<div id="assopartlist">' end,
                 case when doc_id % 3 = 0 then '<ul><li>' else '<div class="d-item">' end, '<div class="mtitle"><a href="/a/', cast(doc_id as string), '">First ', cast(doc_id as string), '</a></div><i class="mdate">', case when doc_id % 9 = 0 then '2024.31.2' else '2024.3.2' end, '</i><span class="subsitename">Unit ', cast(doc_id % 4 as string), '</span>',
                 case when doc_id % 3 = 0 then '<li>' else '</div><div class="d-item">' end, '<a href="', case when doc_id % 2 = 0 then 'https://elsewhere.test/b' else 'b' end, '">Second</a> on 112-05-06 <b class="category">Kind</b></div></body>') as html
        from {documents}""",
    "d_attempts": """
        select event_id as attempt_id, user_id as page_id,
               case event_type when 'error' then 'failed_transient' when 'signup' then 'not_modified' when 'purchase' then 'success_changed' else 'success_unchanged' end as outcome,
               ts as started_at, value > 100 as content_changed
        from {events}""",
}
_SIX = {"spark": "(select explode(sequence(0, 5)) as k)", "duck": "(select cast(unnest(range(0, 6)) as integer) as k)"}

#: Spellings that differ.
_WORDS = {
    "spark": {
        # One walk over the text cuts it into blocks of a step; a window is a block and the beginning of the next. Cutting
        # each window from the whole text would walk from its beginning every time.
        "{windows}": f"inline({text.WINDOWS.format(text='text', step=320, rest=80)})".replace("{1,320}", "{{1,320}}"),  # braces, for spark.sql
        "{content}": "content",
        "{numbers}": "explode(sequence(0L, (greatest(length(text) - 400, 0) + 319) div 320))",
        "{listed_urls}": "array_sort(collect_list(case when doc_id % 3 <> 1 then concat('https://', source, '.example.org/a/', cast(doc_id as string)) end))",
        "sha256(html)": "sha2(html, 256)", "{rows_in_order}": "listagg(row, '') within group (order by doc_id)", "{all}": "",
    },
    "duck": {
        "{windows}": "unnest(range(0, 1 + (greatest(length(text) - 400, 0) + 319) // 320)) as seq",
        "{content}": "substring(text, cast(1 + 320 * seq as int), 400)",
        "{listed_urls}": "list_sort(list(concat('https://', source, '.example.org/a/', cast(doc_id as string))) filter (doc_id % 3 <> 1))",
        "{numbers}": "unnest(range(0, 1 + (greatest(length(text) - 400, 0) + 319) // 320))",
        "{rows_in_order}": "string_agg(row, '' order by doc_id)",
        "{all}": ", 'g'",
    },
}


def _spelled(sql: str, dialect: str) -> str:
    for word, own in {"{six}": _SIX[dialect], **_WORDS[dialect]}.items():
        sql = sql.replace(word, own)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str, **instead: DataFrame) -> DataFrame:
    """A table of `sf_dir` or a view over them; `instead` gives rows of a table to use in its place."""
    ship(spark)
    if name in instead:
        return instead[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spelled(VIEWS[name], "spark")
    return spark.sql(sql, **{t: view(spark, sf_dir, t, **instead) for t in set(re.findall(r"{(\w+)}", sql))})


def duck(sql: str) -> str:
    """SQL for DuckDB with the views it names put in front."""
    used, todo = [], [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    for v in todo:
        body = _spelled(VIEWS[v], "duck")
        used.append(f"{v} as ({re.sub(r'{(\w+)}', lambda m: m[1], body)})")
    if not used:
        return sql
    sql = sql.strip()
    first = "with recursive " if sql.lower().startswith("with recursive ") else "with "
    return f"{first}{', '.join(used)}{', ' + sql[len(first) :] if sql.lower().startswith(first) else ' ' + sql}"
