"""Documents: cleaning, hashes, repeats, versions, chunks, redaction, backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog.registry import normal, q, query
from spindrift.functions import text
from spindrift.operators import documents
from spindrift.plans.views import view


@query(f"select doc_id, length({normal('text')}) as chars, md5({normal('text')}) as text_md5 from documents")
def text_normalize(spark, sf_dir):
    t = text.normalized(F.col("text"))
    return view(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t.cast("binary")).alias("text_md5"))


@query(f"select doc_id, sha256({normal('text')}) as content_hash from documents")
def content_hash(spark, sf_dir):
    return documents.hashed(view(spark, sf_dir, "documents")).select("doc_id", "content_hash")


@query(f"select sha256({normal('text')}) as content_hash, count(*) as members, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return documents.exact_duplicates(view(spark, sf_dir, "documents"))


@query(
    """
    with s as (select canonical_url, sha256(body) as content_hash, min(seq) as seq from d_versions group by all)
    select canonical_url, seq, content_hash, row_number() over w as version, lag(seq) over w as supersedes, lead(seq) over w is null as is_current from s window w as (partition by canonical_url order by seq)"""
)
def version_chain(spark, sf_dir):
    return documents.versions(view(spark, sf_dir, "d_versions"))


@query(
    f"""
    with t as (select doc_id, {normal("text")} as t from documents where text is not null),
         c as (select doc_id, t, unnest(range(0, case when length(t) = 0 then 0 else greatest(1, cast(ceil((length(t) - 100) / 600.0) as bigint)) end)) as seq from t)
    select doc_id, seq, md5(substr(t, seq * 600 + 1, 700)) as content_md5 from c"""
)
def chunk_fixed(spark, sf_dir):
    return documents.fixed_chunks(view(spark, sf_dir, "documents")).select("doc_id", "seq", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_HEADED = "replace(text, '. The ', concat('.', chr(10), '## The '))"


@query(
    rf"""
    with recursive t as (select doc_id, {normal(_HEADED)} as t from documents where text is not null),
         l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from t),
         s as (select doc_id, line, sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as start from l),
         h as (select t.doc_id, t.t, length(t.t) as n, heads from t left join (select doc_id, list(cast(start as bigint)) as heads from s where regexp_matches(line, '^#{{1,6}}\s+\S') group by doc_id) using (doc_id) where length(t.t) > 0),
         c as (select doc_id, 0::bigint as begins, case when 700 < n then coalesce(list_max(list_filter(heads, lambda p: p >= 350 and p <= 700)), 700) else n end as ends from h
               union all select doc_id, b, case when b + 700 < n then coalesce(list_max(list_filter(heads, lambda p: p >= b + 350 and p <= b + 700)), b + 700) else n end
               from (select h.*, greatest(c.ends - 100, c.begins + 1) as b from c join h using (doc_id) where c.ends < h.n)),
         w as (select doc_id, begins, ends, regexp_replace(substr(t, begins + 1, ends - begins), '^\s+|\s+$', '', 'g') as content from c join h using (doc_id))
    select doc_id, row_number() over (partition by doc_id order by begins) - 1 as seq, md5(content) as content_md5, ends - begins as token_count, begins, ends from w where content <> ''"""
)
def chunk_headings(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").select("doc_id", F.expr(_HEADED.replace("chr(10)", "'\\n'")).alias("text"))
    return documents.heading_chunks(rows).select("doc_id", "seq", F.md5(F.col("content").cast("binary")).alias("content_md5"), "token_count", "begins", "ends")


@query(
    rf"""
    with t as (select doc_id, {normal("text")} as t from documents where text is not null), k as (select doc_id, t, regexp_extract_all(t, '\s*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])') as tokens from t where t <> ''),
         c as (select doc_id, tokens, unnest(range(0, greatest(1, cast(ceil((len(tokens) - 20) / 80.0) as bigint)))) as seq from k where len(tokens) > 0)
    select doc_id, seq, md5(regexp_replace(array_to_string(tokens[seq * 80 + 1 : seq * 80 + 100], ''), '^\s+|\s+$', '', 'g')) as content_md5, least(len(tokens), seq * 80 + 100) - seq * 80 as token_count from c"""
)
def chunk_tokens(spark, sf_dir):
    """Windows of 100 tokens that share 20."""
    rows = view(spark, sf_dir, "documents")
    return documents.heading_chunks(rows, 100, 20, documents.token_offsets).select("doc_id", "seq", F.md5(F.col("content").cast("binary")).alias("content_md5"), "token_count")


# What SQL without lookaround can say of the same rule.
_PERSONAL = r"(?i)(?:密碼|password|cookie|學號|成績|身分證|session\s*[:=]|token\s*[:=])|(?:^|[^\p{L}\p{N}_])[A-Z][12]\d{8}(?:$|[^\p{L}\p{N}_])|(?:^|[^\p{L}\p{N}_])\d{8,10}(?:$|[^\p{L}\p{N}_])"
_SAID = "case doc_id % 9 when 0 then concat(text, ' Session = x') when 1 then concat('密碼', text) when 2 then concat('id a123456789 ', text) when 3 then concat(text, '_12345678') when 4 then concat(text, '12345678901') when 5 then concat(text, ' (1234567890)') else text end"


@query(f"select doc_id, regexp_matches(said, {q(_PERSONAL)}) as personal, md5(case when regexp_matches(said, {q(_PERSONAL)}) then '[已隱去可能的個人或敏感資料]' else said end) as text_md5 from (select doc_id, {_SAID} as said from documents)")
def redact(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", F.expr(_SAID).alias("said")).select("doc_id", text.is_personal(F.col("said")).alias("personal"), F.md5(text.redacted(F.col("said")).cast("binary")).alias("text_md5"))


@query("select p.page_id from (select *, concat('https://src', cast(page_id % 20 as string), '.example.org/d/', cast(page_id as string)) as canonical_url from d_pages) p where not exists (select 1 from d_docs d where is_current and d.canonical_url = p.canonical_url)")
def stale_pages(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages").withColumn("canonical_url", F.expr("concat('https://src', cast(page_id % 20 as string), '.example.org/d/', cast(page_id as string))"))
    return documents.stale(pages, view(spark, sf_dir, "d_docs").where("is_current")).select("page_id")


_KEYED = "(select page_id, ingestion_status, concat('https://src', cast(page_id % 20 as string), '.example.org/d/', cast(page_id as string)) as canonical_url, cast(page_id % 3 as string) as content_hash from d_pages)"
_SAVED = "(select canonical_url, cast(doc_id % 2 as string) as content_hash from d_docs)"


def _keyed(spark, sf_dir):
    pages = view(spark, sf_dir, "d_pages").selectExpr("page_id", "ingestion_status", "concat('https://src', cast(page_id % 20 as string), '.example.org/d/', cast(page_id as string)) as canonical_url", "cast(page_id % 3 as string) as content_hash")
    return pages, view(spark, sf_dir, "d_docs").selectExpr("canonical_url", "cast(doc_id % 2 as string) as content_hash")


@query(f"select page_id, case when exists (select 1 from {_SAVED} s where s.canonical_url = p.canonical_url and s.content_hash = p.content_hash) then 'done' else ingestion_status end as ingestion_status from {_KEYED} p")
def semi_backfill(spark, sf_dir):
    return documents.backfilled(*_keyed(spark, sf_dir)).select("page_id", "ingestion_status")


@query(f"select page_id from {_KEYED} p where not exists (select 1 from {_SAVED} s where s.canonical_url = p.canonical_url and s.content_hash = p.content_hash)")
def needs_ingestion(spark, sf_dir):
    return documents.needs_ingestion(*_keyed(spark, sf_dir)).select("page_id")


@query("select doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 as n from documents where text is not null")
def term_counts(spark, sf_dir):
    return view(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.term_count(F.col("text"), "the").cast("long").alias("n"))


_TOLD = """case doc_id % 7 when 0 then concat(' ', cast(1890 + doc_id % 60 as string), '-', lpad(cast(doc_id % 14 as string), 2, '0'), '-', lpad(cast(doc_id % 33 as string), 2, '0'), 'T10:00 ')
  when 1 then concat(text, ' 截止日期： ', cast(100 + doc_id % 30 as string), '年', cast(doc_id % 14 as string), '月', cast(doc_id % 33 as string), '日 or so') when 2 then concat('報名期限 2024/', cast(doc_id % 14 as string), '/', cast(doc_id % 33 as string), ', ', text)
  when 3 then concat('on 99-', cast(doc_id % 14 as string), '-1 or ', cast(1900 + doc_id % 20 as string), '.2.3') when 4 then concat('202', cast(doc_id % 10 as string), '0', cast(doc_id % 10 as string), '1', cast(doc_id % 10 as string)) else text end"""


def _made(x: str) -> str:
    y, m, d = (rf"regexp_extract({x}, '(\d{{3,4}})[年\-/.](\d{{1,2}})[月\-/.](\d{{1,2}})日?', {i})" for i in (1, 2, 3))
    return f"try_cast(lpad(cast(case when try_cast({y} as int) < 1911 then 1911 else 0 end + try_cast({y} as int) as varchar), 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as date)"


def _date(x: str) -> str:
    iso = rf"case when regexp_matches(trim({x}), '^\d{{4}}-\d{{2}}-\d{{2}}(T\d{{2}}:\d{{2}})?$') then try_cast(substr(trim({x}), 1, 10) as date) when regexp_matches(trim({x}), '^\d{{8}}$') then try_strptime(trim({x}), '%Y%m%d')::date end"
    return f"coalesce({iso}, {_made(x)})"


_DUE = r"regexp_extract(told, '(?:截止(?:日|日期|時間)?|報名期限)[：:\s]*(\d{3,4}[年\-/.]\d{1,2}[月\-/.]\d{1,2}日?)', 1)"


@query(f"select doc_id, {_date('told')} as parsed, {_date(_DUE)} as deadline from (select doc_id, {_TOLD} as told from documents)")
def parse_dates(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").select("doc_id", F.expr(_TOLD).alias("told"))
    return rows.select("doc_id", text.parsed_date(F.col("told")).alias("parsed"), text.deadline(F.col("told")).alias("deadline"))
