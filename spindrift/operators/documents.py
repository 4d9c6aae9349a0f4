"""The document pipeline: clean, hash, fold repeats, cut into chunks, keep versions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.shipping import ship

CHUNK, OVERLAP = 700, 100


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", text.content_hash(F.col("text")))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal normalised texts: hash, members, the smallest id."""
    return hashed(docs).groupBy("content_hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id")).where("members > 1")


def versions(rows: DataFrame) -> DataFrame:
    """Saved versions of each url (canonical_url, seq, body): a hash is saved once a url, later ones supersede earlier ones."""
    keyed = rows.withColumn("content_hash", F.sha2(F.col("body").cast("binary"), 256))
    saved = keyed.groupBy("canonical_url", "content_hash").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("canonical_url").orderBy("seq")
    return saved.select("canonical_url", "seq", "content_hash", F.row_number().over(order).cast("long").alias("version"), F.lag("seq").over(order).alias("supersedes"), F.lead("seq").over(order).isNull().alias("is_current"))


def fixed_chunks(docs: DataFrame, width: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, seq, content) of windows over the normalised text, in time linear in it."""
    t = docs.select("doc_id", text.normalized(F.col("text")).alias("t"))
    return t.select("doc_id", F.inline(text.windows(F.col("t"), width, overlap)))


_HEADING = re.compile(r"(?m)^#{1,6}\s+\S.*$")


#: A token of a text: a word or another sign, with the white space before it.
_TOKEN = re.compile(r"\s*(?:\w+|[^\w\s])")


def token_offsets(t: str) -> list[int]:
    """Where the tokens of a text begin, and its end: what stands between two of them is one token."""
    found = [m.start() for m in _TOKEN.finditer(t)]
    return [*found, len(t)] if found else [0, len(t)]


def heading_cuts(t: str, width: int, overlap: int, offsets=None) -> list[tuple[str, int, int]]:
    """(content, begin, end) of windows of so many characters, or tokens where `offsets` says where these begin, that end
    before the last heading of their second half where there is one; ends are exclusive.

    A text is read once: windows are slices, headings are found by halving. Windows of white space alone are left out.
    """
    at_char = None if offsets is None else offsets(t)
    n = len(t) if at_char is None else len(at_char) - 1
    heads = [m.start() for m in _HEADING.finditer(t)]
    if at_char is not None:
        heads = [bisect_left(at_char, h) for h in heads]
    out, at = [], 0
    while at < n and t:
        end = min(n, at + width)
        if end < n:
            last = bisect_right(heads, end) - 1
            if last >= 0 and heads[last] >= at + width // 2:
                end = heads[last]
        content = (t[at:end] if at_char is None else t[at_char[at] : at_char[end]]).strip()
        if content:
            out.append((content, at, end))
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    return out


def heading_chunks(docs: DataFrame, width: int = CHUNK, overlap: int = OVERLAP, offsets=None) -> DataFrame:
    """(doc_id, seq, content, token_count, begins, ends) of windows cut at headings, as in `heading_cuts`: each cut depends on
    the one before, hence Python, in batches. `offsets` is None for characters, or a function such as `token_offsets`."""
    if width <= 0 or not 0 <= overlap < width:
        raise ValueError("windows must be longer than what they share")

    @F.pandas_udf("array<struct<content:string,begins:long,ends:long>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"content": c, "begins": b, "ends": e} for c, b, e in heading_cuts(t, width, overlap, offsets)] if t else [])

    ship(docs.sparkSession)
    parts = docs.select("doc_id", F.posexplode(cut(text.normalized(F.col("text")))).alias("seq", "c"))
    return parts.select("doc_id", F.col("seq").cast("long").alias("seq"), "c.content", (F.col("c.ends") - F.col("c.begins")).alias("token_count"), "c.begins", "c.ends")


def page_body(title, body, most: int = 20_000):
    """The text of a page: its title put before a body that does not begin with it, normalised, at most so long."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    whole = F.when((t != "") & ~F.startswith(b, t), F.when(b != "", F.concat(t, F.lit("\n"), b)).otherwise(t)).otherwise(b)
    return F.substring(text.normalized(whole), 1, most)


def page_role(items, lists, details, path, title, body, published):
    """listing, detail or other by what a page holds: its number of items, list and detail elements, path, texts and day."""
    p, dated = F.lower(path), published.isNotNull()
    listing = (items > 0) & (lists | (items >= 2) | F.contains(p, F.lit("/p/403-")) | F.contains(p, F.lit("/p/404-")))
    detail = (items == 0) & (title != "") & (F.length(body) >= 40) & (details | dated & F.contains(p, F.lit("/p/406-")))
    return F.when(listing, "listing").when(detail, "detail").otherwise("other")


def stale(pages: DataFrame, current: DataFrame) -> DataFrame:
    """Pages whose url no current document has."""
    return pages.join(current.select("canonical_url").distinct(), "canonical_url", "left_anti")


def backfilled(pages: DataFrame, saved: DataFrame) -> DataFrame:
    """Pages with ingestion_status done where a document of the same url and hash exists, as it was elsewhere."""
    known = saved.select("canonical_url", "content_hash").distinct().withColumn("_known", F.lit(True))
    return pages.join(known, ["canonical_url", "content_hash"], "left").withColumn("ingestion_status", F.when(F.col("_known"), "done").otherwise(F.col("ingestion_status"))).drop("_known")


def needs_ingestion(pages: DataFrame, saved: DataFrame) -> DataFrame:
    """Pages whose url and hash is not saved yet."""
    return pages.join(saved.select("canonical_url", "content_hash"), ["canonical_url", "content_hash"], "left_anti")
