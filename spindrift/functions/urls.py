"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File endings that are no pages, those of documents, and query keys that trap a crawler.
RESOURCES = ("7z", "avi", "css", "csv", "doc", "docx", "gif", "gz", "ico", "jpeg", "jpg", "js", "mov", "mp3", "mp4", "odt", "pdf", "png", "ppt", "pptx", "rar", "svg", "tar", "tif", "tiff", "txt", "webp", "xls", "xlsx", "xml", "zip")
DOCUMENTS = ("pdf", "doc", "docx", "odt", "xls", "xlsx")
TRAPS = ("fbclid", "gclid", "jsessionid", "phpsessid", "redirect", "return", "session", "sessionid", "sid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: Limits beyond which a url is a trap.
MOST_PARAMS, MOST_QUERY, MOST_SEGMENTS, MOST_REPEATS = 6, 512, 32, 3
#: Words by which an anchor announces something.
ANNOUNCES = ("公告", "通知", "訊息")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower case, without user, port and the dots of a rooted name."""
    return F.rtrim(F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")), F.lit("."))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def params(url: Column) -> Column:
    """Query pairs as they stand; an empty query has none."""
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def decoded(text: Column) -> Column:
    """Percent-decoded, as it stands where that cannot be."""
    return F.coalesce(F.try_url_decode(text), text)


def _with_query(start: Column, q: Column) -> Column:
    return F.concat(start, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def canonical(url: Column) -> Column:
    """https, host in lower case, %2C in the path as a comma, the query as it is, no fragment."""
    return _with_query(F.concat(F.lit("https://"), host(url), F.regexp_replace(path(url), "%2[Cc]", ",")), query(url))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def frontier_canonical(url: Column) -> Column:
    """Scheme and host in lower case, query pairs decoded, in order and encoded again, no fragment."""
    pair = lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)", 1)).alias("v"))
    ordered = F.array_sort(F.transform(params(url), pair))
    q = F.array_join(F.transform(ordered, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return _with_query(F.concat(scheme, F.lit("://"), host(url), path(url)), q)


def in_scope(h: Column, roots: list[str]) -> Column:
    """A root host or a host below one; nothing without roots."""
    out = F.lit(False)
    for r in (r.strip().lower().rstrip(".") for r in roots):
        if r:
            out = out | (h == r) | F.endswith(h, F.lit("." + r))
    return out


def in_scope_table(rows: DataFrame, hosts: DataFrame, h: str = "host") -> DataFrame:
    """Rows whose host is one of a table of hosts (host) or below one: they meet on each of the host's own suffixes.

    Hosts below others of the table are left out first, so that a row meets one at most.
    """

    def suffixes(c: str, first: int) -> Column:
        parts = F.split(c, r"\.")
        starts = F.when(F.size(parts) >= first, F.sequence(F.lit(first), F.size(parts))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    allowed = hosts.select(F.rtrim(F.lower(F.trim("host")), F.lit(".")).alias("_root")).where("_root <> ''").distinct()
    nested = allowed.select(F.col("_root").alias("_low"), F.explode(suffixes("_root", 2)).alias("_root")).join(allowed, "_root").select(F.col("_low").alias("_root"))
    tops = allowed.join(nested, "_root", "left_anti")
    return rows.withColumn("_root", F.explode(suffixes(h, 1))).join(tops, "_root").select(*rows.columns)


def below_root(url: Column, roots: list[str]) -> Column:
    """The root itself, with or without a slash, or a url below it."""
    out = F.lit(False)
    for r in roots:
        out = out | url.isin(r, r + "/") | F.startswith(url, F.lit(r + "/"))
    return out


def is_resource(url: Column) -> Column:
    return F.rlike(path(url), F.lit(rf"(?i)\.({'|'.join(RESOURCES)})$"))


def is_document(url: Column) -> Column:
    return F.rlike(path(url), F.lit(rf"(?i)\.({'|'.join(DOCUMENTS)})$"))


def longest_run(segments: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    step = lambda a, x: F.struct(x.alias("last"), F.when(a["last"] == x, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["most"], F.when(a["last"] == x, a["run"] + 1).otherwise(1)).alias("most"))
    return F.aggregate(segments, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")), step)["most"]


def is_trap(url: Column, max_query: int = MOST_QUERY, max_params: int = MOST_PARAMS, max_segments: int = MOST_SEGMENTS, max_run: int = MOST_REPEATS) -> Column:
    """Urls a crawler gets lost in: long or tracked or repeated queries, deep paths, one segment again and again."""
    keys = F.transform(params(url), lambda p: F.regexp_extract(F.lower(p), "^([^=]*)", 1))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return (
        (F.length(query(url)) > max_query)
        | (F.size(keys) > max_params)
        | F.arrays_overlap(keys, F.array(*map(F.lit, TRAPS)))
        | (F.size(F.array_distinct(keys)) < F.size(keys))
        | (F.size(segments) > max_segments)
        | (longest_run(F.transform(segments, F.lower)) > max_run)
    )


def is_crawlable(url: Column) -> Column:
    """http or https, no fragment, not a file of another kind."""
    return F.rlike(url, F.lit("(?i)^https?://")) & ~F.rlike(url, F.lit("#.")) & ~is_resource(url)


def is_bounded(url: Column, hosts: list[str] | None = None) -> Column:
    """Whether the crawl frontier may take the url; without `hosts` any host will do."""
    fine = is_crawlable(url) & ~is_trap(url)
    return fine if hosts is None else fine & in_scope(host(url), hosts)


def is_allowed(url: Column, roots: list[str]) -> Column:
    """https without user or odd port, on an allowed host."""
    a = authority(url)
    return F.rlike(url, F.lit("(?i)^https://")) & ~F.contains(a, F.lit("@")) & F.rlike(a, F.lit("^[^:]+(:(443)?)?$")) & in_scope(host(url), roots)


def target(url: Column, roots: list[str], hosts: list[str] | None = None, documents: bool = False) -> Column:
    """The url in the form that the frontier keeps, null where it may not be followed; documents pass if they may."""
    normal = frontier_canonical(canonical(url))
    fine = is_allowed(url, roots) & ~is_trap(normal)
    if hosts is not None:
        fine = fine & in_scope(host(normal), hosts)
    follow = ~is_resource(normal) | is_document(normal) if documents else ~is_resource(normal)
    return F.when(fine & follow, normal)


def content_identity(url: Column) -> Column:
    """The canonical url, with the two routes to one page of content folded into a third."""
    c = canonical(url)
    route = r"(?i)^(https://[^/?#]+)/p/(?:404|406)-(\d+)-(\d+)(?:,[^/?]+)?\.php(?=\?|$)"
    return F.regexp_replace(c, route, "$1/p/content-$2-$3.php")


def link_type(anchor: Column, url: Column) -> Column:
    """announcement by the anchor's words, document by the path, content with any anchor, else unknown."""
    a = F.lower(F.coalesce(anchor, F.lit("")))
    says = F.rlike(a, F.lit("|".join(ANNOUNCES)))
    return F.when(says, "announcement").when(is_document(url), "document").when(F.trim(a) != "", "content").otherwise("unknown")


def page_type(role: Column, items: Column) -> Column:
    """What a parsed page is, by its role and the number of announcements that it lists."""
    return F.when((role == "listing") | (items > 0), "announcement_listing").when(role == "detail", "announcement_detail").otherwise("general_page")
