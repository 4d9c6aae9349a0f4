"""Text functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\x0B\f　]+"


def normalized(text: Column) -> Column:
    """Lines with runs of blanks folded into one space, trimmed, blank lines dropped; null for null."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 hex of the normalised text."""
    return F.sha2(normalized(text).cast("binary"), 256)


def search_key(text: Column) -> Column:
    """Lower case without white space: what phrases are looked up in."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def letters_only(text: Column) -> Column:
    """Lower case, only ASCII letters and digits and common ideographs."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z㐀-鿿]+", "")


def set_apart(text: Column) -> Column:
    """The lower-cased words, three blanks apart, with two before and one behind."""
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one behind."""
    # In words that stand three blanks apart, any three characters are a trigram unless the last two are blanks.
    return F.array_distinct(F.regexp_extract_all(set_apart(text), F.lit("(?=(.(?!  )..))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members of two arrays; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both).cast("double")), F.lit(0.0))


def gram_list(term: str) -> list[str]:
    """The trigrams of a literal, made once with the plan instead of once a row."""
    import re

    padded = (f"  {w} " for w in re.findall(r"[^\W_]+", term.lower()))
    return list(dict.fromkeys(p[i : i + 3] for p in padded for i in range(len(p) - 2)))


def likeness_to(grams: Column, term: str) -> Column:
    """Trigram likeness of a literal to a column of distinct trigrams."""
    own = gram_list(term)
    if not own:
        return F.lit(0.0)
    both = F.size(F.array_intersect(grams, F.split(F.lit("\t".join(own)), "\t")))  # one literal, folded with the plan
    return both.cast("double") / (F.size(grams) + len(own) - both).cast("double")


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Distinct character n-grams of the letters; a single character is its own gram."""
    return key_ngrams(letters_only(F.coalesce(text, F.lit(""))), low, high)


def key_ngrams(t: Column, low: int = 2, high: int = 4) -> Column:
    """Distinct character n-grams of a text that is only letters."""

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1)))
        return F.when(F.length(t) >= n, F.transform(places, lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in range(low, high + 1)]
    return F.when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(F.concat(*grams)))


def coverage(haystack: Column, needles: list[str]) -> Column:
    """Share of the needles that the search key of the haystack contains; 0 without needles."""
    keys = [k for k in ("".join(n.lower().split()) for n in needles) if k]
    if not keys:
        return F.lit(0.0)
    key = search_key(haystack)
    return sum((F.contains(key, F.lit(k)).cast("int") for k in keys), F.lit(0)).cast("double") / len(keys)


def contains_either(title: Column, queries: list[str]) -> Column:
    """Whether the title's key contains a query's key or the other way round."""
    key = search_key(title)
    out = F.lit(False)
    for q in ("".join(q.lower().split()) for q in queries):
        if q:
            out = out | F.contains(key, F.lit(q)) | F.contains(F.lit(q), key)
    return out


#: What makes a message personal (case does not matter), and the mark that takes its place.
PERSONAL = r"(?:密碼|password|cookie|學號|成績|身分證|session\s*[:=]|token\s*[:=])|(?<![\p{L}\p{N}_])[A-Z][12]\p{Nd}{8}(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])\p{Nd}{8,10}(?![\p{L}\p{N}_])"
REDACTED = "[已隱去可能的個人或敏感資料]"


def is_personal(text: Column) -> Column:
    return F.rlike(text, F.lit(f"(?i){PERSONAL}"))


def redacted(text: Column, mark: str = REDACTED) -> Column:
    """The whole text gives way to a mark if it holds personal data."""
    return F.when(is_personal(text), F.lit(mark)).otherwise(text)


#: A date in a text, and the words that a deadline follows.
DATE = r"(\p{Nd}{3,4})[年\-/.](\p{Nd}{1,2})[月\-/.](\p{Nd}{1,2})日?"
DEADLINE = r"(?:截止(?:日|日期|時間)?|報名期限)[：:\s]*(\p{Nd}{3,4}[年\-/.]\p{Nd}{1,2}[月\-/.]\p{Nd}{1,2}日?)"


def parsed_date(text: Column) -> Column:
    """An ISO date or time, else the first year-month-day in the text; null if there is none or it is no date.

    Years before 1911 that are not in ISO form count from 1911.
    """
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:.[0-9]{2}(?::?[0-9]{2}.*)?)?$", 1)
    basic = F.regexp_replace(F.regexp_extract(t, r"^([0-9]{8})(?:.[0-9]{2}(?::?[0-9]{2}.*)?)?$", 1), r"^(....)(..)(..)$", "$1-$2-$3")
    part = lambda i: F.nullif(F.regexp_extract(t, DATE, i), F.lit(""))
    year = part(1).cast("int")
    year = F.when(year < 1911, year + 1911).otherwise(year)
    found = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(basic, F.lit("")), "yyyy-MM-dd"), F.when(part(3).isNotNull(), found))


def deadline(text: Column) -> Column:
    """The date right after the words for a deadline."""
    return parsed_date(F.nullif(F.regexp_extract(text, DEADLINE, 1), F.lit("")))


def term_count(text: Column, term: str) -> Column:
    """Occurrences of a literal term that do not overlap."""
    import re

    return F.regexp_count(text, F.lit(re.escape(term)))


#: SQL of (seq, content) of the windows of a text, each a step of characters and the beginning of the next one: one walk
#: cuts the text into blocks, so time is linear in its length. A null or empty text has one window.
WINDOWS = """transform(array(regexp_extract_all(coalesce({text}, ''), '(?s).{{1,{step}}}', 0)), b -> transform(
    sequence(0L, greatest(size(b) - 1L - if(size(b) > 1 and length(get(b, size(b) - 1)) <= {rest}, 1, 0), 0L)),
    i -> named_struct('seq', i, 'content', if({text} is null, null, concat(coalesce(get(b, cast(i as int)), ''), substring(coalesce(get(b, cast(i + 1 as int)), ''), 1, {rest}))))))[0]"""


def windows(text: Column, width: int, overlap: int) -> Column:
    """[(seq, content)] of windows of `width` characters that overlap, the last one ending with the text; none of an empty one.

    The text is cut once into blocks of a step, a window is some of them: linear in the text.
    """
    step = width - overlap
    more = -(-overlap // step)  # blocks behind a window's own that it reaches into
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    length = F.length(text)
    n = F.when(length <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((length - overlap) / step))).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda b: F.transform(places, lambda i: F.struct(i.cast("long").alias("seq"), F.substring(F.array_join(F.slice(b, i + 1, F.lit(more + 1)), ""), 1, width).alias("content")))
    return F.transform(F.array(blocks), cut)[0]


#: Identifiers that are not shown, and the characters that end a url.
INTERNAL_ID = r"[\[（(]?\s*\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b\s*[\]）)]?"
URL_STOP = r"\s<>\"'，。；：、！？）)\]}"


def sanitized(text: Column, allowed_urls: list[str] = ()) -> Column:
    """Text for output: without identifiers and without urls other than the allowed ones; blanks and lines tidied.

    Punctuation behind a url that goes stays.
    """
    import re

    plain = F.regexp_replace(text, INTERNAL_ID, "")
    end = rf"(?=[{URL_STOP}]|$)"
    kept = "|".join(re.escape(u) for u in sorted(allowed_urls, key=len, reverse=True))
    but = rf"(?!(?:{kept})[,.!?;:]*{end})" if allowed_urls else ""
    out = F.regexp_replace(plain, rf"{but}https?://(?=[^{URL_STOP}])[^{URL_STOP}]*?([,.!?;:]*){end}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+([，。；：、])", "$1"), r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)[\s&&[^\n]]+$", ""), r"^\s+|\s+$", "")


#: Questions that ask for announcements of any kind, and the polite beginnings that do not matter.
GENERIC = ("公告", "最新公告", "最近公告", "有哪些公告", "最近有哪些公告", "最新有哪些公告", "有什麼公告", "最近有什麼公告", "最新有什麼公告", "有那些公告", "最近有那些公告", "最新有那些公告", "有哪些最新公告", "有什麼最新公告", "有那些最新公告", "消息", "最新消息", "最近消息", "通知", "最新通知", "最近通知")
REQUESTS = ("想知道", "告訴我", "幫忙", "幫我", "查詢", "搜尋", "搜索", "列出", "請問", "看看", "可以", "麻煩", "請", "查", "找", "列")
#: Numerals of counts.
DIGITS = {"零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def is_generic(query: Column) -> Column:
    """Whether a question asks for announcements without a subject."""
    plain = F.regexp_replace(F.coalesce(query, F.lit("")), r"[\s　，。！？!?、：:；;「」『』（）()【】\[\]<>〈〉…]+", "")
    asked = F.regexp_replace(F.regexp_replace(plain, f"^(?:{'|'.join(REQUESTS)})+", ""), "一下$", "")
    return asked.isin(*GENERIC)


def count_of(told: Column) -> Column:
    """A count in digits or in numerals up to 999; null for anything else."""
    d = "".join(DIGITS)
    form = rf"^(?:([{d}])?(百))?(?:([{d}])?(十))?([{d}])?$"
    value = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv]), F.nullif(F.regexp_extract(told, form, i), F.lit(""))), F.lit(None).cast("int"))
    place = lambda digit, mark, worth: F.when(F.regexp_extract(told, form, mark) != "", F.coalesce(value(digit), F.lit(1)) * worth).otherwise(0)
    numeral = F.when((told != "") & F.rlike(told, F.lit(form)), place(1, 2, 100) + place(3, 4, 10) + F.coalesce(value(5), F.lit(0)))
    return F.coalesce(F.try_to_number(F.when(F.rlike(told, F.lit("^[0-9]{1,9}$")), told), F.lit("999999999")).cast("int"), numeral)


def clipped(text: Column, most: int) -> Column:
    """At most so many characters of a field for output."""
    return F.substring(text, 1, most)


def ordered_distinct(values: Column) -> Column:
    """First occurrences in order, nulls left out."""
    return F.array_distinct(F.array_compact(values))


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A vector that stands in for a learned one in tests: bytes of the text's SHA-256, again and again, within -1 and 1."""
    digest = F.sha2(text.cast("binary"), 256)
    byte = lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: byte(i) / 127.5 - 1.0)
