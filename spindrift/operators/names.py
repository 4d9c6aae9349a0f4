"""Names of units in whole texts: one automaton over a registry of any size, spans of what it finds, and what they resolve to."""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.shipping import ship

#: Names that a registry may hold: it is sent to every task.
MOST = 100_000
#: What a unit's name ends with where it keeps shorter names inside it from counting, and what may stand
#: before it in a request.
WITHIN = ("學院", "學系", "研究所", "學程", "中心", "系", "所", "處", "組", "室")
BEFORE = ("請問", "麻煩", "幫我查", "幫我", "查詢", "查", "想知道", "比較", "以及", "還有", "和", "與", "及", "、")
#: The same where a name tells of a unit that is not known, and words that ask for announcements.
UNKNOWN = ("學院", "學系", "學程", "中心", "系", "處", "組", "室")
UNKNOWN_BEFORE = ("請問", "麻煩", "幫我查", "幫我", "查詢", "查", "想知道", "以及", "還有", "和", "與", "及", "、")
ASKS = ("公告", "最新", "消息", "訊息", "通知")
#: Words without which a route to a source does not count, and the one that prefers routes that begin with it.
ROUTED, INNER = ("獎學金", "獎助學金"), "校內"

_RUN = re.compile("[一-鿿A-Za-z0-9]+")


def unit_like(text: str, endings: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of at least two letters, digits or ideographs and the first ending behind them, from left to right.

    A run of such characters is walked once, so time is linear in the text. Of endings that begin at one place the one
    listed first counts.
    """
    out, ends = [], re.compile("|".join(map(re.escape, endings)))
    for run in _RUN.finditer(text):
        at = run.start()
        while (found := ends.search(text, at + 2, run.end())) is not None:
            out.append((at, found.end()))
            at = found.end()
    return out


class Names:
    """An automaton that is built again where it is needed; only the names travel.

    `own` are names of the institution itself, which may stand before a unit's in a request.
    """

    def __init__(self, names: list[str], own: tuple[str, ...] = ()):
        self.names, self.own = sorted({n for n in names if n}), tuple(own)
        self._automaton = None

    def __getstate__(self):
        return self.names, self.own

    def __setstate__(self, state):
        self.names, self.own = state
        self._automaton = None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name): from the left the longest name that begins there, without overlaps."""
        if not self.names or not text:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for n in self.names:
                self._automaton.add_word(n, n)
            self._automaton.make_automaton()
        longest: dict[int, str] = {}
        for end, name in self._automaton.iter(text):
            start = end + 1 - len(name)
            if len(name) > len(longest.get(start, "")):
                longest[start] = name
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                at = start + len(longest[start])
                out.append((start, at, longest[start]))
        return out

    def told(self, text: str) -> list[tuple[int, int, str]]:
        """Spans without those that lie inside the name of another unit."""
        known, found = set(self.names), self.spans(text)
        if not found:
            return []
        before = re.compile(f"^(?:{'|'.join(map(re.escape, (*self.own, *BEFORE)))})+")
        others = []
        for start, end in unit_like(text, WITHIN):
            name = before.sub("", text[start:end])
            if name and name not in known:
                others.append((end - len(name), end))
        out, k = [], 0
        for start, end, name in found:  # both lists go from left to right, and neither overlaps itself
            while k < len(others) and others[k][1] < end:
                k += 1
            if not (k < len(others) and others[k][0] <= start and end <= others[k][1]):
                out.append((start, end, name))
        return out

    def unknown(self, text: str) -> list[str]:
        """Names that look like a unit's and touch no known one, without what stands before them in a request."""
        known, out, k = self.told(text), set(), 0
        before = re.compile(f"^(?:{'|'.join(map(re.escape, UNKNOWN_BEFORE))})+")
        for start, end in unit_like(text, UNKNOWN):
            while k < len(known) and known[k][1] <= start:
                k += 1
            if k < len(known) and known[k][0] < end:
                continue
            name = before.sub("", text[start:end]).strip()
            if name:
                out.add(name)
        return sorted(out)


def names_of(registry: DataFrame, column: str = "alias", most: int = MOST, own: tuple[str, ...] = ()) -> Names:
    """The automaton of a registry's names, which must be bounded: it is held by the driver and every task."""
    rows = registry.select(F.trim(column).alias("n")).where("n <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the registry has more than {most} names")
    return Names([r.n for r in rows], own)


SPAN = "array<struct<start:int,end:int,alias:string>>"


def mentions(rows: DataFrame, text: str, names: Names, unit_aware: bool = False) -> DataFrame:
    """rows with `mentions`: spans (start, end, alias) of the names in a whole text; null texts have none."""
    spark = rows.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(names)

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        find = held.value.told if unit_aware else held.value.spans
        return pd.Series([[{"start": s, "end": e, "alias": a} for s, e, a in find(t or "")] for t in texts], dtype=object)

    return rows.withColumn("mentions", run(text))


def normalized(rows: DataFrame, text: str, directory: DataFrame, unit_aware: bool = False) -> DataFrame:
    """rows with `normal`: the trimmed text in which every alias gives way to its unit; directory: (alias, unit), one row an alias."""
    spark = rows.sparkSession
    ship(spark)
    names = names_of(directory)
    table = {r.alias: r.unit for r in directory.select(F.trim("alias").alias("alias"), F.trim("unit").alias("unit")).where("alias <> '' and unit <> ''").collect()}
    held = spark.sparkContext.broadcast((Names(list(table)), table)) if len(table) < len(names.names) else spark.sparkContext.broadcast((names, table))

    def one(t):
        if t is None:
            return None
        t, (own, units) = t.strip(), held.value
        out, at = [], 0
        for start, end, alias in own.told(t) if unit_aware else own.spans(t):
            out += [t[at:start], units[alias]]
            at = end
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return rows.withColumn("normal", run(text))


@dataclass(frozen=True)
class Directory:
    """What a name resolves to.

    aliases: (alias, unit); sources: (name, unit, enabled); units: (unit, enabled, strategy, source_name), strategy one of
    listing, scoped and unsupported; routes: (alias, source); own: names of the institution, see `Names`. A unit's own name
    is an alias of it.
    """

    aliases: DataFrame
    sources: DataFrame
    units: DataFrame
    routes: DataFrame
    own: tuple[str, ...] = ()

    def known(self) -> DataFrame:
        """(alias, unit), several rows where an alias stands for several units."""
        own = self.aliases.select(F.trim("alias").alias("alias"), F.trim("unit").alias("unit")).where("alias <> '' and unit <> ''")
        named = own.select(F.col("unit").alias("alias"), "unit").union(self.sources.select(F.trim("unit").alias("alias"), F.trim("unit").alias("unit")))
        return own.union(named).distinct()


LISTING, SCOPED, UNVERIFIED = "known_unit_with_listing", "known_unit_with_scoped_search", "known_unit_without_verified_site"
RESOLVED = "key, status string, requested string, unit string, candidates array<string>, source string"


def resolved(rows: DataFrame, key: str, unit: str, query: str, directory: Directory) -> DataFrame:
    """(key, status, requested, unit, candidates, source): what each question (a requested unit, a query; both may be null) is about.

    One known unit and no unknown one resolves to its source, its scoped search or neither; several, or known and unknown
    ones, are ambiguous. Unknown units count in a query only if it asks for announcements. A route stands for a source
    where the words for it are there. One row a key in, one out.
    """
    spark = rows.sparkSession
    ship(spark)
    known = directory.known()
    own = spark.sparkContext.broadcast((names_of(known, own=directory.own), names_of(directory.routes)))

    @F.pandas_udf("aliases array<string>, unknown array<string>, routes array<string>")
    def read(units: pd.Series, queries: pd.Series) -> pd.DataFrame:
        names, routes = own.value
        out = []
        for u, q in zip(units, queries, strict=True):
            u, q = (u or "").strip(), q or ""
            unknown = set(names.unknown(u)) | (set(names.unknown(q)) if any(a in q for a in ASKS) else set())
            whole = " ".join(x for x in (u, q.strip()) if x)
            found = [a for _, _, a in routes.spans(whole)] if any(w in whole for w in ROUTED) else []
            inner = [a for a in found if a.startswith(INNER)] if INNER in whole else []
            out.append((sorted({a for t in (u, q) for _, _, a in names.told(t)}), sorted(unknown), sorted(set(inner or found))))
        return pd.DataFrame(out, columns=["aliases", "unknown", "routes"])

    c = F.col
    asked = rows.select(c(key).alias("_k"), F.trim(F.coalesce(unit, F.lit(""))).alias("_u"), F.trim(F.coalesce(query, F.lit(""))).alias("_q"), read(unit, query).alias("m")).select("_k", "_u", "_q", "m.*")
    units = asked.select("_k", F.explode("aliases").alias("alias")).join(known, "alias").groupBy("_k").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    source = directory.sources.select(F.col("name").alias("source"), F.trim("unit").alias("s_unit"), F.col("enabled").alias("s_enabled"))
    routed = asked.select("_k", F.explode("routes").alias("alias")).join(directory.routes.select(F.trim("alias").alias("alias"), "source"), "alias").join(source, "source").groupBy("_k").agg(F.array_sort(F.collect_set(F.struct("source", "s_unit", "s_enabled"))).alias("via"))
    enabled = directory.sources.where("enabled").groupBy(F.trim("unit").alias("_unit")).agg(F.array_sort(F.collect_list("name")).alias("own_sources"))
    official = directory.units.select(F.col("unit").alias("_unit"), F.struct(c("enabled"), c("strategy"), c("source_name")).alias("official"))
    empty = F.array().cast("array<string>")
    all_of = asked.join(units, "_k", "left").join(routed, "_k", "left").withColumn("units", F.coalesce("units", empty)).withColumn("_unit", F.when(F.size("units") == 1, c("units")[0]))
    all_of = all_of.join(enabled, "_unit", "left").join(official, "_unit", "left")
    n, odd, via = F.size("units"), F.size("unknown"), F.coalesce(F.size("via"), F.lit(0))
    one, mine = c("via")[0], F.filter(F.coalesce("own_sources", empty), lambda s: s == c("official.source_name"))
    requested = F.when(c("_u") != "", c("_u")).otherwise(c("_q"))

    def said(status, unit=None, candidates=None, source=None, asked_for=None):
        text = F.lit(None).cast("string")
        return F.struct(F.lit(status).alias("status"), (requested if asked_for is None else asked_for).alias("requested"), (text if unit is None else unit).alias("unit"), (empty if candidates is None else F.array_sort(candidates)).alias("candidates"), (text if source is None else source).alias("source"))

    rules = [
        ((n > 0) & (odd > 0), said("ambiguous", candidates=F.array_union("units", "unknown"))),
        (n > 1, said("ambiguous", candidates=c("units"))),
        (odd > 1, said("ambiguous", candidates=c("unknown"))),
        (odd == 1, said("unknown", asked_for=c("unknown")[0])),
        (via > 1, said("ambiguous", candidates=F.transform("via", lambda v: v["source"]))),
        ((via == 1) & (n > 0) & ~F.array_contains("units", one["s_unit"]), said("ambiguous", candidates=F.array_union("units", F.array(one["s_unit"])))),
        ((via == 1) & ~one["s_enabled"], said(UNVERIFIED, unit=one["s_unit"])),
        (via == 1, said(LISTING, unit=one["s_unit"], source=one["source"])),
        ((n == 0) & (c("_u") != ""), said("unknown")),
        (n == 0, said("none")),
        (c("official").isNotNull() & (~c("official.enabled") | (c("official.strategy") == "unsupported")), said(UNVERIFIED, unit=c("_unit"))),
        (c("official").isNotNull() & (c("official.strategy") == "scoped"), said(SCOPED, unit=c("_unit"))),
        (c("official").isNotNull() & (F.size(mine) == 1), said(LISTING, unit=c("_unit"), source=mine[0])),
        (c("official").isNotNull() | c("own_sources").isNull(), said(UNVERIFIED, unit=c("_unit"))),
        (F.size("own_sources") > 1, said("ambiguous", candidates=F.array(c("_unit")))),
    ]
    chain = None
    for when, value in rules:
        chain = F.when(when, value) if chain is None else chain.when(when, value)
    return all_of.select(c("_k").alias(key), chain.otherwise(said(LISTING, unit=c("_unit"), source=c("own_sources")[0])).alias("r")).select(key, "r.*")
