"""How far the sources of a language differ in their words: smoothed term shares compared exactly.

Single-pass in-memory indexing: a task counts the terms of its documents in memory until a block is full and spills it
as runs sorted by term, one a hash shard and language. The runs of a shard are merged over a heap into frequencies:
chunks come sorted by their first term, so at any time only those whose range is reached are open. Distances of pairs
of sources start from the shares of absent terms and are corrected in a stream: once for the terms that a source has,
once for those that both have.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import forget, shipped, shuffle_partitions, spread_join, written

#: Documents of its language that a kept term occurs in at least; weight of a term never seen; ranks of terms given.
LEAST_DOCS, UNSEEN, TOP = 30, 5, 50
#: Entries of a block in memory, entries of a chunk of a run, bytes of a text that are split at once.
BLOCK, CHUNK, SLICE = 400_000, 4_096, 1 << 20
#: Entries of open chunks from which on a merge takes off what is complete.
OPEN = 200_000
#: Shards for each shuffle partition; sources of a language compared in one piece of work, and postings in one: as many as
#: this, and as many times the pairs of sources that it may tell of.
SHARDS, SIDE, POSTINGS, PAIRS = 4, 256, 2_000, 4

#: Bytes of a term: A-Z lower-cased, a-z and all beyond ASCII; others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes):
    """Lists of the terms of a text in UTF-8, a slice at a time."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _runs(shards: int, most: int = BLOCK, chunk: int = CHUNK):
    """Documents (lang, source, text) to chunks of term-sorted runs."""

    def spill(counts, docs, rows):
        """The block as one table, sorted by shard, language and term, and cut into a row a chunk."""
        cols: list[list] = [[], [], [], [], [], []]
        for group, own in counts.items():
            lang, source = group
            seed = zlib.crc32(f"{lang}\0{source}".encode("utf-8", "surrogatepass"))
            cols[0] += [zlib.crc32(t, seed) % shards for t in own]
            cols[1] += [lang] * len(own)
            cols[2] += own
            cols[3] += [source] * len(own)
            cols[4] += own.values()
            cols[5] += map(docs[group].__getitem__, own)
        for (lang, source), n in rows.items():  # the empty term stands for the group itself
            for c, x in zip(cols, (0, lang, b"", source, n, 0), strict=True):
                c.append(x)
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "lang", "term", "source", "n", "docs"])
        cols.clear()
        table = table.sort_by([(c, "ascending") for c in ("shard", "lang", "term")]).combine_chunks()
        shard, lang, term, source, n, seen = (table.column(i).combine_chunks() for i in range(6))
        code, at = lang.dictionary_encode().indices.to_numpy(), shard.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (code[1:] != code[:-1])]))
        cuts = np.concatenate([np.arange(s, e, chunk) for s, e in zip(starts, [*starts[1:], len(at)], strict=True)])
        for s in range(0, len(cuts), 256):
            own, end = cuts[s : s + 256], cuts[s + 256] if s + 256 < len(cuts) else len(at)
            offsets, first = pa.array(np.append(own, end) - own[0], pa.int32()), pa.array(own)
            lists = [pa.ListArray.from_arrays(offsets, c.slice(own[0], end - own[0])) for c in (term, source, n, seen)]
            yield pa.RecordBatch.from_arrays([shard.take(first), lang.take(first), term.take(first), *lists], names=["shard", "lang", "first", "terms", "sources", "n", "docs"])

    def run(batches):
        counts, docs, rows, held = defaultdict(Counter), defaultdict(Counter), Counter(), 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                group = lang, source
                own, seen = counts[group], set()
                before = len(own)
                rows[group] += 1
                for part in terms(text.as_py()):
                    own.update(part)
                    seen.update(part)
                docs[group].update(seen)
                held += len(own) - before
                if held >= most:  # between documents, so that each is counted in one run
                    yield from spill(counts, docs, rows)
                    counts.clear(), docs.clear(), rows.clear()
                    held = 0
        if rows:
            yield from spill(counts, docs, rows)

    return run, "shard int, lang string, first binary, terms array<binary>, sources array<string>, n array<long>, docs array<long>"


def _summed(parts: list[pa.Table]) -> pa.Table:
    """Entries (term, source, n, docs) of several runs; equal ones are added up."""
    return pa.concat_tables(parts).group_by(["term", "source"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["term", "source", "n", "docs"])


def merged(chunks, most: int = OPEN):
    """Tables (term, source, n, docs) of one shard and language, every entry once.

    Chunks (tables, sorted by term) come by their first term and lie open on a heap by the next one. Once they hold over
    `most` entries, all that is below the first term of the coming chunk is complete: it is taken off the heap, chunk by
    chunk, and added up; what is left of a chunk goes back.
    """
    heap, held = [], 0

    def below(first):
        nonlocal held
        parts, back = [], []
        while heap and (first is None or heap[0][0] < first):
            _, k, chunk, at = heapq.heappop(heap)
            end = chunk.num_rows if first is None else _place(chunk, at, first)
            parts.append(chunk.slice(at, end - at))
            held -= end - at
            if end < chunk.num_rows:
                back.append((chunk["term"][end].as_py(), k, chunk, end))
        for entry in back:
            heapq.heappush(heap, entry)
        if parts:
            yield _summed(parts)

    for k, chunk in enumerate(chunks):
        first = chunk["term"][0].as_py()
        if held > most:
            yield from below(first)
        heapq.heappush(heap, (first, k, chunk, 0))
        held += chunk.num_rows
    yield from below(None)


def _place(chunk: pa.Table, low: int, first: bytes) -> int:
    """How many entries of a chunk come before a term."""
    column, high = chunk["term"], chunk.num_rows
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if column[middle].as_py() < first else (low, middle)
    return low


def _merge():
    """Chunks sorted by (shard, lang, first) to frequencies (lang, term, source, n, docs)."""

    def rows(batches):
        for b in batches:
            lists = [b.column(c) for c in ("terms", "sources", "n", "docs")]
            for i, (shard, lang) in enumerate(zip(b.column("shard").to_pylist(), b.column("lang").to_pylist(), strict=True)):
                yield (shard, lang), pa.Table.from_arrays([c.slice(i, 1).flatten() for c in lists], names=["term", "source", "n", "docs"])

    def run(batches):
        for (_, lang), part in groupby(rows(batches), key=lambda r: r[0]):
            for table in merged(chunk for _, chunk in part):
                yield from table.add_column(0, "lang", pa.array([lang], pa.string()).take(pa.array(np.zeros(table.num_rows, np.int32)))).to_batches(max_chunksize=20_000)

    return run, "lang string, term binary, source string, n long, docs long"


def frequencies(docs: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, term, source, n, docs): occurrences and documents of every term in every (lang, source) of documents.

    The term that is empty stands for the group itself and counts its rows, so that groups without terms are there.
    """
    n = shuffle_partitions(shipped(docs).sparkSession)
    run, schema = _runs(SHARDS * n, block, chunk)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    runs = read.mapInArrow(run, schema)
    merge, schema = _merge()
    return runs.repartition(n, "shard").sortWithinPartitions("shard", "lang", "first").mapInArrow(merge, schema)


def _share(n: Column, whole: Column, v: Column) -> Column:
    """1 + floor(1000000000 * (n + 5) / (whole + 5 v)) in exact integers; 0 where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = wide(whole) + wide(v) * F.lit(UNSEEN)
    up = wide(n + F.lit(UNSEEN)) * F.lit(1_000_000_000).cast("decimal(10,0)")
    rest = up % below
    return F.when(v > 0, F.lit(1) + ((up - rest) / below).cast("decimal(20,0)").cast("long")).otherwise(F.lit(0).cast("long"))


def absent(others: np.ndarray, values: np.ndarray, times: np.ndarray, own: int, v: int) -> np.ndarray:
    """For each other source (share of a term it lacks): sum over the own terms of |p - other| - |own - other|.

    values: the distinct shares of the own terms, ascending; times: terms with each; own: share of a term not there.
    """
    many, sums = np.concatenate([[0], np.cumsum(times)]), np.concatenate([[0], np.cumsum(times * values)])
    at = np.searchsorted(values, others, "right")
    total = sums[-1] - 2 * sums[at] + others * (2 * many[at] - many[-1])
    return total - many[-1] * np.abs(own - others)


def _absent_rows():
    """Rows (lang, at, base, v, hist, others) to (lang, a, b, f): distances as if no term were in both sources."""
    names = ["lang", "a", "b", "f"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                lang, at, base, v, hist, others = (c.to_pylist()[0] for c in b.slice(i, 1).columns)
                hist = sorted((h["p"], h["times"]) for h in hist or [])
                values, times = (np.array([h[j] for h in hist], np.int64) for j in (0, 1))
                ids, bases = (np.array([o[j] for o in others if o["at"] != at], np.int64) for j in ("at", "base"))
                if not len(ids):
                    continue
                mine = absent(bases, values, times, base, v)
                me = np.full(len(ids), at)
                a, o = np.concatenate([me, ids]), np.concatenate([ids, me])
                f = np.concatenate([v * np.abs(base - bases) + mine, mine])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a), pa.array(o), pa.array(f)], names=names)

    return run, "lang string, a long, b long, f long"


def both(p: np.ndarray, p0: np.ndarray, q: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """What a term adds to the distances of the sources (rows, columns) that have it, beyond what `absent` said of each."""
    p, p0 = p[:, None], p0[:, None]
    return np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0)


def _both_rows(side: int):
    """Postings (lang, lo, hi, part, term, at, p, base) sorted so, to (lang, a, b, f): one matrix of a pair of blocks is held."""
    names = ["lang", "a", "b", "f"]

    def out(key, sums):
        x, y = np.nonzero(sums)
        a, b = x + key[1] * side, y + key[2] * side
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * (2 * len(a))), pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.tile(sums[x, y], 2))], names=names)

    def add(sums, key, at, p, base):
        rows, columns = at // side == key[1], at // side == key[2]
        x, y = at[rows] - key[1] * side, at[columns] - key[2] * side
        more = both(p[rows], base[rows], p[columns], base[columns])
        sums[np.ix_(x, y)] += np.triu(more, 1) if key[1] == key[2] else more

    def run(batches):
        key, sums, term, held = None, None, None, []

        def close():
            if held:
                add(sums, key, *(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)
            cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now, word = tuple(c[s] for c in cols[:4]), cols[4][s]
                if now != key or word != term:
                    close()
                if now != key:
                    if key is not None:
                        yield from out(key, sums)
                    key, sums = now, np.zeros((side, side), np.int64)
                term = word
                held.append([c[s:e] for c in cols[5:]])
        close()
        if key is not None:
            yield from out(key, sums)

    return run, "lang string, a long, b long, f long"


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, side: int = SIDE) -> DataFrame:
    """(lang, source, part, item, value, rank): sources of each language by how far they differ, and their own terms.

    `pair`: every other source of the language, value being the distance of their shares over all kept terms, all ranks.
    `term`: terms that a source has more of than its language, up to rank `top`. Shares are whole billionths, sums are
    exact. Null text, lang and source count as empty ones; a group without terms takes part; repeated rows count as
    often as they come; a language that keeps no term has distances of 0 and no terms. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    found = written(frequencies(docs, block, chunk), "frequencies")
    word = F.col("term").cast("string")
    held = F.collect_list(F.struct("source", "n"))  # a posting for each source of the language
    kept = written(found.where("length(term) > 0").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), held.alias("in")).where(F.col("docs") >= least).select("lang", word.alias("term"), "whole", "in"), "kept")
    posted = kept.select("lang", "term", F.explode("in").alias("e")).select("lang", "term", "e.source", "e.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_size"), F.sum(F.size("in").cast("long")).alias("postings"))
    sizes = posted.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    named = found.where("length(term) = 0").groupBy("lang", "source").agg(F.sum("n").alias("rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    of_lang = Window.partitionBy("lang")
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("size", "terms", "v", "lang_size", "postings")))
    groups = groups.withColumn("base", _share(F.lit(0).cast("long"), F.col("size"), F.col("v"))).withColumn("at", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long"))
    groups = written(groups.withColumn("sources", F.count("*").over(of_lang)), "groups")  # a row for each (lang, source)
    forget(found)

    total = kept.agg(F.coalesce(F.sum(F.size("in")), F.lit(0))).first()[0]
    shared = spread_join(posted, groups.where("terms > 0"), ["lang", "source"], "terms", total).withColumn("p", _share(F.col("n"), F.col("size"), F.col("v")))
    shared = written(shared.select("lang", "term", "source", "at", "sources", "postings", "base", "p"), "shares")

    hist = shared.groupBy("lang", "at", "p").agg(F.count("*").alias("times")).groupBy("lang", "at").agg(F.collect_list(F.struct("p", "times")).alias("hist"))
    blocks = (F.floor((F.col("sources") - 1) / side) + 1).cast("long")
    others = groups.groupBy("lang", F.floor(F.col("at") / side).alias("o")).agg(F.collect_list(F.struct("at", "base")).alias("others"))
    asked = groups.join(hist, ["lang", "at"], "left").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).join(others, ["lang", "o"])
    far, schema = _absent_rows()
    parts = asked.select("lang", "at", "base", "v", "hist", "others").repartition(n).mapInArrow(far, schema)

    own = F.floor(F.col("at") / side)
    piece = F.greatest(F.lit(POSTINGS), PAIRS * F.pow(F.least("sources", F.lit(side)), 2))
    dealt = shared.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("lang", F.least(own, "o").alias("lo"), F.greatest(own, "o").alias("hi"), F.pmod(F.xxhash64("term"), (F.col("postings") / piece).cast("long") + 1).alias("part"), "term", "at", "p", "base")
    near, schema = _both_rows(side)
    parts = parts.union(dealt.repartition(n, "lang", "lo", "hi", "part").sortWithinPartitions("lang", "lo", "hi", "part", "term", "at").mapInArrow(near, schema))
    label = lambda c, name: groups.select("lang", F.col("at").alias(c), F.col("source").alias(name))
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("f").alias("value")).join(label("a", "source"), ["lang", "a"]).join(label("b", "item"), ["lang", "b"])

    q = _share(F.col("whole"), F.col("lang_size"), F.col("v"))
    usual = kept.join(F.broadcast(langs) if langs.count() < 10_000 else langs, "lang").select("lang", "term", q.alias("q"))
    more = shared.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return ranked(pairs, "pair").union(ranked(more, "term").where(F.col("rank") <= top))


def op12(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank over documents (lang, source, text); cases as in `audit`."""
    return audit(docs)


ORACLE = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), w as (
  select lang, source, id, term, count(*) as n from (select lang, source, id, unnest(words) as term from d) group by all
), kept as (
  select lang, term from w group by lang, term having count(*) >= 30
), v as (
  select lang, cast(count(*) as hugeint) as v from kept group by lang
), c as (
  select lang, source, term, cast(sum(n) as hugeint) as n from w semi join kept using (lang, term) group by all
), groups as (
  select g.lang, g.source, coalesce(v.v, 0) as v, coalesce(sum(c.n), 0) as size
  from (select distinct lang, source from d) g left join v using (lang) left join c on c.lang = g.lang and c.source = g.source group by all
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.size + 5 * g.v) as p
  from groups g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), q as (
  select lang, term, 1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * any_value(v)) as p
  from c join v using (lang) group by lang, term
), pair as (
  select a.lang, a.source, b.source as item, coalesce(f.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
    on f.lang = a.lang and f.source = a.source and f.item = b.source
), term as (
  select p.lang, p.source, p.term as item, p.p - q.p as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.p
), both_parts as (
  select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
where part = 'pair' or rank <= 50
"""
