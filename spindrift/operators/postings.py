"""An inverted index of trigrams: which rows hold a gram, and how many grams they have, in files by gram.

A search reads the partitions of its own grams alone. Rows lie in blocks by a hash of their id; when rows change, the
blocks that they are in are made anew and no others. Tasks invert what they read in memory, run by run: a gram's row names
the places of its ids in the run's list of ids of about the same size, in about a byte each, and only these go to files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.shipping import ship

#: Files by gram, blocks of rows.
BUCKETS, BLOCKS = 64, 16
#: Postings that a task inverts at once, about, and texts whose grams it lists at once; the greatest size of a list over the smallest; what a list of ids has for a bucket.
RUN, PIECE, SPAN, IDS = 4_000_000, 2_048, 1.25, -1
#: Each task writes its own files of up to so many buckets and blocks; more would be too small, so rows are dealt by file then.
FILES = 64
#: A gram's places, or without a gram the ids themselves, of rows with `size` up to `top` grams.
INDEX = "block int, bucket int, gram string, run long, size int, top int, held binary"
#: Bits of a sort key: gram, list of ids, place.
_LIST, _PLACE = 14, 24


def _block(ident: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int")


def _packed(gaps: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Gaps of each row in a byte each, those of 255 and more in five."""
    small = gaps < 255
    ends = np.cumsum(np.where(small, 1, 5))
    out, at = np.empty(ends[-1] if len(ends) else 0, np.uint8), ends - np.where(small, 1, 5)
    out[at] = np.where(small, gaps, 255)
    for i in range(4):
        out[at[~small] + 1 + i] = gaps[~small] >> 8 * i & 255
    told, cuts = out.tobytes(), [*at[starts].tolist(), len(out)]
    return [told[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _places(held: bytes, n: int) -> np.ndarray:
    """The places, out of n, that a row of a gram names."""
    told = np.frombuffer(held, np.uint8)[1:]
    if held[0]:
        return np.flatnonzero(np.unpackbits(told, count=n))
    wide = np.flatnonzero(told == 255)
    if not len(wide):
        return np.cumsum(told, dtype=np.int64)
    out, at = [], 0  # a byte of a wide gap may be 255 itself
    while at < len(told):
        step = 5 if told[at] == 255 else 1
        out.append(int.from_bytes(told[at + 1 : at + 5].tobytes(), "little") if step == 5 else int(told[at]))
        at += step
    return np.cumsum(out)


def _inverted(parts: list[tuple[np.ndarray, ...]], names: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of the index of one run; parts: (block, id, size) of rows and the grams of all of them, as numbers into `names`."""
    block, ids, size, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
    span = (np.log(size) / np.log(SPAN)).astype(np.int64)
    order = np.lexsort((ids, span, block))
    new = np.r_[True, (block[order][1:] != block[order][:-1]) | (span[order][1:] != span[order][:-1])]
    first, own = np.flatnonzero(new), np.cumsum(new) - 1
    count = np.diff(np.r_[first, len(ids)])
    if len(first) >= 1 << _LIST or len(ids) >= 1 << _PLACE:
        raise ValueError(f"{len(ids)} rows in {len(first)} lists are too many for a run")
    where = np.empty(len(ids), np.int64)
    where[order] = own << _PLACE | np.arange(len(ids)) - first[own]
    key = grams.astype(np.int64) << _LIST + _PLACE | np.repeat(where, size)
    key.sort()
    place, row = (key & (1 << _PLACE) - 1).astype(np.int32), key >> _PLACE
    del key
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    row = row[starts]
    gaps = np.diff(place, prepend=np.int32(0))
    gaps[starts] = place[starts]
    lists, named = row & (1 << _LIST) - 1, row >> _LIST
    held, ends = _packed(gaps, starts), [*starts[1:].tolist(), len(place)]
    for r, (a, b, n) in enumerate(zip(starts.tolist(), ends, count[lists].tolist(), strict=True)):
        if len(held[r]) > n // 8 + 1:
            bits = np.zeros(n, bool)
            bits[place[a:b]] = True
            held[r] = b"\1" + np.packbits(bits).tobytes()
        else:
            held[r] = b"\0" + held[r]
    low, top = np.minimum.reduceat(size[order], first), np.maximum.reduceat(size[order], first)
    run, bucket = uuid.uuid4().int >> 66, np.array([zlib.crc32(g.encode()) % buckets for g in names])
    tables = [ids[order][a : a + n] for a, n in zip(first, count, strict=True)]
    tables = [np.diff(x, prepend=0).astype("<i8").tobytes() + size[order][a : a + len(x)].astype("<i4").tobytes() for a, x in zip(first, tables, strict=True)]
    for of, bucket, gram, kept in ((lists, bucket[named], [names[i] for i in named.tolist()], held), (np.arange(len(first)), np.full(len(first), IDS), [""] * len(first), tables)):
        columns = [block[order][first][of], bucket, gram, np.full(len(of), run), low[of], top[of], kept]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in INDEX.split(", ")])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(size, gram, names): how many distinct trigrams each text of words set apart by three blanks has, these text by text
    as numbers, and what the numbers stand for."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    signs, letters = _numbered(points, 0x110000)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    # Any three characters of a text are a trigram unless the last two are blanks.
    blank = points == 32
    whole = np.flatnonzero((row[2:] == row[:-2]) & ~(blank[1:-1] & blank[2:]))
    a = len(signs)
    told, gram = _numbered((letters[whole] * a + letters[whole + 1]) * a + letters[whole + 2], a**3)
    key = row[whole] << 32 | gram
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    of = [chr(c) for c in signs.tolist()]
    return np.bincount(key >> 32, minlength=len(texts)), (key & 0xFFFFFFFF).astype(np.int32), [of[t // a // a] + of[t // a % a] + of[t % a] for t in told.tolist()]


def _numbered(x: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct members in order, and the place of each; by a table where the bound of the members is small."""
    if below > 1 << 22:
        members, places = np.unique(x, return_inverse=True)
        return members, places.ravel()
    seen = np.zeros(below, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


def postings(rows: DataFrame, buckets: int = BUCKETS, blocks: int = BLOCKS, run: int = RUN) -> DataFrame:
    """Rows of the index (`INDEX`) for rows (id, text); texts without any trigram have none."""
    words = rows.select(_block(F.col("id").cast("long"), blocks).alias("block"), F.col("id").cast("long").alias("id"), text.set_apart(F.col("text")).alias("t"))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known, n = [], {}, 0
        for b in batches:
            block, ids, texts = b.column("block").to_numpy(), b.column("id").to_numpy(), b.column("t").to_pylist()
            for s in range(0, len(texts), PIECE):
                size, grams, names = _grams(texts[s : s + PIECE])
                number = np.array([known.setdefault(g, len(known)) for g in names], np.int32)
                some = size > 0
                if some.any():
                    parts.append((block[s : s + PIECE][some], ids[s : s + PIECE][some], size[some], number[grams]))
                n += len(grams)
                if parts and n >= run:
                    yield from _inverted(parts, list(known), buckets)
                    parts, known, n = [], {}, 0
        if parts:
            yield from _inverted(parts, list(known), buckets)

    ship(rows.sparkSession)
    return words.where("id is not null").mapInArrow(invert, INDEX)


def _write(rows: DataFrame, path: str, files: int) -> None:
    if files > FILES:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "bucket")
    # Sorted files let a reader skip what lies between its grams.
    rows.sortWithinPartitions("block", "bucket", "gram", "size").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("block", "bucket").parquet(path)


def build(rows: DataFrame, path: str, buckets: int = BUCKETS, blocks: int = BLOCKS) -> None:
    """Write the index of rows (id, text), one row an id, under a path of the shared storage."""
    _write(postings(rows, buckets, blocks).unionByName(_marks(rows.sparkSession, None, buckets, blocks)), path, buckets * blocks)


def update(rows: DataFrame, changed: DataFrame, path: str, buckets: int = BUCKETS, blocks: int = BLOCKS) -> None:
    """Make the blocks anew that hold ids of `changed` (id): rows that came, went or have another text. rows: the new table."""
    touched = [r.block for r in changed.select(_block(F.col("id").cast("long"), blocks).alias("block")).distinct().collect()]  # at most `blocks`
    if touched:
        _write(postings(rows.where(_block(F.col("id").cast("long"), blocks).isin(*touched)), buckets, blocks).unionByName(_marks(rows.sparkSession, touched, buckets, blocks)), path, buckets * blocks)


def _marks(spark: SparkSession, touched: list[int] | None, buckets: int, blocks: int) -> DataFrame:
    """A row without a gram for every file, so that a file whose grams all went is written anew too."""
    empty = {"gram": "''", "run": "0L", "size": "0", "top": "0", "held": "cast(null as binary)"}
    all_of = spark.range(0, blocks * (buckets + 1), 1, 1).selectExpr(f"cast(id % {blocks} as int) as block", f"cast(id div {blocks} as int) + {IDS} as bucket", *[f"{x} as {c}" for c, x in empty.items()])
    return all_of if touched is None else all_of.where(F.col("block").isin(*touched))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def _found(index: DataFrame, own: list[str], m: int, least: float, buckets: int, most: int | None = None) -> DataFrame:
    """(id, likeness) of rows that share one of the grams `own` with a query of m grams and are at least so like it by these
    alone; of each list of ids only the `most` best, if given."""
    files = sorted({zlib.crc32(g.encode()) % buckets for g in own})
    rows, ids = index.where(F.col("bucket").isin(*files) & F.col("gram").isin(*own)), index.where((F.col("bucket") == IDS) & F.col("held").isNotNull())
    if least > 0:
        rows, ids = (x.where((F.col("top") >= least * m - 1e-9) & (F.col("size") <= m / least + 1e-9)) for x in (rows, ids))

    def count(hits: pa.Table, listed: pa.Table) -> pa.Table:
        if not hits.num_rows or not listed.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "likeness": pa.array([], pa.float64())})
        told = listed.column("ids")[0].as_py()
        n = len(told) // 12
        found, size = np.zeros(n, np.int64), np.frombuffer(told, "<i4", offset=8 * n)
        for held in hits.column("held").to_pylist():
            found[_places(held, n)] += 1
        likeness = found / (size + m - found)
        kept = np.flatnonzero((found > 0) & (likeness >= least))
        if most is not None and len(kept) > most:
            kept = kept[np.argpartition(-likeness[kept], most - 1)[:most]]
        return pa.table({"id": np.cumsum(np.frombuffer(told, "<i8", n))[kept], "likeness": likeness[kept]})

    ship(index.sparkSession)
    key = ["run", "block", "size"]
    listed = ids.select(*[F.col(c).alias(f"{c}_") for c in key], F.col("held").alias("ids"))
    return rows.select(*key, "held").groupBy(*key).cogroup(listed.groupBy(*[f"{c}_" for c in key])).applyInArrow(count, "id long, likeness double")


def matches(index: DataFrame, query: str, least: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """(id, likeness) of rows that share a trigram with the query and are at least so like it.

    Files, grams and sizes are filtered in the scan: a row of s grams can be as like a query of m grams as the lesser
    over the greater of s and m at best.
    """
    own = text.gram_list(query)
    if not own:
        return index.select(F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("likeness")).limit(0)
    return _found(index, own, len(own), least, buckets)


def bound(index: DataFrame, query: str, k: int, least: float = 0.0, buckets: int = BUCKETS) -> float:
    """A likeness that the k-th best row reaches for certain: the k-th best of those with most of the query's grams in its
    first files, by what these alone say. A search from there on reads fewer rows and gives the same best ones."""
    own = sorted(text.gram_list(query), key=lambda g: (zlib.crc32(g.encode()) % buckets, g))
    if not own:
        return least
    best = _found(index, own[: max(1, len(own) // 2)], len(own), 0.0, buckets, k).select(F.col("likeness").alias("x")).orderBy(F.desc("x")).limit(k)
    low = best.agg(F.count("*").alias("n"), F.min("x").alias("x")).first()
    return max(least, low.x) if low.n == k else least


def top(index: DataFrame, query: str, k: int, least: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """(id, likeness, rank): the k rows most like the query, of equal ones the smaller ids."""
    from pyspark.sql import Window

    found = matches(index, query, bound(index, query, k, least, buckets), buckets).withColumn("_r", F.round("likeness", 12))
    best = [F.desc("_r"), F.asc("id")]
    return found.orderBy(*best).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*best))).drop("_r")
