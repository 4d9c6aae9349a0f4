"""Near copies by the likeness of their word shingles: balls of fingerprints bring candidates together, exact Jaccard decides.

A text is the set of its word shingles. Equal sets are folded first. Each remaining set has `WORDS` SimHash fingerprints
of 64 bits, and each of these is searched by meet-in-the-middle ball hashing: it emits all variants within one bit of each
of its `BLOCKS` blocks, so that fingerprints within 11 bits always meet, and wider ones where a block differs in two bits
or fewer. At a Jaccard of 0.8 a bit differs with a probability of at most 0.152 and a block of 16 in two bits or fewer
with 0.55, so that of these pairs all but 3 in a million meet in one of the 16 blocks, and likelier ones sooner. Where
few members make the majority of a bit a coarse thing (at most `TINY` shingles in both together), sets within 0.8 differ
in one member: those meet exactly, the larger one emitting the sets that lack one of its members.

What meets is compared on two fingerprints (at most `NEAR` bits in one and `WIDE` in both: 1 in 1,000 of the pairs at 0.8
is lost to that in a block, and one in 10 million others passes), and linked only if its exact Jaccard over 64-bit shingle
hashes reaches 0.8, in whole numbers. Pairs that the first fingerprint has joined are not looked at again. Where a variant
gathers more near pairs than a few a row, only a spanning forest of them is listed, so that rows stay linear. Large trees
that share members make a crowd; if links leave a crowd in parts, its members are compared with each other inside tasks,
by chunks of bounded size, so no candidate is dropped. Pairs of a crowd of the first fingerprint are not listed for others.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import simhash
from spindrift.llm.common import forget, shipped, shuffle_partitions, spread_join, written
from spindrift.llm.graph import connected_components

#: Words of a shingle.
SHINGLE = 5
#: Fingerprints of a set, and blocks that each is cut into.
WORDS, BLOCKS = 4, 4
#: Differing bits of the fingerprint that met, and of it and the next one, up to which a pair is a candidate.
NEAR, WIDE = 18, 30
#: Members of two sets together up to which those of Jaccard 0.8 differ in one member at most.
TINY = 9
#: Rows of a variant in one task; with more, pairs of parts of this size are dealt.
GROUP = 8_192
#: Up to this many rows of a variant are compared together with those of other variants; larger trees are crowds.
SMALL = 5
#: Near pairs a row from which on a variant gives a forest.
DENSE = 2
#: Sets of a crowd, and members of these sets, in a chunk.
CHUNK, SPAN = 512, 1 << 17
#: 64-bit words of a sieve of ids at most, one or two an id below that.
SIEVE = 1 << 20
#: Rows compared at once with all others of their variant.
TILE = 128


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; fewer words: the whole sequence; none: empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = {b" ".join(words)} if len(words) <= shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams)))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """The fingerprints of a set that is not empty: the first of its hashes as they are, the others of hashes of those."""
    words = [simhash.majority(h)]
    for t in range(1, WORDS):
        x = h + np.uint64(0x9E3779B97F4A7C15 * t % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(simhash.majority(x ^ (x >> np.uint64(31))))
    return np.array(words, np.uint64)


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def alike(shared, n, m):
    """Whether Jaccard is at least 0.8, by shared and own members."""
    return shared * 9 >= (n + m) * 4


def _sketch(batches):
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column(1)]
        words = pa.array([fingerprints(h).view(np.int64) if len(h) else None for h in sets], pa.list_(pa.int64()))
        less = pa.array([[_digest(np.delete(h, i)) for i in range(len(h))] if 1 < len(h) <= TINY else None for h in sets], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array([len(h) for h in sets], pa.int32()), words, less], names=["id", "digest", "n", "words", "less"])


def _members(batches):
    for b in batches:
        sets = pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["id", "s"])


def _near(rows, i, j):
    """Whether rows i and j are to be compared: near, in no part or crowd together, and without a variant that both reach the same way."""
    _, flip, f, g, _, part, crowd = rows
    bits = np.bitwise_count(f[i] ^ f[j])
    ok = (bits <= NEAR) & (part[i] != part[j]) & (crowd[i] != crowd[j]) & ((flip[i] != flip[j]) | (flip[i] == 0))
    i, j, bits = i[ok], j[ok], bits[ok]
    ok = bits + np.bitwise_count(g[i] ^ g[j]) <= WIDE
    return i[ok], j[ok]


def _group(rows, s: int, e: int):
    """Near pairs of the rows s to e of one variant; None if there are more than `DENSE` a row."""
    f, left, right, n = rows[2], [], [], 0
    for at in range(s, e, TILE):
        met = np.bitwise_count(f[at : min(at + TILE, e), None] ^ f[None, at:e]) <= NEAR
        i, j = np.nonzero(met)
        i, j = _near(rows, i[j > i] + at, j[j > i] + at)
        left.append(i)
        right.append(j)
        n += len(i)
        if n > DENSE * (e - s):
            return None
    return np.concatenate(left), np.concatenate(right)


def _trees(rows, s: int, e: int):
    """Trees of near rows, each as its rows and the pairs that span it: every row is searched from once."""
    f, g = rows[2], rows[3]
    todo = np.arange(s, e)
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        own, pairs = list(queue), []
        while queue and len(todo):
            at = queue.pop()
            bits = np.bitwise_count(f[todo] ^ f[at])
            near = (bits <= NEAR) & (bits + np.bitwise_count(g[todo] ^ g[at]) <= WIDE)
            hit, todo = todo[near], todo[~near]
            queue += hit.tolist()
            own += hit.tolist()
            pairs += [(at, x) for x in hit.tolist()]
        yield np.array(own), pairs


def _candidates(rows):
    """(a, b, crowd) of sorted (key, flip, f, g, rep, part, crowd) with whole keys: candidates, and whether they span a crowd."""
    key, flip, rep, part, crowd = rows[0], rows[1], rows[4], rows[5], rows[6]
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(key)))
    left, right, spans = [], [], []
    size, end = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes)
    few = np.flatnonzero((size > 1) & (size <= SMALL))
    for d in range(1, SMALL):
        few = few[few + d < end[few]]
        i, j = _near(rows, few, few + d)
        left.append(rep[i])
        right.append(rep[j])
    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        e = s + m
        if flip[s] and (flip[s:e] == flip[s]).all():
            continue
        found = _group(rows, s, e)
        if found is not None:
            left.append(rep[found[0]])
            right.append(rep[found[1]])
            continue
        for own, pairs in _trees(rows, s, e):
            if (part[own] == part[own[0]]).all() or (crowd[own] == crowd[own[0]]).all():
                continue
            if len(own) > SMALL:
                spans.append(rep[np.array(pairs)])
            else:
                i, j = _near(rows, *own[np.array(np.triu_indices(len(own), 1))])
                left.append(rep[i])
                right.append(rep[j])
    listed = np.stack([np.concatenate(left), np.concatenate(right)], 1)
    for pairs, span in ((listed, False), (np.concatenate(spans) if spans else listed[:0], True)):
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1], pa.int64()), pa.array(pairs[:, 0], pa.int64()), pa.array(np.full(len(pairs), span))], names=["a", "b", "crowd"])


def _meet(batches):
    """`_candidates` of sorted rows, a key being held until its last row is there."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield from _candidates([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
    if held is not None:
        yield from _candidates(held)


def _met(nodes: DataFrame) -> DataFrame:
    """Candidates of (rep, part, crowd, f, g), f being searched: (a, b, crowd) as `_candidates` gives them."""
    n = shuffle_partitions(nodes.sparkSession)
    rows = simhash.balls(nodes, "f", BLOCKS)
    # At most BLOCKS * 2^16 keys, far fewer of them crowded.
    crowded = written(rows.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_c")).where("_c > 1"), "crowded")
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("rep"), F.col("_c")).cast("int")
        placed = rows.join(F.broadcast(crowded), "key", "left").withColumn("_own", own)
        each = placed.withColumn("_o", F.explode(F.when(F.col("_c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_c") - 1))))
        part = F.xxhash64("key", F.least("_own", "_o"), F.greatest("_own", "_o"))
        rows = each.select(F.when(F.col("_c").isNull(), F.col("key")).otherwise(part).alias("key"), *rows.columns[1:])
    rows = rows.select("key", "flip", "f", "g", "rep", "part", "crowd")
    return written(_numbers(rows.repartition(n, "key").sortWithinPartitions("key")), "candidates")


def _numbers(rows: DataFrame) -> DataFrame:
    def run(batches):
        yield from _meet(pa.RecordBatch.from_arrays([*b.columns[:2], *(b.column(c).view(pa.uint64()) for c in (2, 3)), *b.columns[4:]], names=b.schema.names) for b in batches)

    return rows.mapInArrow(run, "a long, b long, crowd boolean")


def joins(sets: list[np.ndarray], parts: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the given parts of one group as all its links would: each set is searched from once at most."""
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    here, todo, links = np.zeros(flat.max() + 1, bool), np.ones(len(sets), bool), []
    while todo.any():
        own = todo & (parts == parts[np.argmax(todo)])
        queue = list(np.flatnonzero(own))
        todo &= ~own
        while queue and todo.any():
            at = queue.pop()
            mine = flat[starts[at] : starts[at] + size[at]]
            here[mine] = True
            near = todo & alike(np.add.reduceat(here[flat], starts, dtype=np.int64), size, size[at])
            here[mine] = False
            for part in np.unique(parts[near]):
                links.append((at, int(np.flatnonzero(near & (parts == part))[0])))
                grown = todo & (parts == part)
                queue += list(np.flatnonzero(grown))
                todo &= ~grown
    return links


def _compare(batches):
    """Links (a, b) of sorted (key, rep, part, s), whole keys at a time."""
    now, held = None, []

    def done():
        found = joins([s for _, _, s in held], np.array([p for _, p, _ in held]))
        pairs = [(held[i][0], held[j][0]) for i, j in found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)] if pairs else [pa.array([], pa.int64())] * 2, names=["a", "b"])

    for b in batches:
        for i, (k, rep, part) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
            if held and k != now:
                yield done()
                held = []
            now = k
            held.append((rep, part, b.column(3)[i].values.to_numpy(zero_copy_only=False)))
    if held:
        yield done()


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of the texts of `nodes` (id), and of a few others: texts are sieved where they lie and do not move."""
    size = min(SIEVE, 1 << nodes.count().bit_length())
    word, bit = F.pmod(F.xxhash64("id"), F.lit(size)).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), 58) as int))")
    sieve = nodes.select(word, bit.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text").select("id", "text", word, bit.alias("own"))
    found = texts.join(F.broadcast(sieve), "w").where(F.col("m").bitwiseAND(F.col("own")) != 0).select("id", "text")
    return written(found.mapInArrow(_members, "id long, s array<long>"), "sets")


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the candidates (a, b) whose sets are alike."""
    sets = _sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    out = written(both.where(alike(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b"), "links")
    forget(sets)
    return out


def _chunks(members: DataFrame) -> DataFrame:
    """(key, rep, part) of the crowds of (rep, crowd, part, n) in several parts: members of different parts share a key.

    The largest part of a crowd and the rest are each cut into chunks. Each chunk of the rest meets all chunks, so the
    largest part moves as often as the rest has chunks; chunks of the largest part do not meet.
    """
    parts = members.groupBy("crowd", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    chunks = lambda rows, n: F.ceil(F.greatest(rows / CHUNK, n / SPAN)).cast("int")
    totals = parts.groupBy("crowd").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "part", "n")).alias("most")).where("rows > most.rows")
    sizes = totals.select("crowd", "rows", F.col("most.part").alias("most"), chunks(F.col("rows") - F.col("most.rows"), F.col("n") - F.col("most.n")).alias("rest"), chunks(F.col("most.rows"), F.col("most.n")).alias("large"))
    placed = spread_join(members, written(sizes, "crowds"), ["crowd"], "rows", members.count())
    large = F.col("part") == F.col("most")
    own = F.when(large, F.col("rest") + F.pmod(F.xxhash64("rep"), F.col("large"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rest"))).cast("int")
    last = F.when(large, F.col("rest") - 1).otherwise(F.col("rest") + F.col("large") - 1)
    each = placed.withColumn("_own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), last)))
    return each.select(F.xxhash64("crowd", F.least("_own", "_o"), F.greatest("_own", "_o")).alias("key"), "rep", "part")


def _edges(labels: DataFrame) -> DataFrame:
    """Components (node, component) as links (a, b) that make the same ones."""
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _joined(docs: DataFrame, classes: DataFrame, labels: DataFrame, crowds: DataFrame) -> DataFrame:
    """Components, those members of a crowd in `crowds` (node, component) that are in different ones having been compared with each other."""
    members = crowds.select(F.col("node").alias("rep"), F.col("component").alias("crowd")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    members = members.join(classes.select("rep", "n").groupBy("rep").agg(F.max("n").alias("n")), "rep").select("rep", "crowd", F.coalesce("component", "rep").alias("part"), "n")
    rows = written(_chunks(written(members, "members")), "parts")
    if rows.isEmpty():
        return labels
    sets = _sets(docs, rows.select(F.col("rep").alias("id")))
    rows = rows.join(sets.withColumnRenamed("id", "rep"), "rep").select("key", "rep", "part", "s")
    more = written(rows.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "part", "rep").mapInArrow(_compare, "a long, b long"), "links")
    forget(sets)
    return labels if more.isEmpty() else connected_components(_edges(labels).union(more))


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, rep) of each set of shingles, rep being its least doc_id, and (node, component) of the reps that link."""
    rows = shipped(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    sketches = rows.mapInArrow(_sketch, "id long, digest binary, n int, words array<long>, less array<binary>")
    classes = written(sketches.groupBy("digest").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "words", "less"))), "classes")
    tiny = classes.select(F.explode("less").alias("digest"), F.col("rep").alias("a")).join(classes.select("digest", F.col("rep").alias("b")), "digest").select("a", "b")

    def met(words, parts, crowds):
        """Candidates (a, b), and those of them that span crowds."""
        nodes = classes.where("words is not null").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumnRenamed("component", "part")
        nodes = nodes.join(crowds.withColumnRenamed("node", "rep"), "rep", "left").withColumnRenamed("component", "crowd")
        nodes = written(nodes.select("rep", F.coalesce("part", "rep").alias("part"), F.coalesce("crowd", "rep").alias("crowd"), "words"), "nodes")
        found = None
        for t in words:
            f, g = (F.element_at("words", F.lit(x % WORDS + 1)) for x in (t, t + 1))
            more = _met(nodes.select("rep", "part", "crowd", f.alias("f"), g.alias("g")))
            found = more if found is None else found.union(more)
        return found.select("a", "b"), found.where("crowd").select("a", "b")

    # The first fingerprint alone joins most of what is alike; for the others only what it left apart is compared.
    none = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    pairs, spans = met(range(1), none, none)
    pairs = written(pairs.union(tiny).distinct(), "pairs")
    labels = connected_components(_links(docs, pairs))
    crowds = none if spans.isEmpty() else connected_components(spans)
    more, spans = met(range(1, WORDS), labels, crowds)
    more = _links(docs, written(more.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs"))
    labels = labels if more.isEmpty() else connected_components(_edges(labels).union(more))
    crowds = crowds if spans.isEmpty() else connected_components(_edges(crowds).union(spans))
    return classes.select("digest", "rep"), labels if crowds.isEmpty() else _joined(docs, classes, labels, crowds)
