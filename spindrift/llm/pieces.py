"""SentencePiece BPE encoding by a merge-type prefix table.

Merging is local: an encoding is right exactly if each two neighbouring tokens are what merging makes of the two
alone. So every prefix of a text has one last token. The table stores it for each prefix: an automaton lists the
tokens that end there, and the one that is compatible with the last token of the prefix before it is taken; ids are
then recovered backwards from the end. The work is linear in the text, whatever its length.

Texts are cut only where no token of the vocabulary could reach over the cut, which changes nothing; the ids of the
cut-out parts are remembered for as long as there is room.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import shipped

#: Parts whose ids a worker remembers: so many new ones, and as many that were used before those.
REMEMBERED = 100_000

#: Texts whose ids are held at once.
AT_ONCE = 256


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes as the library does for a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(i) for i in range(m.get_piece_size())]
        self.fits: dict[tuple[str, str], bool] = {}
        self.tokens = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merged(p) == [p]:  # others are never the outcome of merging
                self.tokens.add_word(p, p)
        self.tokens.make_automaton()
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        alone = {c for p in self.ids if len(p) > 1 for c in p}
        space = "▁"
        assert not any(c + space in inside for c in alone - {space}), "a token reaches into the next word"
        joined = "".join(re.escape(c) for c in sorted(alone - {space}))
        #: A run of spaces with the characters that tokens may join to it, or one character that no longer token holds.
        self.parts = re.compile(f"{space}*[{joined}]+|{space}+|[^{joined}{space}]", re.S)

    def merged(self, text: str) -> list[str]:
        """Merging as defined: again and again the neighbours whose union scores highest, the leftmost of equals."""
        parts: list[str | None] = list(text)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves the two tokens as they are, side by side."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= 600_000:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def split(self, part: str) -> list[str]:
        """The tokens of a part by the prefix table."""
        last: list[str | None] = [None] * (len(part) + 1)
        fits = self.fits
        for end, p in self.tokens.iter(part):
            at = end + 1 - len(p)
            if last[end + 1] is not None:
                continue
            before = last[at]
            if at == 0 or (before is not None and (found if (found := fits.get((before, p))) is not None else self.compatible(before, p))):
                last[end + 1] = p
        out, end = [], len(part)
        while end:
            p = last[end]
            if p is None:
                raise ValueError("a character without a token inside a part")
            out.append(p)
            end -= len(p)
        return out[::-1]

    def encode_part(self, part: str) -> tuple[int, ...]:
        """The ids of a part that is not among the new ones."""
        found = self.older.get(part)
        if found is None:
            if len(part) == 1:
                i = self.ids.get(part)
                found = (i,) if i is not None else tuple(self.bytes[b] for b in part.encode("utf-8", "replace"))
            else:
                found = tuple([self.ids[p] for p in self.split(part)])
        if len(part) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[part] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids as the library gives them without begin, end or sampling; none for a null or empty text."""
        if not text:
            return []
        out: list[int] = []
        for x in self.parts.findall("▁" + text.replace(" ", "▁")):
            out += self.known.get(x) or self.encode_part(x)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row. Null or empty texts have no ids; other columns are ignored, repeated rows repeat."""
    path = path or model_path()

    def run(batches):
        own = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([own.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], names=["id", "ids"])

    return shipped(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, ids array<int>")


def op7(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    Null and empty texts have no ids and decode to an empty text. Repeated rows repeat; an empty table gives an empty
    result; other columns are ignored.
    """
    path = path or model_path()

    def run(batches):
        own = encoder(path)
        for b in batches:
            decimal = own.decimal
            n, ids_sha, text_sha = np.zeros(b.num_rows, np.int64), [], []
            for i, t in enumerate(b.column(1)):
                ids = own.encode(t.as_py())
                n[i] = len(ids)
                ids_sha.append(hashlib.sha256(",".join([decimal[x] for x in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
