"""Extension points: a table function over pages for SQL, and embedders of texts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from spindrift.shipping import ship


def _columns(*names: str) -> StructType:
    return StructType([StructField("position", IntegerType()), *[StructField(n, StringType()) for n in names]])


#: Parts of a page, and the columns of each.
PARTS = {
    "links": _columns("url", "label"),
    "items": _columns("url", "title", "told", "summary", "anchor_text"),
    "headings": _columns("heading"),
    "lines": _columns("line"),
    "forms": _columns("action", "method"),
}


class PageParts:
    """page_parts(html, url, part): rows of one kind of part of a page; its columns follow from `part`, which is a literal."""

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, part: AnalyzeArgument) -> AnalyzeResult:
        if not part.isConstantExpression or part.value not in PARTS:
            raise ValueError(f"part must be one of {', '.join(PARTS)}")
        return AnalyzeResult(schema=PARTS[part.value])

    def eval(self, html: str | None, url: str | None, part: str):
        from spindrift.sources import html as pages

        if part == "forms":
            rows = pages.forms(html, url)
        else:
            found = pages.read(html, url)
            rows = [{"heading": h} for h in found["headings"]] if part == "headings" else [{"line": x} for x in found["body"].split("\n") if x] if part == "lines" else found[part]
        for i, row in enumerate(rows):
            yield i, *(row[f.name] for f in PARTS[part].fields[1:])


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: select ... from pages, lateral page_parts(html, url, 'links')."""
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.udtf.register("page_parts", udtf(PageParts))


class Embedder(Protocol):
    """What makes vectors of texts: any object of this form that can be pickled, a model being loaded where it is used."""

    size: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Stands in for a learned embedder in tests: bytes of the text's SHA-256, again and again, within -1 and 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        import hashlib

        digests = (hashlib.sha256(t.encode()).digest() for t in texts)
        return [[d[i % 32] / 127.5 - 1.0 for i in range(self.size)] for d in digests]


def embedded(rows: DataFrame, column: str, embedder: Embedder, into: str = "embedding") -> DataFrame:
    """rows with the vectors of a column of texts; null texts have none. Texts go to the embedder in Arrow batches."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        there = [i for i, t in enumerate(texts) if t is not None]
        for i, v in zip(there, embedder.embed([texts[i] for i in there]) if there else [], strict=True):
            if len(v) != embedder.size:
                raise ValueError(f"a vector of {len(v)} components, not {embedder.size}")
            out[i] = v
        return out

    return rows.withColumn(into, run(column))
