"""Files as tables: documents with their metadata, feeds, fixtures. A bad file is a row with an error, not a failure."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import urls
from spindrift.shipping import ship
from spindrift.sources.dom import Tree, tidy
from spindrift.sources.folder import DocumentFolder
from spindrift.sources.html import clean

#: Fixed: what metadata must have, those that are dates, and the two of which one must be there.
REQUIRED = ("title", "source_url", "unit", "document_type", "version")
DATES, DATED = ("published_at", "effective_from", "effective_to"), ("published_at", "effective_from")


_QUOTED = re.compile(r"""(["'])(.*?)\1\s*(?:#.*)?$""")


def pairs(text: str) -> dict[str, str] | None:
    """Flat `key: value` lines of a metadata file, comments and blank lines left out; None where it says anything else."""
    out = {}
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() in ("---", "..."):
            continue
        k, sep, v = line.partition(":")
        if not sep or not k.strip() or line.startswith((" ", "\t", "-")):
            return None
        v = v.strip()
        quoted = _QUOTED.match(v)
        v = quoted[2] if quoted else v.split(" #")[0].strip()
        out[k.strip()] = "" if not quoted and v in ("null", "~") else v
    return out


def _parsed(content: bytes | None, ending: str, side: bytes | None, error: str | None) -> tuple[str | None, dict | None, str | None]:
    """(text, metadata, error) of a document."""
    if error or content is None:
        return None, None, error or "no content"
    if side is None:
        return None, None, "no metadata"
    try:
        meta = pairs(side.decode("utf-8"))
        text = None if ending == "pdf" else content.decode("utf-8")
    except UnicodeDecodeError as e:
        return None, None, f"UnicodeDecodeError: {e.reason}"
    if meta is None:
        return None, None, "metadata is no mapping"
    lacking = [k for k in REQUIRED if not meta.get(k)]
    wrong = [k for k in DATES if meta.get(k) and not _is_day(meta[k])]
    if ending == "pdf":
        error = "no reader for pdf"
    elif lacking:
        error = f"no {', '.join(lacking)}"
    elif wrong:
        error = f"no date: {', '.join(wrong)}"
    elif not any(meta.get(k) for k in DATED):
        error = f"no {' or '.join(DATED)}"
    if text is not None:
        text = clean(Tree(text)) if ending in ("html", "htm") else tidy(text)
    return text, meta, error


def _is_day(value: str) -> bool:
    try:
        date.fromisoformat(value)
    except ValueError:
        return False
    return True


def documents(spark: SparkSession, folder: str, roots: list[str] | None = None, stream: bool = False, **options) -> DataFrame:
    """(path, text, metadata, error) of the documents below a folder, each with the metadata file of its stem.

    Files of other kinds are left out. A file that cannot be read, one without metadata, with metadata that lacks
    something, or, where `roots` are given, with a source off them, is a row with an error. Batches come in the order of
    paths; as a stream every file comes once, when it has arrived, so its metadata must be there before it.
    """
    ship(spark)
    spark.dataSource.register(DocumentFolder)
    rows = (spark.readStream if stream else spark.read).format("document_folder").options(**options).load(folder)

    @F.pandas_udf("text string, metadata map<string,string>, error string")
    def parse(contents: pd.Series, endings: pd.Series, sides: pd.Series, errors: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parsed(*r) for r in zip(contents, endings, sides, errors, strict=True)], columns=["text", "metadata", "error"])

    found = rows.select("path", parse("content", "ending", "metadata", "error").alias("p")).select("path", "p.text", "p.metadata", "p.error")
    if roots is not None:
        off = F.col("error").isNull() & ~urls.is_allowed(F.col("metadata")["source_url"], roots)
        found = found.withColumn("error", F.when(off, "source_url is not allowed").otherwise(F.col("error")))
    return found


def feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published, description) of the items of RSS files; items without title or link are left out."""
    schema = "title string, link string, pubDate string, description string"
    items = spark.read.schema(schema).option("rowTag", "item").option("mode", "PERMISSIVE").format("xml").load(path)
    return items.where("title is not null and link is not null").select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.col("pubDate").alias("published"), "description")


def fixture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path)


def relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC, read in `parts` ranges of a numeric key."""
    return spark.read.options(**options).jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
