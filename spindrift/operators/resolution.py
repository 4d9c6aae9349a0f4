"""Names of units in texts: longest aliases, what they stand for, and whether that is one unit."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(aliases: list[str]) -> str:
    """An alternation that prefers longer aliases, so that none is cut short by one it contains."""
    return "(" + "|".join(re.escape(a) for a in sorted(set(aliases), key=lambda a: (-len(a), a))) + ")"


def mentions(text: Column, aliases: list[str]) -> Column:
    """Aliases in the text in order, without overlaps."""
    return F.regexp_extract_all(text, F.lit(pattern(aliases)), F.lit(0)) if aliases else F.array().cast("array<string>")


def units(rows: DataFrame, key: str, text: str, directory: list[tuple[str, str]]) -> DataFrame:
    """(key, unit, alias): each unit a text names, with its first alias. directory: (alias, unit), a small registry."""
    known = F.broadcast(rows.sparkSession.createDataFrame(directory, "alias string, unit string"))
    found = rows.select(key, F.explode(F.array_distinct(mentions(F.col(text), [a for a, _ in directory]))).alias("alias"))
    return found.join(known, "alias").groupBy(key, "unit").agg(F.min("alias").alias("alias"))


def resolution(rows: DataFrame, key: str, text: str, directory: list[tuple[str, str]], scoped: set[str], suffix: str) -> DataFrame:
    """(key, status, unit): one of none, unknown, ambiguous, scoped (the unit has a source) and unverified.

    A text that names no known unit but a word with the suffix of unit names names an unknown one.
    """
    own = units(rows, key, text, directory).groupBy(key).agg(F.count("*").alias("n"), F.min("unit").alias("unit"))
    like = F.rlike(F.col(text), F.lit(rf"(?i)\w+{re.escape(suffix)}"))
    status = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, F.when(F.col("unit").isin(*scoped), "scoped").otherwise("unverified")).when(like, "unknown").otherwise("none")
    return rows.select(key, text).join(own, key, "left").select(key, status.alias("status"), F.when(F.col("n") == 1, F.col("unit")).alias("unit"))


def normalized(text: Column, directory: list[tuple[str, str]]) -> Column:
    """The text with each alias replaced by its unit."""
    table, find = dict(directory), re.compile(pattern([a for a, _ in directory])) if directory else None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or find is None else find.sub(lambda m: table[m[0]], t.strip()))

    return run(text)


def aliases_by_unit(directory: DataFrame) -> DataFrame:
    return directory.groupBy("unit").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def registry_faults(units_: DataFrame, aliases: DataFrame) -> DataFrame:
    """(fault, name) of a registry: names given twice, aliases of two units, parents that do not exist."""
    twice = units_.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated unit").alias("fault"), F.col("unit").alias("name"))
    shared = aliases.groupBy("alias").agg(F.countDistinct("unit").alias("n")).where("n > 1").select(F.lit("shared alias").alias("fault"), F.col("alias").alias("name"))
    orphan = units_.where("parent is not null").join(units_.select(F.col("unit").alias("parent")).distinct(), "parent", "left_anti").select(F.lit("unknown parent").alias("fault"), F.col("unit").alias("name"))
    return twice.union(shared).union(orphan)


def intent(text: Column, kinds: dict[str, list[str]], default: str = "general") -> Column:
    """The first kind of which the text holds a term."""
    out = None
    for kind, terms in kinds.items():
        holds = F.rlike(F.lower(text), F.lit("|".join(re.escape(t.lower()) for t in terms)))
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out.otherwise(default) if out is not None else F.lit(default)


def topic(text: Column, removed: list[str]) -> Column:
    """What is left of a question without its unit and its phrases of asking."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), pattern([r.lower() for r in removed]), " "), r"\s+", " "))


def derived(directory: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """(unit, alias) of a registry with, for each unit name that ends with a suffix, the name with its short form."""
    out = directory.select("unit", "alias")
    for long, short in suffixes.items():
        ending = directory.where(F.endswith("unit", F.lit(long)))
        out = out.unionByName(ending.select("unit", F.concat(F.expr(f"substring(unit, 1, length(unit) - {len(long)})"), F.lit(short)).alias("alias")))
    return out.distinct()
