"""URL filter rules by a sort-merge range join, with DataFrame operations only.

A host's canonical key is its labels reversed, each followed by a dot: a rule's host and all its subdomains are then
the keys of one interval, and such intervals nest. Rule ends and urls are sorted together; each rule end carries the
stack of rules that are active from there on, and a url takes the stack of the last end before it. Partitions are key
ranges; a partition begins with the stack that the ranges before it left. The path is judged against the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import shuffle_partitions, written

#: (verdict, host, path): the rules of the registered query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: What a url gets that no rule fits.
DEFAULT = "allow"
RULE_SCHEMA = "verdict string, host string, path string"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end.

    Both are empty for null and for urls without ://.
    """
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + F.lit(3))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def ends(rules: DataFrame) -> DataFrame:
    """(key, stack) at every begin and end of a rule host's interval: the rules that are active from there on.

    What is active at a begin are the rules of the host and of its suffixes, at an end those of its proper suffixes:
    both by an equi-join, as a host has few suffixes. Rules without a host are ignored, a null path is "".
    """
    rule = F.struct(F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("wide"), "path", "verdict", F.concat("host", "path").alias("rule"))
    own = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    held = own.select(F.col("host").alias("suffix"), rule.alias("r"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = own.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(held, "suffix")
    stack = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("r"))))
    both = chain.groupBy("host").agg(stack(F.lit(True)).alias("begin"), stack(F.col("suffix") != F.col("host")).alias("end"))
    low = key(F.col("host"))
    high = F.concat(F.substr(low, F.lit(1), F.length(low) - 1), F.lit("/"))  # "/" follows "." in code order
    event = lambda k, s: F.struct(k.alias("key"), F.col(s).alias("stack"))
    return both.select(F.explode(F.array(event(low, "begin"), event(high, "end"))).alias("e")).select("e.*")


def judged(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """`urls` (columns host and path, any others) with columns rule and verdict.

    The rule with the longest host and path wins. Urls of one key may lie in several partitions, so a host that has a
    third of all rows is spread; of a partition, only the last stack is handed to the next ones.
    """
    spark = urls.sparkSession
    n = shuffle_partitions(spark)
    points = urls.select(key(F.col("host")).alias("_key"), F.lit(1).alias("_kind"), F.xxhash64(*urls.columns).alias("_spread"), F.lit(None).cast("array<struct<len:int,wide:int,path:string,verdict:string,rule:string>>").alias("_stack"), F.struct(*urls.columns).alias("_row"))
    at = ends(rules).select(F.col("key").alias("_key"), F.lit(0).alias("_kind"), F.lit(-(1 << 63)).alias("_spread"), F.col("stack").alias("_stack"))
    merged = at.unionByName(points, allowMissingColumns=True).repartitionByRange(n, "_key", "_kind", "_spread").withColumn("_part", F.spark_partition_id())
    rows = written(merged, "sweep")
    swept = Window.partitionBy("_part").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # One row a partition; the running stack over them is what each partition begins with.
    lasts = rows.groupBy("_part").agg(F.max_by("_stack", F.when(F.col("_kind") == 0, F.col("_key"))).alias("_left"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(lasts.select(F.col("_part").alias("_p"), F.last("_left", ignorenulls=True).over(before).alias("_carried")))
    active = F.coalesce(F.last("_stack", ignorenulls=True).over(swept), F.col("_carried"))
    out = rows.join(carried, F.col("_part") == F.col("_p"), "left").withColumn("_active", active).where("_kind = 1")
    fit = F.array_max(F.filter("_active", lambda r: F.startswith(F.col("_row.path"), r["path"])))
    return out.withColumn("_fit", fit).select("_row.*", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The given rules as a table of literals, which the plan holds itself."""
    if not rules:
        return spark.createDataFrame([], RULE_SCHEMA)
    names = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule, strict=True)]) for rule in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def op10(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    Null urls and urls without :// have an empty host and path, which no rule fits. Repeated rows repeat; an empty
    table of pages gives an empty result, an empty table of rules the default verdict.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    return judged(urls, rule_table(pages.sparkSession) if rules is None else rules)


ORACLE = r"""
with parts as (
  select page_id,
         case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), split as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(rule, rule_host, rule_path, verdict) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits as (
  select page_id, host, path,
         (select arg_max(rule, length(rule)) from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule,
         (select arg_max(verdict, length(rule)) from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as verdict
  from split
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits
"""
