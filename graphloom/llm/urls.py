"""URL filtering by dated lists: validity intervals and an as-of join at fetch time.

List events (a pattern is added to or removed from a category on a date) become intervals; a capture is evaluated
against the entries that were active when it was fetched.  A pattern is a host and stands for its subdomains: a
host's suffixes are the join keys, so the join is an equi-join with a bounded range test behind it.  Captures of one
suffix are dealt over several tasks, those of a top-level domain over many, and list entries are sent to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Longer names are no host names.
LONGEST_HOST = 253
#: Tasks that share the captures of a suffix of one label, and of any other.
TOP_SALTS, SALTS = 64, 8


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and final dot; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    h = F.regexp_replace(h, r"\.$", "")
    return F.when((h != "") & (F.length(h) <= LONGEST_HOST), h)


def suffixes(h: Column) -> Column:
    """The host and its parent domains, the most specific first."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _salts(pattern: Column) -> Column:
    return F.when(F.contains(pattern, F.lit(".")), SALTS).otherwise(TOP_SALTS)


def intervals(events: DataFrame) -> DataFrame:
    """``pattern, category, since, until`` (exclusive, null: open) from ``pattern, category, day, action`` (add or remove).

    An entry is active from an addition until the next event of its pattern and category; of one day's events the
    removal is the last.  Events with nulls don't count; repeated additions make adjoining intervals.
    """
    e = events.select(F.lower("pattern").alias("pattern"), F.col("category").cast("string").alias("category"), F.col("day").cast("date").alias("day"), F.col("action").cast("string").alias("action"))
    e = e.dropna().where(F.col("action").isin("add", "remove")).distinct()
    order = Window.partitionBy("pattern", "category").orderBy("day", "action")
    e = e.withColumn("until", F.lead("day").over(order))
    return e.where("action = 'add' and (until is null or until > day)").select("pattern", "category", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``page_id, host, fetched, blocked, pattern, category, since`` for each row of ``captures`` (page_id, url, fetched).

    Of several active entries the most specific pattern is told, then the first category, then the earliest date.
    A capture without host or without fetch date matches nothing and is not blocked.  Repeated rows are kept.
    """
    c = captures.select(F.col("page_id"), host(F.col("url").cast("string")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    c = materialize(c.withColumn("row", F.monotonically_increasing_id()), "url-captures")
    keyed = c.select("row", "fetched", F.posexplode(suffixes(F.col("host"))).alias("depth", "pattern"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row"), _salts(F.col("pattern"))).cast("int"))
    listed = intervals(events).withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("pattern")) - 1)))
    # by shuffle: both sides can be large, and neither's size on disk tells that of its rows
    active = keyed.join(listed.hint("merge"), ["pattern", "salt"]).where("since <= fetched and (until is null or fetched < until)")
    best = active.groupBy("row").agg(F.min(F.struct("depth", "category", "since", "pattern")).alias("best"))
    return c.join(best.hint("merge"), "row", "left").select("page_id", "host", "fetched", F.col("best").isNotNull().alias("blocked"), "best.pattern", "best.category", "best.since")
