"""URL filters: temporal list join.

Dated list entries (add, remove) become validity intervals with ``lead``; every
capture is looked up under each suffix of its host and each leading path of its
URL, and an entry decides where its interval covers the fetch time.  Intervals
are cut at period bounds and joined on (key, period), so that an old entry with
many changes or a host with a third of all captures meets only the intervals of
its period, and a hot key can be split by the join.

Defined cases: a null or unparsable URL matches nothing and is kept; a null
fetch time matches nothing; entries without key, date or action are ignored;
several entries of one key at one time: a removal wins; repeated entries and
captures change nothing; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import aside, cut

FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """Host suffixes of two labels and more, and host with each leading path."""
    labels = F.split(host(url), "\\.")
    n = F.size(labels)
    names = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    steps = F.filter(F.split(path(url), "/"), lambda s: s != "")
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.concat(
        F.lit("p:"), host(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.when(host(url) == "", F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.concat(names, F.when(F.size(steps) > 0, paths).otherwise(
        F.expr("cast(array() as array<string>)")))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) of dated entries (key, day, action): from an
    add up to, not including, the next removal."""
    e = entries.filter("key is not null and day is not null and action in ('add', 'remove')")
    e = e.groupBy("key", "day").agg(F.min(F.when(F.col("action") == "remove", 0).otherwise(1)).alias("on"))
    w = Window.partitionBy("key").orderBy("day")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).filter(F.col("on") != F.col("was"))
    e = e.withColumn("valid_to", F.coalesce(F.lead("day").over(w), F.to_date(F.lit(FOREVER))))
    return e.filter("on = 1").select("key", F.col("day").alias("valid_from"), "valid_to")


def by_period(spans: DataFrame, last: Column) -> DataFrame:
    """Intervals cut at month bounds up to the ``last`` month asked for."""
    end = F.least(F.date_sub("valid_to", 1), last)
    months = F.when(end >= F.col("valid_from"), F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    return spans.withColumn("period", F.explode(months))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``captures`` with ``blocked``, ``n_entries`` (active entries that match),
    ``by_key`` (the least of their keys) and ``listed_since``; columns of these names are
    replaced, all others stay."""
    named, back = aside(captures, _url=url_col, _day=day_col)
    c = cut(named.withColumn("_row", F.monotonically_increasing_id()))
    last = c.agg(F.max("_day").alias("_last"))
    listed = intervals(entries).crossJoin(F.broadcast(last))  # one row
    listed = cut(by_period(listed, F.col("_last")).select("key", "period", "valid_from", "valid_to"))
    asked = c.select("_row", "_day", F.trunc("_day", "month").alias("period"), F.explode(keys(F.col("_url"))).alias("key"))
    hit = asked.join(listed, ["key", "period"]).filter("_day >= valid_from and _day < valid_to")
    hit = hit.groupBy("_row").agg(F.count("*").alias("n_entries"), F.min(F.struct("key", "valid_from")).alias("m"))
    out = c.join(hit, "_row", "left")
    return back(out, blocked=F.col("m").isNotNull(), n_entries=F.coalesce("n_entries", F.lit(0)), by_key=F.col("m.key"), listed_since=F.col("m.valid_from"))
