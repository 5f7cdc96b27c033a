"""Stream workers in batch form: the chunk worker on conversation turns, an index
that grows by batches of documents, and event-time windows with late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.operators import retrieval as rt
from docloom.sources.io import shared_folder
from docloom.streaming import ingest
from docloom.streaming import requests as rq
from docloom.streaming import windows as ew
from docloom.workloads import inputs as inp
from docloom.workloads import sqltext as S
from docloom.workloads.registry import query


@query("st_requests", f"""with r as (select conv_id::varchar || '-' || turn::varchar as request_id, {S.words('text')} as w from conversations)
 select request_id, true as ok, len(range(0, len(w), 56))::int as chunks, len(w)::int as last_token from r where len(w) > 0""")
def _(spark, d):
    c = inp.table(spark, d, "conversations")
    payload = F.to_json(F.struct("text", F.lit(64).alias("chunk_size"), F.lit(8).alias("overlap")))
    raw = c.select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.lit("replies").alias("reply_topic"), payload.alias("payload"))).alias("value"))
    r = rq.replies(rq.chunk_handler(rq.parse_requests(raw)))
    x = r.select("request_id", "ok", F.from_json("result", "array<struct<token_start:int,token_end:int>>").alias("c")).filter(F.size("c") > 0)
    return x.select("request_id", "ok", F.size("c").alias("chunks"), F.array_max(F.transform("c", lambda z: z["token_end"])).alias("last_token"))


def grown(spark, d):
    """An index root fed with all documents in four batches: the first holds
    older texts of some of them and others that go, the last brings the rest."""
    root = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    t = inp.texts(spark, d)
    part = F.pmod(F.xxhash64("doc_idx"), F.lit(3))
    old = t.filter(part == 2).withColumn("text", F.reverse("text"))
    gone = t.filter(part == 1).select((-1 - F.col("doc_idx")).alias("doc_idx"), "text")
    ingest.append(t.filter(part == 0).unionByName(old).unionByName(gone), 0, root)
    ingest.append(t.filter(part == 1), 1, root)
    ingest.append(t.filter(part == 1), 1, root)  # delivered again
    ingest.append(t.filter(part == 2), 2, root, deleted=gone)
    return root


@query("st_grown_bm25", S.select([S.LEX, S.bm25_ctes(10)], "select query_id, doc_idx, score, rank from bm25"))
def _(spark, d):
    return rt.bm25(inp.queries(spark, d), ingest.open_bm25(spark, grown(spark, d)), 10)


@query("st_grown_vocab", S.select([S.TOK, S.POST, S.STATS, S.VOC], f"select term, df, {S.q6('idf')} as idf from voc"))
def _(spark, d):
    from docloom.operators.indexing import rounded

    return rounded(ingest.open_bm25(spark, grown(spark, d))["vocab"], "idf")


DELAY = "2 hours"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
# Events come by id in three batches, but each fortieth comes with the last one.
ARRIVED = """with a as (select *, case when event_id % 40 = 7 then 2 else event_id * 3 // (select max(event_id) + 1 from events) end b from events),
 late as (select * from a where ts < (select max(x.ts) from a x where x.b < a.b) - interval 2 hours),
 ok as (select * from a where event_id not in (select event_id from late)),
 mark as (select (epoch_us(max(ts)) // 1000) * 1000 - 7200000000 as m from ok)"""


def aggs():
    return [F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")]


def arrived(spark, d):
    """The root of a stream that took all events, batch by batch."""
    root = f"{shared_folder(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    e = inp.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    n = e.agg(F.max("event_id") + 1).first()[0] or 1
    batch = F.when(F.col("event_id") % 40 == 7, 2).otherwise(F.floor(F.col("event_id") * 3 / n))
    for b in range(3):
        e.filter(batch == b).write.parquet(f"{root}/inbox/part={b}")
        ew.split_late(spark.readStream.schema(EVENTS).parquet(f"{root}/inbox/part=*"), root, DELAY).awaitTermination()
    return root


def closed(spark, windows, root, name):
    ew.write_closed(windows, root, name).awaitTermination()
    w = spark.read.schema(windows.schema).parquet(f"{root}/{name}")
    return w.withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})


@query("st_tumbling", f"""{ARRIVED}, h as (select *, epoch_us(ts) // 3600000000 as hour from ok)
 select hour * 3600000000 as window_start, (hour + 1) * 3600000000 as window_end, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents
 from h where (hour + 1) * 3600000000 <= (select m from mark) group by hour, event_type""")
def _(spark, d):
    root = arrived(spark, d)
    return closed(spark, ew.tumbling(ew.on_time(spark, root, EVENTS), "1 hour", ["event_type"], aggs(), DELAY), root, "hours")


@query("st_sessions", f"""{ARRIVED}, g as (select *, epoch_us(ts) - coalesce(lag(epoch_us(ts)) over (partition by user_id order by ts), -1e15::bigint) > 86400000000 as fresh from ok),
 i as (select *, sum(fresh::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g)
 select min(epoch_us(ts)) as window_start, max(epoch_us(ts)) + 86400000000 as window_end, user_id, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents
 from i group by user_id, s having window_end <= (select m from mark)""")
def _(spark, d):
    root = arrived(spark, d)
    return closed(spark, ew.sessions(ew.on_time(spark, root, EVENTS), "1 day", ["user_id"], aggs(), DELAY), root, "sessions")


@query("st_late", f"{ARRIVED} select event_id, b::int as batch from late")
def _(spark, d):
    return ew.late(spark, arrived(spark, d)).select("event_id", "batch")
