"""Document chunks, vector search and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..core.session import load
from ..operators import retrieval as RT
from ..sources.files import scratch_path
from ..streaming import reelstate as RS
from ..streaming import streams as ST
from .base import events, query, rounded

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\x00', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"


@query("documents_cleaned", f"SELECT doc_id, length({_CLEAN}) AS n, md5({_CLEAN}) AS digest FROM documents WHERE {_CLEAN} <> ''")
def _(spark, sf):
    d = RT.clean_pages(load(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


_CHUNKS = """ch AS (SELECT doc_id, source, CAST(c AS INT) AS chunk, CAST(c * 750 AS INT) AS start, CAST(least(c * 750 + 900, length(text)) AS INT) AS "end", substring(text, CAST(c * 750 + 1 AS INT), 900) AS chunk_text
 FROM (SELECT *, unnest(range(CASE WHEN length(text) > 900 THEN CAST(ceil((length(text) - 900) / 750.0) AS INT) + 1 ELSE 1 END)) AS c FROM documents WHERE length(text) > 0))"""


def chunks(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "text")
    c = RT.chunk_texts(d, "text", 900, 150)
    return c.withColumn("chunk_id", RT.chunk_id("source", "doc_id", "chunk"))


@query("document_chunks", f"""WITH {_CHUNKS} SELECT doc_id, chunk, start, "end", md5(chunk_text) AS digest, source || ':p' || doc_id || ':c' || chunk AS chunk_id FROM ch""")
def _(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk", "start", "end", F.md5("chunk_text").alias("digest"), "chunk_id")


@query("chunks_by_id", f"WITH {_CHUNKS} SELECT chunk_id, md5(chunk_text) AS digest FROM (SELECT *, source || ':p' || doc_id || ':c' || chunk AS chunk_id FROM ch) WHERE chunk_id IN ('src0:p0:c0', 'src3:p3:c1', 'src9:p9:c0')")
def _(spark, sf):
    return RT.chunk_by_id(chunks(spark, sf), ["src0:p0:c0", "src3:p3:c1", "src9:p9:c0"]).select("chunk_id", F.md5("chunk_text").alias("digest"))


# The mean vector of every label asks for its nearest vectors.
_QV = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY ALL), q AS (SELECT label AS query_id, list(x ORDER BY i) AS qv FROM p GROUP BY label),
 s AS (SELECT query_id, vec_id, list_inner_product(e, qv) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(qv, qv)) AS score, list_inner_product(e, qv) AS ip FROM v, q),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5)"""


def label_queries(spark, sf):
    e = load(spark, sf, "embeddings")
    mean = e.groupBy("label").agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(64)])
    return mean.select(F.col("label").alias("query_id"), F.array(*[f"m{i}" for i in range(64)]).alias("embedding"))


def matches(spark, sf, cosine=True):
    e = RT.check_dimension(load(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 64)
    return RT.top_matches(e, label_queries(spark, sf), 5, cosine=cosine)


@query("nearest_vectors_by_cosine", f"WITH {_QV} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM k")
def _(spark, sf):
    return rounded(matches(spark, sf), "score")


@query(
    "nearest_vectors_by_inner_product",
    f"WITH {_QV} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(ip, 12) DESC, vec_id) AS INT) AS rank, round(ip, 6) AS score FROM s QUALIFY rank <= 5",
)
def _(spark, sf):
    return rounded(matches(spark, sf, cosine=False), "score")


@query("matches_with_documents", f"WITH {_QV} SELECT query_id, rank, doc_id, source FROM k JOIN documents ON vec_id = doc_id")
def _(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return RT.attach_chunks(matches(spark, sf), docs, "vec_id").select("query_id", "rank", F.col("vec_id").alias("doc_id"), "source")


@query(
    "assembled_context",
    f"WITH {_QV} SELECT query_id, count(*) AS n_chunks, md5(string_agg(text, E'\\n\\n' ORDER BY rank)) AS digest FROM k JOIN documents ON vec_id = doc_id GROUP BY query_id",
)
def _(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    ctx = RT.assemble_context(RT.attach_chunks(matches(spark, sf), docs, "vec_id"))
    return ctx.select("query_id", "n_chunks", F.md5("context").alias("digest"))


@query(
    "answer_mode_gate",
    f"WITH {_QV}, b AS (SELECT query_id, max(score) AS t FROM k GROUP BY 1) SELECT query_id, round(t, 6) AS top_score, CASE WHEN t >= 0.9 THEN 'grounded' WHEN query_id % 2 = 0 THEN 'domain' ELSE 'general' END AS mode FROM b",
)
def _(spark, sf):
    asked = label_queries(spark, sf).withColumn("question", F.when(F.col("query_id") % 2 == 0, "Why did Steam cost rise?").otherwise("Hello"))
    return rounded(RT.answer_mode(matches(spark, sf), asked, "question", ["steam", "starch"], floor=0.9), "top_score")


@query("vectors_of_wrong_length", "SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) <> 64 - label % 2 GROUP BY label")
def _(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.filter(F.size("embedding") != 64 - F.col("label") % 2).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(spark, stream, name, mode="append"):
    """Run a stream over everything there is, into files, and read them back."""
    out, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# A stream hands out a window once the latest time has passed its end by the allowed lateness.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stream_tumbling_means",
    f"""SELECT * FROM (SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def _(spark, sf):
    return rounded(drain(spark, ST.tumbling_means(event_stream(spark, sf), "ts", "1 hour", ["value"], ["event_type"]), "tumbling"), "value")


@query("batch_tumbling_means", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def _(spark, sf):
    return rounded(ST.tumbling_means(events(spark, sf), "ts", "1 hour", ["value"], ["event_type"]), "value")


@query(
    "stream_sliding_statistics",
    f"""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL '6 hours', ts) - INTERVAL 12 HOUR, time_bucket(INTERVAL '6 hours', ts) - INTERVAL 18 HOUR]) AS s FROM events)
 SELECT CAST(s AS TIMESTAMP) AS start, CAST(s + INTERVAL 24 HOUR AS TIMESTAMP) AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM w GROUP BY ALL HAVING s + INTERVAL 24 HOUR <= {_CLOSED}""",
)
def _(spark, sf):
    out = ST.sliding_stats(event_stream(spark, sf), "ts", "24 hours", "6 hours", "value", ["event_type"])
    return rounded(drain(spark, out, "sliding"), "mean", "std")


_SESS = """SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n, round(avg(value), 6) AS mean FROM (
 SELECT *, sum(CAST(g AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 43200000000, true) AS g FROM events)) GROUP BY user_id, sid"""


@query("stream_gap_sessions", f"{_SESS} HAVING max(ts) + INTERVAL 12 HOUR <= {_CLOSED}")
def _(spark, sf):
    return rounded(drain(spark, ST.gap_sessions(event_stream(spark, sf), "ts", "12 hours", "value", ["user_id"]), "sessions"), "mean")


@query("batch_gap_sessions", _SESS)
def _(spark, sf):
    return rounded(ST.gap_sessions(events(spark, sf), "ts", "12 hours", "value", ["user_id"]), "mean")


@query("stream_unique_rows", "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL")
def _(spark, sf):
    out = ST.unique_rows(event_stream(spark, sf).select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"])
    return drain(spark, out, "unique").select("user_id", "event_type", F.lit(True).alias("seen"))


@contextmanager
def rocksdb(spark):
    """The state store that state machines need, for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(
    "stream_turnup_rows",
    """WITH r AS (SELECT event_type AS machine, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS reel_id, ts, value, event_id FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY machine, reel_id ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY machine, reel_id) AS n_rows, max(reel_id) OVER (PARTITION BY machine) AS newest FROM r)
 SELECT machine, reel_id, ts, value, n_rows FROM n WHERE k = least(2, n_rows) AND reel_id < newest""",
)
def _(spark, sf):
    with rocksdb(spark):
        s = event_stream(spark, sf).select(
            F.col("event_type").alias("machine"), F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("reel_id"), "ts", "value"
        )
        return drain(spark, ST.turnup_stream(s), "turnup")


def feed(spark, rows, transform, name):
    """Hand out rows by their ``part``, one after another, to a stream that goes on where it stopped; read its output."""
    inbox, out, state = (scratch_path(spark, f"{name}{x}") for x in ("-in", "", "-state"))
    first, last = rows.agg(F.min("part"), F.max("part")).head()
    if first is None:
        return spark.createDataFrame([], transform(rows.drop("part")).schema)
    for part in range(first, last + 1):
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(inbox)
        result = transform(spark.readStream.schema(rows.drop("part").schema).parquet(inbox))
        q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


# Every part holds eight days; a tenth of the rows comes one part later, beyond the allowed lateness for most of them.
_PARTS = """x AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8 + CAST(event_id % 10 = 0 AS BIGINT) AS part FROM events),
 latest AS (SELECT part, max(max(epoch_ms(ts))) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x GROUP BY part)"""


def delayed_events(spark, sf):
    part = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 8) + (F.col("event_id") % 10 == 0).cast("bigint")
    return events(spark, sf).withColumn("part", part)


@query(
    "stream_tumbling_means_with_late_rows",
    f"""WITH {_PARTS}, k AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type, value FROM x JOIN latest USING (part) WHERE before IS NULL OR epoch_ms(time_bucket(INTERVAL '1 hour', ts)) + 3600000 > before - 21600000)
 SELECT CAST(s AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS value FROM k GROUP BY ALL HAVING epoch_ms(s) + 3600000 <= (SELECT max(epoch_ms(ts)) FROM events) - 21600000""",
)
def _(spark, sf):
    out = feed(spark, delayed_events(spark, sf), lambda s: ST.tumbling_means(s, "ts", "1 hour", ["value"], ["event_type"], late="6 hours"), "late-tumbling")
    return rounded(out, "value")


@query(
    "stream_unique_rows_with_late_rows",
    f"WITH {_PARTS} SELECT event_id, ts, user_id, event_type FROM x JOIN latest USING (part) WHERE before IS NULL OR epoch_us(ts) > (before - 86400000) * 1000",
)
def _(spark, sf):
    # A third of the events is sent again one part later.
    first = delayed_events(spark, sf).select("event_id", "ts", "user_id", "event_type", "part")
    again = first.filter("event_id % 3 = 0").withColumn("part", F.col("part") + 1)
    return feed(spark, first.unionByName(again), lambda s: ST.unique_rows(s, "ts", ["event_id"], late="1 day"), "late-unique")


@query(
    "stream_reel_events_out_of_order",
    """WITH x AS (SELECT event_type AS machine, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS reel_id, ts, event_id, event_id % 97 AS code, value FROM events),
 r AS (SELECT * FROM x WHERE epoch_ms(time_bucket(INTERVAL '1 hour', ts)) + 3600000 <= (SELECT max(epoch_ms(ts)) FROM events) - 21600000),
 e AS (SELECT *, lag(code) OVER w AS previous, lead(value) OVER w AS next_power FROM r WINDOW w AS (PARTITION BY machine ORDER BY ts, event_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY machine, reel_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY machine, reel_id) AS n_rows, max(reel_id) OVER (PARTITION BY machine) AS newest FROM r)
 SELECT machine, 'turnup' AS kind, reel_id, ts, value, n_rows FROM n WHERE k = least(2, n_rows) AND reel_id < newest
 UNION ALL SELECT machine, 'break', reel_id, min(ts), NULL, NULL FROM e WHERE (code = 0 AND previous <> 0) OR (value > 200 AND next_power < 200) GROUP BY machine, reel_id""",
)
def _(spark, sf):
    # Rows come up to three hours late, so that those around the end of a part reach the stream after newer ones.
    e = events(spark, sf)
    part = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("event_id") % 7 * 1800) / 691200)
    rows = e.select(
        F.col("event_type").alias("machine"), F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("reel_id"), "ts", F.col("event_id").alias("tie"),
        (F.col("event_id") % 97).cast("double").alias("code"), F.col("value").alias("power"), "value", part.alias("part"),
    )
    with rocksdb(spark):
        return feed(spark, rows, lambda s: RS.reel_event_stream(s, late="6 hours", level=200.0), "reel-events")
