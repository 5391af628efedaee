"""Registered queries of the streams, run to the end of their tables, and SQL for what they have put out by then."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import names
from provenant.operators import health, snapshot
from provenant.plans import fixtures as fx
from provenant.plans.catalog import query
from provenant.sources.counted import land, report
from provenant.sources.logs import read_log
from provenant.sources.tables import table
from provenant.streaming import stateful
from provenant.streaming.buckets import Buckets, newest
from provenant.streaming.index import shared_folder


def _stream(spark, sf_dir, name):
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("""WITH m AS (SELECT conv_id, turn, role, TIMESTAMP '2024-01-01' + to_seconds(CAST(conv_id * 60 + turn AS BIGINT)) AS ts FROM conversations),
    t AS (SELECT conv_id AS session, turn AS turn_seq, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment, ts FROM m)
    SELECT session, turn_seq, role, segment FROM t WHERE ts <= (SELECT max(ts) FROM m) - INTERVAL 10 MINUTE""")
def stream_turns(spark, sf_dir):
    """Conversations as a stream: the turns that the watermark, ten minutes behind, has closed."""
    stamp = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("conv_id") * 60 + F.col("turn"))
    said = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("turn_seq"), "role", stamp.alias("ts"))
    return stateful.drain(stateful.turns(said), shared_folder(spark))


@query("""WITH e AS (SELECT event_id // 3 AS id, event_id % 3 AS nth, event_id, user_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(event_id * 2 AS BIGINT)) AS ts FROM events),
    o AS (SELECT id, min(ts) FILTER (nth = 0) AS started, count(*) FILTER (nth = 1) AS steps, max(user_id) FILTER (nth = 1) AS target, coalesce(bool_or(nth = 2 AND id % 7 <> 0), false) AS ended FROM e GROUP BY id)
    SELECT CASE WHEN id % 2 = 0 THEN 'operation' ELSE 'claim' END AS kind, CAST(id AS VARCHAR) AS id, steps, CAST(target AS VARCHAR) AS last_target FROM o
    WHERE started IS NOT NULL AND NOT ended AND started <= (SELECT max(ts) FROM e) - INTERVAL 13 MINUTE""")
def stream_abandoned(spark, sf_dir):
    """Three events in a row are the start, a step and the end of a piece of work, of which every seventh has no end."""
    e, piece = F.col("event_id"), F.floor(F.col("event_id") / 3)
    nth = e % 3
    event = F.when(nth == 0, "start").when(nth == 1, "step").when(piece % 7 != 0, "end")
    rows = _stream(spark, sf_dir, "events").select(F.when(piece % 2 == 0, "operation").otherwise("claim").alias("kind"), piece.cast("string").alias("id"), event.alias("event"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=e * 2)).alias("ts"), nth.alias("seq"), F.col("user_id").alias("target"))
    return stateful.still_open(stateful.drain(stateful.abandoned(rows.filter("event IS NOT NULL")), shared_folder(spark)))


@query("""WITH e AS (SELECT ts, event_id % 37 = 0 AS refused, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS arrived FROM events)
    SELECT strftime(CASE WHEN ts <= arrived + INTERVAL 1 HOUR THEN date_trunc('hour', ts) END, '%Y-%m-%d %H') AS hour, count(*) AS records, count(*) FILTER (refused) AS refused FROM e GROUP BY 1""")
def stream_recency(spark, sf_dir):
    """Hours of a real stream, and the rows that it set aside in one row without an hour; every eleventh event is stamped two hours ahead of its arrival."""
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    rows = _stream(spark, sf_dir, "events").select(ts.alias("ts"), F.when(e % 11 == 0, ts - F.expr("INTERVAL 2 HOUR")).otherwise(ts).alias("arrived"), F.when(e % 37 == 0, "k").alias("refused_kind"))
    hours, future = stateful.recency(rows, shared_folder(spark))
    ahead = future.agg(F.count(F.lit(1)).alias("records"), F.count("refused_kind").alias("refused")).filter("records > 0")
    return hours.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "records", "refused").unionByName(ahead.select(F.lit(None).cast("string").alias("hour"), "records", "refused"))


@query(f"""WITH {fx.I_SQL}, u AS (SELECT concat(url, '#', page_id) AS url, CAST(verified_at AS TIMESTAMP) AS verified_at, page_id FROM i WHERE content_hash IS NOT NULL),
    o AS (SELECT *, row_number() OVER (ORDER BY verified_at NULLS FIRST, url) AS nth FROM u), n AS (SELECT count(*) // 4 AS n FROM pages WHERE page_id % 4 = 0)
    SELECT url, CAST(CASE WHEN nth <= n THEN TIMESTAMP '2024-03-01' WHEN nth <= 2 * n THEN TIMESTAMP '2024-03-02' ELSE verified_at END AS VARCHAR) AS verified_at,
    CASE WHEN nth <= 2 * n THEN CASE WHEN page_id % 2 = 0 THEN 'unchanged' ELSE 'changed' END END AS verify_outcome FROM o, n""")
def verify_cursor(spark, sf_dir):
    """Two runs as a stream of two files' worth of orders over the kept index, each for a sixteenth of the pages; odd pages have changed."""
    p, top = F.col("page_id"), shared_folder(spark)
    unique = F.concat("url", F.lit("#"), p)
    rows = fx.index(spark, sf_dir).filter("content_hash IS NOT NULL").select(unique.alias("url"), "content_hash", F.col("verified_at").cast("timestamp").alias("verified_at"), F.lit(None).cast("string").alias("verify_outcome"))
    index = Buckets(spark, f"{top}/index", "url", 16)
    index.merge(0, rows, newest("url"))
    digest = F.when(p % 2 == 0, F.sha2("html", 256)).otherwise("new")
    reads = table(spark, sf_dir, "pages").select(unique.alias("url"), F.explode(F.array(F.lit(1), F.lit(2))).alias("read_no"), F.lit(200).alias("status"), digest.alias("digest"))
    orders = table(spark, sf_dir, "pages").filter(p % 4 == 0).agg(F.floor(F.count(F.lit(1)) / 4).cast("int").alias("n"))
    for day in ("2024-03-01", "2024-03-02"):
        orders.select(F.lit(day).cast("timestamp").alias("run_at"), "n").write.mode("append").parquet(f"{top}/runs")
        runs = spark.readStream.schema("run_at timestamp, n int").parquet(f"{top}/runs")
        kept = stateful.verify_runs(spark, runs, reads, f"{top}/cursor", index)
    return kept.select("url", F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at"), "verify_outcome")


def _log(spark, sf_dir):
    """A capture log of the events as files, one for each fifth of them: lines with a stamp of either offset form, with none, dated ahead, torn, refusals and errors."""
    e, top = F.col("event_id"), f"{shared_folder(spark)}/log"
    clock = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=e), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(e % 97 == 0, clock).when(e % 211 == 0, F.lit("2099-01-01T00:00:00Z")).when(e % 2 == 0, F.concat(clock, F.lit("+0000"))).otherwise(F.concat(clock, F.lit("+00:00")))
    more = F.when(e % 37 == 0, F.concat(F.lit('"refused": "no", "refused_kind": "kind'), e % 3, F.lit('"'))).when(e % 41 == 0, F.concat(F.lit('"urls_seen": 2, "errors": [{"code": "E'), e % 5, F.lit('", "message": "m", "url": "u"}, {"code": "F"}]'))).otherwise('"urls_seen": 1')
    line = F.when(e % 501 == 0, '{"ts": "2024').otherwise(F.concat(F.lit('{"ts": "'), stamp, F.lit('", '), more, F.lit("}")))
    lines = table(spark, sf_dir, "events").select((e % 5).alias("src"), "event_id", line.alias("value"))
    lines.repartition("src").sortWithinPartitions("src", "event_id").drop("event_id").write.partitionBy("src").text(top)
    return top


@query("""WITH l AS (SELECT event_id % 5 AS src, event_id AS e, TIMESTAMP '2024-01-01' + to_minutes(CAST(event_id AS BIGINT)) AS ts, event_id % 501 <> 0 AS json FROM events),
    g AS (SELECT *, json AND e % 97 <> 0 AS good, json AND e % 97 <> 0 AND e % 211 = 0 AS ahead FROM l),
    w AS (SELECT *, good AND NOT ahead AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-03 01:00:00' AS recent, good AND NOT ahead AND ts > TIMESTAMP '2024-01-03 01:00:00' AS later FROM g)
    SELECT CAST(src AS VARCHAR) AS src, count(*) AS lines, count(*) FILTER (good) AS records, count(*) FILTER (json AND NOT good) AS naive, count(*) FILTER (ahead OR later) AS future, max(e) - max(CASE WHEN good THEN e END) AS behind,
        count(*) FILTER (recent AND e % 37 = 0) AS refusals, strftime(max(CASE WHEN recent AND e % 37 = 0 THEN ts END), '%Y-%m-%d %H:%M:%S') AS newest_refusal,
        coalesce(string_agg(DISTINCT concat('kind', e % 3), ',' ORDER BY concat('kind', e % 3)) FILTER (recent AND e % 37 = 0), '') AS kinds,
        2 * count(*) FILTER (recent AND e % 41 = 0 AND e % 37 <> 0) AS errors, concat('E', max(CASE WHEN recent AND e % 41 = 0 AND e % 37 <> 0 THEN e END) % 5) AS error_code FROM w GROUP BY 1 ORDER BY 1""".replace("max(e) - max(CASE WHEN good THEN e END) AS behind", "(max(e) - max(CASE WHEN good THEN e END)) // 5 AS tail"))
def log_health(spark, sf_dir):
    """The evaluation of a log that is read by its own source, at midnight of the third of January over a day."""
    made = health.evaluate(read_log(spark, _log(spark, sf_dir)), F.lit("2024-01-03").cast("timestamp"))
    return made.select(F.regexp_extract("src", "src=([0-9]+)", 1).alias("src"), "lines", "records", "naive", "future", "tail", "refusals", F.date_format("newest_refusal", "yyyy-MM-dd HH:mm:ss").alias("newest_refusal"), F.array_join("kinds", ",").alias("kinds"), "errors", F.coalesce("error_code", F.lit("E")).alias("error_code"))


@query("""WITH c AS (SELECT CASE page_id % 7 WHEN 0 THEN 'gone' WHEN 1 THEN 'blocked' WHEN 2 THEN 'strange' WHEN 3 THEN NULL ELSE 'unchanged' END AS o FROM pages),
    n AS (SELECT unnest(['unchanged', 'changed', 'unstable', 'stable_unchanged', 'stable_changed', 'stable_baseline', 'stable_rebaselined', 'prefix_agreed', 'incomparable', 'gone', 'malformed', 'blocked', 'rate_limited', 'server_error', 'no_content', 'timeout', 'unreachable', 'other', 'rows']) AS line, unnest(range(19)) AS ord)
    SELECT 'verify' AS job, CAST(ord AS INTEGER) AS ord, line, (SELECT count(*) FROM c WHERE CASE line WHEN 'rows' THEN true WHEN 'other' THEN o IS NULL OR o = 'strange' ELSE o = line END) AS n FROM n""")
def verify_report(spark, sf_dir):
    """Counters that come with the write of a verify pass over pages whose number was declared."""
    pages = table(spark, sf_dir, "pages")
    landed = land(pages.select("page_id", "url"), pages.count(), shared_folder(spark))
    outcome = F.expr("CASE page_id % 7 WHEN 0 THEN 'gone' WHEN 1 THEN 'blocked' WHEN 2 THEN 'strange' WHEN 3 THEN NULL ELSE 'unchanged' END")
    return report(landed.withColumn("outcome", outcome), f"{shared_folder(spark)}/rows", "verify")


@query(f"""WITH {fx.I_SQL}, d AS (SELECT *, content_hash IS NULL AND item_key IS NOT NULL AND (last_outcome IS NULL OR last_outcome = 'ok') AS due,
        CASE WHEN page_id % 13 = 0 THEN 'internal_error' ELSE CASE page_id % 10 WHEN 5 THEN 'not_visible' WHEN 6 THEN 'blocked' WHEN 7 THEN 'rate_limited' WHEN 8 THEN 'server_error' WHEN 9 THEN 'no_content' ELSE 'ok' END END AS o FROM i)
    SELECT concat(d.url, '#', d.page_id) AS url, CASE WHEN due AND o = 'ok' THEN sha256(p.html) ELSE content_hash END AS content_hash, CASE WHEN due AND o = 'ok' THEN CAST(octet_length(encode(p.html)) AS BIGINT) END AS hash_bytes,
        CASE WHEN due AND o <> 'internal_error' THEN o ELSE last_outcome END AS last_outcome, due AND o = 'ok' AS sketched FROM d JOIN pages p USING (page_id)""")
def snapshot_pass(spark, sf_dir):
    """Two passes over a kept index, the second of which finds only what is ours to mend; every thirteenth read failed on our side."""
    p, top = F.col("page_id"), shared_folder(spark)
    unique, none = F.concat("url", F.lit("#"), p), F.lit(None)
    empty = {"hash_bytes": "long", "hash_truncated": "boolean", "final_url": "string", "content_sketch": "array<string>", "content_sketch_algo": "string", "hashed_at": "timestamp", "last_attempt_at": "timestamp"}
    rows = fx.index(spark, sf_dir).select(unique.alias("url"), "item_key", "first_seen", "content_hash", "last_outcome", *(none.cast(t).alias(c) for c, t in empty.items()))
    index = Buckets(spark, f"{top}/index", "url", 16)
    index.merge(0, rows, newest("url"))
    reads = fx.reads(spark, sf_dir).filter("read_no = 1").select(unique.alias("url"), F.when(p % 13 != 0, F.col("status")).alias("status"), F.when(p % 13 == 0, "unsafe_host").alias("error"), none.cast("string").alias("final_url"), "body", F.lit(True).alias("complete"))
    for day in ("2024-03-01", "2024-03-02"):
        snapshot.run(index, reads, F.lit(day).cast("timestamp"), 1 << 30)
    return index.read().select("url", "content_hash", "hash_bytes", "last_outcome", F.col("content_sketch").isNotNull().alias("sketched"))


# A host as it is written, and as it is looked up; by page_id % 8.
_HOSTS = (("BÜCHER.Example", "xn--bcher-kva.example"), ("faß.de", "fass.de"), ("日本語。jp", "xn--wgv71a119e.jp"), ("пример.рф", "xn--e1afmkfd.xn--p1ai"), ("ä" * 60 + ".org", None), ("a\u00ad\u200bb.org", "ab.org"), ("mañana.com.", "xn--maana-pta.com."), ("x\u2028y.org", None))


@query(f"SELECT page_id, CASE page_id % 8 {' '.join(f"WHEN {k} THEN {repr(a) if a else 'NULL'}" for k, (_, a) in enumerate(_HOSTS))} END AS name FROM pages")
def host_names(spark, sf_dir):
    host = F.get(F.array(*(F.lit(h) for h, _ in _HOSTS)), (F.col("page_id") % 8).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", names.ascii_names(host).alias("name"))
