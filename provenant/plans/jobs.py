"""Registered queries of the capture job and its replay, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import urls
from provenant.operators import capture, job
from provenant.plans import fixtures as fx
from provenant.plans.catalog import _CLAIM_SQL, query
from provenant.sources.tables import table, transcripts
from provenant.streaming.index import shared_folder

_NET = urls.Rules(reserved_domains=("example.net",))


@query(f"""WITH {fx.CITED_SQL}, e AS (SELECT *, regexp_matches({fx.host_sql('url')}, '(^|[.])example[.]net$') AS excluded FROM cited), k AS (SELECT DISTINCT url FROM e WHERE seen < CAST('2024-01-10' AS DATE)),
    s AS (SELECT e.*, CASE WHEN excluded THEN 'excluded' WHEN k.url IS NOT NULL AND length(e.url) % 4 <> 0 THEN 'recurring' WHEN k.url IS NOT NULL THEN 'deferred'
        WHEN row_number() OVER (PARTITION BY e.url ORDER BY seen, msg_id) = 1 THEN 'new' ELSE 'recurring' END AS state FROM e LEFT JOIN k ON k.url = e.url WHERE role IN ('user', 'assistant'))
    SELECT m.msg_id, count(s.url) AS seen, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'recurring') AS recurring, count(*) FILTER (state = 'excluded') AS excluded, count(*) FILTER (state = 'deferred') AS deferred
    FROM m LEFT JOIN s ON s.msg_id = m.msg_id WHERE m.role IN ('user', 'assistant') AND trim(m.text) <> '' GROUP BY m.msg_id""")
def capture_job(spark, sf_dir):
    """From JSON lines to counters: conversations written as transcripts, in one block of text or two, read back and captured against what was known on the tenth."""
    messages, top = fx.messages(spark, sf_dir), f"{shared_folder(spark)}/transcripts"
    block = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("https://tools.org/not-said").alias("text"))
    # A text that is written as two blocks is cut at its first newline, which joining puts back.
    cut = F.instr("text", "\n")
    blocks = F.when(cut > 0, F.array(block(F.substring("text", F.lit(1), cut - 1)), tool, block(F.substring("text", cut + 1, F.length("text"))))).otherwise(F.array(tool, block(F.col("text"))))
    record = lambda content: F.to_json(F.struct(F.col("role").alias("type"), F.col("session").cast("string").alias("sessionId"), F.col("msg_id").alias("uuid"), F.col("seen").cast("string").alias("timestamp"), F.struct(content.alias("content")).alias("message")))
    line = F.when(F.col("role") == "user", record(F.col("text"))).otherwise(record(blocks))
    lines = messages.select("session", "turn_seq", line.alias("value"))
    lines.repartition("session").sortWithinPartitions("session", "turn_seq").select("value").write.text(top)
    said = transcripts(spark, top).select("msg_id", "session", "turn_seq", "role", "text", F.to_date("stamp").alias("seen"), F.lit("wells").alias("project"))
    known = capture.url_index(capture.citations(messages.filter("seen < '2024-01-10'"), _NET)).select("url", F.when(F.length("url") % 4 != 0, F.lit("K")).alias("item_key"))
    return job.run(said, known, _NET).counters.drop("claims", "errors")


@query(f"""WITH {fx.CITED_SQL}, {_CLAIM_SQL.replace("SELECT url, seen, CASE", "SELECT url, seen, msg_id, role, CASE")},
    c AS (SELECT *, CASE WHEN role = 'user' THEN 'user-shared' ELSE 'general' END AS context, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS origin FROM claims)
    SELECT url, claim, CAST(min(seen) AS VARCHAR) AS first_seen, count(*) AS times_seen, (min(struct_pack(s := seen, m := msg_id, c := context))).c AS context, (min(struct_pack(s := seen, m := msg_id, o := origin))).o AS origin FROM c GROUP BY url, claim""")
def claim_origins(spark, sf_dir):
    """Where each claim was made first: what the whole job keeps of it."""
    messages = fx.messages(spark, sf_dir).withColumn("project", F.lit(None).cast("string"))
    nothing = spark.createDataFrame([], "url string, item_key string")
    made = job.run(messages, nothing, urls.Rules(reserved_domains=())).claims
    return made.select("url", "claim", F.col("first_seen").cast("string").alias("first_seen"), "times_seen", "context", "origin")


@query(f"""WITH {fx.M_SQL}, t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn_seq) AS segment FROM m WHERE trim(text) <> ''),
    l AS (SELECT * FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY session, segment ORDER BY turn_seq DESC) = 1)
    SELECT session, turn_seq, text FROM l WHERE regexp_matches(lower(text), 'https?://')""")
def live_turn_texts(spark, sf_dir):
    return job.live_turns(fx.messages(spark, sf_dir)).select("session", "turn_seq", "text")


@query("""WITH q AS (SELECT user_id AS url, count(*) % 7 AS attempts, min(event_id) AS first_failed, max(event_id) AS last_failed, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS seen_date FROM events GROUP BY user_id),
    o AS (SELECT *, CASE WHEN attempts >= 5 THEN 'abandoned' WHEN url % 3 = 0 OR url % 5 = 0 THEN 'recovered' WHEN url % 3 = 1 THEN 'deferred' WHEN url % 5 = 1 THEN 'failed' ELSE 'waiting' END AS outcome FROM q)
    SELECT CAST(url AS VARCHAR) AS url, seen_date, outcome, CASE WHEN outcome IN ('abandoned', 'recovered') THEN NULL WHEN outcome = 'failed' THEN attempts + 1 ELSE attempts END AS attempts FROM o""")
def replay_queue(spark, sf_dir):
    """Users stand for addresses and their events for failures; by user_id % 3 the index has an item, a claim or nothing, by user_id % 5 a writer has stored, failed or not tried."""
    u = F.col("user_id")
    events = table(spark, sf_dir, "events")
    queue = events.groupBy("user_id").agg((F.count(F.lit(1)) % 7).alias("attempts"), F.min("event_id").alias("first_failed"), F.max("event_id").alias("last_failed"), F.to_date(F.min("ts")).alias("seen_date"))
    queue = queue.select(u.cast("string").alias("url"), F.lit("p").alias("project"), F.lit("c").alias("context"), "seen_date", "first_failed", "last_failed", "attempts", F.lit("e").alias("last_error"), u)
    index = queue.filter(u % 3 < 2).select("url", F.when(u % 3 == 0, "K").alias("item_key"))
    written = queue.filter(u % 5 < 2).select("url", (u % 5 == 0).alias("ok"))
    left, outcomes = job.replay(queue.drop("user_id"), index, written, F.lit(0).cast("long"))
    return outcomes.join(left.select("url", "attempts"), "url", "left").select("url", F.col("seen_date").cast("string").alias("seen_date"), "outcome", "attempts")
