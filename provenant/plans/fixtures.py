"""Messages, sightings, reads, index, log and operations derived from the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.urls import DEFAULT, PARTS
from provenant.sources.tables import table

#: A bare address in the messages made here, where no address holds brackets.
BARE = r"https?://[^ \t\r\n<>\"'`\[\](){}]+"
# How a message shows or cites its page, by (conv_id + turn) % 6.
_FORMS = (" See {}.", " [ref]({}).", " `{}`", "\n```\n{}\n```\n", " (cf. {}) and again {}, done.", "")


def messages(spark: SparkSession, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("__url"))
    n = pages.count()
    c = (table(spark, sf_dir, "conversations") if turns is None else turns).select("conv_id", "turn", "role", "text")
    c = c.withColumn("page_id", (F.col("conv_id") * 7 + F.col("turn") * 3) % n)
    kind = (F.col("conv_id") + F.col("turn")) % 6
    said = F.lit("")
    for k, form in enumerate(_FORMS):
        said = F.when(kind == k, F.replace(F.lit(form), F.lit("{}"), F.col("__url"))).otherwise(said)
    seen = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int"))
    return c.join(pages, "page_id").select(F.concat_ws(":", "conv_id", "turn").alias("msg_id"), F.col("conv_id").alias("session"), F.col("turn").alias("turn_seq"), "role", F.concat(F.coalesce("text", F.lit("")), said).alias("text"), seen.alias("seen"))


def _form_sql(form: str) -> str:
    return "replace('" + form + "', '{}', p.url)"


M_SQL = f"""n AS (SELECT count(*) AS c FROM pages),
m AS (SELECT concat(t.conv_id, ':', t.turn) AS msg_id, t.conv_id AS session, t.turn AS turn_seq, t.role,
    coalesce(t.text, '') || CASE (t.conv_id + t.turn) % 6 {" ".join(f"WHEN {k} THEN {_form_sql(f)}" for k, f in enumerate(_FORMS))} END AS text,
    CAST('2024-01-01' AS DATE) + CAST(t.conv_id % 30 AS INTEGER) AS seen
    FROM conversations t CROSS JOIN n JOIN pages p ON p.page_id = (t.conv_id * 7 + t.turn * 3) % n.c)"""


def part_sql(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{PARTS}', {k})"


def host_sql(u: str) -> str:
    return f"nullif(lower(regexp_replace(regexp_replace({part_sql(u, 2)}, '^.*@', ''), ':[0-9]*$', '')), '')"


def canonical_sql(u: str) -> str:
    a, trackers = part_sql(u, 2), ", ".join(f"'{t}'" for t in DEFAULT.trackers)
    query = f"array_to_string(list_filter(string_split(substr({part_sql(u, 4)}, 2), '&'), lambda f: NOT list_contains([{trackers}], lower(split_part(f, '=', 1)))), '&')"
    port = f"regexp_extract({a}, '(:[0-9]+)$', 1)"
    return f"""CASE WHEN regexp_matches({u}, '{PARTS}') THEN lower({part_sql(u, 1)}) || '://' || regexp_extract({a}, '^(.*@)', 1) || coalesce({host_sql(u)}, '')
        || CASE WHEN regexp_matches({port}, '^:0+$') THEN '' ELSE {port} END || regexp_replace({part_sql(u, 3)}, '/+$', '')
        || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END ELSE {u} END"""


_BARE = BARE.replace("'", "''")
CITED_SQL = rf"""{M_SQL},
x AS (SELECT m.*, regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)```.*?(```|$)', ' ', 'g'), '`[^`]*`', ' ', 'g'), '{_BARE}') AS found FROM m),
y AS (SELECT x.* EXCLUDE (found), CAST(unnest(range(len(found))) AS INTEGER) AS pos, regexp_replace(unnest(found), '[.,;:\]}}>]+$', '') AS raw FROM x),
z AS (SELECT y.*, {canonical_sql('raw')} AS url FROM y),
cited AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY msg_id, url ORDER BY pos) = 1)"""


def sightings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    src = (F.col("event_id") * 31 + F.col("user_id")) % 997
    rows = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(src.alias("src"), F.to_date("ts").alias("seen"))
    seen = rows.select(F.concat(F.lit("s"), "src").alias("url"), "seen")
    return seen, rows.filter("src % 3 = 0").select(F.concat(F.lit("s"), "src").alias("url")).distinct()


S_SQL = "s AS (SELECT concat('s', (event_id * 31 + user_id) % 997) AS url, ((event_id * 31 + user_id) % 997) % 3 = 0 AS triaged, CAST(ts AS DATE) AS seen FROM events WHERE event_type = 'signup')"


def reads(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """Two reads of each page, its html so many times over, with a status by page_id; the second differs where page_id % 4 is 1 or 2."""
    status = F.expr("CASE page_id % 10 WHEN 5 THEN 404 WHEN 6 THEN 403 WHEN 7 THEN 429 WHEN 8 THEN 503 WHEN 9 THEN 202 ELSE 200 END")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.repeat("html", times).alias("html"), status.alias("status"), F.explode(F.array(F.lit(1), F.lit(2))).alias("read_no"))
    body = F.when((F.col("read_no") == 2) & (F.col("page_id") % 4 == 1), F.concat("html", F.lit("<!-- nonce -->"))).when((F.col("read_no") == 2) & (F.col("page_id") % 4 == 2), F.substring("html", 1, 900)).otherwise(F.col("html"))
    return pages.select("page_id", "url", "read_no", "status", body.alias("body"))


R_SQL = """r AS (SELECT page_id, url, read_no, CASE page_id % 10 WHEN 5 THEN 404 WHEN 6 THEN 403 WHEN 7 THEN 429 WHEN 8 THEN 503 WHEN 9 THEN 202 ELSE 200 END AS status,
    CASE WHEN read_no = 2 AND page_id % 4 = 1 THEN html || '<!-- nonce -->' WHEN read_no = 2 AND page_id % 4 = 2 THEN substr(html, 1, 900) ELSE html END AS body
    FROM pages CROSS JOIN (SELECT unnest([1, 2]) AS read_no))"""
OUTCOME_SQL = "CASE WHEN status IN (202, 204, 205) THEN 'no_content' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (404, 410) THEN 'gone' WHEN status IN (401, 403) THEN 'blocked' WHEN status = 429 THEN 'rate_limited' WHEN status BETWEEN 500 AND 599 THEN 'server_error' ELSE 'unreachable' END"


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % k).cast("int"))
    p = F.col("page_id")
    key = F.concat(F.lit("K"), p)
    return table(spark, sf_dir, "pages").filter(p % 19 != 0).select(
        p, "url", F.when(p % 11 != 0, key).alias("item_key"), F.when(p % 11 == 0, key).alias("pending_key"), day(30).alias("first_seen"), F.when(p % 5 != 0, day(28)).alias("verified_at"), F.when(p % 3 == 0, F.sha2("html", 256)).alias("content_hash"), F.when(p % 4 == 0, "gone").when(p % 4 == 1, "ok").alias("last_outcome")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    pages = table(spark, sf_dir, "pages").filter(p % 17 != 0).select(p, F.when(p % 13 == 0, F.concat("url", F.lit("/x"))).otherwise(F.col("url")).alias("url"))
    return pages.select(F.concat(F.lit("K"), p).alias("key"), "url").unionByName(pages.filter(p % 23 == 0).select(F.concat(F.lit("D"), p).alias("key"), "url"))


I_SQL = """i AS (SELECT page_id, url, CASE WHEN page_id % 11 <> 0 THEN concat('K', page_id) END AS item_key, CASE WHEN page_id % 11 = 0 THEN concat('K', page_id) END AS pending_key,
    CAST('2024-01-01' AS DATE) + CAST(page_id % 30 AS INTEGER) AS first_seen, CASE WHEN page_id % 5 <> 0 THEN CAST('2024-01-01' AS DATE) + CAST(page_id % 28 AS INTEGER) END AS verified_at,
    CASE WHEN page_id % 3 = 0 THEN sha256(html) END AS content_hash, CASE page_id % 4 WHEN 0 THEN 'gone' WHEN 1 THEN 'ok' END AS last_outcome FROM pages WHERE page_id % 19 <> 0),
it0 AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN url || '/x' ELSE url END AS url FROM pages WHERE page_id % 17 <> 0),
it AS (SELECT concat('K', page_id) AS key, url FROM it0 UNION ALL SELECT concat('D', page_id), url FROM it0 WHERE page_id % 23 = 0)"""


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    refused = F.when(e % 37 == 0, F.concat(F.lit('"kind'), e % 3, F.lit('"'))).otherwise("null")
    line = F.when(e % 501 == 0, '{"ts": 17').otherwise(F.concat(F.lit('{"ts": '), e * 60 + 1704067200, F.lit(', "urls_new": '), e % 4, F.lit(', "refused_kind": '), refused, F.lit("}")))
    return table(spark, sf_dir, "events").select((e % 5).alias("src"), e.alias("seq"), line.alias("value"))
