"""The registered queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import extract, stamps, urls
from provenant.operators import capture, content, coverage, delta, gates, incidents, ledger, reports, upkeep
from provenant.plans import fixtures as fx
from provenant.sources.tables import of_host, table
from provenant.streaming import index as streaming

FLAGSHIP, RUN = "url_index_build", "2024-01-30"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _dated(df: DataFrame) -> DataFrame:
    """Dates as ISO text."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT page_id, {fx.canonical_sql('url')} AS canonical, {fx.host_sql('url')} AS host FROM pages")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.host(F.col("url")).alias("host"))


_ODD = ("https://LOCALHOST:8080/x", "https://fonts.gstatic.com/a", "https://box.tail.ts.net/", "https://site.com/a.PNG", "https://site.com/wiki/a.png", "https://doi.org/10.1/", "https://doi.org/10.1000/ab", "https://dotless/", "http://10.2.3.4/", "http://8.8.8.8/", "mailto:a")
_REASON = (None, "exact_host", "infra_host", "private_suffix", "asset", None, "malformed_doi", None, "dotless", "unsafe_address", None, "no_host")


@query(f"SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'reserved_name' {' '.join(f'''WHEN {k} THEN '{r}' ''' for k, r in enumerate(_REASON) if r)} END AS reason FROM pages")
def exclusion_reasons(spark, sf_dir):
    odd = F.get(F.array(*map(F.lit, _ODD)), (F.col("page_id") % 12 - 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.excluded_reason(F.coalesce(odd, "url")).alias("reason"))


@query(f"SELECT array_to_string(string_split({fx.host_sql('url')}, '.')[-2:], '.') AS site, count(*) AS n FROM pages GROUP BY 1")
def site_rollup(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.site(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT page_id, url, list_filter(string_split({fx.part_sql('url', 3)}, '/'), lambda s: s <> '') AS steps FROM pages)
    SELECT page_id, CASE WHEN len(steps) > 1 THEN {fx.part_sql('url', 1)} || '://' || {fx.part_sql('url', 2)} || '/' || array_to_string(steps[:len(steps) - 1], '/') END AS parent FROM p""")
def parent_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.parent(F.col("url")).alias("parent"))


@query("SELECT page_id, page_id % 5 IN (1, 2, 3) AS unbalanced, page_id % 5 = 4 AS vcs FROM pages")
def bracket_balance(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, ("(a)[b]", "(a", "a)", "[a(b])(", "x.git@v1"))), (F.col("page_id") % 5).cast("int"))
    damaged = F.concat(F.regexp_replace("url", r"[\[\]()]", ""), tail)
    return table(spark, sf_dir, "pages").select("page_id", urls.unbalanced(damaged).alias("unbalanced"), urls.vcs_requirement(damaged).alias("vcs"))


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey % 224) * 16777216 + (l_partkey % 256) * 65536 + (l_suppkey % 256) * 256 + l_linenumber AS number,
    l_orderkey % 224 IN (0, 10, 127) OR (l_orderkey % 224 = 100 AND l_partkey % 256 BETWEEN 64 AND 127) OR (l_orderkey % 224 = 169 AND l_partkey % 256 = 254)
    OR (l_orderkey % 224 = 172 AND l_partkey % 256 BETWEEN 16 AND 31) OR (l_orderkey % 224 = 192 AND l_partkey % 256 = 168) OR (l_orderkey % 224 = 198 AND l_partkey % 256 IN (18, 19))
    OR (l_orderkey % 224 = 192 AND l_partkey % 256 = 0 AND (l_suppkey % 256 = 2 OR (l_suppkey % 256 = 0 AND l_linenumber NOT IN (9, 10))))
    OR (l_orderkey % 224 = 198 AND l_partkey % 256 = 51 AND l_suppkey % 256 = 100) OR (l_orderkey % 224 = 203 AND l_partkey % 256 = 0 AND l_suppkey % 256 = 113) AS unsafe FROM lineitem""")
def ip_literal_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", urls.ipv4(F.concat_ws(".", F.col("l_orderkey") % 224, F.col("l_partkey") % 256, F.col("l_suppkey") % 256, "l_linenumber")).alias("number"))
    return rows.withColumn("unsafe", urls.unsafe_ipv4(F.col("number")))


#: Notations of one host, written by hand, and whether it is unsafe.
_HOSTS = (("2130706433", True), ("0x7f000001", True), ("017700000001", True), ("127.1", True), ("10.1", True), ("134744072", False), ("8.8.8.8", False), ("[::1]", True), ("[2606:4700::1111]", False), ("[::ffff:10.0.0.1]", True), ("[::ffff:8.8.8.8]", False), ("[fe80::1]", True), ("[2001:db8::5]", True), ("192.0.2.7", True), ("198.19.0.1", True), ("203.0.113.9", True), ("[1::2::3]", False))


@query(f"SELECT page_id, CASE WHEN page_id % {len(_HOSTS)} IN ({', '.join(str(k) for k, (_, bad) in enumerate(_HOSTS) if bad)}) THEN 'unsafe_address' WHEN page_id % {len(_HOSTS)} = {len(_HOSTS) - 1} THEN 'dotless' END AS reason FROM pages")
def ip_notations(spark, sf_dir):
    host = F.get(F.array(*(F.lit(h) for h, _ in _HOSTS)), (F.col("page_id") % len(_HOSTS)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.excluded_reason(F.concat(F.lit("http://"), host, F.lit(":8080/a"))).alias("reason"))


#: Texts around an address, and what they cite, written by hand: {} is the address.
_CITING = (
    ("See {}.", "{}"), ("**{}** (cf. [x]({}))", "{}"), ("`{}` and ``{}``", ""), ("a\n\n```\n{}\n~~~\n", ""), ("> ~~~\n> {}\n> ~~~\n\n{}/q", "{}/q"), ("![b]({}/i) [l]({}/j 'x')", "{}/j"),
    ("({}/P_(s))", "{}/P_(s)"), ("{}/P_(s and", ""), ("{}/{id}/x", ""), ("[{}/label]({}/target)", "{}/target"), ('<a href="{}/h">h</a>', "{}/h"), ("<div>\n{}\n</div>\n\n<{}/auto>", "{}/auto"),
    ("text\n\n    {}\n\nend", ""), ("- item\n    {}/li", "{}/li"), ("[r][1]\n\n[1]: {}/ref", "{}/ref"), ("| {}/cell | x |", "{}/cell"), ("[t]({}/%7Bid%7D)", ""), ("'{}/it's'", "{}/it's"), ("{}/a?x=1&amp;y=2!", "{}/a?x=1&y=2"),
)


@query(f"""SELECT page_id, replace(CASE page_id % {len(_CITING)} {' '.join("WHEN " + str(k) + " THEN '" + want.replace("'", "''") + "'" for k, (_, want) in enumerate(_CITING))} END, '{{}}', url) AS cited FROM pages""")
def citations_markdown(spark, sf_dir):
    form = F.get(F.array(*(F.lit(t) for t, _ in _CITING)), (F.col("page_id") % len(_CITING)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(extract.citations(F.replace(form, F.lit("{}"), F.col("url"))), lambda c: c["raw"]), " ").alias("cited"))


#: Fields after an address and what canonical leaves of them, written by hand.
_FIELDS = (("?utm_source=x&a=1", "?a=1"), ("?UTM_Medium=y", ""), ("?a=1&fbclid=2&b=%20", "?a=1&b=%20"), ("?utm%5Fid=7&c", "?c"), ("?references=1", "?references=1"), ("?b=2&b=2#top", "?b=2&b=2"), ("/#x", ""))


@query(f"SELECT page_id, CASE page_id % {len(_FIELDS)} {' '.join(f'''WHEN {k} THEN '{want}' ''' for k, (_, want) in enumerate(_FIELDS))} END AS fields FROM pages")
def tracker_strip(spark, sf_dir):
    site = F.lit("https://Site.org:0/x")
    tail = F.get(F.array(*(F.lit(t) for t, _ in _FIELDS)), (F.col("page_id") % len(_FIELDS)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(urls.canonical(F.concat(site, tail)), F.lit("https://site.org/x"), F.lit("")).alias("fields"))


@query(f"WITH {fx.CITED_SQL} SELECT msg_id, pos, raw, url FROM cited")
def citations_extract(spark, sf_dir):
    return capture.citations(fx.messages(spark, sf_dir)).select("msg_id", "pos", "raw", "url")


@query(f"WITH {fx.CITED_SQL} SELECT url, CAST(min(seen) AS VARCHAR) AS first_seen, CAST(max(seen) AS VARCHAR) AS last_seen, count(*) AS times_seen FROM cited GROUP BY url")
def url_index_build(spark, sf_dir):
    return _dated(capture.url_index(capture.citations(fx.messages(spark, sf_dir))))


@query(ORACLE["url_index_build"])
def index_upsert(spark, sf_dir):
    """The same index from two batches of messages, one merged into the other."""
    messages = fx.messages(spark, sf_dir)
    one, two = (capture.url_index(capture.citations(messages.filter(F.col("session") % 2 == k))) for k in (0, 1))
    return _dated(capture.merge_index(one, two))


@query(ORACLE["url_index_build"])
def stream_index_equals_batch(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    turns = spark.readStream.schema(given.schema).parquet(f"{sf_dir}/conversations.parque[t]")
    return _dated(streaming.keep_index(fx.messages(spark, sf_dir, turns), streaming.shared_folder(spark)))


@query(f"""WITH {fx.CITED_SQL}, k AS (SELECT DISTINCT url FROM cited WHERE seen < CAST('2024-01-10' AS DATE))
    SELECT m.msg_id, count(c.url) AS seen, CAST(0 AS BIGINT) AS excluded, count(k.url) AS recurring, count(c.url) - count(k.url) AS new
    FROM m LEFT JOIN cited c ON c.msg_id = m.msg_id LEFT JOIN k ON k.url = c.url GROUP BY m.msg_id""")
def capture_counters(spark, sf_dir):
    messages = fx.messages(spark, sf_dir)
    cited = capture.citations(messages, urls.DEFAULT).withColumn("excluded_reason", urls.excluded_reason(F.col("url"), urls.Rules(reserved_domains=())))
    return capture.message_counters(messages, cited, cited.filter("seen < DATE'2024-01-10'").select("url").distinct())


_CLAIM_SQL = r"""spot AS (SELECT cited.*, instr(text, raw) AS k FROM cited),
parts AS (SELECT spot.*, regexp_extract(substr(text, 1, k - 1), '(?s)^(?:.*(?:[.!?][ \n]|\n))?(.*)$', 1) AS before, substr(text, k + length(raw)) AS rest FROM spot),
tails AS (SELECT parts.*, regexp_extract(rest, '(?s)^(.*?[.!?])(?:[ \n]|$)', 1) AS stop, regexp_extract(rest, '^([^\n]*)', 1) AS line FROM parts),
said AS (SELECT tails.*, CASE WHEN stop = '' THEN line ELSE split_part(stop, chr(10), 1) END AS after FROM tails),
whole AS (SELECT said.*, trim(regexp_replace(before || raw || after, '[ \t\r\n]+', ' ', 'g')) AS w, regexp_replace(before || after, '[ \t\r\n\[\]().,;:!?`]', '', 'g') <> '' AS words FROM said),
claims AS (SELECT url, seen, CASE WHEN length(w) > 400 THEN regexp_replace(substr(w, 1, 400), ' [^ ]*$', '') || ' […]' ELSE w END AS claim FROM whole WHERE words)"""


@query(f"""WITH {fx.CITED_SQL}, {_CLAIM_SQL}, links AS (SELECT url, claim, CAST(min(seen) AS VARCHAR) AS first_seen, CAST(max(seen) AS VARCHAR) AS last_seen, count(*) AS times_seen FROM claims GROUP BY url, claim)
    SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY url ORDER BY first_seen, claim) <= 50""")
def claims_links(spark, sf_dir):
    return _dated(capture.claim_links(capture.citations(fx.messages(spark, sf_dir)), fx.messages(spark, sf_dir)))


@query("""WITH seg AS (SELECT conv_id AS session, turn AS turn_seq, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM conversations)
    SELECT session, segment, max(turn_seq) AS turn_seq FROM seg WHERE role = 'assistant' GROUP BY session, segment""")
def turn_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("turn_seq"), "role")
    return capture.last_of_segment(capture.turn_segments(rows))


@query(f"WITH {fx.S_SQL} SELECT url, array_to_string(list_sort(list_distinct(list(concat('seen:', seen)))), ',') AS tags FROM s GROUP BY url")
def tag_sets(spark, sf_dir):
    seen, _ = fx.sightings(spark, sf_dir)
    return capture.tag_sets(seen.select("url", F.concat(F.lit("seen:"), "seen").alias("tag"))).select("url", F.array_join("tags", ",").alias("tags"))


_DELTA_SQL = f"""{fx.S_SQL}, g AS (SELECT url, count(DISTINCT CASE WHEN seen < CAST('{RUN}' AS DATE) THEN seen END) AS prior, max(CASE WHEN seen = CAST('{RUN}' AS DATE) THEN 1 ELSE 0 END) AS today, max(CASE WHEN triaged THEN 1 ELSE 0 END) AS triaged FROM s GROUP BY url),
d AS (SELECT *, CASE WHEN today = 1 AND prior >= 2 THEN CASE WHEN triaged = 1 THEN 'recurring_triaged' ELSE 'recurring_untriaged' END WHEN today = 1 AND prior = 1 THEN 'persisting' WHEN today = 1 THEN 'new' WHEN prior >= 1 THEN 'dropped' END AS bucket FROM g)"""


@query(f"WITH {_DELTA_SQL} SELECT url, prior, today, triaged, bucket FROM d")
def source_delta_buckets(spark, sf_dir):
    return delta.buckets(*fx.sightings(spark, sf_dir), RUN)


@query(f"WITH {_DELTA_SQL} SELECT bucket, count(*) AS n FROM d WHERE bucket IS NOT NULL GROUP BY bucket")
def delta_summary(spark, sf_dir):
    return delta.summary(delta.buckets(*fx.sightings(spark, sf_dir), RUN))


@query(f"WITH {fx.S_SQL}, w AS (SELECT DISTINCT concat('s', user_id) AS url FROM events) SELECT url, CASE WHEN url IN (SELECT url FROM s) THEN 'triaged' ELSE 'unknown_url' END AS status FROM w")
def triage_apply(spark, sf_dir):
    return delta.triage(fx.sightings(spark, sf_dir)[0], table(spark, sf_dir, "events").select(F.concat(F.lit("s"), "user_id").alias("url")))


@query(f"WITH {fx.R_SQL} SELECT {fx.OUTCOME_SQL} AS outcome, count(*) AS n FROM r GROUP BY 1")
def fetch_outcomes(spark, sf_dir):
    return fx.reads(spark, sf_dir).groupBy(content.outcome(F.col("status")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.R_SQL} SELECT {fx.host_sql('url')} AS host, count(*) AS reads, count(*) FILTER (status IN (401, 403, 429)) AS refused, count(*) FILTER (status IN (404, 410)) AS absent FROM r GROUP BY 1")
def host_tallies(spark, sf_dir):
    return content.host_tallies(fx.reads(spark, sf_dir).withColumn("final_url", F.lit(None).cast("string")))


@query(f"""WITH {fx.R_SQL}, p AS (SELECT url, {fx.OUTCOME_SQL} AS outcome, list_filter(string_split({fx.part_sql('url', 3)}, '/'), lambda s: s <> '') AS steps FROM r WHERE read_no = 1),
    q AS (SELECT *, CASE WHEN len(steps) > 1 THEN {fx.part_sql('url', 1)} || '://' || {fx.part_sql('url', 2)} || '/' || array_to_string(steps[:len(steps) - 1], '/') END AS parent FROM p),
    k AS (SELECT DISTINCT parent AS url FROM q WHERE parent IS NOT NULL AND length(parent) % 2 = 0)
    SELECT url, outcome, CASE WHEN outcome = 'gone' AND parent IS NOT NULL AND parent NOT IN (SELECT url FROM k) AND parent NOT IN (SELECT url FROM p WHERE outcome = 'ok') THEN 'not_visible' ELSE outcome END AS refined FROM q""")
def absence_corroborated(spark, sf_dir):
    """Parents whose address has an even length were read and seen; the others never were."""
    reads = fx.reads(spark, sf_dir).filter("read_no = 1").select("url", content.outcome(F.col("status")).alias("outcome"))
    parents = reads.select(urls.parent(F.col("url")).alias("url")).filter("length(url) % 2 = 0").distinct().withColumn("outcome", F.lit("ok"))
    return _refined(reads, parents)


def _refined(reads, parents):
    """Only the pages' own reads are reported; their parents' reads are evidence."""
    both = reads.select("url", "outcome").unionByName(parents)
    return content.corroborated(both).join(parents.select("url").distinct(), "url", "left_anti").select("url", "outcome", "refined")


@query(f"WITH {fx.I_SQL} SELECT url, CAST(first_seen AS VARCHAR) AS first_seen FROM i WHERE content_hash IS NULL AND item_key IS NOT NULL AND (last_outcome IS NULL OR last_outcome = 'ok') ORDER BY i.first_seen, url LIMIT 100")
def worklist_hash(spark, sf_dir):
    return upkeep.needs_hash(fx.index(spark, sf_dir), 100).select("url", F.col("first_seen").cast("string").alias("first_seen"))


@query(f"WITH {fx.I_SQL} SELECT url, CAST(verified_at AS VARCHAR) AS verified_at FROM i WHERE content_hash IS NOT NULL ORDER BY i.verified_at NULLS FIRST, url LIMIT 100")
def worklist_verify(spark, sf_dir):
    return upkeep.needs_verify(fx.index(spark, sf_dir), 100).select("url", F.col("verified_at").cast("string").alias("verified_at"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", content.content_hash(F.col("html")).alias("digest"))


@query()
def chunk_stats(spark, sf_dir):
    return content.chunk_stats(table(spark, sf_dir, "pages").select("url", F.col("html").alias("body")))


_SKETCH_SQL = "t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), v AS (SELECT DISTINCT doc_id, substr(sha256(w), 1, 16) AS v FROM t), k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v) <= 128), sk AS (SELECT doc_id, list_sort(list(v)) AS sketch FROM k GROUP BY doc_id)"


def _word_sketches(spark, sf_dir):
    digests = F.transform(F.split("text", " "), lambda w: F.sha2(w.cast("binary"), 256))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", content.sketch_of(digests).alias("sketch"))


@query(f"WITH {_SKETCH_SQL} SELECT doc_id, array_to_string(sketch, ',') AS sketch FROM sk")
def word_kmv_sketch(spark, sf_dir):
    return _word_sketches(spark, sf_dir).select("doc_id", F.array_join("sketch", ",").alias("sketch"))


@query(f"""WITH {_SKETCH_SQL}, p AS (SELECT a.doc_id, a.sketch AS a, b.sketch AS b, list_sort(list_distinct(list_concat(a.sketch, b.sketch))) AS u FROM sk a JOIN sk b ON b.doc_id = a.doc_id + 1),
    q AS (SELECT doc_id, a, b, CASE WHEN len(a) < 128 AND len(b) < 128 THEN u ELSE u[1:128] END AS low FROM p)
    SELECT doc_id, CAST(len(list_intersect(list_intersect(low, a), b)) AS DOUBLE) / len(low) AS similarity FROM q""")
def sketch_similarity(spark, sf_dir):
    one = _word_sketches(spark, sf_dir)
    two = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("sketch").alias("b"))
    return one.join(two, "doc_id").select("doc_id", content.similarity(F.col("sketch"), F.col("b")).alias("similarity"))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n]+', ' ', 'g')), '') AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", content.title(F.col("html")).alias("title"))


@query(r"""WITH p AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|template)\b.*?</(script|style|noscript|template)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS chars FROM pages)
    SELECT page_id, CAST(chars AS INTEGER) AS chars, chars < 800 AS gate FROM p""")
def title_gate(spark, sf_dir):
    chars = table(spark, sf_dir, "pages").select("page_id", content.visible_chars(F.col("html")).alias("chars"))
    return chars.withColumn("gate", F.col("chars") < content.GATE_CHARS)


@query(f"""WITH {fx.I_SQL}, {fx.R_SQL}, h AS (SELECT url, read_no, status, {fx.OUTCOME_SQL} AS o, sha256(body) AS d FROM r)
    SELECT i.url, CASE WHEN a.o <> 'ok' THEN a.o WHEN a.d = i.content_hash THEN 'unchanged' WHEN b.o <> 'ok' THEN b.o WHEN a.d <> b.d THEN 'unstable' ELSE 'changed' END AS verdict
    FROM (SELECT url, CASE WHEN page_id % 2 = 0 THEN content_hash ELSE 'older' END AS content_hash FROM i WHERE content_hash IS NOT NULL) i JOIN h a ON a.url = i.url AND a.read_no = 1 JOIN h b ON b.url = i.url AND b.read_no = 2""")
def verify_verdicts(spark, sf_dir):
    stored = fx.index(spark, sf_dir).filter("content_hash IS NOT NULL").select("url", F.when(F.col("page_id") % 2 == 0, F.col("content_hash")).otherwise("older").alias("content_hash"))
    return content.verdicts(stored, content.page_reads(fx.reads(spark, sf_dir)))


#: Times that a page stands in its reads.
_LONG = 20


def _verified(spark, sf_dir):
    """Stable sketches by page_id % 16: 9 of what an earlier pass agreed on, 1 of the page's text backwards, 5 of the page in an older kind; the others have none. So have content sketches: by page_id % 8, 3 of the page, 7 of its text backwards. Addresses are made unique by page, and pages long enough that a changed end is a small part."""
    p, unique = F.col("page_id"), F.concat("url", F.lit("#"), "page_id")
    indexed = fx.index(spark, sf_dir).filter("content_hash IS NOT NULL")
    given = table(spark, sf_dir, "pages").join(indexed.select("page_id"), "page_id", "left_semi").select(unique.alias("url"), F.repeat("html", _LONG).alias("html"), p)
    bodies = lambda chosen, turned: content.body_sketches(given.filter(chosen).select("url", F.when(turned, F.reverse("html")).otherwise(F.col("html")).alias("body")))
    earlier = given.filter(p % 16 == 9).select("url", F.explode(F.array(F.lit(1), F.lit(2))).alias("read_no"), "html")
    agreed = content.stable_sketches(earlier.select("url", "read_no", F.when(F.col("read_no") == 2, F.concat("html", F.lit("<!-- earlier -->"))).otherwise(F.col("html")).alias("body")))
    stable = bodies((p % 16).isin(1, 5), p % 16 == 1).unionByName(agreed).withColumnRenamed("sketch", "stable_sketch")
    whole = bodies((p % 8).isin(3, 7), p % 8 == 7).withColumnRenamed("sketch", "content_sketch")
    hashes = given.select("url", F.when(p % 2 == 0, F.sha2("html", 256)).otherwise("older").alias("content_hash"))
    stored = indexed.select(unique.alias("url"), F.when(p % 16 == 5, "older").otherwise(content.STABLE_ALGO).alias("stable_algo"), F.lit(content.CONTENT_ALGO).alias("content_sketch_algo")).join(hashes, "url")
    reads = fx.reads(spark, sf_dir, _LONG).select(unique.alias("url"), "read_no", "status", "body")
    return content.verify(stored.join(stable, "url", "left").join(whole, "url", "left"), reads)


@query()
def verify_verdicts_full(spark, sf_dir):
    return _verified(spark, sf_dir).select("url", "verdict", F.array_join("sketch", ",").alias("sketch"), F.array_join("content_sketch", ",").alias("content_sketch"), "similarity")


@query(f"""WITH {fx.I_SQL}, {fx.R_SQL}, h AS (SELECT page_id, read_no, {fx.OUTCOME_SQL} AS o FROM r)
    SELECT concat(i.url, '#', i.page_id) AS url, CASE WHEN o <> 'ok' THEN o WHEN i.page_id % 2 = 0 THEN 'unchanged' WHEN i.page_id % 4 = 3 THEN 'changed'
        ELSE CASE i.page_id % 16 WHEN 9 THEN 'stable_unchanged' WHEN 1 THEN 'stable_changed' WHEN 5 THEN 'stable_rebaselined' ELSE 'stable_baseline' END END AS verdict,
        o = 'ok' AND i.page_id % 2 = 1 AND i.page_id % 16 IN (5, 13) AS has_sketch, o = 'ok' AND i.page_id % 2 = 0 AS has_content_sketch,
        CASE WHEN o = 'ok' AND i.page_id % 8 = 3 THEN 'no resolvable difference' WHEN o = 'ok' AND i.page_id % 8 = 7 THEN 'less than half shared' ELSE 'size unknown' END AS note
    FROM i JOIN h ON h.page_id = i.page_id AND read_no = 1 WHERE content_hash IS NOT NULL""")
def verify_states(spark, sf_dir):
    """Every verdict by the form of its page, written by hand; what is to be stored, and the size of a change."""
    note = F.when(F.col("similarity") < 0.5, "less than half shared").otherwise(reports.overlap_note(F.col("similarity")))
    return _verified(spark, sf_dir).select("url", "verdict", F.col("sketch").isNotNull().alias("has_sketch"), F.col("content_sketch").isNotNull().alias("has_content_sketch"), note.alias("note"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'pmid' ELSE 'repo' END AS scheme, CASE l_linenumber % 4 WHEN 0 THEN concat('10.1000/', l_partkey) WHEN 1 THEN concat('2401.', 10000 + l_partkey % 10000) WHEN 2 THEN concat('', l_partkey) ELSE concat('o', l_suppkey, '/r', l_partkey) END AS id FROM lineitem")
def identifier_ids(spark, sf_dir):
    url = F.expr("CASE l_linenumber % 4 WHEN 0 THEN concat('https://doi.org/10.1000/', l_partkey) WHEN 1 THEN concat('https://arxiv.org/abs/2401.', 10000 + l_partkey % 10000, 'v2') WHEN 2 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', l_partkey, '/') ELSE concat('https://github.com/o', l_suppkey, '/r', l_partkey, '.git') END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", urls.identifier(url).alias("i")).select("l_orderkey", "l_linenumber", "i.scheme", "i.id")


_DAMAGED = "(SELECT page_id, {c} AS good FROM pages)".format(c=fx.canonical_sql("url"))


@query(f"""WITH p AS {_DAMAGED}, d AS (SELECT good, CASE page_id % 4 WHEN 0 THEN good WHEN 1 THEN good || ').' WHEN 2 THEN good || '**' ELSE good END AS url FROM p UNION ALL SELECT good, good || '**' FROM p WHERE page_id % 8 = 3)
    SELECT url, good AS corrected, CASE WHEN url = good THEN 'keep' WHEN good IN (SELECT url FROM d) THEN 'merge' ELSE 'rewrite' END AS action FROM d""")
def repair_plan(spark, sf_dir):
    return upkeep.repair_plan(_damaged(spark, sf_dir))


def _damaged(spark, sf_dir):
    p = F.col("page_id")
    good = table(spark, sf_dir, "pages").select(p, urls.canonical(F.col("url")).alias("good"))
    hurt = good.select(F.when(p % 4 == 1, F.concat("good", F.lit(")."))).when(p % 4 == 2, F.concat("good", F.lit("**"))).otherwise(F.col("good")).alias("url"))
    return hurt.unionByName(good.filter(p % 8 == 3).select(F.concat("good", F.lit("**")).alias("url")))


@query(f"""WITH {fx.I_SQL}, b AS (SELECT coalesce(i.item_key, it.key) AS key, i.url AS row_url, it.url AS item_url FROM (SELECT * FROM i WHERE item_key IS NOT NULL) i FULL JOIN it ON it.key = i.item_key)
    SELECT CASE WHEN item_url IS NULL THEN 'row_item_missing' WHEN row_url = item_url THEN 'ok' WHEN row_url IS NOT NULL THEN 'url_disagreement' WHEN key IN (SELECT pending_key FROM i WHERE pending_key IS NOT NULL) THEN 'orphan_pending_claim' WHEN item_url IN (SELECT url FROM i) THEN 'orphan_duplicate' ELSE 'orphan_stranded' END AS bucket, count(*) AS n FROM b GROUP BY 1""")
def reconcile_buckets(spark, sf_dir):
    return upkeep.reconcile(fx.index(spark, sf_dir), fx.items(spark, sf_dir))


@query("WITH q AS (SELECT user_id AS url, count(*) AS attempts, min(event_id) AS first_failed FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT *, CASE WHEN attempts >= 5 THEN 'abandon' ELSE 'replay' END AS action FROM q")
def retry_drain(spark, sf_dir):
    return upkeep.drain(table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("url"), F.col("event_id").alias("failed")))


@query("""WITH l AS (SELECT event_id % 5 AS src, event_id AS seq, event_id % 501 <> 0 AS good, event_id % 501 <> 0 AND event_id % 37 = 0 AS refused, event_id * 60 + 1704067200 AS ts FROM events)
    SELECT src, count(*) AS lines, count(*) FILTER (good) AS records, count(*) FILTER (NOT good) AS unparseable, count(*) FILTER (refused) AS refused, max(CASE WHEN refused THEN ts END) AS last_refused,
    coalesce(string_agg(DISTINCT concat('kind', seq % 3), ',' ORDER BY concat('kind', seq % 3)) FILTER (refused), '') AS kinds, max(seq) - max(CASE WHEN good THEN seq END) AS tail FROM l GROUP BY src""")
def health_warnings(spark, sf_dir):
    return upkeep.health(fx.capture_log(spark, sf_dir))


@query("""SELECT o_orderkey AS op_id, count(l_orderkey) AS steps, (max(struct_pack(s := l_linenumber, t := l_partkey))).t AS last_target FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 9 = 0 GROUP BY o_orderkey""")
def unfinished_ops(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("op_id"))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("op_id"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("seq"))
    return upkeep.unfinished(starts, steps, starts.filter("op_id % 9 <> 0"))


# Form of an address by page_id % 14, the tier it gets and why; the last two stay.
_RETIRE = (
    ("https://site.net/a{ID}", "hard", "placeholder"), ("https://site.net/a\x07b", "hard", "control_character"), ("mailto:a", "hard", "no_host"), ("https://printer.local/x", "policy", "only_in_context"), ("https://a.test/x", "hard", "reserved_name"),
    ("https://a..b/x", "hard", "no_name"), ("https://site.net/a.png", "policy", "asset"), ("https://fonts.gstatic.com/a", "policy", "infra_host"), ("https://box.tail.ts.net/x", "policy", "private_suffix"), ("http://10.2.3.4/x", "policy", "unsafe_address"),
    ("https://dotless/x", "policy", "dotless"), ("https://doi.org/10.1", "policy", "malformed_doi"), ("https://good.net/a", None, None), ("https://good.net/a**", None, None),
)


def _cases(k: int) -> str:
    return " ".join(f"WHEN {n} THEN '{row[k]}'" for n, row in enumerate(_RETIRE) if row[k])


_FORM_SQL = "CASE page_id % 14 " + " ".join("WHEN {} THEN '{}'".format(n, u.replace("\x07", "' || chr(7) || '")) for n, (u, _, _) in enumerate(_RETIRE)) + " END"


@query(f"SELECT {_FORM_SQL} AS url, CASE WHEN page_id % 11 <> 0 THEN concat('K', page_id) END AS item_key, CASE page_id % 14 {_cases(1)} END AS tier, CASE page_id % 14 {_cases(2)} END AS reason FROM pages WHERE page_id % 22 <> 0 AND page_id % 14 < 12")
def retire_plan(spark, sf_dir):
    """Rows without an item are retired too, unless a claim is pending."""
    p = F.col("page_id")
    form = F.get(F.array(*(F.lit(u) for u, _, _ in _RETIRE)), (p % 14).cast("int"))
    index = table(spark, sf_dir, "pages").select(form.alias("url"), F.when(p % 11 != 0, F.concat(F.lit("K"), p)).alias("item_key"), F.when(p % 22 == 0, "claim").alias("pending_key"))
    return gates.retire_plan(index, policy=True)


@query(f"WITH {fx.I_SQL} SELECT key, url, 'reserved_name' AS reason FROM it WHERE {fx.host_sql('url')} = 'example.org' OR {fx.host_sql('url')} LIKE '%.example.org'")
def prune_plan(spark, sf_dir):
    return gates.prune_plan(fx.items(spark, sf_dir), urls.Rules(reserved_domains=("example.org",)))


@query("""WITH s AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN concat('10.1000/', l_partkey) ELSE concat('10.1101/', l_partkey, 'v1') END AS doi, CASE WHEN l_linenumber % 2 = 0 THEN concat('https://doi.org/10.1000/', l_partkey) ELSE concat('https://www.biorxiv.org/content/10.1101/', l_partkey, 'v1') END AS url FROM lineitem WHERE l_linenumber < 7)
    SELECT doi, min(url) AS url, bool_or(p_partkey IS NOT NULL) AS checked, max(CASE WHEN p_partkey % 7 = 0 THEN 'retracted' END) AS finding FROM s LEFT JOIN part ON doi = concat('10.1000/', p_partkey) AND p_partkey % 3 <> 0 GROUP BY doi""")
def doi_gate(spark, sf_dir):
    url = F.expr("CASE WHEN l_linenumber = 7 THEN concat('https://doc.net/10.1000/', l_partkey) WHEN l_linenumber % 2 = 0 THEN concat('https://doi.org/10.1000/', l_partkey) ELSE concat('https://www.biorxiv.org/content/10.1101/', l_partkey, 'v1') END")
    notices = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("10.1000/"), "p_partkey").alias("doi"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'retracted' END").alias("finding"))
    return gates.doi_gate(table(spark, sf_dir, "lineitem").select(url.alias("url")), notices)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'gone' ELSE 'blocked' END AS outcome, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 4 < 2 THEN 'not_visible' WHEN o_orderkey % 5 <> 0 THEN 'gone' ELSE 'blocked' END AS refined FROM orders""")
def repo_downgrade(spark, sf_dir):
    """Repository addresses by o_orderkey % 4: a root, a root with .git, a deeper page, and a page of the code host's own."""
    url = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('https://github.com/o/r', o_orderkey) WHEN 1 THEN concat('https://github.com/o/r', o_orderkey, '.git') WHEN 2 THEN concat('https://github.com/o/r', o_orderkey, '/tree/x') ELSE concat('https://github.com/orgs/r', o_orderkey) END")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"), F.when(F.col("o_orderkey") % 5 != 0, "gone").otherwise("blocked").alias("outcome"))
    return gates.repo_downgrade(orders, orders.filter("o_orderkey % 3 = 0").select(F.concat(F.lit("o/r"), "o_orderkey").alias("slug"))).select("o_orderkey", "outcome", "refined")


@query(f"WITH {fx.I_SQL} SELECT url, pending_key, CASE WHEN page_id % 4 IN (0, 3) THEN 'in_flight' WHEN pending_key IN (SELECT key FROM it) THEN 'complete' ELSE 'release' END AS action FROM i WHERE item_key IS NULL AND pending_key IS NOT NULL")
def stale_claims(spark, sf_dir):
    """Claims by page_id % 4: 100 s old, 180 s, 500 s, and of unknown age."""
    at = F.expr("CASE page_id % 4 WHEN 0 THEN 900 WHEN 1 THEN 820 WHEN 2 THEN 500 END")
    return gates.stale_claims(fx.index(spark, sf_dir).withColumn("claimed_at", at), fx.items(spark, sf_dir), F.lit(1000))


@query(f"WITH {fx.I_SQL} SELECT url FROM i WHERE {fx.host_sql('url')} = 'example.net' OR {fx.host_sql('url')} LIKE '%.example.net'")
def host_rows(spark, sf_dir):
    return of_host(fx.index(spark, sf_dir), "example.net").select("url")


_TURNS_SQL = """seg AS (SELECT session, turn_seq, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn_seq ROWS UNBOUNDED PRECEDING) AS segment FROM m),
    last AS (SELECT session, max(turn_seq) AS turn_seq FROM seg WHERE role = 'assistant' GROUP BY session, segment)"""


@query(f"""WITH {fx.CITED_SQL}, {_TURNS_SQL}, u AS (SELECT url, max(CASE WHEN l.session IS NULL THEN 0 ELSE 1 END) AS final FROM cited c LEFT JOIN last l ON l.session = c.session AND l.turn_seq = c.turn_seq WHERE role = 'assistant' GROUP BY url),
    k AS (SELECT u.*, url IN (SELECT {fx.canonical_sql('url')} FROM pages WHERE page_id % 3 <> 0) AS known FROM u),
    counts AS (SELECT count(*) FILTER (final = 1) AS eligible, count(*) FILTER (final = 1 AND known) AS present, count(*) FILTER (final = 0) AS mid_only FROM k)
    SELECT *, present * CAST(100 AS DOUBLE) / nullif(eligible, 0) AS percent FROM counts""")
def capture_coverage(spark, sf_dir):
    messages = fx.messages(spark, sf_dir)
    index = table(spark, sf_dir, "pages").filter("page_id % 3 <> 0").select(urls.canonical(F.col("url")).alias("url"))
    counts = coverage.coverage(capture.citations(messages), capture.last_of_segment(capture.turn_segments(messages)), index)
    return counts.withColumn("percent", F.col("percent").cast("double"))


@query(f"""WITH {fx.CITED_SQL}, o AS (SELECT msg_id, list_distinct(regexp_extract_all(text, '{fx._BARE}')) AS a FROM m), b AS (SELECT msg_id, list(DISTINCT raw) AS b FROM cited GROUP BY msg_id),
    d AS (SELECT a, coalesce(b, []) AS b FROM o LEFT JOIN b USING (msg_id)), e AS (SELECT list_filter(a, lambda x: NOT list_contains(b, x)) AS lost, list_filter(b, lambda x: NOT list_contains(a, x)) AS gained FROM d)
    SELECT count(*) AS messages, count(*) FILTER (len(lost) + len(gained) > 0) AS changed, CAST(sum(len(lost)) AS BIGINT) AS lost, CAST(sum(len(gained)) AS BIGINT) AS gained,
    CAST(sum(len(list_filter(lost, lambda x: len(list_filter(gained, lambda y: starts_with(x, y))) > 0))) AS BIGINT) AS shortened FROM e""")
def extraction_diff(spark, sf_dir):
    """Every bare address, shown or cited and with its closing punctuation, against the citations."""
    messages = fx.messages(spark, sf_dir)
    old = messages.select("msg_id", F.array_distinct(F.regexp_extract_all("text", F.lit(fx.BARE), F.lit(0))).alias("urls"))
    return coverage.extraction_diff(old, capture.citations(messages).groupBy("msg_id").agg(F.collect_set("raw").alias("urls")))


@query("""WITH p AS (SELECT concat(url, '#', page_id) AS url, page_id % 4 AS form, string_split(html, ' ') AS a, string_split(substr(html, 1, 900), ' ') AS b FROM pages),
    k AS (SELECT url, a, CASE form WHEN 1 THEN a[:len(a) - 1] WHEN 2 THEN b[:len(b) - 1] || CASE WHEN list_contains(a[len(b):], b[len(b)]) THEN [b[len(b)]] ELSE [] END ELSE a END AS kept FROM p),
    s AS (SELECT url, CAST(coalesce(list_sum(list_transform(kept, lambda w: octet_length(encode(w)))), 0) AS BIGINT) AS kept, CAST(list_sum(list_transform(a, lambda w: octet_length(encode(w)))) AS BIGINT) AS total FROM k)
    SELECT *, CASE WHEN kept >= total * CAST(0.9 AS DOUBLE) THEN true END AS agreed FROM s""")
def reads_agreed(spark, sf_dir):
    """The words of two reads of a page stand for their chunks; the second has words at its end that are new every time, or stops early, perhaps inside a word."""
    words = fx.reads(spark, sf_dir).select(F.concat("url", F.lit("#"), "page_id").alias("url"), "read_no", F.split("body", " ").alias("digests"))
    return coverage.agreed(words.withColumn("sizes", F.transform("digests", lambda w: F.octet_length(w))))


def _records(spark, sf_dir):
    """Capture records by event_id: root, pin, what was observed of it, an identifier and whether anything was written."""
    of = "concat('/opt/v', event_id % 3) AS root", "CASE WHEN event_id % 4 <> 0 THEN concat('/opt/v', event_id % 2) END AS pinned", "CASE WHEN event_id % 10 = 3 THEN 'unknown' END AS seen", "CASE WHEN event_id % 6 <> 0 THEN concat('i', event_id) END AS incident_id", "event_id % 7 <> 0 AS wrote"
    r = table(spark, sf_dir, "events").selectExpr("event_id", *of)
    return r.select("event_id", "incident_id", incidents.kind(*(F.col(c) for c in ("root", "pinned", "seen", "incident_id", "wrote"))).alias("kind"))


_KIND_SQL = "k AS (SELECT event_id, concat('i', event_id) AS incident_id, CASE WHEN event_id % 6 = 0 OR event_id % 7 = 0 THEN NULL WHEN event_id % 10 = 3 THEN 'unverified' WHEN event_id % 4 <> 0 AND event_id % 3 <> event_id % 2 THEN 'stale' END AS kind FROM events)"


@query(f"WITH {_KIND_SQL} SELECT event_id, kind FROM k")
def incident_kinds(spark, sf_dir):
    return _records(spark, sf_dir).select("event_id", "kind")


@query(f"""WITH {_KIND_SQL} SELECT incident_id, coalesce(CASE WHEN event_id % 9 = 1 THEN 'stale' END, kind) AS kind, CASE WHEN event_id % 9 = 1 THEN 'closed' WHEN event_id % 5 = 2 THEN 'acknowledged' ELSE 'open' END AS status FROM k WHERE event_id % 9 = 1 OR kind IS NOT NULL""")
def incident_ledger(spark, sf_dir):
    """Every ninth incident is in the ledger and closed already; every fifth identifier is acknowledged after the import."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("i"), "event_id").alias("incident_id"), "event_id")
    old = events.filter("event_id % 9 = 1").select("incident_id", F.lit("stale").alias("kind"), F.lit("closed").alias("status"))
    ledger = incidents.open_incidents(old, _records(spark, sf_dir).select("incident_id", "kind"))
    return incidents.acknowledge(ledger, events.filter("event_id % 5 = 2"))[0].select("incident_id", "kind", "status")


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber, sha1(unhex('{stamps.WRITES}') || encode(concat(l_orderkey, chr(10), CASE WHEN l_linenumber % 4 <> 0 THEN concat('https://a.org/', l_partkey) ELSE '' END))) AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, substr(h, 1, 12) || '5' || substr(h, 14, 3) || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 15) AS write_id FROM h""")
def write_ids(spark, sf_dir):
    url = F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("https://a.org/"), "l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stamps.write_id(F.col("l_orderkey").cast("string"), url).alias("write_id"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 1704067200 + event_id % 28 * 86400 + event_id % 24 * 3600 + event_id % 60 * 60 + CASE WHEN event_id % 4 < 2 THEN 14400 ELSE 0 END END AS at FROM events")
def offset_times(spark, sf_dir):
    raw = F.expr("concat('2024-01-', lpad(1 + event_id % 28, 2, '0'), 'T', lpad(event_id % 24, 2, '0'), ':', lpad(event_id % 60, 2, '0'), ':00', CASE event_id % 4 WHEN 0 THEN '-0400' WHEN 1 THEN '-04:00' WHEN 2 THEN 'Z' ELSE '' END)")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(stamps.offset_time(raw)).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'unknown' WHEN event_id % 12 = event_id % 10 THEN 'current' ELSE 'mismatch' END AS state FROM events")
def version_states(spark, sf_dir):
    running = F.expr("CASE WHEN event_id % 13 = 0 THEN 'dev' ELSE concat('1.', event_id % 12, '.3') END")
    return table(spark, sf_dir, "events").select("event_id", stamps.version_state(running, F.expr("concat('1.0', event_id % 10, '.3')")).alias("state"))


@query("""WITH c AS (SELECT DISTINCT user_id % 5 AS u, event_id % 7 AS p FROM events) SELECT concat('/home/u', u, '/p', p, '/src') AS cwd, CASE WHEN p % 2 = 0 THEN concat('p', p) WHEN u = 4 THEN 'src' ELSE concat('p', p) END AS project FROM c""")
def project_names(spark, sf_dir):
    """Folders of even projects lie in a repository; one user's home isn't known."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("/home/u"), F.col("user_id") % 5, F.lit("/p"), F.col("event_id") % 7, F.lit("/src")).alias("cwd"), F.lit(None).cast("string").alias("override"))
    roots = rows.filter("cwd rlike '/p[0246]/src$'").select(F.regexp_replace("cwd", "/src$", "").alias("path")).distinct()
    return stamps.projects(rows, roots, tuple(f"/home/u{k}" for k in range(4))).select("cwd", "project")


@query(f"""WITH {fx.CITED_SQL}, {_CLAIM_SQL}, links AS (SELECT url, claim, CAST(min(seen) AS VARCHAR) AS first_seen, CAST(max(seen) AS VARCHAR) AS last_seen, count(*) AS times_seen FROM claims GROUP BY url, claim)
    SELECT url, claim, last_seen FROM links WHERE claim ILIKE '%SEE%' OR url ILIKE '%SEE%' QUALIFY row_number() OVER (PARTITION BY url ORDER BY first_seen, claim) <= 50""")
def claim_search(spark, sf_dir):
    messages = fx.messages(spark, sf_dir)
    return _dated(capture.search_claims(capture.claim_links(capture.citations(messages), messages), "SEE").select("url", "claim", "last_seen"))


@query("""WITH w AS (SELECT concat('u', user_id) AS url, bool_or(event_id % 400 = 0) AS was, count(*) AS attempts, min(event_id) AS first_failed, max(event_id) AS last_failed FROM events GROUP BY user_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY was ORDER BY first_failed, url) AS nth, count(*) FILTER (was) OVER () AS held FROM w)
    SELECT url, attempts, first_failed, last_failed, CASE WHEN was OR nth <= greatest(500 - held, 0) THEN 'queued' ELSE 'refused' END AS state FROM n""")
def retry_queue(spark, sf_dir):
    """Every 400th event is a failure that is queued already; the others come now."""
    failed = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_id").alias("failed"))
    old = failed.filter("failed % 400 = 0").groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.min("failed").alias("first_failed"), F.max("failed").alias("last_failed"))
    queued, refused = ledger.enqueue(old, failed.filter("failed % 400 <> 0"))
    return queued.withColumn("state", F.lit("queued")).unionByName(refused.withColumn("state", F.lit("refused")))


@query(r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n]+', ' ', 'g')), '') END AS t FROM pages),
    f AS (SELECT url, max(t) AS t FROM p GROUP BY url),
    a AS (SELECT p.page_id, p.url, f.t, CASE WHEN page_id % 3 = 1 THEN 'cleared' WHEN f.t IS NOT NULL THEN 'resolved' ELSE 'waiting' END AS action FROM p JOIN f ON f.url = p.url WHERE page_id % 5 <> 0)
    SELECT concat('K', page_id) AS key, CASE WHEN action = 'resolved' THEN t WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'A real title' END AS title, CASE WHEN action = 'waiting' THEN 'title:unresolved,web' ELSE 'web' END AS tags, action FROM a""")
def title_backfill(spark, sf_dir):
    """Stored titles by page_id % 3: the address, a real title, none. Pages with an even page_id were fetched with their title, the others gave the address."""
    p, pages = F.col("page_id"), table(spark, sf_dir, "pages")
    tags = F.when(p % 5 != 0, F.array(F.lit(ledger.UNRESOLVED), F.lit("web"))).otherwise(F.array(F.lit("web")))
    items = pages.select(F.concat(F.lit("K"), p).alias("key"), "url", F.when(p % 3 == 0, F.col("url")).when(p % 3 == 1, "A real title").alias("title"), tags.alias("tags"))
    fetched = pages.select("url", F.when(p % 2 == 0, content.title(F.col("html"))).otherwise(F.col("url")).alias("title"))
    return ledger.backfill(items, fetched).withColumn("tags", F.array_join("tags", ","))


_HURT_SQL = f"p AS {_DAMAGED}, d AS (SELECT good, CASE page_id % 4 WHEN 0 THEN good WHEN 1 THEN good || ').' WHEN 2 THEN good || '**' ELSE good END AS url FROM p UNION ALL SELECT good, good || '**' FROM p WHERE page_id % 8 = 3)"


@query(f"WITH {_HURT_SQL} SELECT DISTINCT good AS url, concat('t', length(url) % 3) AS tag FROM d")
def repaired_tags(spark, sf_dir):
    rows = _damaged(spark, sf_dir)
    return ledger.moved_tags(rows.select("url", F.concat(F.lit("t"), F.length("url") % 3).alias("tag")), upkeep.repair_plan(rows))


@query(f"WITH {_HURT_SQL} SELECT good AS url, 'c' AS claim, min(length(url)) AS first_seen, max(length(url)) AS last_seen, count(*) AS times_seen FROM d GROUP BY good")
def repaired_claims(spark, sf_dir):
    """The length of an address stands for its days."""
    rows, day = _damaged(spark, sf_dir), F.length("url").cast("long")
    return ledger.moved_claims(rows.select("url", F.lit("c").alias("claim"), day.alias("first_seen"), day.alias("last_seen"), F.lit(1).cast("long").alias("times_seen")), upkeep.repair_plan(rows))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN concat('/opt/v', event_id % 50) END AS root FROM events)
    SELECT concat('i', event_id) AS incident_id, root, 'stale' AS kind FROM r WHERE root IS NULL OR root NOT IN (SELECT concat('/opt/v', p_partkey % 50) FROM part WHERE p_partkey % 50 < 20)""")
def incident_import(spark, sf_dir):
    """The ledger knows the roots that parts name; records without a root are legacy ones."""
    root = F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("/opt/v"), F.col("event_id") % 50))
    found = table(spark, sf_dir, "events").select(F.concat(F.lit("i"), "event_id").alias("incident_id"), root.alias("root"), F.lit("stale").alias("kind"))
    known = table(spark, sf_dir, "part").filter("p_partkey % 50 < 20").select(F.concat(F.lit("/opt/v"), F.col("p_partkey") % 50).alias("root"))
    return ledger.open_roots(found, known)
