"""The registered queries of the operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import chat, decontamination, exact_dedup, fill_in_middle, hard_negatives, html_extraction, line_dedup, mixing, near_dedup, pii, substring_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    text = html_extraction.extractor(html_extraction.learn(pages))
    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the nearest benchmark item within reach, if any, and where it lies, in words."""
    found = decontamination.match(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("found").isNotNull().alias("contaminated"), "found.item_id", "found.distance", "found.start", "found.end")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_chats(turns))


def _learned(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return toxicity.learn(docs, _table(spark, sf_dir, "labels").filter(train))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.scorer(_learned(docs, spark, sf_dir))
    scored = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.learn(docs)).select("doc_id", "pii.*")
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), _sha("base").alias("base_sha256"), "spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", _sha("kept").alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", _sha("kept").alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


URL_RULES = tuple(url_filter.Rule(*r) for r in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")))
#: Sites of the pages table that carry junk; their addresses are the list of op12.
JUNK_SITES = r"(^|\.)(casino-win|ads-track|free-bets|spam-farm|cheap-pills|adult-x)\."


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical address of every page of a junk site."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, pages.filter(url_filter.host(F.col("url")).rlike(JUNK_SITES)), URL_RULES)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(_table(spark, sf_dir, "documents"))
    whole = made.withColumn("restored", fill_in_middle.restore(F.col("output"), F.col("form")))
    return whole.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha("output").alias("output_sha256"), _sha("restored").alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_html_extraction, op4_decontamination, op5_chat_formatting, op6_toxicity, op7_pii, op8_substring_dedup, op9_line_dedup, op10_near_dedup, op11_hard_negatives, op12_url_filters, op13_fill_in_middle)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256, {_FOLDED} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
        g AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS gram FROM s),
        dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY gram ORDER BY doc_id, p) AS nth FROM g) WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM dup),
        every AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS body, count(*) AS n FROM every e LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 3""",
    "op12_url_filters": r"""
        WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
        c AS (SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN fields = '' THEN '' ELSE '?' || fields END END AS key
            FROM (SELECT *, regexp_replace(regexp_replace(query, '(^|&)(utm_[a-z]+|fbclid|gclid|ref)=[^&]*', '', 'g'), '^&', '') AS fields FROM u)),
        r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        listed AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '(^|\.)(casino-win|ads-track|free-bets|spam-farm|cheap-pills|adult-x)\.')),
        best AS (SELECT page_id, host, path, key, h || p AS rule, v FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) = 1)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM best""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        e AS (SELECT doc_id, text, t, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
        g AS (SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM f)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM g""",
}
