"""The queries of the text operators, and their DuckDB texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import alignment, decontaminate, hard_negatives, lattice_lm, licenses, mixing, quality_knn, quality_rules, secrets, simhash, token_counts, toxicity, warc
from vitalgrid.llm.common import fold, table
from vitalgrid.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15) AS h
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM s),
f AS (SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / weight AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
  FROM f WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, weight * max(CASE WHEN fill >= lev THEN lev END) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS repeats FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (
  SELECT g.source, g.h, g.words, coalesce(sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         r.target - r.repeats * r.source_size AS rest
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, max(h) AS h FROM c WHERE below <= rest GROUP BY source),
x AS (
  SELECT c.source, c.h, CASE WHEN c.rest <= 0 THEN -1 WHEN c.below + c.words - c.rest < c.rest - c.below THEN 1 ELSE 0 END AS how
  FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.h)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size::BIGINT AS source_size, round(r.target, 3) AS target_3,
  (d.size * (r.repeats + CASE WHEN x.how = -1 THEN 0 WHEN d.h < x.h OR (x.how = 1 AND d.h = x.h) THEN 1 ELSE 0 END))::BIGINT AS taken, r.target AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""


@query("op1_mix_sources", OP1_SQL.replace(", round(r.target, 3) AS target_3", ""))
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of weights 5, 2, 1 with at most three repeats."""
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    return mixing.mix(sized, mixing.cycle_weights(sized)).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; cutoffs by language from all labels."""
    measured = materialize(quality_rules.measure(table(spark, sf_dir, "documents"), keep=("doc_id", "lang")), "rule-measures")
    chosen = quality_rules.cutoffs(measured, table(spark, sf_dir, "labels"), "lang")
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.judge(measured, chosen, "lang").select("doc.doc_id", *[f"m.{n}" for n in named], "base_failed", "kept", "failed_rules")


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices, labels and evaluated expressions of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc.doc_id", "found.*")


@query("op10_simhash_near_duplicates")
def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as the 32k piece model counts them."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op7_lattice_scores")
def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and lattice log probabilities of every document; a seventh is held out."""
    scored = lattice_lm.score_documents(table(spark, sf_dir, "documents"), lattice_lm.not_held_out())
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark),
iw AS (
  SELECT item_id, least(len(words), 10) AS n, array_to_string(words[p : p + least(len(words), 10) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS p FROM i WHERE len(words) > 0)),
n AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, p, n, array_to_string(words[p : p + n - 1], ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM w, n WHERE len(words) >= n)),
h AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, w)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op8_decontaminate", OP8_SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH k(no, kind, pattern, least_value) AS (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', '(AKIA[A-Z0-9]+)', 20),
  (2, 'hex', '([0-9a-f]+)', 24),
  (3, 'private_key', '(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)', 0),
  (4, 'web_token', '(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', 0),
  (5, 'code_host', '((?:gh[pousr]_|glpat-)[A-Za-z0-9_-]{20,})', 0),
  (6, 'chat_bot', '(xox[abprs]-[A-Za-z0-9-]{10,})', 0),
  (7, 'map_key', '(AIza[0-9A-Za-z_-]{35})', 0),
  (8, 'url_login', '([a-z][a-z0-9+.-]*://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@)', 0)),
m AS (
  SELECT row, no, kind, least_value, regexp_extract_all(text, pattern) AS hits, regexp_extract_all(text, pattern, 1) AS vals, regexp_split_to_array(text, pattern) AS gaps
  FROM (SELECT row_number() OVER () AS row, coalesce(text, '') AS text FROM documents), k),
p AS (
  SELECT row, no, kind, least_value, len(vals[i]) AS n,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS l
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) < 40 OR no <> 2)
  UNION ALL
  SELECT row, no, kind, least_value, length(h) AS n, s, length(h) AS l FROM (
    SELECT row, no, kind, least_value, h, sum(g + length(h)) OVER (PARTITION BY row ORDER BY i) - length(h) AS s
    FROM (SELECT row, no, kind, least_value, unnest(hits) AS h, unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS g, unnest(range(len(hits))) AS i FROM m WHERE len(hits) >= 40 AND no = 2))),
f AS (SELECT row, no, kind, s::BIGINT AS s, kind || ':' || s::BIGINT || ':' || (s + l)::BIGINT AS span FROM p WHERE n >= least_value),
a AS (
  SELECT row, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(span, ',' ORDER BY s, no) AS spans
  FROM f GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN a USING (row)
"""


@query("op9_secret_scan", OP9_SQL)
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.describe(base), 256).alias("base_sha256"), secrets.describe(F.col("spans")).alias("spans"),
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    classifier = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, classifier, keep=("doc_id",))
    return scored.select("doc.doc_id", (fold(F.col("doc.doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_quality_votes")
def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a quarter of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    space = quality_knn.fit_on(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    scored = quality_knn.score(docs, space, keep=("doc_id",))
    return scored.select("doc.doc_id", (fold(F.col("doc.doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_align_tokens")
def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level and the piece tokens of every document."""
    return alignment.alignment_statistics(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, list_dot_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of each anchor within the score windows of its five best positives."""
    moved = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), moved))


OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id AND f.payload_digest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op12_warc", OP12_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each, in the order of the merged index; a page's time is made from its id."""
    pages = table(spark, sf_dir, "pages")
    date = F.timestamp_seconds(F.lit(1_767_225_600) + F.coalesce(pages["page_id"], F.lit(0)))
    found = warc.archive_pages(pages, date)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
