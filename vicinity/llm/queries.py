"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import ann, chat, decontam, html_text, jaccard, licenses, mixing, suffix_dedup, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Schemas of the tools that conversations may call.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("lookup", "id", "integer", True), ("run", "code", "string", True), ("run", "timeout", "number", False)]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations as canonical JSON, linked with what it answers and with its tool calls."""
    return chat.format_chat(_table(spark, sf_dir, "conversations"), spark.createDataFrame(TOOLS, chat.SCHEMA_ROWS))


#: The same where texts hold no tool calls, as in the driver's tables.
OP1_SQL = """WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
  p AS (SELECT DISTINCT a.conv_id, u.turn AS q, a.turn AS r FROM m u JOIN m a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT m.conv_id, m.turn, m.role, m.turn AS position, CASE WHEN m.role = 'assistant' THEN x.q END AS reply_to, CASE WHEN m.role = 'user' THEN y.r END AS answered_by,
  0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_valid, NULL::INTEGER AS max_level,
  '{"content":' || to_json(m.text)::VARCHAR || CASE WHEN m.role = 'assistant' AND x.q IS NOT NULL THEN ',"reply_to":' || x.q ELSE '' END || ',"role":' || to_json(m.role)::VARCHAR || '}' AS json
FROM m LEFT JOIN p x ON x.conv_id = m.conv_id AND x.r = m.turn LEFT JOIN p y ON y.conv_id = m.conv_id AND y.q = m.turn"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents under byte_bpe_50k.json."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), name="byte_bpe_50k.json", limit=512)


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other embeddings of every embedding whose id is divisible by 100."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 100, 10, recall=0.96)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text of documents."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), licenses.default_templates(spark))


def _op4_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.TEMPLATES)
    shingle = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END"
    return rf"""WITH t0 AS (SELECT template, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {rows}) v(template, text)),
  t1 AS (SELECT template, list_distinct({shingle}) AS h FROM t0),
  t AS (SELECT template, len(h) AS n, greatest(8, pow(2, ceil(log2(2 * len(h))))::INTEGER) AS size, unnest(h) AS s FROM t1),
  d0 AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
  d1 AS (SELECT doc_id, text, {shingle} AS h FROM d0),
  d AS (SELECT doc_id, text, unnest(h) AS s, unnest(range(0, len(h))) AS p FROM d1),
  hits AS (SELECT doc_id, text, template, n, size, d.s AS s, p FROM d JOIN t ON d.s = t.s),
  inside AS (SELECT doc_id, text, template, n, s, (p // (size // 2) - k) * (size // 2) AS pos FROM hits, (VALUES (0), (1)) v(k) WHERE p // (size // 2) >= k),
  windows AS (SELECT doc_id, text, template, n, pos, count(DISTINCT s) AS matched FROM inside GROUP BY ALL)
SELECT doc_id, template, n::INTEGER AS n_shingles, max(matched)::INTEGER AS matched, max(matched) / n::DOUBLE AS containment, count(*) AS n_windows, min(pos)::INTEGER AS first_shingle
FROM windows WHERE matched >= 0.8 * n GROUP BY doc_id, text, template, n"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, verbatim or as a paraphrase, and the item."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), cosine=decontam.COSINE)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every whole text of documents without its repeated 200-byte strings."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 200, digest=True)


#: The same by all 200-byte strings (as hexadecimal digits), their hashes counted.
OP6_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
  p AS (SELECT r, unnest(range(0, n - 199)) AS a FROM d),
  g AS (SELECT p.r, p.a, hash(substr(d.x, 2 * p.a + 1, 400)) AS h FROM p JOIN d USING (r)),
  again AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
  cover AS (SELECT r, a, CASE WHEN a <= lag(a) OVER (PARTITION BY r ORDER BY a) + 200 THEN 0 ELSE 1 END AS new FROM g SEMI JOIN again USING (h)),
  runs AS (SELECT r, min(a) AS a, max(a) + 200 AS z FROM (SELECT r, a, sum(new) OVER (PARTITION BY r ORDER BY a) AS run FROM cover) GROUP BY r, run),
  gone AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
  edges AS (SELECT r, z AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS z FROM (SELECT r, a, z FROM runs UNION ALL SELECT r, -1, 0 FROM d)),
  rest AS (SELECT e.r, string_agg(substr(d.x, 2 * e.a + 1, 2 * (coalesce(e.z, d.n) - e.a)), '' ORDER BY e.a) AS x FROM edges e JOIN d USING (r) GROUP BY e.r)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(rest.x)) AS kept_sha256 FROM d JOIN rest USING (r) LEFT JOIN gone USING (r)"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles reach a Jaccard similarity of 0.85."""
    return jaccard.shingle_components(_table(spark, sf_dir, "documents"), 4, 85)


#: The same by all pairs of documents that share a shingle, and their transitive closure.
OP7_SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' ')) WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS h FROM w),
  e AS (SELECT r, len(h) AS n, unnest(h) AS g FROM s),
  pairs AS (SELECT a.r AS x, b.r AS y, any_value(a.n + b.n) AS n, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
  links AS (SELECT x, y FROM pairs WHERE 100 * m >= 85 * (n - m)),
  near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT r AS x, r AS y FROM s UNION SELECT a.x, b.y FROM reach a JOIN near b ON a.y = b.x),
  least AS (SELECT a.x AS r, min(s.doc_id) AS component_id FROM reach a JOIN s ON s.r = a.y GROUP BY a.x)
SELECT doc_id, len(h)::BIGINT AS n_shingles, component_id FROM s JOIN least USING (r)"""


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes from each: weights 3, 1, 2, 150% of all words, twice each at most."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned from the labelled rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit_on_labels(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page of pages."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_token_counts": op2_token_counts,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_html_extraction": op10_html_extraction,
}
ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op4_license_scan": _op4_sql(), "op6_suffix_dedup": OP6_SQL, "op7_ngram_jaccard": OP7_SQL}
