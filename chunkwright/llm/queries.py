"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm import chat, decontam, htmltext, jaccard, lm, mixing, quality, tokencounts, topk, toxicity
from chunkwright.llm.textops import shared_dir, stored


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.add_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def _remainder(n: int):
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches, each committed twice as a job that is run again would.

    All documents are inserted; of those with doc_id % 10 = 1 the vocabulary's count is provisional (their words)
    and later revised. Documents with doc_id % 10 = 0 are withdrawn and then come back. ``spark.chunkwright.vocabulary``
    names the vocabulary's file.
    """
    vocabulary = spark.conf.get("spark.chunkwright.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = stored(tokencounts.count_tokens(docs, vocabulary, words="n_words"), "token-counts")
    rollup = tokencounts.Rollup(spark, shared_dir(spark, "token-rollup"))

    def both(rows: DataFrame, sign: int = 1, count: str = "n_tokens") -> DataFrame:
        return tokencounts.changes(rows, "words-1", sign, "n_words").union(tokencounts.changes(rows, "byte_bpe_50k", sign, count))

    early, moved = F.coalesce(F.col("doc_id") % 10 == 1, F.lit(False)), F.col("doc_id") % 10 == 0
    provisional = counted.withColumn("n", F.when(early, F.col("n_words")).otherwise(F.col("n_tokens")))
    revision = tokencounts.changes(counted.where(early), "byte_bpe_50k", -1, "n_words").union(tokencounts.changes(counted.where(early), "byte_bpe_50k"))
    batches = {"documents/insert": both(provisional, count="n"), "documents/withdraw": both(counted.where(moved), -1), "documents/revise": revision, "documents/return": both(counted.where(moved))}
    for k, (name, rows) in enumerate(batches.items()):
        for _ in range(2):
            rollup.commit(name, rows)
        if k == 1:
            rollup.compact()
    return rollup.totals()


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scorer = toxicity.train(docs, labels.where(_remainder(3) != 1))
    scored = toxicity.add_scores(docs.select("doc_id", "text", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")), scorer)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents weigh what the quality classifier expects of them."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(_remainder(3) != 1), "quality")
    graded = quality.add_grades(docs.select("doc_id", "text", "source"), model).withColumnRenamed("expected_grade", "weight")
    return mixing.mix(graded.drop("tail_probabilities"), weight="weight").select("doc_id", "size", "source_size", "target", "taken")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(_read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(_remainder(3) != 1), "quality")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    graded = quality.add_grades(docs.select("doc_id", "text", held_out), model)
    top = F.coalesce(F.try_element_at("tail_probabilities", F.lit(-1)), F.lit(1.0)).alias("p_top_grade")
    return graded.select("doc_id", "held_out", "expected_grade", top, quality.passes().alias("selected"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.expand(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_sets(_read(spark, sf_dir, "documents"), n=4, share=85)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"), F.coalesce(_remainder(5), F.lit(0)) != 1, from_files=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_mixing": op4_mixing,
        "op5_topk": op5_topk,
        "op6_quality": op6_quality,
        "op7_chat": op7_chat,
        "op8_decontamination": op8_decontamination,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_lm_scoring": op10_lm_scoring,
    }


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, row_number() OVER w AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back,
    sum(23 + length(role) + length(text)
      + length(regexp_replace(role, '[^\\]', '', 'g')) + length(regexp_replace(text, '[^\\]', '', 'g'))
      + len(regexp_extract_all(role || '=' || text, '<\||</?s>|\[/?INST\]|<</?SYS>>'))) OVER w AS upto
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM t WHERE len(w) > 0)),
spots AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows))),
found AS (SELECT r, s, n, item_id FROM spots JOIN windows USING (n, k)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM found) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL, "op7_chat": OP7_SQL, "op8_decontamination": OP8_SQL, "op9_jaccard_join": OP9_SQL}
