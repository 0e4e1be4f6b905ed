"""One query per operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import ann, hard_negatives, html_text, language_id, license_scan, line_dedup, minhash, mixing, nbest, quality, token_counts, vector_dedup, vectors, whitening
from docketry.session import importable, materialize, read

PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
QUALITY_LIMIT = 0.7


def tokenizer_path(name: str = PIECE_MODEL) -> str:
    """Where the vocabulary files of the public tokenizers lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template notices in every whole text."""
    found = license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base, blocks = F.col("places"), F.concat("blocks", "wrapped")
    best = F.filter(blocks, lambda b: b["best"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], best["label"])).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(best["containment"]), F.lit(0.0))).alias("score"),
        F.size(blocks).cast("long").alias("n_blocks"),
    )


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors of one label with a cosine of at least 0.98."""
    found = vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points in at least 5 documents stay in the largest doc_id only."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, no source above 2 epochs."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector by inner product."""
    found = ann.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the 32k piece model."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least 0.85 on three-word shingles."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=3, percent=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 best segmentations of every whole text under the 32k piece model, and whether the best decodes to the text."""
    docs = nbest.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), n_best=4, check=True)
    p = F.col("pieces")
    return docs.select(
        "doc_id",
        F.size(p["ids"]).cast("long").alias("n_pieces"),
        p["score"].alias("score"),
        (F.size(p["alternatives"]) + F.when(F.size(p["ids"]) > 0, 1).otherwise(0)).cast("long").alias("n_segmentations"),
        p["alternatives"]["score"].alias("other_scores"),
        F.sha2(F.array_join(p["ids"].cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        p["round_trip"].alias("round_trip"),
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from the labelled rows that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(quality.statistics(docs), "text-statistics")
    model = quality.learn(stats.where(~language_id.held_out()), read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    return quality.score(stats, model).select("doc_id", language_id.held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each 50th vector and its 5 positives, the first 3 rows of other labels with 50 to 95 % of the positive's score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), vectors.whole("embedding").alias("x"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 4 leading components of the distinct ones, scaled to variance 1."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", vectors.whole("embedding").alias("x"))
    return whitening.whitened(rows, whitening.fit(rows, components=4), key="vec_id")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.*, hot.k IS NOT NULL AND l.doc_id <> hot.keeper AS gone FROM l LEFT JOIN hot ON l.k = hot.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = r.vec_id)::BIGINT AS n_links, min(root) AS component_id, min(root) = vec_id AS kept FROM r GROUP BY vec_id
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT a.r, a.id AS anchor_id, c.r AS other, c.id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.r <> c.r AND len(a.x) = len(c.x) WHERE a.id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id, other) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.r = p.r AND NOT n.same WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}

    def ready(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        return run

    return {k: ready(f) for k, f in sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op2_vector_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op9_minhash_dedup": OP9_SQL, "op12_hard_negatives": OP12_SQL}
