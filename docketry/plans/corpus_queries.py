"""Queries over whole texts: the learned sentence splitter and dictionaries of many phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import dictionary, sentences
from docketry.plans.queries import query
from docketry.session import read

_AROUND = sentences.AROUND.replace("'", "''")

SENTENCE_MODEL = rf"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{sentences.SPACE}'), lambda x: trim(x, '{_AROUND}')), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT unnest(ws) AS core, unnest(list_concat(['!'], ws)[:len(ws)]) AS before, unnest(list_concat(ws[2:], [''])) AS after FROM w WHERE len(ws) > 0),
t AS (SELECT lower(CASE WHEN dotted THEN left(core, length(core) - 1) ELSE rtrim(core, '{sentences.MARKS}') END) AS word, dotted, regexp_matches(left(core, 1), '\p{{Lu}}') AS capital, dotted AND regexp_matches(left(after, 1), '[0-9]') AS number, right(before, 1) IN ('!', '?') AS shout,
  CASE WHEN suffix(before, '.') AND NOT suffix(before, '..') THEN lower(left(before, length(before) - 1)) END AS stopped FROM (SELECT *, suffix(core, '.') AND NOT suffix(core, '..') AS dotted FROM e)),
k AS (SELECT * FROM t WHERE length(word) <= {sentences.LONGEST} AND regexp_matches(word, '\p{{L}}')),
c AS (SELECT word, sum(dotted::INT) AS dotted, sum((NOT dotted)::INT) AS plain, sum(number::INT) AS numbered FROM k GROUP BY word),
p AS (SELECT sum(dotted)::DOUBLE AS stops, sum(numbered)::DOUBLE AS numbers, least(sum(dotted) / sum(dotted + plain), 0.99) AS chance FROM c),
s AS (SELECT word, dotted, plain, length(replace(word, '.', '')) AS bare, 2 * (dotted * (ln(0.99) - ln(chance)) + plain * (ln(0.01) - ln(1 - chance))) AS gain FROM c, p WHERE dotted >= {sentences.RARE_STOP} * stops),
a AS (SELECT word, dotted, plain, gain * exp(-bare) * (length(word) - bare + 1) * pow(bare, -plain) AS score FROM s WHERE score >= {sentences.LEAST_SCORE}),
b AS (SELECT k.word, capital, coalesce(shout OR (a.word IS NULL AND length(stopped) > 1 AND regexp_matches(stopped, '\p{{L}}')), false) AS sure FROM k LEFT JOIN a ON k.stopped = a.word),
n AS (SELECT word, sum(sure::INT) AS starts, sum((sure AND capital)::INT) AS capital_starts, sum((NOT sure AND capital)::INT) AS capital_inside, sum((NOT sure AND NOT capital)::INT) AS small_inside, sum((NOT sure)::INT) AS inside FROM b GROUP BY word),
q AS (SELECT sum(starts)::DOUBLE AS n1, sum(inside)::DOUBLE AS n2 FROM n),
x AS (SELECT 'opener' AS kind, word, starts::DOUBLE AS h1, n1, inside::DOUBLE AS h2, n2, capital_inside = 0 AND small_inside > 0 AS never FROM n, q WHERE capital_starts >= {sentences.RARE_START} * n1
  UNION ALL SELECT 'lead', word, numbered::DOUBLE, dotted::DOUBLE, numbers - numbered, stops - dotted, false FROM c, p WHERE dotted >= {sentences.RARE_STOP} * stops AND dotted > 0 AND dotted < stops),
r AS (SELECT *, h1 / n1 AS r1, h2 / n2 AS r2, (h1 + h2) / (n1 + n2) AS r FROM x),
l AS (SELECT *, 2 * (CASE WHEN h1 > 0 THEN h1 * (ln(r1) - ln(r)) ELSE 0 END + CASE WHEN n1 > h1 THEN (n1 - h1) * (ln(1 - r1) - ln(1 - r)) ELSE 0 END
  + CASE WHEN h2 > 0 THEN h2 * (ln(r2) - ln(r)) ELSE 0 END + CASE WHEN n2 > h2 THEN (n2 - h2) * (ln(1 - r2) - ln(1 - r)) ELSE 0 END) AS score FROM r)
SELECT 'abbreviation' AS kind, word, dotted::BIGINT AS marked, plain::BIGINT AS other, round(score, 3) AS score FROM a
UNION ALL SELECT kind, word, h1::BIGINT, (CASE WHEN kind = 'lead' THEN n1 ELSE h2 END)::BIGINT, round(score, 3) FROM l WHERE (score >= {sentences.LEAST_SCORE_OF_PAIRS} AND r1 > r2) OR never"""


@query("sentence_model", SENTENCE_MODEL)
def sentence_model(spark, sf):
    known, leading, opening = sentences.learn_tables(read(spark, sf, "documents"), "text")
    score = F.round("score", 3).alias("score")
    found = known.select(F.lit("abbreviation").alias("kind"), "word", F.col("dotted").alias("marked"), F.col("plain").alias("other"), score)
    return found.union(leading.select(F.lit("lead"), "word", "numbered", "dotted", score)).union(opening.select(F.lit("opener"), "word", "starts", "inside", score))


@query("learned_chunks")
def learned_chunks(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rows = sentences.with_chunks(docs, "text", sentences.learn(docs, "text"))
    return rows.select("doc_id", F.size("chunks").alias("n_chunks"), F.sha2(F.to_json("chunks").cast("binary"), 256).alias("chunks_sha"))


@query("dictionary_match", """WITH k AS (SELECT DISTINCT lower(text) AS key, (item_id % 7)::VARCHAR AS value FROM benchmark WHERE text <> ''),
m AS (SELECT doc_id, value, length(key) AS n FROM documents JOIN k ON contains(lower(documents.text), key)), b AS (SELECT doc_id, value FROM m QUALIFY n = max(n) OVER (PARTITION BY doc_id))
SELECT d.doc_id, v.passage FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS passage FROM b GROUP BY doc_id) v USING (doc_id)""")
def dictionary_match(spark, sf):
    keys = read(spark, sf, "benchmark").select(F.col("text").alias("key"), (F.col("item_id") % 7).alias("value"))
    return dictionary.longest_key(read(spark, sf, "documents").select("doc_id", "text"), "text", keys, "passage").select("doc_id", "passage")


@query("dictionary_censor")
def dictionary_censor(spark, sf):
    phrases = read(spark, sf, "benchmark").select(F.col("text").alias("phrase"), F.lit(False).alias("cased"))
    rows = dictionary.censor(read(spark, sf, "documents").select("doc_id", "text"), "text", phrases)
    return rows.select("doc_id", F.col("censored.n").alias("n_places"), F.sha2(F.col("censored.text").cast("binary"), 256).alias("text_sha"))
