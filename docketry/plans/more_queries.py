"""Further operators of the inventory: filters, shares of lists, samples, labels, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions import dates, text
from docketry.operators import density, figures
from docketry.plans import tables as t
from docketry.plans.queries import BASE, VECTORS, query
from docketry.session import read

#: Pairs that one part of a sample makes.
PAIRS = 8_000_000


def radii(counts: DataFrame, count: str, most: float = 1.0) -> DataFrame:
    """``counts`` with ``radius``: areas in proportion to the counts, the largest circle of radius ``most``."""
    top = counts.agg(F.max(count).alias("_top"))
    return counts.join(F.broadcast(top)).withColumn("radius", F.lit(most) * F.sqrt(F.col(count) / F.col("_top"))).drop("_top")  # one row


def sampled_pairs(left: DataFrame, right: DataFrame, key: str, share: int, of: int, seed: int) -> DataFrame:
    """A repeatable sample of pairs: each of ``left`` meets the rows of ``right`` in as many of ``of`` hash classes as ``share`` says.

    Classes are joined on, so pairs that aren't in the sample are never made. A class of ``left`` is cut into parts, to each of
    which the class of ``right`` goes, so that a part makes about PAIRS pairs at most; parts are dealt to a task each,
    however few bytes the keys are.
    """
    kind = lambda c: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(of))
    parts = max(1, math.ceil(share * left.count() / of * (right.count() / of) / PAIRS))
    part = F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).cast("int")
    a = left.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(share - 1)))).select(F.col(key).alias("left_id"), F.pmod(kind(key) + F.col("_k"), F.lit(of)).alias("_c"), part.alias("_p"))
    b = right.select(F.col(key).alias("right_id"), kind(key).alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    a, b = (x.repartition(of * parts, "_c", "_p") for x in (a, b))
    return a.join(b, ["_c", "_p"]).select("left_id", "right_id")


@query("qualified_documents", r"SELECT doc_id FROM documents WHERE lower(coalesce(lang, '')) = 'en' AND trim(text) <> '' AND NOT coalesce(contains(text, 'stupid'), false) AND len(regexp_extract_all(trim(text), '\S+')) >= 80 AND n_chars BETWEEN 300 AND 5000")
def qualified_documents(spark, sf):
    words = F.size(F.filter(F.split(F.trim("text"), r"[ \t\n\f\r]+"), lambda w: w != ""))
    d = read(spark, sf, "documents")
    return d.where((F.lower(F.coalesce("lang", F.lit(""))) == "en") & F.col("n_chars").between(300, 5000) & (F.trim("text") != "") & ~F.coalesce(F.contains("text", F.lit("stupid")), F.lit(False)) & (words >= 80)).select("doc_id")


@query("path_kinds", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'wp' WHEN contains(url, '/fr/') THEN 'ip' ELSE 'skipped' END AS kind, suffix(regexp_replace(url, '[?#].*$', ''), '0') AS round FROM pages")
def path_kinds(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", F.when(u.contains("/en/"), "wp").when(u.contains("/fr/"), "ip").otherwise("skipped").alias("kind"), F.endswith(F.regexp_replace(u, r"[?#].*$", ""), F.lit("0")).alias("round"))


@query("lowest_counts", f"WITH {BASE}, c AS (SELECT party, count(*) AS n, avg(year) AS y FROM wp JOIN authors USING (paper_id) GROUP BY party) SELECT party, n, round(y, 6) AS mean_year FROM c ORDER BY n, y DESC, party LIMIT 6")
def lowest_counts(spark, sf):
    rows = t.authored(spark, sf, t.working_papers(spark, sf).select("paper_id", "year")).groupBy("party").agg(F.count("*").alias("n"), F.avg("year").alias("y"))
    return rows.orderBy("n", F.desc("y"), "party").limit(6).select("party", "n", F.round("y", 6).alias("mean_year"))


CHUNKS = "WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[Tt]he|[Dd]e')) AS hits, length(text) AS size FROM conversations)"


def _chunks(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit("[Tt]he|[Dd]e")).cast("long").alias("hits"), F.length("text").cast("long").alias("size"))


@query("censored_chunk_counts", CHUNKS + " SELECT conv_id, count(*) FILTER (WHERE hits > 0) AS censored, count(*) AS chunks FROM c GROUP BY conv_id HAVING count(*) FILTER (WHERE hits > 0) > 3")
def censored_chunk_counts(spark, sf):
    return _chunks(spark, sf).groupBy("conv_id").agg(F.count_if(F.col("hits") > 0).alias("censored"), F.count("*").alias("chunks")).where("censored > 3")


@query("densest_chunk", CHUNKS + " SELECT conv_id, turn, hits FROM c WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY hits / size DESC, turn) = 1")
def densest_chunk(spark, sf):
    return figures.first_rows(_chunks(spark, sf).where("size > 0"), ["conv_id"], [(F.col("hits") / F.col("size")).desc(), F.col("turn")]).select("conv_id", "turn", "hits")


@query("first_value_per_key", "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def first_value_per_key(spark, sf):
    return figures.first_rows(read(spark, sf, "documents").select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id")])


@query("grouped_turns", "SELECT conv_id, turn // 3 AS part, count(*) AS n, sha256(string_agg(text, ' ' ORDER BY turn)) AS text_sha FROM conversations GROUP BY ALL")
def grouped_turns(spark, sf):
    rows = read(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 3).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda e: e["text"]), " ")
    return rows.agg(F.count("*").alias("n"), F.sha2(joined.cast("binary"), 256).alias("text_sha"))


@query("circle_radii", f"WITH {VECTORS}, c AS (SELECT topic, count(*) AS size FROM v GROUP BY topic) SELECT topic, size, round(sqrt(size / (SELECT max(size) FROM c)), 9) AS radius FROM c")
def circle_radii(spark, sf):
    return radii(t.vectors(spark, sf).groupBy("topic").agg(F.count("*").alias("size")), "size").withColumn("radius", F.round("radius", 9))


@query("label_vector", f"WITH {BASE} SELECT paper_id, list_contains(parties, 'NATION_1')::INT AS a, list_contains(parties, 'NATION_2')::INT AS b, list_contains(parties, 'NATION_3')::INT AS c FROM lists")
def label_vector(spark, sf):
    coded = F.transform(F.array(*(F.lit(f"NATION_{k}") for k in (1, 2, 3))), lambda c: F.array_contains("parties", c).cast("int"))
    rows = t.parties(spark, sf).select("paper_id", coded.alias("y"))
    return rows.select("paper_id", *(F.get("y", k).alias(n) for k, n in enumerate("abc")))


@query("pair_sample", f"WITH {VECTORS}, h AS (SELECT id, ('0x' || left(md5('7:' || id), 8))::BIGINT % 16 AS c FROM v) SELECT x.id AS left_id, y.id AS right_id FROM h x JOIN h y ON (x.c + 0) % 16 = y.c OR (x.c + 1) % 16 = y.c WHERE x.id % 5 = 0 AND y.id % 5 <> 0")
def pair_sample(spark, sf):
    left, right = t.sides(spark, sf)
    return sampled_pairs(left, right, "id", 2, 16, 7)


@query("text_vs_disk", "SELECT doc_id FROM documents WHERE md5(text) <> md5(CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END)")
def text_vs_disk(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("db"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")).cast("binary")).alias("disk"))
    return d.where("db <> disk").select("doc_id")


@query("instrument_texts", r"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Untyped' ELSE p_type END || ' ' || p_partkey AS label, 'Subject: ' || p_name || chr(10) || p_brand AS body, (p_size // 10 * 10)::INT AS decade FROM part")
def instrument_texts(spark, sf):
    kind = F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_type"))
    return read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.coalesce(kind, F.lit("Untyped")), "p_partkey").alias("label"), F.concat(F.lit("Subject: "), "p_name", F.lit("\n"), "p_brand").alias("body"), dates.decade(F.col("p_size")).alias("decade"))


@query("short_labels", r"SELECT item_id, CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS label, array_to_string(string_split(t, ' ')[1:4], ', ') AS words FROM (SELECT item_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM benchmark)")
def short_labels(spark, sf):
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return read(spark, sf, "benchmark").select("item_id", text.one_line(F.col("text"), 60).alias("label"), F.array_join(F.slice(F.split(flat, " "), 1, 4), ", ").alias("words"))


@query("injected_prefixes", "SELECT item_id, n_name AS country, sha256(n_name || ' ' || text) AS text_sha FROM benchmark CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey < 5)")
def injected_prefixes(spark, sf):
    five = F.explode(F.array(*(F.lit(f"NATION_{k}") for k in range(5))))
    rows = read(spark, sf, "benchmark").select("item_id", "text", five.alias("country"))
    return rows.select("item_id", "country", F.sha2(F.concat_ws(" ", "country", "text").cast("binary"), 256).alias("text_sha"))


@query("keyed_by_content", "SELECT sha256(source || chr(10) || text) AS uuid, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def keyed_by_content(spark, sf):
    uuid = F.sha2(F.concat("source", F.lit("\n"), "text").cast("binary"), 256)
    return read(spark, sf, "documents").groupBy(uuid.alias("uuid")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("label_pair_shares", "SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM labels GROUP BY quality, toxic")
def label_pair_shares(spark, sf):
    counts = read(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    # A row per pair of labels: the window holds a handful of rows.
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))



@query("density_clusters")
def density_clusters(spark, sf):
    near = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return density.clustered(near, min_size=5, min_samples=5, neighbours=15, key="vec_id")
