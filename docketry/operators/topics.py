"""Topic tables: composition, labels by class-based tf-idf."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators import density, layout


def composition(documents: DataFrame) -> DataFrame:
    """Per topic: size, instruments and papers, share of instruments, first and last year, first year by class."""
    inst = F.col("is_instrument")
    return documents.groupBy("topic").agg(F.count("*").alias("size"), F.count_if(inst).alias("n_instruments"), F.count_if(~inst).alias("n_papers"), F.avg(inst.cast("double")).alias("instrument_share"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min(F.when(inst, F.col("year"))).alias("first_instrument_year"), F.min(F.when(~inst, F.col("year"))).alias("first_paper_year"))


def composition_buckets(topics: DataFrame) -> DataFrame:
    """(bucket, topics, documents): topics by their share of instruments, from none to all."""
    s = F.col("instrument_share")
    bucket = F.when(F.col("n_instruments") == 0, "papers only").when(F.col("n_papers") == 0, "instruments only").when(s < 0.25, "mostly papers").when(s <= 0.75, "mixed").otherwise("mostly instruments")
    return topics.where("topic <> -1").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("topics"), F.sum("size").alias("documents"))


def word_labels(documents: DataFrame, topic: str, text: str, top: int = 4, min_df: int = 2, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(topic, rank, word, score): words that mark a topic: tf in the topic times log(1 + mean words of a topic / uses of the word)."""
    words: Column = F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2))
    used = documents.withColumn("_d", F.monotonically_increasing_id()).select(topic, "_d", words.alias("word"))
    if stop_words:
        used = used.where(~F.col("word").isin(*stop_words))
    per_doc = used.groupBy(topic, "_d", "word").agg(F.count("*").alias("n"))
    whole = per_doc.groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("df")).where(F.col("df") >= min_df)
    counts = per_doc.groupBy(topic, "word").agg(F.sum("n").alias("n")).join(whole, "word")
    sizes = counts.groupBy(topic).agg(F.sum("n").alias("all"))
    mean = sizes.agg(F.avg("all").alias("mean"))
    score = F.col("n") / F.col("all") * F.ln(1 + F.col("mean") / F.col("uses"))
    scored = counts.join(sizes, topic).join(F.broadcast(mean)).withColumn("score", F.round(score, 9))  # mean: one row
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("score"), "word"))).where(F.col("rank") <= top).select(topic, "rank", "word", "score")


def clustered(documents: DataFrame, vector: str, topics: int, least: int = 5, seed: int = 42) -> DataFrame:
    """``documents`` with ``topic``: k-means by cosine; clusters of fewer than ``least`` documents are no topic (-1).

    The quick way where the number of topics is known; ``density_topics`` finds it.
    """
    ready = documents.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=topics, featuresCol="_v", predictionCol="topic", distanceMeasure="cosine", seed=seed).fit(ready)
    found = model.transform(ready).drop("_v")
    small = found.groupBy("topic").agg(F.count("*").alias("_n")).where(F.col("_n") < least).select("topic", F.lit(True).alias("_small"))
    return found.join(small, "topic", "left").withColumn("topic", F.when(F.col("_small"), -1).otherwise(F.col("topic"))).drop("_small").select(*documents.columns, "topic")


def density_topics(documents: DataFrame, key: str, vector: str, *, dims: int = 5, neighbours: int = 15, min_size: int = 5, seed: int = 42) -> DataFrame:
    """(key, topic): a layout of ``dims`` dimensions that keeps neighbours by cosine, then density clustering in it. ``key`` is a long and unique.

    A topic is named by its smallest key; documents outside of dense places, or without a usable vector, are no topic (-1).
    """
    laid = layout.laid_out(documents, dims, neighbours, key=key, vector=vector, seed=seed)
    found = density.clustered(laid, min_size=min_size, min_samples=min_size, neighbours=neighbours, key=key)
    return documents.select(key).join(found, key, "left").select(key, F.coalesce("topic", F.lit(density.NOISE)).alias("topic"))


def sizes_with_words(documents: DataFrame, topic: str, text: str) -> DataFrame:
    """(topic, size, word): each topic's size and its first word."""
    sizes = documents.groupBy(topic).agg(F.count("*").alias("size"))
    return sizes.join(word_labels(documents, topic, text, top=1).select(topic, "word"), topic, "left")
