"""Label metrics and no-skill baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def base_rate_entropy(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(label, rate, entropy): the cross-entropy of always predicting the label's rate."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).cast("double").alias("y")) for x in labels))).alias("e")).select("e.*")
    p = F.col("rate")
    term = lambda q: F.when(q > 0, q * F.ln(q)).otherwise(0.0)
    return long.groupBy("label").agg(F.avg("y").alias("rate")).withColumn("entropy", -(term(p) + term(1 - p)))


def label_metrics(rows: DataFrame, truth: str, predicted: str, by: str) -> DataFrame:
    """(by, n, accuracy, precision, recall) of a 0/1 prediction; a ratio without cases is 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = lambda c: F.count_if(c)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg((t == p).cast("double")).alias("accuracy"), ratio(n(t & p), n(p)).alias("precision"), ratio(n(t & p), n(t)).alias("recall"))
