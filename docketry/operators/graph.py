"""Co-authorship graphs: edges, weights, diversity and Katz centrality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coauthor_edges(papers: DataFrame, parties: str = "parties", by: list[str] | None = None) -> DataFrame:
    """(by..., source, target, weight): papers shared by two parties, names in ascending order.

    Pairs are made inside each row from its own list, so nothing is joined;
    a party listed twice gives an edge to itself.
    """
    by = by or []
    lists = F.col(parties)
    pairs = F.flatten(F.transform(lists, lambda a, i: F.transform(F.slice(lists, i + 2, F.size(lists)), lambda b: F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("target")))))
    return papers.select(*by, F.explode(pairs).alias("e")).groupBy(*by, "e.source", "e.target").agg(F.count("*").alias("weight"))


def normalised(edges: DataFrame) -> DataFrame:
    """Weights divided by the largest."""
    most = edges.agg(F.max("weight").alias("most"))
    return edges.join(F.broadcast(most)).select("source", "target", (F.col("weight") / F.col("most")).alias("weight"))  # one row


def collaborators(papers: DataFrame, parties: str = "parties") -> DataFrame:
    """(country, value): distinct other parties that a party shares a paper with; a party that has none is absent."""
    pairs = papers.select(F.explode(parties).alias("country"), F.col(parties).alias("all")).select("country", F.explode("all").alias("other")).where("country <> other").distinct()
    return pairs.groupBy("country").agg(F.count("*").alias("value"))


def katz(edges: DataFrame, by: str = "period", alpha: float = 0.1) -> DataFrame:
    """(by, country, value): weighted Katz centrality of each graph, unit length, rounded to 10 places.

    A graph has one node per party, so its matrix is small; each graph is
    solved in one task.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["source"]) | set(pdf["target"]), reverse=True)
        at = {x: k for k, x in enumerate(nodes)}
        a = np.zeros((len(nodes), len(nodes)))
        for s, t, w in zip(pdf["source"], pdf["target"], pdf["weight"] / pdf["weight"].max(), strict=True):
            a[at[s], at[t]] = a[at[t], at[s]] = w
        x = np.linalg.solve(np.eye(len(nodes)) - alpha * a.T, np.ones(len(nodes)))
        return pd.DataFrame({by: pdf[by].iloc[0], "country": nodes, "value": np.round(x / np.linalg.norm(x), 10)})

    return edges.groupBy(by).applyInPandas(solve, f"{by} string, country string, value double")
