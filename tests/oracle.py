"""Rows of a Spark query and of the SQL beside it, in a form that can be compared."""

import os

import duckdb
import pandas as pd


def connect(sf: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def _cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return v
    return round(float(v), 6)


def rows(pdf: pd.DataFrame) -> list[str]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr([_cell(v) for v in r]) for r in pdf.astype(object).values.tolist())
