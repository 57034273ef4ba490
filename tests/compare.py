"""A query and its SQL, side by side."""

from __future__ import annotations

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(frame):
    def text(v):
        if v is None or pd.isna(v):
            return ""
        if isinstance(v, bool) or str(type(v)).endswith("bool'>"):
            return str(bool(v))
        return f"{float(v):.6f}" if hasattr(v, "__float__") else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))
