"""Compare a query's rows with those of its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = pd.to_datetime(out[c]).dt.tz_localize(None).astype(str)
        elif pd.api.types.is_float_dtype(out[c]):
            out[c] = out[c].map(lambda x: None if pd.isna(x) else f"{x:.9g}")
        else:
            out[c] = out[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and pd.isna(x)) else f"{x:.9g}" if isinstance(x, float) else str(x))
    return out.astype(object).where(out.notna(), "\0").sort_values(list(out.columns), ignore_index=True)


def same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows, else what differs."""
    a, b = plain(spark_df.toPandas()), plain(con.execute(sql).fetchdf())
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    differ = (a != b).any(axis=1)
    return "" if not differ.any() else f"{differ.sum()} of {len(a)} rows differ, as {a[differ].head(2).to_dict('records')} and {b[differ].head(2).to_dict('records')}"
