"""Runs a registered query and its DuckDB twin side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _plain(x)) for k, x in v.asDict().items())
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(v[i]) for i in order) for v in values), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows(names, cursor.fetchall())
    kinds = {c[0]: str(c[1]).upper() for c in cursor.description}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    wide = {"bigint": "NUMBER", "double": "DOUBLE", "int": "NUMBER", "string": "STRING", "boolean": "BOOL"}
    for name, kind in spark_df.dtypes:
        if kind in ("bigint", "double") and not any(k in kinds[name] for k in ("NUMBER", "BIGINT", "INTEGER", "DOUBLE", "FLOAT", wide[kind])):
            return f"type of {name}: {kind} and {kinds[name]}"
        if kind == "bigint" and "HUGEINT" in kinds[name]:
            return f"type of {name}: {kind} and {kinds[name]}"
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; {ours[:2]} {theirs[:2]}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            return f"{a}\n{b}"
    return None
