"""Run a query and its oracle side by side and compare values."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def type_family(t: str) -> str:
    t = t.lower()
    for family, names in {"int": ("bigint", "long", "int64"), "int32": ("integer", "int", "int32", "date32"),
                          "double": ("double", "float64"), "float": ("float",), "string": ("varchar", "string"),
                          "bool": ("boolean", "bool"), "ts": ("timestamp", "timestamp_ntz"), "date": ("date",)}.items():
        if t in names:
            return family
    return t


def compare(df, con, sql: str) -> list[str]:
    """Differences between the Spark frame and the oracle; empty when equal."""
    got, got_cols = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    cols, types = list(rel.columns), [str(t) for t in rel.types]
    want, want_cols = rows_of(cols, rel.fetchall())
    out = []
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    spark_types = {f.name: type_family(f.dataType.simpleString()) for f in df.schema.fields}
    for c, t in zip(cols, types):
        a, b = spark_types[c], type_family(t)
        if a != b and not (a.startswith("array") or a.startswith("struct") or a.startswith("map")):
            out.append(f"type of {c}: {a} != {b}")
    if got != want:
        a, b = list((got - want).items())[:3], list((want - got).items())[:3]
        out.append(f"rows {sum(got.values())} vs {sum(want.values())}; only spark {a}; only oracle {b}")
    if not want:
        out.append("oracle is empty")
    return out
