"""Run registered queries against their DuckDB oracle SQL and compare results.

Usable from tests and as a script: ``python -m tests.oracle_check [sf_dir] [name ...]``.
Comparison: row count, column names, and the multiset of rows (values
normalised to text, arrays as lists, floats exactly).
"""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, _dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


_SPARK_KIND = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64",
               "float": "float32", "string": "text", "timestamp_ntz": "timestamp", "timestamp": "timestamp",
               "boolean": "bool", "date": "date"}
_DUCK_KIND = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "float64",
              "FLOAT": "float32", "VARCHAR": "text", "TIMESTAMP": "timestamp", "BOOLEAN": "bool", "DATE": "date"}


def spark_kinds(df) -> dict[str, str]:
    return {f.name: _SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}


def duck_kinds(con, sql) -> dict[str, str]:
    rel = con.sql(sql)
    return {c: _DUCK_KIND.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}


def rows_of_spark(df):
    cols = df.columns
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    cols = [c for c in rel.columns]
    return cols, [tuple(_norm(v) for v in row) for row in rel.fetchall()]


def compare(spark, sf_dir: str, names=None) -> dict[str, dict]:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        res = {"oracle": name in oracle}
        sdf = qs[name](spark, sf_dir)
        scols, srows = rows_of_spark(sdf)
        res["rows"] = len(srows)
        if name in oracle:
            dcols, drows = rows_of_duck(con, oracle[name])
            res["oracle_rows"] = len(drows)
            res["columns_match"] = sorted(scols) == sorted(dcols)
            res["types_match"] = spark_kinds(sdf) == duck_kinds(con, oracle[name])
            if not res["types_match"]:
                res["types"] = (spark_kinds(sdf), duck_kinds(con, oracle[name]))
            order = [dcols.index(c) for c in scols] if res["columns_match"] else None
            if order is not None:
                drows = [tuple(r[i] for i in order) for r in drows]
            res["values_match"] = res["columns_match"] and sorted(srows) == sorted(drows)
            if not res["values_match"]:
                res["spark_only"] = sorted(set(srows) - set(drows))[:5]
                res["oracle_only"] = sorted(set(drows) - set(srows))[:5]
                res["columns"] = (scols, dcols)
        out[name] = res
    return out


if __name__ == "__main__":
    from cohortgraph.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session()
    results = compare(spark, sf, names)
    bad = 0
    for n, r in results.items():
        ok = r.get("values_match", True) and r.get("types_match", True)
        bad += not ok
        print(("OK  " if ok else "BAD ") + n, {k: v for k, v in r.items() if k not in ("oracle",)})
    print(f"{len(results) - bad}/{len(results)} match")
