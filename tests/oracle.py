"""Run a catalogue query in Spark and its oracle SQL in DuckDB; compare."""

import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = rel.fetchall()
    return [names[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date",
                 "DOUBLE": "double", "BOOLEAN": "boolean", "HUGEINT": "decimal(38,0)"}


def types(df, con, sql):
    s = dict(df.dtypes)
    rel = con.sql(sql)
    d = {n: DUCK_TO_SPARK.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), d.get(c)) for c in sorted(set(s) | set(d)) if s.get(c) != d.get(c)}


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    s_cols, s_rows = spark_rows(df)
    d_cols, d_rows = duck_rows(con, sql)
    problems = []
    bad_types = types(df, con, sql)
    if bad_types:
        problems.append(f"types differ (spark, duckdb): {bad_types}")
    if s_cols != d_cols:
        problems.append(f"columns differ: spark {s_cols} duckdb {d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row counts differ: spark {len(s_rows)} duckdb {len(d_rows)}")
    if s_rows != d_rows:
        diff_s = [r for r in s_rows if r not in set(d_rows)][:5]
        diff_d = [r for r in d_rows if r not in set(s_rows)][:5]
        problems.append(f"values differ: spark-only {diff_s} duckdb-only {diff_d}")
    return len(s_rows), problems
