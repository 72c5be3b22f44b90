"""Compare a query with its SQL on the same Parquet files."""

from __future__ import annotations

import math
import re

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _type_class(name: str) -> str:
    name = str(name).lower()
    if name.startswith(("bigint", "int", "hugeint", "long", "smallint")):
        return "integer"
    if re.match("varchar|string", name):
        return "text"
    return {"double": "float", "boolean": "bool"}.get(name, name)


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def differences(df, con, sql: str) -> list[str]:
    """What differs between the query's rows and the SQL's, [] for nothing."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = [_type_class(d[1]) for d in result.description]
    want_rows = result.fetchall()
    problems = []
    have_types = {f.name: _type_class(f.dataType.simpleString()) for f in df.schema.fields}
    if have_types != dict(zip(names, types)):
        problems.append(f"schema {have_types} != {dict(zip(names, types))}")
    have, want = _rows(df.columns, df.collect()), _rows(names, want_rows)
    if len(have) != len(want):
        problems.append(f"{len(have)} rows != {len(want)}")
    unlike = [(h, w) for h, w in zip(have, want) if h != w]
    if unlike:
        problems.append(f"{len(unlike)} rows differ, first: {unlike[0]}")
    return problems
