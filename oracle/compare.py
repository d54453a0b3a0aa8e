"""Compare a Spark result with a DuckDB result as bags of rows."""

import datetime
import glob
import os
from collections import Counter

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types and rows agree."""
    result = con.execute(sql)
    duck_types = {c[0]: str(c[1]) for c in result.description}
    duck_rows = result.fetchall()
    names = sorted(df.columns)
    if names != sorted(duck_types):
        return [f"columns {names} / {sorted(duck_types)}"]
    out = [f"type of {n}: {t} / {duck_types[n]}" for n, t in df.dtypes if KINDS.get(t, t) != duck_types[n]]
    rows = df.select(*names).collect()
    place = {c[0]: i for i, c in enumerate(result.description)}
    ours = Counter(tuple(_plain(v) for v in r) for r in rows)
    theirs = Counter(tuple(_plain(r[place[n]]) for n in names) for r in duck_rows)
    if len(rows) != len(duck_rows):
        out.append(f"rows {len(rows)} / {len(duck_rows)}")
    only, missing = ours - theirs, theirs - ours
    for label, rest in (("spark only", only), ("oracle only", missing)):
        if rest:
            out.append(f"{label} ({sum(rest.values())}): " + " ;; ".join(str(dict(zip(names, k)))[:500] for k in sorted(
                rest, key=str)[:2]))
    return out
