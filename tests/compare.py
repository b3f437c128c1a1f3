"""Runs a query and its SQL twin and compares rows, types aside, as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def differences(spark, sf_dir: str, query, sql: str, con=None) -> list[str]:
    """What differs; nothing if all is the same."""
    frame = query(spark, sf_dir)
    cursor = (con or connection(sf_dir)).execute(sql)
    names = [d[0] for d in cursor.description]
    out = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} and {sorted(names)}"]
    order = sorted(names)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in frame.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    if ours != theirs:
        out.append(f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}")
    return out
