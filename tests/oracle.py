"""Run a registered query in Spark and its SQL check in DuckDB, and compare the rows."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casetable.drills import all_checks, all_queries  # noqa: E402
from casetable.drills.base import TABLES  # noqa: E402


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v


def _rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in at) for r in rows), key=repr)


def _family(t: str) -> str:
    t = t.upper()
    for family, names in {
        "int": ("BIGINT", "INT", "INTEGER", "LONG"), "double": ("DOUBLE",), "text": ("VARCHAR", "STRING"), "bool": ("BOOLEAN",),
    }.items():
        if t in names:
            return family + ("32" if t in ("INT", "INTEGER") else "")
    return t


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, name: str, folder: str) -> str | None:
    """None when both agree, else what differs."""
    df = all_queries()[name](spark, folder)
    mine = df.collect()
    res = con.execute(all_checks()[name])
    names, types = [d[0] for d in res.description], [str(d[1]) for d in res.description]
    theirs = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds, others = {n: _family(t) for n, t in df.dtypes}, dict(zip(names, map(_family, types)))
    if kinds != others:
        return f"types differ: { {n: (kinds[n], others[n]) for n in kinds if kinds[n] != others[n]} }"
    a, b = _rows(df.columns, mine), _rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; first only here {[x for x in a if x not in set(b)][:2]}, only there {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(names)}, first {str(bad[0])[:700]}"
    return None if a else "no rows"


def main() -> int:
    from casetable.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in all_queries():
        if want and not any(name.startswith(w) for w in want):
            continue
        at = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {time.time() - at:6.2f}s {name} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
