"""Run a query in Spark and its SQL in DuckDB and compare the results by value.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def _kind(text: str) -> str:
    text = text.upper()
    return {"LONG": "BIGINT", "VARCHAR": "STRING", "INTEGER": "INT"}.get(text, text)


def differences(df, con, sql: str, tolerance: float = 0.0) -> list[str]:
    """Empty when schema, row count and all values agree."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: _kind(str(c[1])) for c in cursor.description}
    columns, expected = _ordered(names, cursor.fetchall())
    found_names, found = _ordered(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if columns != found_names:
        return [f"columns {found_names} against {columns}"]
    for field in df.schema.fields:
        kind = _kind(field.dataType.simpleString())
        if kind != types[field.name]:
            out.append(f"type of {field.name}: {kind} against {types[field.name]}")
    if len(found) != len(expected):
        return [*out, f"{len(found)} rows against {len(expected)}"]
    for a, b in zip(found, expected):
        for name, x, y in zip(columns, a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance)
            if not same:
                out.append(f"{name}: {x!r} against {y!r} in {a} / {b}")
                break
        if len(out) > 3:
            break
    return out


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from tallyframe.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con, sql = build_session("local[8]"), connect(sf_dir), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                found = differences(df, con, sql[name])
                label = "same" if not found else "DIFFERENT"
            else:
                found, label = [], f"rows only ({df.count()})"
        except Exception as error:  # noqa: BLE001 - reported per query
            found, label = [f"{type(error).__name__}: {str(error)[:700]}"], "FAILED"
        bad += bool(found)
        print(f"{label:10} {name} {time.time() - start:.2f}s", *found, sep="\n    " if found else " ", flush=True)
    print(f"{bad} queries with differences")


if __name__ == "__main__":
    main()
