"""Side-by-side run of a query and its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _family(kind: pa.DataType) -> str:
    if pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return "string"
    return str(kind)


def rows_and_types(table: pa.Table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = sorted(([_plain(v) for v in row] for row in zip(*cols)), key=lambda r: [(v is None, str(v)) for v in r])
    return names, [_family(table.schema.field(n).type) for n in names], rows


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs first."""
    ours = rows_and_types(df.toArrow())
    theirs = rows_and_types(con.execute(sql).to_arrow_table())
    for what, a, b in zip(("columns", "types"), ours, theirs):
        if a != b:
            return f"{what}: {a} != {b}"
    if len(ours[2]) != len(theirs[2]):
        return f"rows: {len(ours[2])} != {len(theirs[2])}"
    for a, b in zip(ours[2], theirs[2]):
        if a != b:
            return f"row: {str(a)[:300]} != {str(b)[:300]}"
    return None
