"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def same(a, b) -> bool:
    """Exact, but for -0.0 and 0.0."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


#: Longer results are compared as sets of rows inside DuckDB.
MANY = 200_000


def _kind(arrow_type) -> str:
    """What Python would make of a value of that type."""
    text = str(arrow_type)
    for kind, starts in (("int", ("int", "uint")), ("float", ("float", "double")), ("str", ("string", "large_string"))):
        if text.startswith(starts):
            return kind
    return text


def _set_differences(df, con) -> tuple[int, list[str]]:
    """The same for long results, row by row and with repetitions."""
    actual, expected = df.toArrow(), con.execute("SELECT * FROM expected_rows LIMIT 1").to_arrow_table()
    names = sorted(actual.column_names)
    if names != sorted(expected.column_names):
        return 0, [f"columns {names} against {sorted(expected.column_names)}"]
    kinds = [[_kind(t.schema.field(n).type) for n in names] for t in (actual, expected)]
    problems = [f"types {kinds[0]} against {kinds[1]}"] if kinds[0] != kinds[1] else []
    con.register("actual_rows", actual)
    columns = ", ".join(names)
    for a, b in (("actual_rows", "expected_rows"), ("expected_rows", "actual_rows")):
        rows = con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchmany(2)
        if rows:
            problems.append(f"in {a} only, first {rows} ({names})")
    con.unregister("actual_rows")
    return actual.num_rows, problems


def differences(df, con, sql: str) -> tuple[int, list[str]]:
    """Number of rows and what differs (names, row count, first unequal rows)."""
    con.execute(f"CREATE OR REPLACE TEMP TABLE expected_rows AS {sql}")
    if con.execute("SELECT count(*) FROM expected_rows").fetchone()[0] > MANY:
        return _set_differences(df, con)
    result = con.execute("SELECT * FROM expected_rows")
    names = [d[0] for d in result.description]
    expected = sorted_rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return 0, [f"columns {sorted(df.columns)} against {sorted(names)}"]
    actual = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows against {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if not all(map(same, a, e))]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[:2]} ({sorted(names)})")
    return len(actual), problems
