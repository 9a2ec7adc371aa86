"""Run a registered query next to its SQL twin and compare names, types and rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FAMILY = {
    "string": "text", "VARCHAR": "text", "bigint": "i64", "BIGINT": "i64", "int": "i32", "INTEGER": "i32",
    "double": "f64", "DOUBLE": "f64", "boolean": "bool", "BOOLEAN": "bool",
}


def oracle_rows(sql, sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in result.description}
    return names, types, result.fetchall()


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    return repr(value)


def compare(df, sql, sf):
    """Return a list of differences, empty if the results agree."""
    names, types, rows = oracle_rows(sql, sf)
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, kind in df.dtypes:
        if FAMILY.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    order = sorted(names)
    mine = sorted(tuple(_cell(r[n]) for n in order) for r in df.collect())
    place = {n: names.index(n) for n in order}
    theirs = sorted(tuple(_cell(r[place[n]]) for n in order) for r in rows)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    if mine != theirs:
        left = [m for m in mine if m not in set(theirs)][:3]
        right = [t for t in theirs if t not in set(mine)][:3]
        problems.append(f"values over {order}: {left} vs {right}")
    if not mine:
        problems.append("no rows at all")
    return problems
