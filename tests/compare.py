"""Compare a Spark result with a DuckDB result, strictly and regardless of row order."""

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


# Spark type name -> DuckDB type name
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql):
    """Human-readable differences; empty when both sides agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns: spark only {set(df.columns) - set(names)}, sql only {set(names) - set(df.columns)}"]
    wrong = [f"type of {c}: spark {t}, sql {kinds[c]}" for c, t in df.dtypes if TYPES.get(t) != kinds[c]]
    found = [tuple(row) for row in df.collect()]
    if len(found) != len(expected):
        wrong.append(f"rows: spark {len(found)}, sql {len(expected)}")
    ours, theirs = as_rows(df.columns, found), as_rows(names, expected)
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
        wrong += [f"row: spark {a}\n     sql   {b}" for a, b in bad]
        wrong.append(str(sorted(names)))
    return wrong
