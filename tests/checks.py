"""Comparison of a query with its SQL."""

import os

DATA = "/root/testdata/sf0.001"


def rows_of(frame, columns):
    """Rows as sorted tuples of text, numbers to 6 places."""
    text = lambda x: "-" if x is None or x != x else f"{float(x):.6g}" if isinstance(x, float) or hasattr(x, "dtype") else str(x)
    return sorted(tuple(text(x) for x in row) for row in frame[columns].astype(object).values.tolist())


def same_as_sql(df, sql, data=DATA):
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(data):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{name}')")
    got, want = df.toPandas(), db.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # numbers that are whole in one engine may come as floats from the other where a column has nulls
    for frame in (got, want):
        for c in columns:
            if frame[c].dtype.kind in "iuf" or str(frame[c].dtype).startswith(("Int", "Float")):
                frame[c] = frame[c].astype(float)
    assert rows_of(got, columns) == rows_of(want, columns)
