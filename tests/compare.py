"""Both sides of a query as sorted rows of text, floats at ten significant digits."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    return "null" if v is None else f"{v:.10g}" if isinstance(v, float) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.collect())


def duck_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    return names, sorted(tuple(text(r[cols.index(n)]) for n in names) for r in cur.fetchall())
