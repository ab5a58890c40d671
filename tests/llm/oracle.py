"""Runs a registered query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def both(spark, name, sf_dir):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None), key=repr)
    return rows(got), rows(want)
