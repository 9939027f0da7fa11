"""The driver's comparison, in small: equal columns, equal rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


def rows_of(table):
    names = sorted(table.column_names)
    return sorted(repr([plain(x) for x in r]) for r in zip(*(table[c].to_pylist() for c in names), strict=True))


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found, wanted = df.toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    assert rows_of(found) == rows_of(wanted)
