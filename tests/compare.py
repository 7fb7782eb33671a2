"""Rows of Spark and DuckDB in one form, for comparison without regard to order."""


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(tuple(sorted(v.asDict().items())))
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
