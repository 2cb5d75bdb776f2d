"""What tests share."""


def same(df, sql, duck):
    """Whether both give the same rows, in any order."""
    a, b = df.toPandas(), duck.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    order = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    a, b = order(a), order(b)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head().to_string() + b[(a != b).any(axis=1)].head().to_string()
