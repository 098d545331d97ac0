import math


def rows(frame):
    """Rows of a pandas frame as sorted, comparable tuples; columns by name."""
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return None
        if hasattr(v, "tolist"):
            return str(v.tolist())
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def same(df, duck, sql):
    got, want = df.toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]
