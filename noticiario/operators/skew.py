"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys, which bounds what is broadcast.
HOT_SHARE = 1 / 1000
#: Below this count a key fits one task whatever its share.
HOT_ROWS = 50_000


_small: ContextVar[bool] = ContextVar("small", default=False)


@contextmanager
def few_rows(rows: int):
    """Inside, tables come from so few rows that no key of theirs can be hot, nothing is counted to find one, and small numberings need no ranges. Results are the same."""
    token = _small.set(rows < HOT_ROWS or _small.get())
    try:
        yield
    finally:
        _small.reset(token)


def is_small() -> bool:
    return _small.get()


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> list[tuple]:
    """Keys with at least ``share`` of the rows (and ``least`` rows); at most ``1 / share`` of them."""
    if _small.get():
        return []
    counts = df.groupBy(*keys).count()
    total = df.count()
    floor = max(int(total * share), least)
    if total < floor:
        return []
    found = counts.where(F.col("count") >= floor).select(*keys).collect()
    return [tuple(r) for r in found if all(v is not None for v in r)]


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = HOT_SHARE, least: int = HOT_ROWS, hot: list[tuple] | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose ``keys`` are unique.

    Rows of hot keys meet their (at most ``1 / share``) partners in a broadcast join, so they never
    gather in one task; the rest is an ordinary shuffle join. ``how`` is ``inner`` or ``left``; a null
    key matches nothing, and its rows don't travel.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if hot is None:
        hot = hot_keys(left, keys, share, least)
    known = _all_not_null(keys)
    rest = left.where(known)
    parts = []
    if hot:
        schema = [left.schema[k] for k in keys]
        from pyspark.sql.types import StructType

        table = F.broadcast(left.sparkSession.createDataFrame(hot, StructType(schema)))
        near = right.join(table, keys, "left_semi")
        parts.append(rest.join(table, keys, "left_semi").join(F.broadcast(near), keys, how))
        rest, right = rest.join(table, keys, "left_anti"), right.join(table, keys, "left_anti")
    parts.append(rest.join(right, keys, how))
    if how == "left":
        extra = [f for f in right.schema.fields if f.name not in keys]
        parts.append(left.where(~known).withColumns({f.name: F.lit(None).cast(f.dataType) for f in extra}) if extra else left.where(~known))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _all_not_null(keys: list[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).isNotNull()
    return c
