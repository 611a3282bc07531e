"""Deep pages by rank (A13 / A14 beyond the first pages).

``ORDER BY key, id LIMIT n OFFSET m`` as a top-k keeps m + n rows of every task and merges
them in one. Here the range of the order that holds rank m is located by counting: a bounded
sample of the keys gives boundaries, one aggregate counts the rows before each, and the
piece with the rank is counted again until it has at most ``target`` rows. Only that
piece is sorted, with the offset that is left. No step holds more than ``target`` rows or
``SAMPLE`` keys, however deep the page is; a piece of rows with one and the same key and id is
cut at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, BOUNDARIES = 1024, 16


class Order:
    """Rows by (key, id), as the listing has it: desc keys have nulls last, asc keys nulls first; ids ascend."""

    def __init__(self, key: str, row_id: str, descending: bool):
        self.key, self.row_id, self.descending = key, row_id, descending

    def columns(self) -> list[Column]:
        key = F.col(self.key)
        return [key.desc_nulls_last() if self.descending else key.asc_nulls_first(), F.col(self.row_id).asc_nulls_first()]

    def before(self, at: tuple) -> Column:
        """Rows that come before the boundary (key, id)."""
        key, value = F.col(self.key), at[0]
        same = key.isNull() if value is None else key.eqNullSafe(F.lit(value))
        first = F.lit(False) if at[1] is None else F.coalesce(F.col(self.row_id) < F.lit(at[1]), F.lit(True))
        if value is None:
            earlier = key.isNotNull() if self.descending else F.lit(False)
        else:
            earlier = F.coalesce(key > F.lit(value), F.lit(False)) if self.descending else F.coalesce(key < F.lit(value), F.lit(True))
        return earlier | (same & first)

    def sorted(self, keys: list[tuple]) -> list[tuple]:
        keys = sorted(keys, key=lambda k: (k[1] is not None, k[1] if k[1] is not None else 0))
        known = sorted((k for k in keys if k[0] is not None), key=lambda k: k[0], reverse=self.descending)
        nulls = [k for k in keys if k[0] is None]
        return known + nulls if self.descending else nulls + known


def piece_with(df: DataFrame, order: Order, rank: int, target: int) -> tuple[DataFrame, int, int]:
    """(rows of a range of the order, how many rows come before it, how many it has): it holds rank ``rank`` and at most ``target`` rows."""
    piece, below, rows = df, 0, None
    while rows is None or rows > target:
        # the smallest hashes are a uniform sample: a top-k of SAMPLE rows
        sample = piece.select(order.key, order.row_id).orderBy(F.xxhash64(order.row_id, order.key), order.row_id).limit(SAMPLE).collect()
        keys = order.sorted(list({(r[0], r[1]) for r in sample}))
        cuts = keys[1:] if len(keys) <= BOUNDARIES else [keys[i * len(keys) // BOUNDARIES] for i in range(1, BOUNDARIES)]
        slot = reduce(lambda a, b: a + b, [(~order.before(c)).cast("int") for c in cuts], F.lit(0))
        counts = {r["slot"]: r["n"] for r in piece.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = below
        for i in range(len(cuts) + 1):
            n = counts.get(i, 0)
            if at <= rank < at + n:
                break
            at += n
        else:
            return piece.limit(0), at, 0
        if not cuts:  # one key and id: any of its rows will do
            return piece, at, n
        if i:
            piece = piece.where(~order.before(cuts[i - 1]))
        if i < len(cuts):
            piece = piece.where(order.before(cuts[i]))
        below, rows = at, n
    return piece, below, rows


def page_by_rank(df: DataFrame, key: str, row_id: str, descending: bool, offset: int, rows: int, target: int = 10_000) -> DataFrame:
    """``rows`` rows from rank ``offset`` of the order (key, id)."""
    order = Order(key, row_id, descending)
    target = max(target, 2 * rows)
    piece, below, held = piece_with(df, order, offset, target)
    out = piece.orderBy(*order.columns())
    skip = offset - below
    out = (out.offset(skip) if 0 < skip and held <= target else out).limit(min(rows, max(held - skip, 0)))
    missing = rows - (held - skip)
    if missing <= 0 or not held:
        return out
    # the page goes on in the next piece
    return out.unionByName(page_by_rank(df, key, row_id, descending, below + held, missing, target)).orderBy(*order.columns())
