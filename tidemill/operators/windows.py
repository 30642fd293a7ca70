"""Row-count windows, label shifts and the frames they need.

A series without groups would go to one task. Here it is ranked by pieces of its order (each piece counts its rows,
the counts give the offsets), cut into blocks of consecutive ranks, and each block borrows the few rows of its
neighbours that its windows reach: the work stays spread however long the series.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import TypeConverters
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.errors import TidemillError
from tidemill.functions import vectors
from tidemill.operators.stages import Stage, need, need_not, param

PIECE_ROWS = 1 << 20
GRID = 1024  # pieces at most
BLOCK_ROWS = 1 << 17


def range_bounds(df: DataFrame, order: str, piece_rows: int = PIECE_ROWS) -> list:
    """Upper bounds of pieces of about equal size by ``order``: one for each core at least, and so many that a piece has about ``piece_rows`` rows."""
    row = df.agg(F.count(order).alias("n"), F.percentile_approx(order, [k / GRID for k in range(1, GRID)], 20 * GRID).alias("q")).first()
    pieces = min(GRID, max(df.sparkSession.sparkContext.defaultParallelism, -(-row["n"] // piece_rows)))
    return sorted({row["q"][k * GRID // pieces - 1] for k in range(1, pieces)}) if row["n"] else []


def piece_of(order: str | Column, bounds: list) -> Column:
    """The number of bounds below the order, by halving."""

    def between(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(col > F.lit(bounds[mid]), between(mid + 1, b)).otherwise(between(a, mid))

    col = F.col(order) if isinstance(order, str) else order
    return between(0, len(bounds))


def sums_before(totals: dict[int, float], pieces: int) -> list:
    """For each piece, the sum over the pieces before it."""
    out, so_far = [], 0
    for k in range(pieces):
        out.append(so_far)
        so_far += totals.get(k, 0)
    return out


def with_rank(df: DataFrame, order: str, name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with its 1-based place by ``order`` (ties in any order, nulls last left out). Rows of one order stay in one piece."""
    df = df.where(F.col(order).isNotNull())
    bounds = range_bounds(df, order, piece_rows)
    df = df.withColumn("_piece", piece_of(order, bounds))
    sizes = {r["_piece"]: r["count"] for r in df.groupBy("_piece").count().collect()}  # at most GRID rows
    before = F.array(*[F.lit(n) for n in sums_before(sizes, len(bounds) + 1)])
    local = F.row_number().over(Window.partitionBy("_piece").orderBy(order))
    return df.withColumn(name, F.get(before, F.col("_piece")) + local).drop("_piece")


def blocks(df: DataFrame, order: str, back: int, ahead: int, size: int = BLOCK_ROWS) -> tuple[DataFrame, Window, Column]:
    """(rows with borrowed ones, window by block and rank, whether a row is its block's own)."""
    size = max(size, back, ahead, 1)
    ranked = with_rank(df, order, "_rank")
    own = F.floor((F.col("_rank") - 1) / size)
    place = (F.col("_rank") - 1) % size
    homes = F.array(own, F.when(place >= size - back, own + 1), F.when(place < ahead, own - 1))
    spread = ranked.withColumn("_own", own).withColumn("_block", F.explode(F.filter(homes, lambda b: b.isNotNull())))
    return spread, Window.partitionBy("_block").orderBy("_rank"), F.col("_block") == F.col("_own")


_HELPERS = ("_rank", "_own", "_block")


def _framed(df: DataFrame, order: str, group: str | None, back: int, ahead: int):
    if group:
        return df, Window.partitionBy(group).orderBy(order), F.lit(True)
    return blocks(df, order, back, ahead)


class _Series(Stage):
    inputCol = param("inputCol", "column that is windowed", TypeConverters.toString)
    outputCol = param("outputCol", "result; may be the input, which it then replaces", TypeConverters.toString)
    orderCol = param("orderCol", "whole-number order column", TypeConverters.toString)
    groupCol = param("groupCol", "column that separates series", TypeConverters.toString)
    consecutive = param("consecutive", "rows belong together by order values, not by place", TypeConverters.toBoolean)
    duplicates = param("duplicates", "with consecutive: orders may repeat, so match by joins", TypeConverters.toBoolean)
    defaults = {"consecutive": False, "duplicates": False}

    def _checked(self, df: DataFrame) -> tuple[str, str, str, str | None]:
        source, target, order, group = self.required("inputCol"), self.required("outputCol"), self.required("orderCol"), self.value("groupCol")
        need(df.schema, source, order, *([group] if group else []))
        if target != source:
            need_not(df.schema, target)
        return source, target, order, group

    @staticmethod
    def _placed(df: DataFrame, source: str, target: str) -> DataFrame:
        """The result under its name; in place of the input it stands last."""
        return df.drop(source, *_HELPERS).withColumnRenamed("_out", target) if source == target else df.drop(*_HELPERS).withColumnRenamed("_out", target)


class SlidingWindow(_Series):
    """The last ``windowSize`` values, oldest first; rows without a full window (or with a null in it) drop.

    Vectors join into one vector, other columns into an array; with ``consecutive`` the result is always a vector and
    the window holds exactly the orders o-n+1..o.
    """

    windowSize = param("windowSize", "rows of a window", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        source, target, order, group = self._checked(df)
        n = self.required("windowSize")
        if n <= 0:
            raise TidemillError("windowSize must be positive")
        if self.value("consecutive") and self.value("duplicates"):
            return self._joined(df, source, target, order, group, n)
        vector = vectors.is_vector(df, source)
        rows, window, own = _framed(df, order, group, n - 1, 0)
        frame = window.rowsBetween(1 - n, 0)
        if self.value("consecutive"):
            rows = rows.withColumn("_first", F.min(order).over(frame)).withColumn("_seen", F.collect_list(vectors.as_array(df, source)).over(frame))
            fits = (F.size("_seen") == n) & (F.col(order) - F.col("_first") == n - 1)
            kept = rows.where(own & fits).withColumn("_out", array_to_vector(F.flatten("_seen"))).drop("_first", "_seen")
            return self._placed(kept, source, target)
        rows = rows.withColumn("_out", F.collect_list(vectors.as_array(df, source) if vector else F.col(source)).over(frame))
        kept = rows.where(own & (F.size("_out") == n))
        return self._placed(kept.withColumn("_out", array_to_vector(F.flatten("_out"))) if vector else kept, source, target)

    def _joined(self, df: DataFrame, source: str, target: str, order: str, group: str | None, n: int) -> DataFrame:
        keys = [group] if group else []
        out = df.withColumn("_out", vectors.as_array(df, source))
        slim = df.select(*keys, F.col(order).alias("_o"), vectors.as_array(df, source).alias("_older"))
        for i in range(1, n):
            shifted = slim.select(*keys, (F.col("_o") + i).cast(df.schema[order].dataType).alias(order), "_older")
            out = out.join(shifted, [*keys, order]).withColumn("_out", F.concat("_older", "_out")).drop("_older")
        return self._placed(out.withColumn("_out", array_to_vector("_out")), source, target).select(*[c for c in df.columns if c != target], target)


class SeqShift(_Series):
    """The value ``shift`` rows ahead; rows without one drop.

    ``mode`` compat, for groups: the cut is the shift-th largest distinct order of all groups together, and a group
    that ends before it keeps rows that show its own last value.
    """

    shift = param("shift", "rows ahead", TypeConverters.toInt)
    mode = param("mode", "strict or compat", TypeConverters.toString)
    defaults = {"consecutive": False, "duplicates": False, "mode": "strict"}

    def _transform(self, df: DataFrame) -> DataFrame:
        source, target, order, group = self._checked(df)
        s = self.required("shift")
        if s <= 0:
            raise TidemillError("shift must be positive")
        if self.value("consecutive"):
            keys = [group] if group else []
            ahead = df.select(*keys, (F.col(order) - s).cast(df.schema[order].dataType).alias(order), F.col(source).alias("_out"))
            return self._placed(df.join(ahead, [*keys, order]), source, target)
        if self.value("mode") == "compat":
            frame = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order).rowsBetween(0, s)
            orders = df.select(order).distinct() if group else df.select(order)
            cut = orders.orderBy(F.desc(order)).limit(s).agg(F.min(order).alias("_cut"))
            rows = df.withColumn("_out", F.last(source).over(frame)).join(F.broadcast(cut), F.col(order) < F.col("_cut")).drop("_cut")
            return self._placed(rows, source, target)
        rows, window, own = _framed(df, order, group, 0, s)
        rows = rows.withColumns({"_out": F.lead(source, s).over(window), "_there": F.lead(F.lit(1), s).over(window)})
        return self._placed(rows.where(own & F.col("_there").isNotNull()).drop("_there"), source, target)


def top_orders(df: DataFrame, order: str, k: int) -> DataFrame:
    return df.select(order).orderBy(F.desc(order)).limit(k)


def order_dependent_predictions(model, full: DataFrame, test: DataFrame, order: str) -> DataFrame:
    """Transform the whole series, so that windows reach back, and keep what lies in the test range. Empty test: nothing."""
    least = test.agg(F.min(order).alias("_least"))
    return model.transform(full).join(F.broadcast(least), F.col(order) >= F.col("_least")).drop("_least")


def independent_predictions(model, full: DataFrame, test: DataFrame) -> DataFrame:
    return model.transform(test)
