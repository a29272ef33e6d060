"""Order-dependent building blocks that stay distributed when one key holds much of the data.

``index`` values are unique longs, so ``index >> bits`` cuts any group, however hot, into
pieces of at most ``2**bits`` rows. Work inside a piece is an ordinary window; what crosses
pieces is one small row per (group, piece).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_BITS = 20
HOT_ROWS = 1 << 22
SPREAD = 64
SMALL_ROWS = 50_000


def _piece(order_col: str, bits: int) -> Column:
    return F.shiftright(F.col(order_col).cast("long"), bits)


def group_row_number(
    df: DataFrame, keys: list[str], order_col: str, out: str, start: int = 1, bits: int = PIECE_BITS
) -> DataFrame:
    """``row_number`` per group (or overall, with no keys) over a unique long, one piece per task.

    Only keys and order values are numbered, in windows of at most 2**bits such rows; whole rows meet their number in a
    join on the unique order value, spread by its hash, however wide they are. The unpartitioned window runs over
    piece sizes only: rows / 2**bits of them.
    """
    pieces = df.select(*keys, order_col).withColumn("_piece", _piece(order_col, bits))
    sizes = pieces.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_piece").orderBy(order_col)
    numbers = pieces.join(offsets, [*keys, "_piece"]).select(
        F.col(order_col).alias("_ordered"), (F.row_number().over(within) + F.col("_offset") + F.lit(start - 1)).alias("_number")
    )
    joined = df.join(numbers, F.col(order_col) == F.col("_ordered")).drop("_ordered")
    return joined.drop(out).withColumnRenamed("_number", out)


def sequential_index(
    df: DataFrame, order_col: str = "index", out: str = "index", start: int = 1, bits: int = PIECE_BITS
) -> DataFrame:
    """Contiguous numbering in ``order_col`` order without a single-task sort."""
    if out != order_col:
        return group_row_number(df, [], order_col, out, start, bits)
    renamed = df.withColumnRenamed(order_col, "_order")
    return group_row_number(renamed, [], "_order", out, start, bits).drop("_order")


def running_sum(df: DataFrame, order_col: str, value: str, out: str, budget: int, bits: int = PIECE_BITS) -> DataFrame:
    """Rows whose running sum of a non-negative ``value``, in the order of a unique long, stays within ``budget``.

    A prefix sum in levels: sums per piece, pieces per block of 2**10 pieces, and blocks, of which there are rows / 2**(bits + 10).
    Only pieces that begin within the budget are summed row by row.
    """
    pieces = df.withColumn("_piece", _piece(order_col, bits)).withColumn("_block", F.shiftright("_piece", 10))
    sums = pieces.groupBy("_block", "_piece").agg(F.sum(value).alias("_sum"))
    blocks = sums.groupBy("_block").agg(F.sum("_sum").alias("_total"))
    before = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_block", before("_total", Window.orderBy("_block")).alias("_start")).where(F.col("_start") <= budget)
    offset = F.col("_start") + before("_sum", Window.partitionBy("_block").orderBy("_piece"))
    offsets = sums.join(starts, "_block").select("_block", "_piece", offset.alias("_offset")).where(F.col("_offset") <= budget)
    within = Window.partitionBy("_block", "_piece").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    found = pieces.join(offsets, ["_block", "_piece"]).withColumn(out, F.sum(value).over(within) + F.col("_offset"))
    return found.where(F.col(out) <= budget).drop("_block", "_piece", "_offset")


def consecutive_pairs(
    df: DataFrame, keys: list[str], order_col: str, value: str, bits: int = PIECE_BITS
) -> DataFrame:
    """``(keys, src, dst)`` for each row and its successor in the group; hot groups are cut in pieces."""
    pieces = df.select(*keys, order_col, value).withColumn("_piece", _piece(order_col, bits))
    within = Window.partitionBy(*keys, "_piece").orderBy(order_col)
    inside = (
        pieces.withColumn("_next", F.struct(F.lead(value).over(within).alias("v"), F.lead(order_col).over(within).alias("o")))
        .where(F.col("_next.o").isNotNull())
        .select(*keys, F.col(value).alias("src"), F.col("_next.v").alias("dst"))
    )
    edges = pieces.groupBy(*keys, "_piece").agg(
        F.min_by(value, order_col).alias("_first"), F.max_by(value, order_col).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_piece")
    between = (
        edges.withColumn("_following", F.lead("_first").over(across))
        .withColumn("_more", F.lead("_piece").over(across))
        .where(F.col("_more").isNotNull())
        .select(*keys, F.col("_last").alias("src"), F.col("_following").alias("dst"))
    )
    return inside.unionByName(between)


def first_per_group(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Whole rows holding the smallest ``order_col`` of their group.

    The group minimum is a narrow map-side-combined aggregate, so hot groups cost one row per
    task; the wide rows meet it on the unique ``order_col`` and are never sorted by group.
    """
    firsts = df.groupBy(*keys).agg(F.min(order_col).alias(order_col)).select(order_col)
    return df.join(firsts, order_col, "left_semi")


def smallest_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, out: str = "rank") -> DataFrame:
    """First ``limit`` rows per group; Spark cuts each group to ``limit`` rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= limit)


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a user-sized table for broadcast after counting that it is small; larger ones join by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    spread: int = SPREAD,
) -> DataFrame:
    """Join many facts to a ``lookup`` with one row (or a fixed few) per key, salting only the hot keys.

    Keys with ``hot_rows`` facts or more are split over ``spread`` tasks and their single lookup
    row is repeated. At most rows / hot_rows keys can be hot, which bounds the broadcast.
    ``spread_by`` are fact columns that vary within a key (the salt must survive task retries).
    """
    hot = F.broadcast(
        facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows).select(*keys, F.lit(1).alias("_hot"))
    )
    # Null keys match nothing; salting them as well keeps them from piling up in one task.
    spread_out = F.col("_hot").isNotNull()
    for key in keys:
        spread_out = spread_out | F.col(key).isNull()
    salt = F.when(spread_out, F.pmod(F.xxhash64(*spread_by), F.lit(spread))).otherwise(F.lit(0))
    salted = facts.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    repeated = (
        lookup.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), F.lit(spread - 1)).otherwise(F.lit(0)))))
        .drop("_hot")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
