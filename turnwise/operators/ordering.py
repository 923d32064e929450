"""Numbering, running totals, top-k and lookups that hold when one key owns most of the rows.

A window over a whole group puts that group into one task. The helpers here cut the group into
blocks of neighbouring order values first, so no task sees more than a block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows (of dense order values) per block of a running total.
RUN_BLOCK = 1 << 16
# Turns per block of a conversation; also the longest array collected from one.
TURN_BLOCK = 1024
# Turns per block where pairs are formed. A conversation of at most this many turns is brief.
PAIR_BLOCK = 64


def block_of(order: str, width: int) -> Column:
    """Number of the block an integral order value falls into (integer arithmetic, no rounding)."""
    return F.expr(f"cast(`{order}` div {int(width)} as bigint)")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    *,
    ties: Sequence[str] = (),
    width: int = RUN_BLOCK,
    levels: int = 1,
    totals: bool = False,
) -> DataFrame:
    """Add the sum of each value over the rows before this one (0 for the first row).

    ``order`` must be integral. Rows go to blocks of ``width`` order values: one aggregation sums
    the blocks, a window over the few block sums gives every block its start, and a window inside
    the block, which begins with that start as a row of its own, does the rest. Rows with a null key
    form a group, as in any window.

    ``levels`` repeats the scheme on the block sums: with the default width, 1 suits dense orders up
    to about 10^11 rows a key, 3 bounds every window to 65,536 rows whatever the 64-bit order
    values are. With ``totals`` a ``<name>_total`` column holds the sum over the whole group.
    """
    names = list(values)
    block, is_start = f"__block{levels}", f"__start{levels}"
    staged = df.select(
        "*",
        block_of(order, width).alias(block),
        F.lit(False).alias(is_start),
        *[value.alias(f"__v_{name}") for name, value in values.items()],
    )
    sums = staged.groupBy(*keys, block).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    if levels > 1:
        starts = running_totals(
            sums,
            keys,
            block,
            {f"__b_{n}": F.col(f"__s_{n}") for n in names},
            width=width,
            levels=levels - 1,
            totals=totals,
        )
    else:
        group = Window.partitionBy(*keys)
        before = group.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(
            *keys,
            block,
            *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in names],
            *[F.sum(f"__s_{n}").over(group).alias(f"__b_{n}_total") for n in names if totals],
        )
    starts = starts.select(
        *keys,
        block,
        F.lit(True).alias(is_start),
        *[F.col(f"__b_{n}").alias(f"__v_{n}") for n in names],
        *[F.col(f"__b_{n}_total").alias(f"__t_{n}") for n in names if totals],
    )

    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(F.desc(is_start), order, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    kept = [c for c in df.columns if c not in names]
    summed = staged.unionByName(starts, allowMissingColumns=True).select(
        is_start,
        *[F.col(f"`{c}`") for c in kept],
        *[F.sum(f"__v_{n}").over(inside).alias(n) for n in names],
        *[F.first(f"__t_{n}").over(inside).alias(f"{n}_total") for n in names if totals],
    )
    return summed.filter(~F.col(is_start)).drop(is_start)


def number_rows(
    df: DataFrame,
    order: str,
    *,
    keys: Sequence[str] = (),
    name: str = "text_id",
    ties: Sequence[str] = (),
    levels: int = 3,
) -> DataFrame:
    """Number the rows 0, 1, 2, ... by an integral column, per key or over the whole table.

    The values may be sparse (timestamps, hashed ids): see ``levels`` of :func:`running_totals`.
    """
    return running_totals(
        df, keys, order, {name: F.lit(1).cast("bigint")}, ties=ties, levels=levels
    )


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1.

    Spark keeps at most ``n`` rows a key in each task before the shuffle as long as ``n`` does not
    exceed ``spark.sql.optimizer.windowGroupLimitThreshold``; beyond, a salted first pass does.
    """
    spark = df.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(1024)))
        window = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            salted.withColumn("__pre", F.row_number().over(window))
            .filter(F.col("__pre") <= n)
            .drop("__salt", "__pre")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def place(rows: DataFrame) -> list[str]:
    """The columns a table of turns is laid out by: conversation, and block where there is one."""
    return [c for c in ("conv_id", "block") if c in rows.columns]


def attach(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Join one row of facts per conversation to its many rows.

    Rows with a ``block`` meet the facts block by block: the facts are first copied to the blocks
    their conversation really has, so a huge conversation is joined in as many tasks as it has
    blocks. Rows without belong to brief conversations and are joined directly.
    """
    if "block" not in rows.columns:
        return rows.join(facts, "conv_id")
    spread = rows.select("conv_id", "block").distinct().join(facts, "conv_id")
    return rows.join(spread, ["conv_id", "block"])


def all_brief(turns: DataFrame, width: int = PAIR_BLOCK) -> bool:
    """Do all conversations fit one block? Asks for a single turn beyond it.

    With dense turns the filter reaches the scan, where file statistics settle it.
    """
    return turns.filter(F.col("turn") >= width).isEmpty()
