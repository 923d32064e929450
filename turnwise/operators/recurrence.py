"""Recurrence: how much a turn repeats earlier turns and is taken up by later ones.

Two ways to the same numbers:

* ``*_of_similarity`` takes any table of similar turn pairs (``operators.pairs``). The work is linear in
  the rows of that table.
* ``*_of_vectors`` takes the unit vectors themselves. As similarity is a dot product, a sum of
  similarities with many turns is one dot product with the sum of their vectors, so running totals of
  the vectors replace the pairs: the work is linear in the number of turns. Conversations that fit one
  block are paired in place, which is cheaper still.

For a turn t the other turns lie at distance 1..T before or after it: T is the number of speakers
(or a given number) for ``short``, 10 for ``medium``, everything for ``long``. A turn with an unknown
(null) speaker never counts as ``self``. ``turn`` is dense, from 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.conversation import conversation_facts
from turnwise.operators.ordering import PAIR_BLOCK, attach, block_of, running_totals
from turnwise.operators.pairs import WRITTEN_OUT, dot, near_pairs
from turnwise.operators.prepare import with_block

TIME_SCALES = ("short", "medium", "long")
DIRECTIONS = ("forward", "backward")
SPEAKERS = ("self", "other")
KINDS = tuple("_".join(k) for k in product(TIME_SCALES, DIRECTIONS, SPEAKERS))
T_MEDIUM = 10


def check_choice(name: str, value: str, choices: Sequence[str]) -> None:
    if value not in choices:
        raise ValueError(f"Invalid {name} {value!r}: should be one of {tuple(choices)}")


def _check_range(name: str, value: int | str | None) -> None:
    if isinstance(value, bool) or not (isinstance(value, int) and value >= 0):
        raise ValueError(f"{name} must be a number of turns, not {value!r}")


def _with_ranges(
    turns: DataFrame, t_short: int | None, t_medium: int, brief: bool = False
) -> DataFrame:
    """Turns with ``n_turns`` and the three ranges of their conversation."""
    if t_short is not None:
        _check_range("t_short", t_short)
    _check_range("t_medium", t_medium)
    short = F.col("n_speakers") if t_short is None else F.lit(t_short)
    facts = conversation_facts(turns).select(
        "conv_id",
        "n_turns",
        short.cast("bigint").alias("t_short"),
        F.lit(t_medium).cast("bigint").alias("t_medium"),
        F.col("n_turns").alias("t_long"),
    )
    return attach(with_block(turns, brief), facts)


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _divide(score: Column, eligible: Column) -> Column:
    """Average over the eligible turns; undefined (null) where there are none."""
    return score / F.when(eligible > 0, eligible)


def _conditional_sums(value: str, suffix: str = "") -> list[Column]:
    """The twelve sums of ``value`` over rows ``t, o, same, t_short, t_medium, t_long``."""
    ahead = {"forward": "o - t", "backward": "t - o"}
    who = {"self": "same", "other": "NOT same"}
    return [
        F.expr(
            f"sum(if({ahead[d]} BETWEEN 1 AND t_{scale} AND {who[w]}, {value}, 0D))"
            f" AS {scale}_{d}_{w}{suffix}"
        )
        for scale, d, w in product(TIME_SCALES, DIRECTIONS, SPEAKERS)
    ]


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


# ---------------------------------------------------------------- running totals over turns


def _in_parts(rows: DataFrame, dims: int, width: int = WRITTEN_OUT) -> tuple[DataFrame, list[str], int]:
    """``rows`` with ``unit`` cut into parts of at most ``width`` numbers, one row per part.

    Returns the rows, the column that tells the parts apart (none for a single part) and the numbers per part: sums over
    vectors are written out per part, so the size of a plan does not grow with the vectors.
    """
    if dims <= width:
        return rows, [], dims
    parts = F.explode(F.sequence(F.lit(0), F.lit(-(-dims // width) - 1)))
    cut = rows.withColumn("part", parts).withColumn("unit", F.slice("unit", F.col("part") * width + 1, F.lit(width)))
    return cut, ["part"], width


def _number(i: int, unit: str = "unit") -> str:
    return f"coalesce(get({unit}, {i}), 0D)"


def _sweep(rows: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Per turn, the part of its group that lies in each of the six windows.

    Returns ``conv_id, turn`` and, for every window, ``v_<scale>_<direction>`` (dot product of the turn's
    vector with the sum of the window's vectors) and ``n_<scale>_<direction>`` (turns in the window).

    Every turn puts its vector at its own position and asks for the total before six others; a
    window is the difference of two answers. Questions come before the data at a position.
    """
    at = {
        "here": F.col("turn"),
        "next": F.col("turn") + 1,
        "short_start": F.col("turn") - F.col("t_short"),
        "medium_start": F.col("turn") - F.col("t_medium"),
        "short_end": F.col("turn") + 1 + F.col("t_short"),
        "medium_end": F.col("turn") + 1 + F.col("t_medium"),
    }
    last = F.col("n_turns")
    events = F.array(
        *[
            F.struct(
                F.least(F.greatest(position, F.lit(0)), last).cast("bigint").alias("at"),
                F.lit(False).alias("is_data"),
                F.lit(name).alias("point"),
            )
            for name, position in at.items()
        ],
        F.struct(
            F.col("turn").cast("bigint").alias("at"),
            F.lit(True).alias("is_data"),
            F.lit("data").alias("point"),
        ),
    )
    carried = ["unit"] if dims else []
    placed = rows.select("conv_id", *[k for k in keys if k != "conv_id"], "turn", *carried, F.inline(events))
    placed, part, size = _in_parts(placed, dims)
    values = {"n": F.col("is_data").cast("bigint")}
    for i in range(size):
        values[f"s{i}"] = F.expr(f"if(is_data, {_number(i)}, 0D)")
    summed = running_totals(placed, [*keys, *part], "at", values, ties=["is_data"], totals=True)

    def along(suffix: str = "") -> Column:
        return F.expr(" + ".join(["0D", *[f"{_number(i)} * s{i}{suffix}" for i in range(size)]]))

    answered = summed.filter(~F.col("is_data")).select(
        "conv_id", "turn", "point", "n", "n_total", along().alias("v"), along("_total").alias("v_total")
    )
    points = [
        function(F.when(F.col("point") == name, F.col(kind))).alias(f"{kind}_{name}")
        for name in at
        for kind, function in (("n", F.max), ("v", F.sum))  # the parts of a vector add up
    ]
    wide = answered.groupBy("conv_id", "turn").agg(
        *points,
        F.max("n_total").alias("n_end"),
        F.sum(F.when(F.col("point") == "here", F.col("v_total"))).alias("v_end"),
    )
    windows = []
    for kind in ("n", "v"):
        for scale in TIME_SCALES:
            start = F.lit(0) if scale == "long" else F.col(f"{kind}_{scale}_start")
            end = F.col(f"{kind}_end") if scale == "long" else F.col(f"{kind}_{scale}_end")
            windows.append((F.col(f"{kind}_here") - start).alias(f"{kind}_{scale}_backward"))
            windows.append((end - F.col(f"{kind}_next")).alias(f"{kind}_{scale}_forward"))
    return wide.select("conv_id", "turn", *windows)


def _window_sizes() -> dict[str, Column]:
    """Turns in each window of a turn, whoever speaks."""
    behind, ahead = F.col("turn"), F.col("n_turns") - 1 - F.col("turn")
    return {
        f"{scale}_{direction}": F.least(room, F.col(f"t_{scale}"))
        for scale in TIME_SCALES
        for direction, room in (("backward", behind), ("forward", ahead))
    }


def _self_and_other(rows: DataFrame, dims: int) -> DataFrame:
    """Sums and counts of the twelve kinds from running totals: ``conv_id, turn, <kind>, <kind>_n``."""
    own = _sweep(rows.filter("speaker is not null"), ["conv_id", "speaker"], dims)
    own = own.select(
        "conv_id", "turn", *[F.col(c).alias(f"own_{c}") for c in own.columns if c[:2] in ("n_", "v_")]
    )
    joined = rows.join(own, ["conv_id", "turn"], "left")
    if dims:
        joined = joined.join(_sweep(rows, ["conv_id"], dims), ["conv_id", "turn"])
    columns = []
    for window, size in _window_sizes().items():
        same_n = F.coalesce(F.col(f"own_n_{window}"), F.lit(0))
        columns += [same_n.alias(f"{window}_self_n"), (size - same_n).alias(f"{window}_other_n")]
        if dims:
            same = _zero(F.col(f"own_v_{window}"))
            columns += [
                same.alias(f"{window}_self"),
                (F.col(f"v_{window}") - same).alias(f"{window}_other"),
            ]
    return joined.select("conv_id", "turn", *columns)


def eligible_turns(
    turns: DataFrame, *, t_short: int | None = None, t_medium: int = T_MEDIUM, brief: bool = False
) -> DataFrame:
    """``conv_id, turn`` and ``<kind>_n``: how many turns each kind of recurrence looks at."""
    ranged = _with_ranges(turns.select("conv_id", "turn", "speaker"), t_short, t_medium, brief)
    if not brief:
        return _self_and_other(ranged, 0)
    cells = _near_cells(ranged, PAIR_BLOCK, 0)
    return cells.groupBy("conv_id", F.col("t").alias("turn")).agg(
        *_conditional_sums("1D", "_n")
    )


def _near_cells(rows: DataFrame, width: int, dims: int) -> DataFrame:
    """Both directions of every pair within a block, ready for :func:`_conditional_sums`."""
    ranges = ["t_short", "t_medium", "t_long"]
    payload = ["speaker", *ranges, *(["unit"] if dims else [])]
    pairs = near_pairs(rows, payload, width)
    both = F.array(
        F.struct(F.col("a.turn").alias("t"), F.col("b.turn").alias("o")),
        F.struct(F.col("b.turn").alias("t"), F.col("a.turn").alias("o")),
    )
    similarity = _zero(dot("a.unit", "b.unit", dims)) if dims else F.lit(0.0)
    return pairs.select(
        "conv_id",
        similarity.alias("s"),
        _same(F.col("a.speaker"), F.col("b.speaker")).alias("same"),
        *[F.col(f"a.{r}").alias(r) for r in ranges],
        F.inline(both),
    )


# ---------------------------------------------------------------- topic recurrence


def topic_recurrences_of_similarity(
    turns: DataFrame,
    similarity: DataFrame,
    *,
    normalize: bool = False,
    t_short: int | None = None,
    t_medium: int = T_MEDIUM,
    brief: bool = False,
) -> DataFrame:
    """All twelve kinds per turn, one column each, from a similarity table (upper triangle)."""
    ranged = _with_ranges(turns, t_short, t_medium, brief).select(
        "conv_id", "turn", "speaker", "t_short", "t_medium", "t_long"
    )
    others = turns.select("conv_id", F.col("turn").alias("o"), F.col("speaker").alias("other_speaker"))
    s = F.col("similarity")
    cell = F.array(
        F.struct(F.col("row_turn").alias("turn"), F.col("col_turn").alias("o"), s.alias("s")),
        F.struct(F.col("col_turn").alias("turn"), F.col("row_turn").alias("o"), s.alias("s")),
    )
    cells = similarity.filter("row_turn != col_turn").select("conv_id", F.inline(cell))
    paired = (
        cells.join(ranged, ["conv_id", "turn"])
        .join(others, ["conv_id", "o"])
        .withColumn("same", _same(F.col("speaker"), F.col("other_speaker")))
        .withColumnRenamed("turn", "t")
    )
    sums = paired.groupBy("conv_id", F.col("t").alias("turn")).agg(*_conditional_sums("s"))
    scored = turns.select("conv_id", "turn").join(sums, ["conv_id", "turn"], "left")
    if not normalize:
        return scored.select("conv_id", "turn", *[_zero(F.col(k)).alias(k) for k in KINDS])
    counts = eligible_turns(turns, t_short=t_short, t_medium=t_medium, brief=brief)
    return scored.join(counts, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", *[_divide(_zero(F.col(k)), F.col(f"{k}_n")).alias(k) for k in KINDS]
    )


def topic_recurrences_of_vectors(
    turns: DataFrame,
    units: DataFrame,
    dims: int,
    *,
    normalize: bool = False,
    t_short: int | None = None,
    t_medium: int = T_MEDIUM,
    brief: bool = False,
    width: int = PAIR_BLOCK,
) -> DataFrame:
    """All twelve kinds per turn, one column each, from unit vectors of ``dims`` numbers.

    Conversations of at most ``width`` turns are paired within their block, longer ones take the
    running totals; ``brief`` promises that there are none of the latter.
    """
    ranged = _with_ranges(turns.select("conv_id", "turn", "speaker"), t_short, t_medium, brief)
    rows = ranged.join(units.select("conv_id", "turn", "unit"), ["conv_id", "turn"], "left")
    in_place = rows if brief else rows.filter(F.col("n_turns") <= width)
    cells = _near_cells(in_place, width, dims)
    sums = _conditional_sums("s")
    if normalize:
        sums += _conditional_sums("1D", "_n")
    scored = cells.groupBy("conv_id", F.col("t").alias("turn")).agg(*sums)
    if not brief:
        names = [*KINDS, *[f"{k}_n" for k in KINDS if normalize]]
        swept = _self_and_other(rows.filter(F.col("n_turns") > width), dims)
        scored = scored.unionByName(
            swept.select("conv_id", "turn", *[F.col(n).cast("double") for n in names])
        )
    # A conversation of one turn has no pair and takes part through the join only.
    result = turns.select("conv_id", "turn").join(scored, ["conv_id", "turn"], "left")
    if normalize:
        return result.select(
            "conv_id", "turn", *[_divide(_zero(F.col(k)), F.col(f"{k}_n")).alias(k) for k in KINDS]
        )
    return result.select("conv_id", "turn", *[_zero(F.col(k)).alias(k) for k in KINDS])


def topic_recurrence(
    wide: DataFrame, time_scale: str, direction: str, speaker: str
) -> DataFrame:
    """One kind out of the twelve: ``conv_id, turn, score``."""
    check_choice("time_scale", time_scale, TIME_SCALES)
    check_choice("direction", direction, DIRECTIONS)
    check_choice("speaker", speaker, SPEAKERS)
    kind = f"{time_scale}_{direction}_{speaker}"
    return wide.select("conv_id", "turn", F.col(kind).alias("score"))


def long_recurrences(wide: DataFrame) -> DataFrame:
    """``conv_id, turn, time_scale, direction, speaker, score``: one row per turn and kind."""
    rows = F.array(
        *[
            F.struct(
                F.lit(scale).alias("time_scale"),
                F.lit(direction).alias("direction"),
                F.lit(speaker).alias("speaker"),
                F.col(f"{scale}_{direction}_{speaker}").alias("score"),
            )
            for scale, direction, speaker in product(TIME_SCALES, DIRECTIONS, SPEAKERS)
        ]
    )
    return wide.select("conv_id", "turn", F.inline(rows))


# ---------------------------------------------------------------- whole conversations


def _rate(sums: DataFrame, turns: DataFrame) -> DataFrame:
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n >= 2")
    factor = F.lit(2.0) / (F.col("n") * (F.col("n") - 1))
    return counts.join(sums, "conv_id", "left").select(
        "conv_id", (_zero(F.col("total")) * factor).alias("recurrence_rate")
    )


def recurrence_rate_of_similarity(turns: DataFrame, similarity: DataFrame) -> DataFrame:
    """Mean similarity of all turn pairs; conversations of one turn have none and are left out."""
    cells = similarity.filter("row_turn < col_turn")
    return _rate(cells.groupBy("conv_id").agg(F.sum("similarity").alias("total")), turns)


def recurrence_rate_of_vectors(turns: DataFrame, units: DataFrame, dims: int) -> DataFrame:
    """The same from unit vectors: half of what the squared sum exceeds the sum of squares by."""
    rows, part, size = _in_parts(units.select("conv_id", "unit"), dims)
    squares = F.expr(" + ".join(["0D", *[f"{_number(i)} * {_number(i)}" for i in range(size)]]))
    sums = rows.groupBy("conv_id", *part).agg(
        *[F.expr(f"sum({_number(i)}) AS s{i}") for i in range(size)], F.sum(squares).alias("squares")
    )
    squared = F.expr(" + ".join(["0D", *[f"s{i} * s{i}" for i in range(size)]]))
    total = sums.groupBy("conv_id").agg(F.sum((squared - F.col("squares")) / 2).alias("total"))
    return _rate(total, turns)


def recurrence_rate(turns: DataFrame, similarity: DataFrame) -> float:
    """The rate of a single conversation as a number."""
    conversations = turns.select("conv_id").distinct().limit(2).collect()
    if len(conversations) != 1:
        raise ValueError("recurrence_rate takes exactly one conversation")
    row = recurrence_rate_of_similarity(turns, similarity).first()
    if row is None:
        raise ValueError("a conversation of fewer than 2 turns has no recurrence rate")
    return row["recurrence_rate"]


def _group_table(turns: DataFrame, parts: DataFrame, normalize: bool) -> DataFrame:
    """All ordered pairs of the groups of a conversation with their score, 0 where nothing counts.

    ``parts`` holds partial sums: ``conv_id, initiated_by, repeated_by, total, cells``.
    """
    sums = parts.groupBy("conv_id", "initiated_by", "repeated_by").agg(
        F.sum("total").alias("total"), F.sum("cells").alias("cells")
    )
    groups = turns.select("conv_id", "grp").filter("grp is not null").distinct()
    frame = groups.withColumnRenamed("grp", "initiated_by").join(
        groups.withColumnRenamed("grp", "repeated_by"), "conv_id"
    )
    score = _divide(F.col("total"), F.col("cells")) if normalize else F.col("total")
    return frame.join(sums, ["conv_id", "initiated_by", "repeated_by"], "left").select(
        "conv_id", "initiated_by", "repeated_by", _zero(score).alias("score")
    )


def _grouped_turns(turns: DataFrame, column: str) -> DataFrame:
    return turns.select("conv_id", "turn", F.col(column).alias("grp"))


def _across_blocks(rows: DataFrame, dims: int, width: int) -> DataFrame:
    """Sums over the pairs of turns in different blocks, from the totals of blocks.

    The blocks of a conversation are halved again and again; at every level the totals of the left half of a
    stretch meet those of its right half. A pair of blocks meets at exactly one level, and only groups that are present
    meet at all.
    """
    placed, part, size = _in_parts(rows.withColumn("__block", block_of("turn", width)), dims)
    names = ["n", *[f"s{i}" for i in range(size)]]
    totals = placed.groupBy("conv_id", "__block", "grp", *part).agg(
        F.count("*").alias("n"), *[F.expr(f"sum({_number(i)}) AS s{i}") for i in range(size)]
    )
    last = totals.groupBy("conv_id").agg(F.max("__block").alias("last"))
    levels = F.sequence(F.lit(0), F.length(F.bin("last")) - 1)
    spread = totals.join(last, "conv_id").withColumn("level", F.explode(levels))
    stretch = F.expr("shiftright(__block, level + 1)")
    right = F.expr("shiftright(__block, level) & 1") == 1
    halves = (
        spread.withColumns({"stretch": stretch, "right": right})
        .groupBy("conv_id", "level", "stretch", "right", "grp", *part)
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    keys = ["conv_id", "level", "stretch", *part]
    first = halves.filter(~F.col("right")).select(
        *keys, F.col("grp").alias("initiated_by"), *[F.col(n).alias(f"a_{n}") for n in names]
    )
    second = halves.filter("right").select(*keys, F.col("grp").alias("repeated_by"), *names)
    met = first.join(second, keys)
    total = F.expr(" + ".join(["0D", *[f"a_s{i} * s{i}" for i in range(size)]]))
    pairs = F.col("a_n") * F.col("n")  # counted in one part only
    cells = F.when(F.col("part") == 0, pairs).otherwise(0) if part else pairs
    return met.groupBy("conv_id", "initiated_by", "repeated_by").agg(
        F.sum(total).alias("total"), F.sum(cells).alias("cells")
    )


def _within_blocks(rows: DataFrame, dims: int, width: int) -> DataFrame:
    pairs = near_pairs(rows, ["grp", "unit"] if dims else ["grp"], width)
    total = _zero(dot("a.unit", "b.unit", dims)) if dims else F.lit(0.0)
    return pairs.groupBy(
        "conv_id", F.col("a.grp").alias("initiated_by"), F.col("b.grp").alias("repeated_by")
    ).agg(F.sum(total).alias("total"), F.count("*").alias("cells"))


def _group_parts(rows: DataFrame, dims: int, brief: bool, width: int = PAIR_BLOCK) -> DataFrame:
    """Partial sums and cell counts of all pairs: inside blocks by pairs, across blocks by totals."""
    grouped = rows.filter("grp is not null")
    if brief:
        return _within_blocks(grouped, dims, width)
    beyond = grouped.groupBy("conv_id").agg(F.max("turn").alias("last")).filter(F.col("last") >= width)
    longer = attach(with_block(grouped), beyond).drop("block", "last")
    return _within_blocks(grouped, dims, width).unionByName(_across_blocks(longer, dims, width))


def grouped_recurrence_of_vectors(
    turns: DataFrame,
    units: DataFrame,
    dims: int,
    *,
    column: str = "speaker",
    normalize: bool = True,
    brief: bool = False,
) -> DataFrame:
    """``conv_id, initiated_by, repeated_by, score`` between speakers, or groups of any column.

    Sum of the similarities of turns i < j with the first in one group and the second in the
    other, divided by the number of such pairs unless ``normalize`` is off. Turns without a group
    (null) are left out.
    """
    grouped = _grouped_turns(turns, column)
    rows = grouped.join(units.select("conv_id", "turn", "unit"), ["conv_id", "turn"], "left")
    return _group_table(grouped, _group_parts(rows, dims, brief), normalize)


def grouped_recurrence_of_similarity(
    turns: DataFrame,
    similarity: DataFrame,
    *,
    column: str = "speaker",
    normalize: bool = True,
    brief: bool = False,
) -> DataFrame:
    """The same from a similarity table; the number of pairs is counted without forming them."""
    grouped = _grouped_turns(turns, column)
    first = grouped.select("conv_id", F.col("turn").alias("row_turn"), F.col("grp").alias("initiated_by"))
    second = grouped.select("conv_id", F.col("turn").alias("col_turn"), F.col("grp").alias("repeated_by"))
    sums = (
        similarity.filter("row_turn < col_turn")
        .join(first, ["conv_id", "row_turn"])
        .join(second, ["conv_id", "col_turn"])
        .groupBy("conv_id", "initiated_by", "repeated_by")
        .agg(F.sum("similarity").alias("total"))
        .withColumn("cells", F.lit(0).cast("bigint"))
    )
    parts = sums.unionByName(_group_parts(grouped, 0, brief)) if normalize else sums
    return _group_table(grouped, parts, normalize)
