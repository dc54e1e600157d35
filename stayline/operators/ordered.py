"""Ordered work inside groups of any size.

A window partitioned by a group key gives each group to one task. A group may
hold a large share of all rows, so the operators here first look for such groups.
If none is above ``limit`` rows the plain window is used: one shuffle. Otherwise
the large groups are cut into consecutive chunks, the window runs per (group,
chunk), and totals or neighbours are carried across the chunk borders.

The chunk borders are order keys of the group's own rows, chosen by a hash of
the key, so every run and every retried task sees the same borders. The order
columns must be a total order within the group, and group keys must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .lineage import cut_lineage, store

HOT_ROWS = 1_000_000  # groups above this many rows are cut
OVERSAMPLE = 8  # border candidates per border, which evens out the chunk sizes
SLOTS = 4096
SEARCH_STEPS = [1 << b for b in range(30, -1, -1)]
IN_PARTITION_BITS = 33  # of the ids that Spark numbers rows with: partition above, row in it below


def sort_key(order: Sequence[str]) -> Column:
    """A struct that compares like ``order`` ascending with nulls last."""
    return F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])


def ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def hot_groups(df: DataFrame, group: list[str], limit: int) -> DataFrame | None:
    """(group, _n) of the groups above ``limit`` rows, or None without any: at most rows/limit.

    First all groups are counted together by hash slot, which hardly shuffles; no group can be
    above the limit in a slot that is not. Groups are then counted one by one in large slots only.
    """
    slot = F.pmod(F.xxhash64(*group), F.lit(SLOTS))
    count = F.count(F.lit(1)).alias("_n")
    slots = df.groupBy(slot.alias("_slot")).agg(count).where(F.col("_n") > limit)
    large = [r["_slot"] for r in slots.collect()]
    if not large:
        return None
    within = df if len(large) == SLOTS else df.where(slot.isin(large))
    hot = within.groupBy(*group).agg(count).where(F.col("_n") > limit).collect()
    return df.sparkSession.createDataFrame(hot, _schema_of(df, group)) if hot else None


def _schema_of(df: DataFrame, group: list[str]) -> T.StructType:
    return T.StructType([df.schema[g] for g in group]).add("_n", T.LongType())


def find_borders(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    limit: int = HOT_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame | None:
    """Chunk borders of the groups above ``limit`` rows, or None without any.

    (group, _borders, _steps, _first): ``_borders`` are the rows (_key, carried
    columns) that open the second and later chunks, in order; ``_first`` is the
    group's first row. The tables of hot groups and borders hold at most about
    rows/limit groups and keys. They are stored, so the optimizer knows their
    size and broadcasts them while they are small.
    """
    group = list(group)
    hot = hot_groups(df, group, limit)
    if hot is None:
        return None
    every = F.lit(max(1, limit // OVERSAMPLE)).cast("long")
    row = F.struct(sort_key(order).alias("_key"), *carry)
    sampled = F.when(F.pmod(F.xxhash64("_row._key"), every) == 0, F.col("_row"))
    borders = (
        df.select(*group, row.alias("_row"))
        .join(hot, group)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(sampled)).alias("_rows"), F.min("_row").alias("_first"))
        .withColumn("_borders", F.filter("_rows", lambda r, i: (i + 1) % OVERSAMPLE == 0))
    )
    powers = F.array(*[F.lit(s) for s in SEARCH_STEPS])
    steps = F.filter(powers, lambda s: s <= F.size("_borders")).alias("_steps")
    return cut_lineage(borders.select(*group, "_borders", steps, "_first"))


def chunk_of(order: Sequence[str]) -> Column:
    """How many borders are at or below the row's key, by binary search; 0 without borders."""

    def search(key: Column) -> Column:
        return F.aggregate(
            "_steps",
            F.lit(0),
            lambda at, step: F.when(
                (at + step <= F.size("_borders")) & (F.get("_borders", at + step - 1)["_key"] <= key),
                at + step,
            ).otherwise(at),
        )

    found = F.transform(F.array(sort_key(order)), search)  # makes the key once, not once per step
    return F.when(F.col("_borders").isNull(), F.lit(0)).otherwise(found[0])


def cut_groups(
    df: DataFrame, group: Sequence[str], order: Sequence[str], limit: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with a ``_chunk`` column, and the rows of the cut groups, or None without any."""
    group = list(group)
    if not group:
        cut, hot = cut_groups(df.withColumn("_all", F.lit(0)), ["_all"], order, limit)
        return cut.drop("_all"), hot and hot.drop("_all")
    borders = find_borders(df, group, order, limit)
    if borders is None:
        return df.withColumn("_chunk", F.lit(0)), None
    cut, hot = (
        df.join(borders, group, how)
        .withColumn("_chunk", chunk_of(order))
        .drop("_borders", "_steps", "_first")
        for how in ("left", "inner")
    )
    return cut, hot


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    limit: int = HOT_ROWS,
    few_groups: bool = False,
) -> DataFrame:
    """Add, per name, the sum of the expression over the earlier rows of the group.

    All columns of ``df`` move with the shuffle: pass narrow ones and join wide cells later.
    Without a group the rows are dealt by ranges of their order, whatever their number. With ``few_groups``
    (classes, say) so are they if a group is above the limit; otherwise that group is cut at borders, which
    costs the other groups nothing.
    """
    group, names = list(group), list(totals)
    if taken := set(names) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(taken)}")
    if not group:
        return running_by_ranges(df, [], order, totals)
    if few_groups and hot_groups(df, group, limit) is not None:
        return running_by_ranges(df, group, order, totals)
    valued = df.withColumns({f"_v_{n}": e for n, e in totals.items()})
    cut, hot = cut_groups(valued, group, order, limit)
    zero = F.lit(0)

    def before(keys: list[str], by: list[Column], column: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), zero)

    summed = cut.withColumns(
        {n: before([*group, "_chunk"], ascending(order), f"_v_{n}") for n in names}
    )
    if hot is not None:
        chunks = hot.groupBy(*group, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in names])
        offsets = chunks.select(
            *group,
            "_chunk",
            *[before(group, [F.col("_chunk")], f"_c_{n}").alias(f"_o_{n}") for n in names],
        )
        summed = summed.join(offsets, [*group, "_chunk"], "left").withColumns(
            {n: F.col(n) + F.coalesce(F.col(f"_o_{n}"), zero) for n in names}
        )
    return summed.select(*df.columns, *names)


def running_by_ranges(
    df: DataFrame, group: Sequence[str], order: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """As `running`, but rows are dealt by ranges of (group, order), so a group of any size spreads by itself.

    Sums inside the partitions of the range partitioning, then offsets from the sums of a group's earlier
    partitions. The partitions are stored, so that both steps see the same ones; what meets for the offsets
    is one row of each partition and group in it, and of one group never more than the partitions. No
    group keeps its borders in a row, so the width of a row does not depend on the rows. Group keys must
    not be null; the order columns may tie only in rows that are equal otherwise.
    """
    group, names = list(group), list(totals)
    by = ascending([*group, *order])
    ranged = df.withColumns({f"_v_{n}": e for n, e in totals.items()}).repartitionByRange(*by)
    numbered = ranged.sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    kept = store(numbered, "ranged").withColumn("_part", F.shiftright("_row", IN_PARTITION_BITS))
    keys = ["_part", *group]
    inside = Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in names])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, *[F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names])
    summed = kept.join(store(offsets, "offsets"), keys).withColumns(
        {n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_o_{n}") for n in names}
    )
    return summed.select(*df.columns, *names)


def row_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Add the dense 0-based position of each row in its group."""
    return running(df, group, order, {name: F.lit(1).cast("long")}, limit)


def positions_joined(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Positions over all rows of a table with wide cells: only the order key, which must be unique, is
    ranged; the cells move once, to meet their position."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.BinaryType)) and f.name not in order]
    if not wide:
        return row_positions(df, [], order, name)
    if name in df.columns:
        raise ValueError(f"columns exist already: {[name]}")
    keys = {f"_k{i}": F.col(c) for i, c in enumerate(order)}
    placed = row_positions(df.select(*[c.alias(k) for k, c in keys.items()]), [], list(keys), name)
    same = [c.eqNullSafe(F.col(k)) for k, c in keys.items()]
    met = same[0]
    for s in same[1:]:
        met = met & s
    return df.join(placed, met).select(*df.columns, name)
