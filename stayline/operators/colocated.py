"""Both ends of pairs with one shuffle of the cells, or none.

The ends of a pair are neighbours in their subject's time order, so recordings that are dealt by subject
bring both ends of nearly all pairs to one task. A subject above ``limit`` rows is cut into consecutive
chunks, and the row that opens a chunk goes to the chunk before it too: there it is the later end of the
last pair. `write_linked` stores recordings that way, and `read_linked_pairs` needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schema import CROSS_STAY, RECORDINGS, WITHIN_STAY, conform
from .lineage import store
from .ordered import ascending, chunk_of, find_borders, sort_key
from .pairs import TIME_ORDER, fetch_pairs

CHUNK_ROWS = 65_536  # rows of a subject with their cells that lie together
MOST_BORDERS = 1_000_000  # so many borders and subjects, some tens of bytes each, are broadcast
PLACE = ["subject_id", "_chunk"]
LINKED = ["idx_t1", "pair_type", "pair_fold", "copied"]  # what a linked table has beside a recording's columns


def _borders_of(recordings: DataFrame, limit: int, carry: Sequence[str] = ()) -> DataFrame | None:
    """Chunk borders, few enough to be broadcast: of more than MOST_BORDERS only every second, third and so on is
    kept, which makes chunks longer. Without that the cells would have to move once more, to meet the borders."""
    rows = recordings.where(F.col("subject_id").isNotNull()).select("subject_id", *TIME_ORDER, *carry)
    borders = find_borders(rows, ["subject_id"], TIME_ORDER, limit, carry)
    if borders is None:
        return None
    held = borders.agg(F.count(F.lit(1)) + F.sum(F.size("_borders"))).first()[0]
    if held > MOST_BORDERS:
        step = -(-2 * held // MOST_BORDERS)  # a subject that stays has a border at least
        kept = borders.withColumn("_borders", F.filter("_borders", lambda b, i: (i + 1) % step == 0)).where(F.size("_borders") > 0)
        borders = store(kept.withColumn("_steps", F.filter("_steps", lambda s: s <= F.size("_borders"))), "fewer-borders")
    return F.broadcast(borders)


def _opens() -> Column:
    """Whether the row opens the second or a later chunk of its subject."""
    opening = F.get("_borders", F.col("_chunk") - 1)
    return F.coalesce(opening["_key"] == sort_key(TIME_ORDER), F.lit(False))


def _placed(rows: DataFrame, borders: DataFrame | None) -> DataFrame:
    """Rows with ``_chunk`` and ``copied``; a row that opens a chunk comes a second time, in the chunk before."""
    if borders is None:
        return rows.withColumns({"_chunk": F.lit(0), "copied": F.lit(False)})
    here = F.struct(F.col("_chunk").alias("chunk"), F.lit(False).alias("copied"))
    before = F.struct((F.col("_chunk") - 1).alias("chunk"), F.lit(True).alias("copied"))
    return (
        rows.join(borders, "subject_id", "left")
        .withColumn("_chunk", chunk_of(TIME_ORDER))
        .withColumn("_spot", F.explode(F.when(_opens(), F.array(here, before)).otherwise(F.array(here))))
        .withColumns({"_chunk": F.col("_spot.chunk"), "copied": F.col("_spot.copied")})
        .drop("_borders", "_steps", "_spot")
    )


def _chunks_of_pairs(pairs: DataFrame, recordings: DataFrame, borders: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs with the chunk of their earlier end (of the later if that one is not stored), and those whose later end does not come there, or None.

    Only ids and times of subjects with several chunks are looked up.
    """
    if borders is None:
        return pairs.withColumn("_chunk", F.lit(0)), None
    spots = (
        recordings.select("subject_id", *TIME_ORDER)
        .join(borders, "subject_id")
        .withColumn("_chunk", chunk_of(TIME_ORDER))
        .select("row_idx", "_chunk", _opens().alias("_opens"))
    )
    earlier = spots.select(F.col("row_idx").alias("idx_t"), F.col("_chunk").alias("_c0"))
    later = spots.select(F.col("row_idx").alias("idx_t1"), F.col("_chunk").alias("_c1"), "_opens")
    near = (F.col("_c0") == F.col("_c1")) | ((F.col("_c0") + 1 == F.col("_c1")) & F.col("_opens"))
    linked = pairs.join(earlier, "idx_t", "left").join(later, "idx_t1", "left")
    linked = store(
        linked.select(
            *pairs.columns, F.coalesce("_c0", "_c1", F.lit(0)).alias("_chunk"), F.coalesce(near, F.lit(True)).alias("_near")
        ),
        "pair-chunks",
    )
    far = linked.where("NOT _near").select(*pairs.columns)
    return linked.where("_near").drop("_near"), None if far.isEmpty() else far


def fetch_pairs_together(
    pairs: DataFrame, recordings: DataFrame, columns: Sequence[str], how: str = "inner", limit: int = CHUNK_ROWS
) -> DataFrame:
    """As `fetch_pairs`, with one shuffle of the cells.

    Cells and the ends that ask for them are dealt by the pairs' subject and chunk in one exchange; an end
    takes its cells from the row beside it, and the two ends of a pair meet inside the partition. Recordings
    of subjects without a pair are dropped first if the subjects are few enough to be broadcast.

    ``pairs`` has the subject of both its ends; recordings have unique ids. Repeated pairs stay repeated.
    Pairs that lead over more than a chunk border, which `build_pairs` never makes, are fetched by id.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how!r}")
    borders = _borders_of(recordings, limit)
    near, far = _chunks_of_pairs(pairs, recordings, borders)
    subjects = store(pairs.select("subject_id").distinct(), "pair-subjects")
    if subjects.count() <= MOST_BORDERS:
        recordings = recordings.join(F.broadcast(subjects), "subject_id", "left_semi")

    cells = _placed(
        recordings.select("subject_id", *TIME_ORDER, F.struct(*columns).alias("_cells")), borders
    ).select(*PLACE, "row_idx", F.lit(-1).alias("_end"), "_cells")
    ends = [F.struct(F.col(i).alias("row_idx"), F.lit(e).alias("_end")) for e, i in enumerate(["idx_t", "idx_t1"])]
    asking = near.select(*PLACE, F.struct(*pairs.columns).alias("_pair"), F.explode(F.array(*ends)).alias("_e"))
    asking = asking.select(*PLACE, "_e.row_idx", "_e._end", "_pair")
    dealt = cells.unionByName(asking, allowMissingColumns=True).repartition(*PLACE)

    by_row = Window.partitionBy(*PLACE, "row_idx").orderBy("_end")
    found = dealt.withColumn("_cells", F.first("_cells", ignorenulls=True).over(by_row)).where("_end >= 0")
    found = found.withColumns({"_t": F.col("_pair.idx_t"), "_t1": F.col("_pair.idx_t1")})
    by_pair = Window.partitionBy(*PLACE, "_t", "_t1")
    other = F.first(F.when(F.col("_end") == 1, F.col("_cells")), ignorenulls=True).over(by_pair)
    met = found.withColumn("_later", other).where("_end = 0")
    if how == "inner":
        met = met.where("_cells IS NOT NULL AND _later IS NOT NULL")
    result = met.select(
        "_pair.*",
        *[F.col(f"_cells.{c}").alias(f"{c}_t") for c in columns],
        *[F.col(f"_later.{c}").alias(f"{c}_t1") for c in columns],
    )
    return result if far is None else result.unionByName(fetch_pairs(far, recordings, columns, how))


def write_linked(recordings: DataFrame, table: str, buckets: int, path: str, limit: int = CHUNK_ROWS) -> None:
    """Store recordings so that pairs are read without a shuffle: bucketed by subject and chunk, each with the
    link to the next one (``idx_t1``, ``pair_type``) and the fold of its subject's pairs.

    Rows that open a chunk are stored a second time with the chunk before (``copied``). Recordings without a
    subject have no pairs and are left out. Cells move once.
    """
    rows = conform(recordings, RECORDINGS).where("subject_id IS NOT NULL")
    borders = _borders_of(rows, limit, ["row_idx", "fold"])
    placed = _placed(rows, borders).repartition(buckets, *PLACE)
    in_time = Window.partitionBy(*PLACE).orderBy(*ascending(TIME_ORDER))
    after = F.lead(F.struct("row_idx", F.col("ecg_no_within_stay").alias("seq"))).over(in_time)
    own_first = F.first("fold").over(in_time)
    first = own_first if borders is None else F.coalesce("_first.fold", own_first)
    linked = placed.withColumns({"_after": after, "pair_fold": first}).withColumns(
        {
            "idx_t1": F.when(~F.col("copied"), F.col("_after.row_idx")),
            "pair_type": F.when(
                ~F.col("copied") & F.col("_after.row_idx").isNotNull(),
                F.when(F.col("ecg_no_within_stay") < F.col("_after.seq"), WITHIN_STAY).otherwise(CROSS_STAY),
            ),
        }
    )
    (
        linked.select(*RECORDINGS.fieldNames(), "_chunk", *LINKED)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *PLACE)
        .sortBy(*PLACE, *TIME_ORDER)
        .saveAsTable(table)
    )


def read_linked_pairs(
    spark: SparkSession, table: str, columns: Sequence[str], split_name: str | None = None, pair_types: Sequence[str] = ()
) -> DataFrame:
    """Pairs (idx_t, idx_t1, subject_id, fold, pair_type) of a linked table with ``columns`` of both ends, as
    ``<name>_t`` and ``<name>_t1``, without a shuffle. ``split_name`` leaves other subjects' rows out early."""
    from .select import split

    rows = spark.table(table).withColumn("_cells", F.struct("row_idx", *[c for c in columns if c != "row_idx"]))
    rows = rows.select(*PLACE, *TIME_ORDER, "idx_t1", F.col("pair_fold").alias("fold"), "pair_type", "_cells")
    if split_name is not None:
        rows = split(rows, split_name)
    in_time = Window.partitionBy(*PLACE).orderBy(*ascending(TIME_ORDER))
    ends = rows.withColumn("_later", F.lead("_cells").over(in_time)).where("idx_t1 IS NOT NULL")
    if pair_types:
        ends = ends.where(F.col("pair_type").isin(list(pair_types)))
    return ends.select(
        F.col("row_idx").alias("idx_t"),
        "idx_t1",
        "subject_id",
        "fold",
        "pair_type",
        *[F.col(f"_cells.{c}").alias(f"{c}_t") for c in columns],
        *[F.col(f"_later.{c}").alias(f"{c}_t1") for c in columns],
    )
