"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import row_positions
from .common import WORD, least_row, store

# Weights of the sources in code point order, repeating, and the most passes over a source.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3


def draw(*parts: Column | str | int) -> Column:
    """32 hex digits from the parts: the same in every run, task and SQL engine."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[F.coalesce(t, F.lit("null")) for t in texts]))


def low_bits(digits: Column) -> Column:
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, pos, source_size, target) for each source of `sizes` (source, size).

    Targets share the sum of all sizes by weight. None is above `max_passes` times its source's size:
    the excess is shared again by weight among the others until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    sources = store(row_positions(totals, [], ["source"], "pos").withColumn("weight", weight), "mix-sources")
    cap = max_passes * F.col("source_size")
    level, reached = 0.0, None
    while reached != level:  # one small job a round; each round caps at least one source more
        reached = level
        capped = cap / F.col("weight") < level
        left = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, cap).otherwise(0)).alias("spent"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if left["weights"]:
            level = (left["all"] - left["spent"]) / left["weights"]
    target = F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight"))
    return sources.select("source", "pos", "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: str, party: str, votes: str) -> DataFrame:
    """Adds `seats`: Sainte-Laguë in each group for the rounded sum of its votes.

    The divisor lies between sum / (seats + parties / 2) and sum / (seats - parties / 2), so a party's
    seats are known but for few; those go to the highest quotients votes / (2 k + 1), ties to the
    lower k and then the lower party. Only these few rows of a group meet in a window.
    """
    whole = Window.partitionBy(group)
    rows = parties.withColumn("_sum", F.sum(votes).over(whole)).withColumn("_half", F.count(F.lit(1)).over(whole) / 2)
    rows = rows.withColumn("_all", F.round("_sum").cast("long"))
    per_seat = F.when(F.col("_sum") > 0, F.col(votes) / F.col("_sum")).otherwise(0.0)
    rows = rows.withColumn("_least", F.greatest(F.lit(0), F.floor(per_seat * (F.col("_all") - F.col("_half")) - 0.5)).cast("long"))
    rows = rows.withColumn("_most", F.ceil(per_seat * (F.col("_all") + F.col("_half")) + 0.5).cast("long"))
    rows = rows.withColumn("_open", F.col("_all") - F.sum("_least").over(whole))
    quotients = rows.where("_most > _least").withColumn("k", F.explode(F.sequence("_least", F.col("_most") - 1)))
    order = [(F.col(votes) / (2 * F.col("k") + 1)).desc(), F.col("k"), F.col(party)]
    won = (
        quotients.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
        .where("_rank <= _open")
        .groupBy(group, party)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return rows.join(won, [group, party], "left").select(
        *parties.columns, (F.col("_least") + F.coalesce("_won", F.lit(0))).alias("seats")
    )


def mix_sources(
    docs: DataFrame,
    seed: int = 7,
    block_words: int = 64,
    shard_words: int = 131_072,
    weights=WEIGHTS,
    max_passes: int = MAX_PASSES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, digest, source, size, source_size, target, taken) for each row of `docs`; `digest` is the MD5 of the text.

    Documents are dealt to shards of about `shard_words` words by a keyed hash of id and text. In a shard
    the words of a source, documents in hash order, are cut into equal blocks of about `block_words`.
    Sainte-Laguë gives each source its number of blocks from its target's share of the shard. A source
    gets whole passes and, for the rest, the blocks that a seeded draw ranks first; `taken` counts the
    document's words in them. Never more than `max_passes` passes: a seat beyond stays empty.

    Null or empty texts have size 0 and take 0. A null source is a source, the last in order. Rows with
    equal id, source and text are interchangeable, so repeated rows and null ids leave the result
    defined. An empty table gives no rows.
    """
    sizes = docs.select(
        F.col(id_col).alias("id"),
        F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sizes = store(sizes, "mix-sizes")
    sources = store(source_targets(sizes, weights, max_passes), "mix-targets")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-words // shard_words))

    placed = (
        sizes.join(sources, sizes["source"].eqNullSafe(sources["source"]))
        .select("id", "digest", sizes["source"], "size", "source_size", "target", "pos", draw(seed, "doc", F.col("id"), F.col("digest")).alias("draw"))
        .withColumn("shard", low_bits(F.col("draw")) % shards)
    )
    parts = placed.groupBy("shard", "pos", "source_size", "target").agg(F.sum("size").alias("words")).where("words > 0")
    parts = parts.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long"))
    parts = apportion(
        parts.withColumn("votes", F.col("target") * F.col("blocks") / F.col("source_size")), "shard", "pos", "votes"
    )
    seats = F.least(F.col("seats"), max_passes * F.col("blocks"))
    parts = parts.select("shard", "pos", "words", "blocks", seats.alias("seats"))

    by_draw = Window.partitionBy("shard", "pos").orderBy("block_draw", "block")
    ranked = (
        parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("block_draw", draw(seed, "block", F.col("shard"), F.col("pos"), F.col("block")))
        .withColumn("rank", F.row_number().over(by_draw))
    )
    passes = F.floor(F.col("seats") / F.col("blocks")) + F.when(F.col("rank") <= F.col("seats") % F.col("blocks"), 1).otherwise(0)
    chosen = ranked.groupBy("shard", "pos", "words", "blocks").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("block", passes.cast("int").alias("passes")))), lambda b: b["passes"]).alias("passes")
    )

    in_order = Window.partitionBy("shard", "pos").orderBy("draw", F.col("id").asc_nulls_last(), "size", "digest")
    streamed = placed.withColumn("at", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    streamed = streamed.withColumn("at", F.coalesce("at", F.lit(0))).join(chosen, ["shard", "pos"], "left")
    taken = F.expr(
        """aggregate(
            sequence(((at + 1) * blocks - 1) div words, ((at + size) * blocks - 1) div words),
            0L,
            (sum, k) -> sum + get(passes, cast(k AS int)) *
                (least(at + size, (k + 1) * words div blocks) - greatest(at, k * words div blocks)))"""
    )
    return streamed.select(
        F.col("id").alias(id_col),
        "digest",
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"),
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", taken_col: str = "taken", **options) -> DataFrame:
    """The rows of `docs` that the mix takes words of, with `taken`; see `mix_sources`.

    Rows equal in id and text become one, the same in every run, with the sum of what is taken of them.
    A column named as `taken_col` is replaced.
    """
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, **options).where("taken > 0")
    mixed = mixed.groupBy(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).agg(F.sum("taken").alias("_taken"))
    columns = [c for c in docs.columns if c != taken_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        F.col(id_col).alias("_own"),
        F.md5(F.coalesce(text_col, F.lit(""))).alias("_key"),
    )
    rows = least_row(rows, "_own", "_key")
    met = rows.join(mixed, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")))
    return met.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], F.col("_taken").alias(taken_col))
