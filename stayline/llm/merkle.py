"""Merkle manifest of a dataset: one tree per group, a tree over the groups, and a proof for every row.

A node's place in its group is a number whose octal digits are columns. Grouping by all digits but the
last gathers a run of eight; leaving out the next digit gathers eight runs, each already a struct that
nests its children, and so on within blocks of bounded size. The digests of blocks are the nodes of a
further tier of blocks. Proofs come out of the nested structs from the root down, by a transform that
gives each child its siblings and an explode; blocks meet the path above them by grouping. Nothing is
joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import running_by_ranges
from .common import store

RUN = 8  # nodes whose digests are hashed together
RUN_BITS = 3
LEVELS = 3  # levels of a block: 8^3 nodes at most

NO_PATH = "array<struct<at:int,siblings:array<string>>>"


def field(value: Column) -> Column:
    """A value as text that cannot run into the next: its UTF-8 bytes, a colon, itself; null is `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and the siblings on its path give."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf

    def up(digest: Column, level: Column) -> Column:
        at, siblings = level["at"], level["siblings"]
        left = F.array_join(F.slice(siblings, F.lit(1), at), "")
        right = F.array_join(F.slice(siblings, at + 1, F.lit(RUN)), "")
        return F.sha2(F.concat(left, digest, right), 256)

    return F.aggregate(path, leaf, up)


def _roll_up(nodes: DataFrame) -> DataFrame:
    """(_g, _block, digest, children) of nodes (_g, _rank, digest, ...): the digits are grouped away one by one.

    A run is hashed unless it is the only node of its group: then it is the first run and has one child,
    as places are dense. All groupings keep the one partitioning by block.
    """
    payload = [c for c in nodes.columns if c not in ("_g", "_rank", "digest")]
    digits = [f"_d{j}" for j in range(LEVELS)]
    rolled = nodes.select(
        "_g",
        F.shiftright("_rank", RUN_BITS * LEVELS).alias("_block"),
        *[F.shiftright("_rank", RUN_BITS * j).bitwiseAND(RUN - 1).cast("int").alias(d) for j, d in enumerate(digits)],
        "digest",
        *payload,
    ).repartition("_g", "_block")
    for j, digit in enumerate(digits):
        child = F.struct(F.col(digit).alias("at"), "digest", *payload)
        above = ["_block", *digits[j + 1 :]]
        runs = rolled.groupBy("_g", *above).agg(F.sort_array(F.collect_list(child)).alias("children"))
        digests = F.transform("children", lambda c: c["digest"])
        alone = (F.size("children") == 1) & (sum((F.col(c) for c in above[1:]), F.col("_block")) == 0)
        rolled = runs.withColumn(
            "digest", F.when(alone, F.col("children")[0]["digest"]).otherwise(F.sha2(F.array_join(digests, ""), 256))
        )
        payload = ["children"]
    return rolled.select("_g", "_block", "digest", "children")


def _tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Stored blocks of the nodes, blocks of those blocks, and so on until every group has one block."""
    tiers = []
    while True:
        blocks = store(_roll_up(nodes), f"merkle-{name}{len(tiers)}")
        tiers.append(blocks)
        if not blocks.agg(F.max("_block")).first()[0]:
            return tiers
        nodes = blocks.select("_g", F.col("_block").alias("_rank"), "digest")


def _emit(blocks: DataFrame, tops: Sequence[str]) -> DataFrame:
    """Nodes (_g, _rank, digest, payload, path, *tops) of blocks (_g, _block, children, path, *tops), where path
    leads on from the block's digest."""
    rows = blocks.select("_g", F.col("_block").alias("_rank"), "children", "path", *tops)
    for j in reversed(range(LEVELS)):
        siblings = lambda c: F.transform(F.filter("children", lambda o: o["at"] != c["at"]), lambda o: o["digest"])
        own = F.transform("children", lambda c: F.struct(c.alias("node"), siblings(c).alias("siblings")))
        step = F.array(F.struct(F.col("_n.node.at").alias("at"), F.col("_n.siblings").alias("siblings")))
        alone = (F.col("_rank") == 0) & (F.col("_size") == 1)
        rows = (
            rows.select("_g", "_rank", "path", *tops, F.size("children").alias("_size"), F.explode(own).alias("_n"))
            .withColumn("path", F.when(alone, F.col("path")).otherwise(F.concat(step, "path")))
            .withColumn("_rank", F.shiftleft("_rank", RUN_BITS) + F.col("_n.node.at"))
            .select("_g", "_rank", "path", *tops, *(["_n.node.*"] if j == 0 else ["_n.node.children"]))
        )
    return rows.drop("at")


def _meet(blocks: DataFrame, paths: DataFrame, tops: Sequence[str]) -> DataFrame:
    """Blocks with the path of their digest: the two rows of a block meet by grouping."""
    key = ["_g", "_block"]
    both = blocks.select(*key, "children").unionByName(paths.select(*key, "path", *tops), allowMissingColumns=True)
    return both.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("children", "path", *tops)])


def prove_rows(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(order, group, leaf, subroot, root, path, *carry) for each row: its digest, and the path that proves it.

    A leaf is the SHA-256 of the row's columns, each as its UTF-8 length, a colon and the value, null as `-`.
    The leaves of a group are ordered by `order`, nulls last, then by digest; while a group has several nodes,
    every eight consecutive ones are hashed into one. What remains is the group's subroot. Subroots in
    order of the group's value (null first, by UTF-8 bytes) give the root in the same way. `path` holds
    for every level that was hashed, from the leaf to the root, the place in its run and the digests of the
    others. `carry` adds narrow columns of `docs`.

    Rows that are equal in all columns are leaves of their own. A null group is a group. Texts of any
    length are hashed where they are read; only digests move. An empty table gives an empty result.
    """
    carry = dict(carry or {})
    group_key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = docs.select(
        group_key.alias("_g"),
        F.col(order).alias("_id"),
        F.col(group).alias("_group"),
        row_digest([F.col(c) for c in columns]).alias("digest"),
        *[c.alias(f"_x_{n}") for n, c in carry.items()],
    )
    leaves = store(leaves, "merkle-leaves")  # ranges are sampled first: texts are read and hashed once
    one = F.lit(1).cast("long")
    tiers = _tiers(running_by_ranges(leaves, ["_g"], ["_id", "digest"], {"_rank": one}), "rows")

    subroots = tiers[-1].select(F.col("_g").alias("_of"), "digest")
    groups = running_by_ranges(subroots, [], ["_of"], {"_rank": one}).withColumn("_g", F.lit(""))
    top = _tiers(groups, "groups")
    paths = top[-1].select("_g", "_block", F.lit(None).cast(NO_PATH).alias("path"), F.col("digest").alias("root"))
    paths = paths.withColumn("path", F.coalesce("path", F.array().cast(NO_PATH)))
    for blocks in reversed(top):
        nodes = _emit(_meet(blocks, paths, ["root"]), ["root"])
        paths = nodes.select("_g", F.col("_rank").alias("_block"), "path", "root")
    tops = ["subroot", "root"]
    zero = F.lit(0).cast("long")
    paths = nodes.select(F.col("_of").alias("_g"), zero.alias("_block"), "path", F.col("digest").alias("subroot"), "root")
    for blocks in reversed(tiers):
        nodes = _emit(_meet(blocks, paths, tops), tops)
        paths = nodes.select("_g", F.col("_rank").alias("_block"), "path", *tops)
    return nodes.select(
        F.col("_id").alias(order),
        F.col("_group").alias(group),
        F.col("digest").alias("leaf"),
        *tops,
        "path",
        *[F.col(f"_x_{n}").alias(n) for n in carry],
    )
