"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip, then exact overlaps."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import chain
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ordered import running
from .common import WORD, least_row, store
from .components import components
from .words import arrow_schema, batch_of, in_shards, plain_words, trimmed

NGRAM = 4
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Shared shingles of the prefixes that a candidate needs: so many, and one more for each so many of the set.
SHARED, SHARED_EACH = 4, 50
#: Inverted lists above this are long: their shingles come last in the common order.
LONG_LIST = 64
#: Long shingles that tasks are told of at most. It only changes the order of shingles, so the cost, not the result.
MOST_LONG = 1 << 20
#: What one verifying task holds from either side: shingles, each set counting at least so many.
BLOCK_SHINGLES, SET_COST = 200_000, 400
#: Bits of the place of an id in the bit field that spares texts the way to a join they have no part in.
PLACE_BITS = 24

GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, remembered while they are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    out = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        out = out * GOLDEN + h[i : i + len(out)]
    return scramble(out)


def shingle_sets(words: list[list[bytes]], hashes: WordHashes, ngram: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; the whole sequence if it is shorter."""
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words))).astype(np.uint64)
    full, out, at = rolled(h, ngram), [], 0
    for w in words:
        n = len(w)
        if n < ngram:
            out.append(rolled(h[at : at + n], n) if n else h[:0])
        else:
            s = np.sort(full[at : at + n - ngram + 1])
            fresh = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        at += n
    return out


def set_key(shingles: np.ndarray) -> int:
    """Equal sets, and only they, share this positive number (63 bits of a hash of the whole set)."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def at_least(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def needed(n: int, percent: int) -> int:
    """Shared prefix shingles of linked sets: that of the smaller set; never more for a smaller set."""
    return min(SHARED + n // SHARED_EACH, at_least(n, percent))


def prefix_length(n: int, percent: int) -> int:
    """In any common order, linked sets share `needed` shingles within their first so many."""
    return n - at_least(n, percent) + needed(n, percent)


DOCS_AND_COUNTS = "id {id}, digest string, key long, n int, hash long, count int"


def set_reader(schema: pa.Schema, ngram: int, shard_words: int):
    """Rows (id, key, n) of documents, and rows (hash, count) of shingles in several sets of a shard."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows, words in in_shards(batches, 1, plain_words, shard_words):
            out, sets = [], {}
            for row, s in zip(rows, shingle_sets(words, hashes, ngram)):
                key = set_key(s) if len(s) else None
                out.append((row[0], row[2], key, len(s), None, None))
                sets[key] = s
            once, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            often = count > 1
            shared = zip(once[often].view(np.int64).tolist(), count[often].tolist())
            yield batch_of(out + [(None, None, None, None, h, c) for h, c in shared], schema)

    return run


def prefix_reader(schema: pa.Schema, ngram: int, shard_words: int, percent: int, long: np.ndarray):
    """(hash, key, n) for the first shingles of each set: by hash, the long ones behind all others."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, words in in_shards(batches, 0, plain_words, shard_words):
            seen, columns = set(), ([], [], [])
            for s in shingle_sets(words, hashes, ngram):
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                at = np.minimum(np.searchsorted(long, s), max(len(long) - 1, 0))
                late = long[at] == s if len(long) else np.zeros(len(s), bool)
                first = np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)]
                columns[0].append(first.view(np.int64))
                columns[1].append(np.full(len(first), key, np.int64))
                columns[2].append(np.full(len(first), len(s), np.int32))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], schema=schema)

    return run


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Members of at least `least` of the sorted lists, with how many: short lists merge in a heap, long ones are probed.

    A member of `least` lists is in `least` - L of the others when L lists are set aside. The longest
    lists are set aside and probed by binary search for those members only.
    """
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    aside = min(least - 1, int(least / (0.01 * np.log2(longest + 2) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found: dict[int, int] = {}
    last, count = None, 0
    for member in heapq.merge(*short):
        if member == last:
            count += 1
        else:
            if last is not None and count >= least - aside:
                found[last] = count
            last, count = member, 1
    if last is not None and count >= least - aside:
        found[last] = count
    for member in found:
        for of in long:
            at = bisect_left(of, member)
            found[member] += at < len(of) and of[at] == member
    return {m: c for m, c in found.items() if c >= least}


def candidate_finder(schema: pa.Schema, percent: int):
    """Candidates of each set (key, n, long, lists): shared short lists, less what long lists may add, reach the need."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            of_query, members = lists.offsets.to_numpy(), lists.values
            of_list, entries = members.offsets.to_numpy().tolist(), members.values
            other, size, others_long = (entries.field(i).to_numpy() for i in range(3))
            out = []
            for q, (key, n, long) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                a, b = of_query[q], of_query[q + 1]
                merged = [other[of_list[i] : of_list[i + 1]].tolist() for i in range(a, b)]
                least = max(1, min(needed(n, percent), needed(at_least(n, percent), percent)) - long)
                found = divide_skip(merged, least) if len(merged) >= least else {}
                if found:
                    span = slice(of_list[a], of_list[b])
                    about = dict(zip(other[span].tolist(), zip(size[span].tolist(), others_long[span].tolist())))
                    for m, shared in found.items():
                        if shared >= max(1, min(needed(n, percent), needed(about[m][0], percent)) - min(long, about[m][1])):
                            out.append((key, m))
            yield batch_of(out, schema)

    return run


def id_filter(bits: np.ndarray):
    """Rows (number, ...) whose number's bit is set; the number goes."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.int64)
            on = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(on.astype(bool))).drop_columns([batch.schema.names[0]])

    return run


def overlap_links(keys: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int, across: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with `across`, of the links between side 0 and side 1."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    distinct, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    often = np.bincount(column, minlength=len(distinct))
    renumber = np.cumsum(often > 1) - 1
    used = often[column] > 1
    row, column = row[used], renumber[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap, width = np.zeros((m, m), np.float32), 4096
    for start in range(0, int(renumber[-1]) + 1 if len(renumber) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((m, width), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        overlap += part @ part.T
    shared = overlap.astype(np.int64)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if across:
        linked &= side[:, None] != side[None, :]
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((keys[i], keys[j]))
    return out


def verifier(percent: int, schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys, own = group["key"].to_pylist(), np.array(group["own"].to_pylist(), np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        across = len(np.unique(own)) > 1
        return pa.Table.from_batches([batch_of(overlap_links(keys, sets, own, percent, across), schema)])

    return run


def holder_sets(schema: pa.Schema, ngram: int, shard_words: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows, words in in_shards(batches, 1, plain_words, shard_words):
            out = {}
            for row, s in zip(rows, shingle_sets(words, hashes, ngram)):
                if len(s) and set_key(s) == row[2]:
                    out[row[2]] = (row[2], row[3], len(s), int(s[0] >> np.uint64(1)), s.tobytes())
            yield batch_of(out.values(), schema)

    return run


def jaccard_components(
    docs: DataFrame,
    ngram: int = NGRAM,
    percent: int = PERCENT,
    long_list: int = LONG_LIST,
    shard_words: int = 1 << 19,
    block: int = BLOCK_SHINGLES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, digest, n_shingles, component, component_id) for each row of `docs`.

    component_id is the least id reachable by links, `component` a number of its own for each component
    (null for texts without words), `digest` the MD5 of the text.

    Words are runs without ASCII white space, A-Z lower-cased. A set holds the distinct n-word
    shingles, as 64-bit hashes; fewer words are one shingle. Two texts link when 100 * intersection >=
    percent * union. Equal sets are one class and take part once.

    1. Shingles are ordered by hash, those that are often repeated within a shard behind all others. Linked
       sets then share `needed` shingles within short prefixes; only these go into the inverted lists.
    2. DivideSkip merges a set's short lists and keeps those that occur often enough. Long lists are not
       merged: a set with so many of them in its prefix that it needs no others is tied to the shingles themselves.
    3. Pairs and ties are verified by exact overlaps: the sets of a component lie in blocks of about `block`
       shingles, and blocks that share a pair or tie meet. They return a spanning forest of their links only.
    4. Components of the links give the result.

    Null and empty texts have no shingles and link with nothing: component_id is their own id. Rows with
    equal ids are rows of their own, linked if their texts are. A null id is never the least unless all of
    its component are null. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def ddl_of(ddl: str) -> tuple[str, pa.Schema]:
        ddl = ddl.format(id=id_type)
        return ddl, arrow_schema(ddl)

    ddl, schema = ddl_of(DOCS_AND_COUNTS)
    digested = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    read = store(digested.mapInArrow(set_reader(schema, ngram, shard_words), ddl), "join-sets")
    members = read.where("hash IS NULL").select("id", "digest", "key", "n")
    often = read.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("count").alias("count")).where(F.col("count") > long_list // 4)
    known = often.orderBy(F.desc("count"), "hash").limit(MOST_LONG).select("hash").toArrow()["hash"].to_numpy()
    long = np.sort(known.astype(np.int64).view(np.uint64))

    ddl, schema = ddl_of("hash long, key long, n int")
    prefixes = rows.select("text").mapInArrow(prefix_reader(schema, ngram, shard_words, percent, long), ddl)
    by_hash = Window.partitionBy("hash")
    postings = prefixes.repartition("hash").groupBy("hash", "key").agg(F.max("n").alias("n"))
    postings = store(postings.withColumn("length", F.count(F.lit(1)).over(by_hash)).where("length > 1"), "join-postings")

    in_long = postings.where(F.col("length") > long_list)
    long_of = in_long.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("long"))
    short = postings.where(F.col("length") <= long_list).join(long_of, "key", "left").fillna(0, ["long"])
    lists = short.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("key", "n", "long"))).alias("list"))
    # only sets of a size that can link; a pair is met once, at its lower key
    fits = f"m -> 100 * m.n >= {percent} * n AND 100 * n >= {percent} * m.n"
    queries = (
        lists.select(F.posexplode("list").alias("at", "query"), "list")
        .select("query.*", F.expr("slice(list, at + 2, size(list))").alias("rest"))
        .withColumn("rest", F.expr(f"filter(rest, {fits})"))
        .where("size(rest) > 0")
        .groupBy("key", "n", "long")
        .agg(F.collect_list("rest").alias("lists"))
    )
    ddl, schema = ddl_of("a long, b long")
    pairs = store(queries.mapInArrow(candidate_finder(schema, percent), ddl), "join-pairs")
    # tied are sets that may share long shingles only with a set of the least size in reach
    smallest = F.ceil(percent * F.col("n") / 100)
    need = F.least(SHARED + F.floor(smallest / SHARED_EACH), F.ceil(percent * smallest / 100))
    ties = (
        in_long.select("key", "hash", "n").join(long_of, "key").where(F.col("long") >= need).select(F.col("key").alias("a"), (-F.shiftrightunsigned("hash", 1) - 1).alias("b"))
    )
    ties = store(ties, "join-ties")
    groups = components(pairs.unionAll(ties)).where("node >= 0").select(F.col("node").alias("key"), F.col("root").alias("part"))
    groups = store(groups, "join-groups")

    # a set whose ids are all null is found by its digest
    holder = F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("holder")
    holders = members.join(groups, "key").groupBy("key", "part").agg(holder).select("holder.id", "holder.digest", "key", "part")
    holders = store(holders, "join-holders")
    place = F.shiftrightunsigned(F.xxhash64("id", "digest"), 64 - PLACE_BITS)
    set_bits = holders.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    marked = set_bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (PLACE_BITS - 6), np.uint64)
    bits[marked["word"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    near = digested.select(place.alias("place"), "id", "digest", "text").mapInArrow(id_filter(bits), f"id {id_type}, digest string, text string")
    ddl, schema = ddl_of("key long, part long, n int, low long, shingles binary")
    same = near["id"].eqNullSafe(holders["id"]) & (near["digest"] == holders["digest"])
    texts = near.join(holders, same).select(near["id"], "text", "key", "part")
    sets = store(texts.mapInArrow(holder_sets(schema, ngram, shard_words), ddl).dropDuplicates(["key"]), "join-group-sets")
    links = _verified(sets, pairs, ties, percent, block, arrow_schema("a long, b long"))
    roots = components(links).select(F.col("node").alias("key"), "root")
    classes = members.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
    classes = classes.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = classes.join(least, "root").select("key", "root", "component_id")
    return members.join(of_class, "key", "left").select(
        F.col("id").alias(id_col),
        "digest",
        F.col("n").cast("long").alias("n_shingles"),
        F.col("root").alias("component"),
        F.coalesce(F.when(F.col("key").isNotNull(), F.col("component_id")), F.col("id")).alias("component_id"),
    )


def _verified(sets: DataFrame, pairs: DataFrame, ties: DataFrame, percent: int, block: int, schema: pa.Schema) -> DataFrame:
    """Links (a, b). Sets of a part lie in blocks in the order of their least hash, which near copies mostly share;
    blocks meet that hold the two ends of a pair, or sets tied to the same long shingle and of a size in reach."""
    placed = running(
        sets.select("key", "part", "low", "n"), ["part"], ["low", "key"], {"before": F.greatest("n", F.lit(SET_COST)).cast("long")}
    )
    placed = store(placed.select("key", "part", "n", F.floor(F.col("before") / block).cast("int").alias("own")), "join-blocks")
    ends = [placed.select(F.col("key").alias(k), "part", F.col("own").alias(f"own_{k}")) for k in ("a", "b")]
    met = pairs.join(ends[0], "a").join(ends[1].drop("part"), "b")
    met = met.select("part", F.least("own_a", "own_b").alias("first"), F.greatest("own_a", "own_b").alias("second"))

    tied = ties.join(placed, ties["a"] == placed["key"]).groupBy("b", "part", "own")
    tied = tied.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = tied.alias("l"), tied.alias("r")
    reach = (F.col("l.b") == F.col("r.b")) & (F.col("l.own") <= F.col("r.own"))
    in_reach = (percent * F.col("r.low") <= 100 * F.col("l.high")) & (percent * F.col("l.low") <= 100 * F.col("r.high"))
    tied = left.join(right, reach & in_reach).select(
        F.col("l.part").alias("part"), F.col("l.own").alias("first"), F.col("r.own").alias("second")
    )
    met = met.unionAll(tied).distinct()
    by_block = met.select("part", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("own"))
    dealt = placed.select("key", "part", "own").join(by_block, ["part", "own"])
    dealt = dealt.join(sets.select("key", "shingles"), "key").select("part", "first", "second", "own", "key", "shingles")
    return dealt.groupBy("part", "first", "second").applyInArrow(verifier(percent, schema), "a long, b long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` less those that link, directly or through others, to a row that stays.

    Of each component the row with the least id stays, nulls last; of equal ids the one with the least
    text digest; of rows equal in both the one with the least digest of all columns. Texts without words link with nothing and stay.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "digest")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("first"))
    stay = first.select(F.col("first.id").alias("_id"), F.col("first.digest").alias("_digest"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_own"),
        F.md5(F.coalesce(text_col, F.lit(""))).alias("_key"),
        F.rlike(F.coalesce(text_col, F.lit("")), F.lit(WORD)).alias("_words"),
    )
    kept = rows.where("_words").join(stay, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")), "left_semi")
    kept = least_row(kept, "_own", "_key").select("_row").unionAll(rows.where("NOT _words").select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
