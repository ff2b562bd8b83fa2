"""Near-duplicates by SimHash fingerprints, found in BK-trees.

Fingerprints within the radius of each other agree in at least one of
(radius + 1) bit blocks, so each distinct fingerprint goes to one shard per
block, named by the block's value. A shard with many fingerprints is split by
the blocks of the other bits in the same way, and what is still large again:
those within the radius agree in one of these too. A shard's task builds a BK-tree: a node's
children are keyed by their Hamming distance to it, and a search follows only
the edges within the radius of the searched distance. A tree goes no further
than the task that built it, for its size grows with the data; broadcasting
all trees would not be bounded.

A shard gives the links that join its fingerprints to groups, never all pairs
of a group. Groups are then joined across shards by alternating star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import byte_lists, checkpoint, chunks, keyed, others, partitions, real_id, released, tidy

SEED = 42
BITS = 64
#: Fingerprints of a shard, from which on it is split by a further block; and how often, at most.
SPLIT_FROM, SPLITS = 20_000, 2


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of every run of `width` words; of all words if there are fewer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit that more than half of the hashes have."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 32_768):
        part = np.ascontiguousarray(hashes[at : at + 32_768]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """k1, k2 and fp, the fingerprint as a signed long, of every row of keyed documents."""
    types = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("fp", pa.int64())])

    @released
    def run(batches):
        for batch in chunks(batches, 8 << 20):
            fps = [signed(fingerprint(shingle_hashes(t, width))) for t in byte_lists(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(fps, pa.int64())], schema=types)

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, fp long")


class BKTree:
    """Values under their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while at < len(self.values):
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                break
            at = nxt
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """The indexes of all values within the radius."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = children[at]
            if len(edges) <= 2 * radius + 1:
                todo += [c for k, c in edges.items() if d - radius <= k <= d + radius]
            else:
                todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join to one group what the radius joins, no more than one less than the values."""
    tree, links, root = BKTree(), [], list(range(len(values)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, v in enumerate(values):
        for other in tree.within(v, radius):
            if (a := top(k)) != (b := top(other)):
                root[a] = b
                links.append((v, values[other]))
        tree.add(v)
    return links


def sub_blocks(bits: list[int], n: int) -> list[list[int]]:
    """The bits in n blocks of about the same size."""
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def _value(bits: list[int]) -> Column:
    """A hash of the fingerprint's values at these bits."""
    spans = [(int(g[0]), int(g[-1]) + 1) for g in np.split(np.array(bits), np.flatnonzero(np.diff(bits) > 1) + 1)]
    return F.xxhash64(*[F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in spans])


def shards_of(fps: DataFrame, radius: int, split_from: int) -> DataFrame:
    """fp and shard: the shards that each distinct fingerprint in column fp is in."""
    n, empty = radius + 1, F.array().cast("array<struct<path:int,shard:bigint>>")
    entry = lambda path, shard: F.struct(F.lit(path).cast("int").alias("path"), shard.alias("shard"))
    blocks = dict(enumerate(sub_blocks(list(range(BITS)), n)))  # by path: the bits that the shard's members agree in last
    rest = {k: [b for b in range(BITS) if b not in block] for k, block in blocks.items()}
    rows = fps.select("fp", F.explode(F.array(*[entry(k, F.xxhash64(F.lit(k), _value(bits))) for k, bits in blocks.items()])).alias("s")).select("fp", "s.*")
    done = None
    for _ in range(SPLITS):
        large = checkpoint(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > split_from).select("shard"))
        if not large.take(1):
            break
        few = rows.join(large, "shard", "left_anti").select("fp", "shard")
        done = few if done is None else done.union(few)
        parts, left = empty, {}
        for path, bits in rest.items():
            cut = sub_blocks(bits, n)
            own = F.array(*[entry(path * n + k, F.xxhash64("shard", F.lit(k), _value(block))) for k, block in enumerate(cut)])
            parts = F.when(F.col("path") == path, own).otherwise(parts)
            left |= {path * n + k: [b for b in bits if b not in block] for k, block in enumerate(cut)}
        rest = left
        rows = rows.join(large, "shard").select("fp", F.explode(parts).alias("s")).select("fp", "s.*")
    rows = rows.select("fp", "shard")
    return rows if done is None else done.union(rows)


def fingerprint_links(fps: DataFrame, radius: int = 3, split_from: int = SPLIT_FROM) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp, enough to join each group. split_from changes no group."""
    spark = fps.sparkSession
    shards = shards_of(fps, radius, split_from).repartition(partitions(spark), "shard").sortWithinPartitions("shard", "fp")
    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @released
    def search(batches):
        shard, held, out = None, [], []
        for batch in batches:
            for s, v in zip(batch.column("shard").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if s != shard:
                    out += shard_links(held, radius) if len(held) > 1 else []
                    shard, held = s, []
                held.append(v & (2**64 - 1))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([signed(p[k]) for p in out], pa.int64()) for k in (0, 1)], schema=types)
                out = []
        out += shard_links(held, radius) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([signed(p[k]) for p in out], pa.int64()) for k in (0, 1)], schema=types)

    return shards.mapInArrow(search, "a long, b long")


def star_components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every end of a link; root is the least node that it reaches.

    Alternates large-star and small-star steps, each two grouped shuffles of
    the links left, until they no longer change.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    told = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        del both, least, large, small
        tidy(edges.sparkSession)
        if now == told:
            break
        told = now
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def components(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """k1, k2, fp and component, the least k1 that links reach, of every row of keyed documents."""
    rows = checkpoint(fingerprints(docs, width))
    fps = rows.groupBy("fp").agg(F.min("k1").alias("least"))
    roots = star_components(fingerprint_links(fps.select("fp"), radius))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(rooted.join(named, "root").select("fp", "root", "component"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least doc_id that links reach, null ids aside (null if
    there is no other). Null and empty texts have fingerprint zero and are
    linked like any other; equal rows get equal results; other columns are
    ignored and no documents give no rows.
    """
    found = components(keyed(docs), radius, width)
    return found.select(real_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id("component").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """docs with one row of each component: the least doc_id, null last, and of those the least hash of the text.

    Of rows that agree in both one stays, whichever. Columns stay as they are;
    a null text becomes empty.
    """
    rows = keyed(docs, others(docs))
    first = components(rows, radius, width).groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("f")).select("f.k1", "f.k2")
    kept = rows.join(first.distinct().hint("shuffle_hash"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
