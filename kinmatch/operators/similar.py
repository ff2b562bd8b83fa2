"""Records whose sets of hashes have a Jaccard similarity of 0.8 at least, without loss.

Equal sets are one node. In any one order of the hashes two similar sets share
one of their first n - ceil(0.8 n) + 1 (prefix filter), so only these meet in a
join. Hashes that many records of a sample have come last, so that large groups
of near copies don't all meet; the sample changes the order, not the result.
Pairs that meet are dropped where sizes, the place of the shared hash, or
bitmaps show that too little can be shared: each bit that only one set has
stands for a hash, at least, that the other lacks. What is left is compared on
the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.sources.tables import checkpoint

#: A similarity of 4 / 5 at least; the code below has it as 9 * shared >= 4 * (n1 + n2).
LEAST = (4, 5)
WORDS = 32
#: Records in the sample, about, and hashes that are put last, at most.
SAMPLE, MOST = 4096, 1 << 16
#: So many ids are sent to the records, and not the records to them, at most.
FEW = 1 << 18
#: Sets of the pool that are compared together.
TOGETHER = 64


def _bitmap(own: np.ndarray) -> np.ndarray:
    """64 * WORDS bits, of which each hash sets one."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(own.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * WORDS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def frequent(records: DataFrame, hashed: Callable[[DataFrame], DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that many records of a sample have, in their order, and how many have each."""
    every = max(1, records.count() // SAMPLE)
    own = hashed(records.where(F.pmod(F.xxhash64("entity_id"), F.lit(every)) == 0)).select(F.explode(F.array_distinct("own")).alias("h"))
    found = own.groupBy("h").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(MOST).toArrow().sort_by("h")
    return found["h"].to_numpy(), found["c"].to_numpy()


def signatures(records: DataFrame, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """entity_id, node (the set's hash), n, prefix and bits of every record of entity_id and own. last: hashes with what they are ordered by; others come before them."""
    types = pa.schema([("entity_id", pa.string()), ("node", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def ordered(x: np.ndarray) -> np.ndarray:
        if not len(last[0]):
            return x
        at = np.minimum(np.searchsorted(last[0], x), len(last[0]) - 1)
        return x[np.argsort(np.where(last[0][at] == x, last[1][at], 0), kind="stable")]

    def run(batches):
        for batch in batches:
            nodes, sizes, prefix, bits = [], [], [], []
            for own in batch.column("own"):
                x = np.unique(own.values.to_numpy())
                nodes.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(x))
                prefix.append(ordered(x)[: len(x) - -(-LEAST[0] * len(x) // LEAST[1]) + 1])
                bits.append(_bitmap(x))
            yield pa.RecordBatch.from_arrays([batch.column("entity_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefix, types.field("prefix").type), pa.array(bits, types.field("bits").type)], schema=types)

    return records.select("entity_id", "own").mapInArrow(run, "entity_id string, node long, n int, prefix array<long>, bits array<long>")


def _lone(x: str, y: str) -> Column:
    """How many bits x has and y lacks."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)


def _met(nodes: DataFrame) -> DataFrame:
    """a, b of nodes of the first side and of the pool (which a and b tell) that may be similar enough."""
    post = nodes.select("node", "n", "a", "b", F.posexplode("prefix").alias("at", "h"))
    side = lambda x: post.where(x).select("h", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}"))
    enough = lambda most: 9 * most >= 4 * (F.col("n_a") + F.col("n_b"))
    met = side("a").join(side("b"), "h").where(enough(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")))).select("a", "b").distinct()
    bits = lambda x: nodes.where(x).select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = met.join(bits("a"), "a").join(bits("b"), "b")
    return both.where(enough(F.least(F.col("n_a") - _lone("bits_a", "bits_b"), F.col("n_b") - _lone("bits_b", "bits_a")))).select("a", "b")


def _together(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """b, g and piece, one each, and g, piece, a and bs (its b's there), so that a set is sent once to each g and piece and not once for each pair.

    Those b with the same least a are together, TOGETHER to a piece, about.
    """
    least = met.groupBy("b").agg(F.min("a").alias("g"))
    many = least.groupBy("g").agg(F.ceil(F.count("*") / TOGETHER).alias("n"))
    place = checkpoint(least.join(many, "g").select("b", "g", F.pmod(F.xxhash64("b"), F.col("n")).alias("piece")))
    return place, met.join(place, "b").groupBy("g", "piece", "a").agg(F.collect_list("b").alias("bs"))


def owners(records: DataFrame, first: Column, hashed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """s1_id, cand_id: each pool record that is similar to a record of the first side (where `first` holds), with the least of these.

    records: entity_id, of which each names one record, and what `hashed` makes
    own of: the hashes of a record's set, in any order, one at least.
    """
    made = checkpoint(signatures(hashed(records), frequent(records, hashed)))
    groups = made.groupBy("node").agg(F.min("entity_id").alias("entity_id"), F.min(F.when(first, F.col("entity_id"))).alias("s1_id"), F.max((~first).cast("int")).alias("pool"))
    nodes = made.join(groups.select("entity_id", F.col("s1_id").isNotNull().alias("a"), (F.col("pool") == 1).alias("b")), "entity_id")
    met = checkpoint(_met(nodes))
    apart = met.where("a <> b")
    wanted = checkpoint(apart.select(F.col("a").alias("node")).union(apart.select("b")).distinct().join(groups.select("node", "entity_id"), "node"))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted  # then no text is sent
    sets = hashed(records.join(wanted, "entity_id")).select("node", F.array_distinct("own").alias("own"))
    side = lambda x: sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}"))
    place, lists = _together(apart)
    both = F.size(F.array_intersect("own_a", "own_b"))
    close = F.array_contains("bs", F.col("b")) & (9 * both >= 4 * (F.size("own_a") + F.size("own_b")))
    links = lists.join(side("a"), "a").join(place.join(side("b"), "b"), ["g", "piece"]).where(close).select("a", "b")
    links = links.union(met.where("a = b"))
    least = links.join(groups.select(F.col("node").alias("a"), "s1_id"), "a").groupBy("b").agg(F.min("s1_id").alias("s1_id"))
    return made.where(~first).select(F.col("entity_id").alias("cand_id"), F.col("node").alias("b")).join(least, "b").select("s1_id", "cand_id")
