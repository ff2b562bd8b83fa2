"""Rows that carry whole numpy arrays to a bucket, and intervals brought back to their documents.

A map task sends to every bucket one row with all that it has for it, so the
shuffle moves a few compact rows, not one per window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import byte_lists, chunks, released

INTERVALS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
INTERVALS_SQL = "k1 long, k2 long, start long, stop long"


def schema(names: Iterable[str]) -> tuple[pa.Schema, str]:
    names = list(names)
    return pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names)]), ", ".join(["bucket int", *(f"{n} binary" for n in names)])


def batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types.types, strict=True)], schema=types)


def documents_of(doc: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Only the keys that occur, and each row's index among them."""
    used, at = np.unique(doc, return_inverse=True)
    return k1[used].tobytes(), k2[used].tobytes(), at.astype(np.int32).tobytes()


def arrays(batches: Iterator[pa.RecordBatch], types: dict[str, str]) -> dict[str, np.ndarray]:
    """All rows of a partition joined; "doc" counts on over the rows' key arrays k1 and k2."""
    parts: dict[str, list[np.ndarray]] = {n: [] for n in types}
    docs = 0
    for b in batches:
        columns = {n: b.column(n).to_pylist() for n in types}
        for k in range(b.num_rows):
            for n, t in types.items():
                x = np.frombuffer(columns[n][k] or b"", t)
                parts[n].append(x + docs if n == "doc" else x)
            docs += len(parts["k1"][-1])
    return {n: np.concatenate(x) if x else np.zeros(0, types[n]) for n, x in parts.items()}


def same_documents(a: dict[str, np.ndarray]) -> None:
    """Let "doc" be the place of its key in the order of all keys (k1, then k2)."""
    if not len(a["k1"]):
        return
    order = np.lexsort((a["k2"], a["k1"]))
    k1, k2 = a["k1"][order], a["k2"][order]
    new = np.ones(len(order), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    a["doc"], a["k1"], a["k2"] = place[a["doc"]], k1[new], k2[new]


def interval_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (k1[doc], k2[doc], start, stop)], schema=INTERVALS)


def hot_hashes(docs: DataFrame, hashes_of: Callable[[list[bytes]], np.ndarray], least: int, most: int = 100_000, rows: int = 5_000) -> np.ndarray:
    """Hashes, in order, that about `least` or more of what all keyed documents give have, and no more than `most` of them.

    Estimated from about `rows` documents, chosen by a hash, and from so many
    of a large corpus that eight of what is hot are among them. The result only
    decides which task does what, so an estimate is enough.
    """
    share = min(1.0, max(rows / max(1, docs.count()), 8 / least))
    types = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    @released
    def run(batches):
        for batch in chunks(batches, 1 << 20):
            h, c = np.unique(hashes_of(byte_lists(batch.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], schema=types)

    chosen = docs.select("k1", "k2", "text").where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    counts = chosen.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    found = counts.where(F.col("c") >= max(2.0, least * share)).orderBy(F.desc("c"), "h").limit(most).toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def with_intervals(docs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Keyed docs with the arrays starts and stops of their intervals, null if there are none."""
    found = intervals.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("cut"))
    # hashing a partition's intervals spares the sort of its texts
    return docs.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").select(*docs.columns, F.col("cut.start").alias("starts"), F.col("cut.stop").alias("stops"))


def covered(n: int, starts: list[int] | None, stops: list[int] | None) -> np.ndarray:
    """Which of n places lie in an interval."""
    step = np.zeros(n + 1, np.int32)
    if starts:
        np.add.at(step, np.array(starts), 1)
        np.add.at(step, np.array(stops), -1)
    return np.cumsum(step[:n]) > 0
