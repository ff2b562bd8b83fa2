"""Repeated passages: Rabin-Karp hashes of every window of `width` words.

Each map task hashes all windows of its documents and counts them; of windows
with one hash it sends one on. A window goes to the bucket named by the least
hash of the three-word runs within it, so neighbours mostly share a bucket and
travel as runs. A bucket's task counts what all map tasks have sent. Repeated
windows become word intervals, which are joined to their documents again.

Windows around a run of three words that is very common would all go to one
bucket. Such runs are found beforehand in a sample of documents and broadcast,
and the windows named by one go to the bucket of their own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import blobs
from kinmatch.llm.common import bucket_keys, byte_lists, chunks, keyed, partitions, real_id, released
from kinmatch.llm.rolling import Slices, merged, slice_hashes, sliding_min, word_places

WIDTH = 35
RUN = 3
#: Windows that share their least run, from which on they are dealt out by their own hash.
HOT_WINDOWS = 50_000
BLOB_TYPES = {"k1": "int64", "k2": "int64", "doc": "int32", "start": "int32", "n": "int32", "hash": "uint64", "done": "uint8"}


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the number of words of each text."""
    text, starts, stops, counts = word_places(texts)
    return slice_hashes(text, starts, stops), counts


def window_hashes(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """doc, start, hash and bucket hash of every window of `width` words."""
    words, counts = word_hashes(texts)
    run = min(RUN, width)
    hashes = Slices(words).runs(width)
    least = sliding_min(Slices(words).runs(run), width - run + 1)[: len(hashes)]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    start = np.arange(len(words), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = np.flatnonzero(doc[: len(hashes)] == doc[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return doc[whole], start[whole].astype(np.int32), hashes[whole], least[whole]


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element: whether its hash occurs again, and whether it is the first of its hash."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    more = np.ones(len(order), bool)
    more[:-1] = new[1:]
    again, first = np.empty(len(order), bool), np.empty(len(order), bool)
    again[order], first[order] = ~(new & more), new
    return again, first


def hot_runs(docs: DataFrame, width: int, least: int = HOT_WINDOWS) -> np.ndarray:
    """Hashes of the runs that name the bucket of very many different windows."""

    def named(texts: list[bytes]) -> np.ndarray:
        _, _, hashes, run = window_hashes(texts, width)
        return run[repeated(hashes)[1]]

    return blobs.hot_hashes(docs, named, least)


def window_blobs(docs: DataFrame, width: int, hot_windows: int = HOT_WINDOWS, flush: int = 12 << 20) -> DataFrame:
    """For each bucket the windows that this task has; and the intervals that it has found itself, as runs without hashes."""
    spark = docs.sparkSession
    types, sql = blobs.schema(BLOB_TYPES)
    keys = bucket_keys(spark, partitions(spark))
    hot = spark.sparkContext.broadcast(hot_runs(docs, width, hot_windows))

    def send(parts, k1, k2):
        doc, start, hashes, least = map(np.concatenate, zip(*parts, strict=True))
        again, first = repeated(hashes)
        rows = []
        d, a, b = merged(doc[again], start[again], start[again] + width)
        if len(d):
            own1, own2, at = blobs.documents_of(d, k1, k2)
            rows.append((keys[int(k2[d[0]]) % len(keys)], own1, own2, at, a.astype("int32").tobytes(), (b - a).astype("int32").tobytes(), b"", b""))
        doc, start, hashes, least, done = doc[first], start[first], hashes[first], least[first], again[first]
        bucket = (np.where(blobs.among(least, hot.value), hashes, least) % np.uint64(len(keys))).astype(np.int32)
        order = np.argsort(bucket, kind="stable")  # within a bucket by document and start, as they came
        doc, start, hashes, done, bucket = doc[order], start[order], hashes[order], done[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(len(keys) + 1))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a == b:
                continue
            new = np.ones(b - a, bool)
            new[1:] = (doc[a + 1 : b] != doc[a : b - 1]) | (start[a + 1 : b] != start[a : b - 1] + 1)
            at = np.flatnonzero(new)
            own1, own2, own = blobs.documents_of(doc[a:b][at], k1, k2)
            rows.append((keys[k], own1, own2, own, start[a:b][at].tobytes(), np.diff(np.append(at, b - a)).astype("int32").tobytes(), hashes[a:b].tobytes(), done[a:b].astype("uint8").tobytes()))
        return blobs.batch(rows, types)

    @released
    def run(batches):
        parts, keys1, keys2, size, docs_so_far = [], [], [], 0, 0
        for batch in chunks(batches, 1 << 20):
            texts = byte_lists(batch.column("text"))
            doc, start, hashes, least = window_hashes(texts, width)
            parts.append((doc + docs_so_far, start, hashes, least))
            keys1.append(batch.column("k1").to_numpy())
            keys2.append(batch.column("k2").to_numpy())
            docs_so_far += len(texts)
            size += sum(map(len, texts))
            if size >= flush:
                yield send(parts, np.concatenate(keys1), np.concatenate(keys2))
                parts, keys1, keys2, size, docs_so_far = [], [], [], 0, 0
        if parts:
            yield send(parts, np.concatenate(keys1), np.concatenate(keys2))

    return docs.mapInArrow(run, sql)


def repeated_intervals(docs: DataFrame, width: int = WIDTH, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """k1, k2, start, stop: the words of a keyed document that repeated windows cover."""
    sent = window_blobs(docs, width, hot_windows).repartition(partitions(docs.sparkSession), "bucket")

    @released
    def count(batches):
        local, held = [], []
        for b in batches:
            alone = np.array([not x for x in b.column("hash").to_pylist()], bool)
            local.append(b.filter(pa.array(alone)))
            held.append(b.filter(pa.array(~alone)))
        own = blobs.arrays(local, BLOB_TYPES)
        if len(own["doc"]):
            yield blobs.interval_batch(own["doc"], own["start"], own["start"] + own["n"], own["k1"], own["k2"])
        a = blobs.arrays(held, BLOB_TYPES)
        again, _ = repeated(a["hash"])
        doc = np.repeat(a["doc"], a["n"])
        start = np.arange(len(doc), dtype=np.int64) + np.repeat(a["start"] - (np.cumsum(a["n"]) - a["n"]), a["n"])
        new = again & (a["done"] == 0)
        yield blobs.interval_batch(*merged(doc[new], start[new], start[new] + width), a["k1"], a["k2"])

    return sent.mapInArrow(count, blobs.INTERVALS_SQL)


def remove_repeated(docs: DataFrame, width: int = WIDTH, hot_windows: int = HOT_WINDOWS, keep: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with keep, kept (the words left, joined by a space) of every row.

    A null text has no words. Rows that repeat a document repeat its windows,
    so both lose them. Null ids are kept; other columns are ignored; no
    documents give no rows. hot_windows changes no result.
    """
    rows = keyed(docs)
    types = pa.schema([("k1", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    @released
    def cut(batches):
        for batch in chunks(batches, 8 << 20):
            out = []
            for k1, text, starts, stops in zip(batch.column("k1").to_pylist(), byte_lists(batch.column("text")), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True):
                words = text.split()
                kept = words
                if starts:
                    gone = blobs.covered(len(words), starts, stops)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(kept)
                out.append((k1, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if keep else None))
            yield blobs.batch(out, types)

    joined = blobs.with_intervals(rows, repeated_intervals(rows, width, hot_windows))
    done = joined.mapInArrow(cut, "k1 long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.select(real_id(), "n_words", "n_removed", "kept_sha256", *["kept"][: int(keep)])
