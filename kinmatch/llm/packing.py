"""Best-fit packing of token sequences, by vectors of capacities.

A bin (one training sequence) has three capacities: tokens, documents, and
attention cost (the sum of squared piece lengths). A piece asks for
(length, 1, length squared). Pieces are placed longest first; among the bins
that have room in every dimension the piece goes to the one with the best
score: the least weighted norm of what is left (`rule="norm"`) or the greatest
weighted dot product of request and room (`rule="dot"`).

A piece's request depends on its length alone, so the choice is made for whole
classes at once: all pieces of one length against all open bins with the same
room. There are at most `max_tokens` lengths, whatever the corpus, so the plan
is made on the driver from a histogram. Then every piece finds its place by
its length and its rank among the pieces of that length, in an equi-join.
"""

from __future__ import annotations

import itertools
import math
import os
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import bounded_batches, byte_lists, ByValue, checkpoint, chunks, partitions, released
from kinmatch.llm.rolling import slice_hashes, spans, word_places

END_ID = 1
#: Pieces whose ids a worker keeps, at most; then it begins anew.
KEPT_PIECES = 2_000_000
#: Pieces encoded at once, and bytes of text worked on at once, which takes about 30 times as much memory.
AT_ONCE, CHUNK = 4096, 1 << 20


def _bytes(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_PLAIN = _bytes(b"0123456789abcdefghijklmnopqrstuvwxyz")
_MARK = _bytes(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _two_byte_letters() -> np.ndarray:
    """By its two bytes, whether a Latin character is a letter and its lower case one letter too (not so with a dotted capital I)."""
    out = np.zeros(1 << 16, bool)
    for c in map(chr, range(0xC0, 0x180)):
        low = c.lower()
        if len(low) == 1 and unicodedata.category(low).startswith("L") and unicodedata.normalize("NFC", low) == low:
            out[int.from_bytes(c.encode(), "big")] = True
    return out


_LATIN = _two_byte_letters()
#: Places that one row of the plan stands for, at most.
RUN_OF_PLACES = 1 << 16


def piece_lengths(n: int, most: int) -> list[int]:
    return [most] * (n // most) + ([n % most] if n % most else [])


class WordIds(ByValue):
    """Texts' token ids as little-endian 32-bit bytes.

    The tokenizer lowers case, never joins what white space parts, and splits
    letters or digits from marks that follow. So texts are cut into words, and
    ASCII marks at the end of words, in numpy, the latter where an ASCII or Latin
    letter or a digit stands before them; each different piece is encoded once
    and its ids kept under its 64-bit hash. A text that may hold a special
    token is encoded whole. Broadcast, it keeps its pieces from task to task of
    a worker.
    """

    def __init__(self, model: str, kept: int = KEPT_PIECES):
        self.model, self.kept, self.tokenizer = model, kept, None
        self._forget()

    def __getstate__(self) -> dict:
        return {"model": self.model, "kept": self.kept}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _forget(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.model)
        out = []
        for k in range(0, len(texts), AT_ONCE):  # an encoding holds far more than its ids
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
        return out

    def _places(self, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, raw: bytes) -> np.ndarray:
        """Where the ids of pieces, all different, are kept; unknown pieces are encoded first."""
        if len(self.hashes) + len(hashes) > self.kept:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        new = new[np.argsort(hashes[new])]
        if len(new):
            ids = self._encode([raw[a:b].decode() for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            size = np.array([len(x) for x in ids])
            before = len(self.pool)
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))])
            self.first, self.size = (np.insert(x, at[new], y) for x, y in ((self.first, before + np.cumsum(size) - size), (self.size, size)))
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            at = np.searchsorted(self.hashes, hashes)
        return at

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        whole = {k: np.array(self._encode([t.decode()])[0], np.uint32).tobytes() for k, t in enumerate(texts) if b"<|" in t}
        lowered = [b"" if k in whole else t.lower() for k, t in enumerate(texts)]
        text, starts, stops, _ = word_places(lowered)
        raw = np.frombuffer(text, np.uint8)
        # the end of a word without its marks, where that is a letter or a digit
        last = np.maximum.accumulate(np.where(_MARK[raw], -1, np.arange(len(raw))))
        ends = last[stops - 1] + 1
        plain = _PLAIN[raw[ends - 1]] | _LATIN[raw[np.maximum(ends - 2, 0)].astype(np.int64) << 8 | raw[ends - 1]]
        parted = (ends > starts) & (ends < stops) & plain
        a = np.concatenate([starts, ends[parted]])
        b = np.concatenate([np.where(parted, ends, stops), stops[parted]])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        codes, hashes = pd.factorize(slice_hashes(text, a, b))
        one = np.zeros(len(hashes), np.int64)
        one[codes] = np.arange(len(codes))
        at = self._places(hashes, a[one], b[one], text)[codes]
        size = self.size[at]
        ids = self.pool[spans(self.first[at], size)]
        places = np.concatenate([[0], np.cumsum(size)])
        edges = np.cumsum([1, *(len(t) + 1 for t in lowered)])  # where each text begins
        cuts = (4 * places[np.searchsorted(a, edges)]).tolist()
        out = memoryview(ids.tobytes())
        return [whole[k] if k in whole else bytes(out[x:y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def cut_pieces(docs: DataFrame, model: str, max_tokens: int = 4096, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents, end id included, in pieces of max_tokens at most."""
    ids_of = docs.sparkSession.sparkContext.broadcast(WordIds(model))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    types = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    @released
    def cut(batches):
        for batch in chunks(batches, CHUNK):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of.value(byte_lists(batch.column("text"))), strict=True):
                ids, start = ids + end, 0
                for k, n in enumerate(piece_lengths(len(ids) // 4, max_tokens)):
                    rows.append((doc, k, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def plan_bins(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "norm") -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Records (length, first rank, pieces, first bin, offset) and the number of bins.

    The pieces of `length` with ranks from the first rank on go to as many
    bins in a row, each at that offset.
    """
    room, weights = np.array(capacity, float), np.array(weights, float)
    states = np.zeros((64, 3), np.int64)  # what is left in the bins of a state; zero if no bin is in it
    ranges: list[list[tuple[int, int]]] = []  # (first bin, bins)
    row_of: dict[tuple[int, int, int], int] = {}
    unused: list[int] = []
    records: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(state: tuple[int, int, int], first: int, n: int) -> None:
        nonlocal states
        row = row_of.get(state)
        if row is None:
            row = unused.pop() if unused else len(ranges)
            if row == len(ranges):
                ranges.append([])
                if row == len(states):
                    states = np.concatenate([states, np.zeros_like(states)])
            row_of[state], states[row], ranges[row] = row, state, []
        ranges[row].append((first, n))

    for length in sorted(counts, reverse=True):
        asked = (length, 1, length * length)
        each = min(c // a for c, a in zip(capacity, asked, strict=True))
        if not each:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        left, rank, wants = counts[length], 0, np.array(asked)
        while left:
            fits = np.flatnonzero((states[: len(ranges)] >= wants).all(1))
            if not len(fits):
                new = math.ceil(left / each)
                put(tuple(capacity), bins, new)
                bins += new
                continue
            have = states[fits]
            score = (((have - wants) / room) ** 2 * weights).sum(1) if rule == "norm" else -((have / room) * (wants / room) * weights).sum(1)
            for row in fits[np.argsort(score, kind="stable")].tolist():
                state, taken = tuple(states[row].tolist()), ranges[row]
                del row_of[state]
                states[row], ranges[row] = 0, []
                unused.append(row)
                after = tuple(x - a for x, a in zip(state, asked, strict=True))
                kept = []
                for first, n in taken:
                    use = min(n, left)
                    if use:
                        records.append((length, rank, use, first, capacity[0] - state[0]))
                        if all(after):
                            put(after, first, use)
                        rank, left = rank + use, left - use
                    if use < n:
                        kept.append((first + use, n - use))
                for first, n in kept:
                    put(state, first, n)
                if not left:
                    break
    return records, bins


def in_runs(records: np.ndarray, most: int = RUN_OF_PLACES) -> np.ndarray:
    """The records of plan_bins cut so that none has more than `most` pieces, for a class may have any number."""
    parts = -(-records[:, 2] // most)
    out = np.repeat(records, parts, axis=0)
    at = (np.arange(len(out)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    out[:, 1] += at
    out[:, 3] += at
    out[:, 2] = np.minimum(out[:, 2] - at, most)
    return out


def ranked_by_length(pieces: DataFrame, rows_each: int = 20_000) -> DataFrame:
    """Adds rank, from 0 among the pieces of a length; a common length is dealt out by salt."""
    salts = max(1, math.ceil(pieces.count() / rows_each))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, model: str, max_tokens: int = 4096, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    model: the tokenizer file's content. A null text is empty and takes one
    token, the end id. Null ids are kept, repeated rows are packed each by
    itself, other columns are ignored; no documents give no rows. The limits
    on documents and cost default to what max_tokens allows anyhow, since either
    would make more sequences. A document of more than max_tokens is cut; which
    of equally long pieces is placed first depends on doc_id, piece and crc.
    """
    spark = docs.sparkSession
    pieces = checkpoint(cut_pieces(docs, model, max_tokens))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_tokens rows at most
    records, _ = plan_bins(counts, (max_tokens, max_documents or max_tokens, max_cost or max_tokens**2), weights, rule)
    columns = in_runs(np.array(records, "int64").reshape(-1, 5)).T
    plan = spark.createDataFrame(pa.table(dict(zip(("length", "first", "n", "bin", "offset"), map(pa.array, columns), strict=True)))).repartition(partitions(spark))
    places = plan.select("length", "first", "bin", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    places = places.select("length", (F.col("first") + F.col("k")).alias("rank"), (F.col("bin") + F.col("k")).alias("sequence_id"), "offset")
    return ranked_by_length(pieces).join(places, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
