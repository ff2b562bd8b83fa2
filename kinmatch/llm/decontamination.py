"""Benchmark decontamination by templates.

Texts become sequences of template words: numbers, units after numbers, and
names (capitals inside a sentence) give typed placeholders, any other word its
lower-case form without the marks around it. Windows of template words are
hash-joined with the benchmark's windows. Windows that match at one offset
between a document and an item form an alignment; its slots, the values behind
the placeholders, must map one to one from item to document, so that a question
with other numbers or names is found and one that merely looks alike is not.

Texts have three readings. The strict one is as above. The loose one takes
sentence-initial capitals for names too, and a run of names or numbers for one
placeholder. In the exact one every word stands for itself: it is for items too
short for a template or with too few words besides placeholders, and takes only
whole copies. In the other two a match may have words put in or left out: where
no offset covers enough, the words around a shared window are aligned, and runs
of BLOCK_WORDS equal words and more count.

1. The benchmark's windows become a table, with a key for each reading, width
   and hash. Of its keys a bitmap of fixed size is broadcast.
2. One pass over the documents gives the windows that the bitmap doesn't rule
   out. They meet the benchmark's in an equi-join, whose benchmark side is
   broadcast if its size allows; nothing of the benchmark is held whole by the
   driver or a task.
3. The texts of documents with a shared window, few of all, are read again and
   each is held against the items it shares windows with.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.llm.common import bounded_batches, broadcast_if_small, byte_lists, ByValue, checkpoint, chunks, keyed, real_id, released, with_keys
from kinmatch.llm.rolling import mix, slice_hashes, Slices, word_places

WIDTH = 8
#: The share of an item's template words that an alignment has to cover, and how many it takes at least.
COVER = 0.6
LEAST_WORDS = 5
#: Literal words that a window needs; placeholders alone say nothing.
LITERALS = 3
#: Equal words in a row that count in an alignment with words put in or left out.
BLOCK_WORDS = 4
#: Bits of the map of the benchmark's keys.
BITS = 1 << 25
#: Rows of a side that is broadcast, at most: of a few numbers each (windows, keys), and of a document's matches.
MOST_WINDOWS, MOST_FOUND = 200_000, 50_000
#: Words that a worker keeps, at most; then it begins anew.
CACHED_WORDS = 2_000_000

UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups"
    b" ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % degrees celsius fahrenheit k c f usd eur gbp dollar dollars euro euros cent cents $".split()
)
NUMBER = re.compile(rb"[-+]?[$]?[0-9][0-9.,:/]*%?\Z")
MARKS = b"!\"#&'()*,./:;<=>?@[\\]^_`{|}~"
STOPS = (b".", b"!", b"?", b":")

STRICT, LOOSE, EXACT = 0, 1, 2
WORD, NUM, UNIT, NAME = 0, 1, 2, 3
#: What stands for a placeholder among the words' hashes.
SLOT = np.array([0, 0x6E756D6265720001, 0x756E697400000002, 0x6E616D6500000003], np.uint64)
_ROW = np.dtype([("value", "<u8"), ("flags", "u1")])
_NUMBER, _UNIT, _CAPITAL, _STOP, _EMPTY, _MARK = 1, 2, 4, 8, 16, 32


def describe(word: bytes) -> bytes:
    """A word's hash without its marks, and what may be made of it."""
    import xxhash

    bare = word.strip(MARKS)
    text = bare.decode(errors="replace")
    low = text.lower().encode()
    flags = _NUMBER if NUMBER.match(bare) else 0
    flags |= _UNIT if low in UNITS else 0
    flags |= _CAPITAL if text[:1].isupper() else 0
    flags |= _STOP if word.endswith(STOPS) else 0
    flags |= 0 if bare else _EMPTY
    flags |= _MARK if word[-1:] in MARKS else 0
    return xxhash.xxh64_intdigest(low, 7).to_bytes(8, "little") + bytes([flags])


class Templates(ByValue):
    """Template words of texts. Broadcast, it keeps its words, by their hashes, from task to task of a worker."""

    def __init__(self, cached: int = CACHED_WORDS):
        self.cached = cached
        self._forget()

    def __getstate__(self) -> dict:
        return {"cached": self.cached}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, _ROW)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every word of all texts: its text, what may be made of it, and its hash."""
        text, starts, stops, counts = word_places(texts)
        codes, hashes = pd.factorize(slice_hashes(text, starts, stops))
        if len(self.hashes) + len(hashes) > self.cached:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        if len(new):
            one = np.zeros(len(hashes), np.int64)
            one[codes] = np.arange(len(codes))
            new = new[np.argsort(hashes[new])]
            told = np.frombuffer(b"".join([describe(text[a:b]) for a, b in zip(starts[one[new]].tolist(), stops[one[new]].tolist(), strict=True)]), _ROW)
            self.hashes, self.rows = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.rows, at[new], told)
            at = np.searchsorted(self.hashes, hashes)
        rows = self.rows[at][codes]
        return np.repeat(np.arange(len(texts)), counts), rows["flags"], rows["value"]

    @staticmethod
    def reading(doc: np.ndarray, flags: np.ndarray, value: np.ndarray, which: int = STRICT) -> tuple[np.ndarray, ...]:
        """For every template word of all texts: its text, its hash, its kind, its own value's hash, and its place among the words."""
        loose = which == LOOSE
        stop = (flags & _STOP) > 0
        begins = np.ones(len(doc), bool)  # a sentence
        begins[1:] = stop[:-1] | (doc[1:] != doc[:-1])
        number = (flags & _NUMBER) > 0
        follows = np.zeros(len(doc), bool)
        follows[1:] = number[:-1] & (doc[1:] == doc[:-1])
        kind = np.where(number, NUM, np.where(follows & ((flags & _UNIT) > 0), UNIT, np.where(((flags & _CAPITAL) > 0) & (~begins | loose), NAME, WORD)))
        if which == EXACT:
            kind = np.zeros(len(doc), np.int64)
        kept = (flags & _EMPTY) == 0
        doc, kind, value, marked, place = doc[kept], kind[kept], value[kept], (flags[kept] & _MARK) > 0, np.arange(int(kept.sum()))
        if loose and len(doc):
            goes_on = np.zeros(len(doc), bool)
            goes_on[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | (kind[1:] == NUM)) & (doc[1:] == doc[:-1]) & ~marked[:-1]
            first = np.flatnonzero(~goes_on)
            inside = place - first[np.cumsum(~goes_on) - 1]
            value = np.add.reduceat(mix(value + inside.astype(np.uint64)), first)
            doc, kind, place = doc[first], kind[first], place[first]
        return doc, np.where(kind == WORD, value, SLOT[kind]), kind, value, place


def window_width(size: int, width: int = WIDTH) -> int:
    """So wide that an item with one word changed still has a whole window."""
    return min(width, size, max(BLOCK_WORDS, (size - 1) // 2))


def key_of(reading: int, width: int, hashes: np.ndarray) -> np.ndarray:
    """What a window is joined by."""
    return mix(hashes + np.uint64(reading << 32 | width)).view(np.int64)


@dataclass
class Item:
    """An item of the benchmark in one reading; offsets of its windows."""

    reading: int
    width: int
    template: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray

def readings_of(text: bytes, width: int = WIDTH, cover: float = COVER) -> list[Item]:
    """An item's readings that can tell it: the strict and the loose one, or else the exact one; none if it has no word."""
    words = Templates().words([text])
    out, told = [], False
    for reading in (STRICT, LOOSE, EXACT):
        if reading == EXACT and told:
            break
        _, template, kind, value, _ = Templates.reading(*words, reading)
        n = len(template)
        if not n or reading != EXACT and n < LEAST_WORDS:
            continue
        w = min(width, n) if reading == EXACT else window_width(n, width)
        hashes = Slices(template).runs(w)
        at = np.arange(len(hashes)) if reading == EXACT else np.flatnonzero(enough(kind, w))
        if not len(at):
            continue
        out.append(Item(reading, w, template, kind, value, at, key_of(reading, w, hashes[at])))
        told |= reading == STRICT and int(covered_by(at, w, n).sum()) >= least_cover(n, cover)
    return out


def least_cover(n: int, cover: float) -> int:
    return max(LEAST_WORDS, math.ceil(cover * n))


def covered_by(offsets, width: int, n: int) -> np.ndarray:
    seen = np.zeros(n, bool)
    for q in offsets:
        seen[q : q + width] = True
    return seen


def enough(kind: np.ndarray, width: int) -> np.ndarray:
    """Whether each window has as many literal words as it needs."""
    sums = np.concatenate([[0], np.cumsum(kind == WORD)])
    return sums[width:] - sums[:-width] >= min(LITERALS, width)


def consistent(kind: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether the slots map one to one, within a kind."""
    slots = kind != WORD
    pairs = set(zip(kind[slots].tolist(), ours[slots].tolist(), theirs[slots].tolist(), strict=True))
    return len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})


def gapped(ours: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the words that an alignment in order covers."""
    runs = [b for b in SequenceMatcher(None, ours.tolist(), theirs.tolist(), autojunk=False).get_matching_blocks() if b.size >= BLOCK_WORDS]
    places = lambda starts: np.concatenate([np.arange(a, a + b.size) for a, b in zip(starts, runs, strict=True)]) if runs else np.zeros(0, np.int64)
    return places([b.a for b in runs]), places([b.b for b in runs])


def best_alignment(item: Item, hits: list[tuple[int, int]], read: tuple[np.ndarray, ...], cover: float) -> tuple | None:
    """(words covered, words of the item, where, slots, slots with the item's own values) of the best alignment of an item and a text.

    hits: (place in the text, offset in the item) of the windows they share.
    read: the text's template, kinds, values and places in the item's reading.
    """
    template, _, value, place = read
    size, best = len(item.template), None
    least = size if item.reading == EXACT else least_cover(size, cover)

    def take(theirs: np.ndarray, ours: np.ndarray) -> None:
        nonlocal best
        if not consistent(item.kind[theirs], item.value[theirs], value[ours]):
            return
        slots = item.kind[theirs] != WORD
        row = (len(theirs), size, int(place[ours[0]]), int(slots.sum()), int((item.value[theirs][slots] == value[ours][slots]).sum()))
        if best is None or (-row[0], row[2]) < (-best[0], best[2]):
            best = row

    lines: dict[int, list[int]] = defaultdict(list)
    for at, offset in hits:
        lines[at - offset].append(offset)
    for shift in sorted(lines):
        at = np.flatnonzero(covered_by(lines[shift], item.width, size))
        if len(at) >= least:
            take(at, shift + at)
    if best or item.reading == EXACT:
        return best
    slack, tried = max(WIDTH, size // 4), None
    for shift in sorted(lines):
        if tried is not None and shift <= tried:
            continue
        tried = shift + slack // 2
        low, high = max(0, shift - slack), min(len(template), shift + size + 2 * slack)
        ours, theirs = gapped(template[low:high], item.template)
        if len(theirs) >= least:
            take(theirs, low + ours)
    return best


MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType())] + [T.StructField(n, T.IntegerType()) for n in ("covered", "item_words", "at_word", "slots", "same_slots")]))
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.int32()) for n in ("covered", "item_words", "at_word", "slots", "same_slots"))]))


ITEM = pa.schema([("item", pa.int64()), ("reading", pa.int32()), ("width", pa.int32()), *((n, pa.binary()) for n in ("template", "kind", "value")), ("keys", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))])
ITEM_SQL = "item long, reading int, width int, template binary, kind binary, value binary, keys array<long>, offsets array<int>"


def item_table(benchmark: DataFrame, cover: float) -> tuple[DataFrame, DataFrame]:
    """Texts of items (item, a hash of the text, and its ids, one for each row), and their readings."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("text").agg(F.collect_list(F.struct("item_id")).alias("ids")).withColumn("item", F.xxhash64("text"))

    def run(batches):
        for batch in batches:
            rows = [(k, x) for k, t in zip(batch.column("item").to_pylist(), byte_lists(batch.column("text")), strict=True) for x in readings_of(t, cover=cover)]
            columns = [[k for k, _ in rows], [x.reading for _, x in rows], [x.width for _, x in rows], [x.template.tobytes() for _, x in rows], [x.kind.astype("u1").tobytes() for _, x in rows], [x.value.tobytes() for _, x in rows], [x.keys for _, x in rows], [x.offsets for _, x in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ITEM.types, strict=True)], schema=ITEM)

    return texts.select("item", "ids"), checkpoint(bounded_batches(texts).select("item", "text").mapInArrow(run, ITEM_SQL))


class Sieve(ByValue):
    """The benchmark's readings with their widths, and a bit for each of its keys: what a window needs to have a chance in the join."""

    def __init__(self, widths: list[tuple[int, int]], bits: np.ndarray):
        self.widths, self.bits = widths, bits

    def __call__(self, doc: np.ndarray, template: np.ndarray, reading: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and places of the windows within one text that may be the benchmark's."""
        out = []
        for width in [w for r, w in self.widths if r == reading and len(template) >= w]:
            keys = key_of(reading, width, Slices(template).runs(width))
            spot = keys & (BITS - 1)
            hit = np.flatnonzero((self.bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1))
            hit = hit[doc[hit] == doc[hit + width - 1]]
            out.append((keys[hit], hit))
        return out


def sieve_of(items: DataFrame) -> Sieve:
    widths = sorted({(r[0], r[1]) for r in items.select("reading", "width").distinct().collect()})  # three readings of WIDTH widths at most
    spot = items.select(F.explode("keys").alias("k")).select(F.col("k").bitwiseAND(F.lit(BITS - 1)).alias("spot"))
    words = spot.groupBy(F.shiftright("spot", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("b")).toArrow()  # BITS / 64 rows at most
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return Sieve(widths, bits)


def shared_windows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """k1, k2, item, reading and hits (at, offset): the windows that keyed documents and items share."""
    sc = rows.sparkSession.sparkContext
    sieve, templates = sc.broadcast(sieve_of(items)), sc.broadcast(Templates())
    types = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])

    @released
    def run(batches):
        readings = sorted({r for r, _ in sieve.value.widths})
        for batch in chunks(batches, 1 << 20):
            words = templates.value.words(byte_lists(batch.column("text")))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for reading in readings:
                doc, template, *_ = Templates.reading(*words, reading)
                begins = np.searchsorted(doc, np.arange(batch.num_rows))
                for keys, at in sieve.value(doc, template, reading):
                    own = doc[at]
                    yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(keys), pa.array((at - begins[own]).astype(np.int32))], schema=types)

    met = rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, key long, at int")
    theirs = items.select("item", "reading", F.explode(F.arrays_zip("keys", "offsets")).alias("w")).select("item", "reading", F.col("w.keys").alias("key"), F.col("w.offsets").alias("offset"))
    hits = met.join(broadcast_if_small(theirs, MOST_WINDOWS), "key")
    return hits.groupBy("k1", "k2", "item", "reading").agg(F.collect_set(F.struct("at", "offset")).alias("hits"))


CANDIDATE = ("item", "reading", "width", "template", "kind", "value", "hits", "ids")


def matches_of(rows: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """k1, k2 and matches of the keyed documents that have any; documents that agree in both keys once."""
    texts, items = item_table(benchmark, cover)
    hits = shared_windows(rows, items).join(items.drop("keys", "offsets"), ["item", "reading"]).join(texts, "item")
    wanted = checkpoint(hits.groupBy("k1", "k2").agg(F.collect_list(F.struct(*CANDIDATE)).alias("candidates")))
    # only keys are broadcast; the texts that they leave are few, as the candidates are
    again = rows.select("k1", "k2", "text").join(broadcast_if_small(wanted.select("k1", "k2"), MOST_WINDOWS), ["k1", "k2"], "left_semi").join(wanted, ["k1", "k2"])
    templates = rows.sparkSession.sparkContext.broadcast(Templates())
    names = [f.name for f in MATCH.elementType.fields]

    @released
    def run(batches):
        for batch in chunks(batches, 2 << 20):
            words = templates.value.words(byte_lists(batch.column("text")))
            reads: dict[int, tuple] = {}
            found = []
            for d, candidates in enumerate(batch.column("candidates").to_pylist()):
                best: dict[tuple, tuple] = {}
                for c in sorted(candidates, key=lambda c: c["reading"]):
                    if c["item"] in best:
                        continue
                    reading = c["reading"]
                    if reading not in reads:
                        doc, *rest = Templates.reading(*words, reading)
                        reads[reading] = np.searchsorted(doc, np.arange(batch.num_rows + 1)), rest
                    edges, rest = reads[reading]
                    own = tuple(x[edges[d] : edges[d + 1]] for x in rest)
                    own = (*own[:3], own[3] - own[3][:1])
                    item = Item(reading, c["width"], np.frombuffer(c["template"], np.uint64), np.frombuffer(c["kind"], "u1"), np.frombuffer(c["value"], np.uint64), np.zeros(0), np.zeros(0))
                    row = best_alignment(item, [(h["at"], h["offset"]) for h in c["hits"]], own, cover)
                    if row:
                        best[c["item"]] = [(x["item_id"], *row) for x in c["ids"]]
                found.append([dict(zip(names, m, strict=True)) for m in sorted(itertools.chain(*best.values()), key=lambda m: (m[0] is None, m))])
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(found, _MATCH)], names=["k1", "k2", "matches"])

    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("matches", MATCH)])
    return checkpoint(again.mapInArrow(run, schema).where(F.size("matches") > 0).dropDuplicates(["k1", "k2"]))


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str = "matches", cover: float = COVER) -> DataFrame:
    """docs with an array of the benchmark items found in each text, empty if there are none.

    Null and empty texts, and items without a word, match nothing; items of
    fewer than LEAST_WORDS template words, and those with too few literal words
    for a template, match where all their words stand one after another. Rows
    are kept as they come, other columns too, whatever their names; a column of
    the array's name is replaced. Rows that repeat a document have the same
    matches; equal items are each found, ordered by id, null last. Of several
    alignments of an item the one that covers most counts, of those the first.
    Without items or documents nothing is found. Numbers are digits; those
    spelled out are words like any other.
    """
    docs = docs.drop(column)
    rows, keys = with_keys(docs)
    found = matches_of(keyed(docs), benchmark, cover).select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), F.col("matches").alias(column))
    return rows.join(broadcast_if_small(found, MOST_FOUND), keys, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(f"`{column}`"), F.array().cast(MATCH)).alias(column))


def without_matches(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, in with_matches' terms; all columns stay as they are."""
    rows, keys = with_keys(docs)
    found = matches_of(keyed(docs), benchmark, cover).select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]))
    return rows.join(broadcast_if_small(found, MOST_FOUND), keys, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, covered, item_words, at_word, slots, same_slots.

    In with_matches' terms. A row that repeats a document gives its rows again.
    """
    rows = keyed(docs)
    found = matches_of(rows, benchmark, cover)
    both = rows.select("k1", "k2").join(broadcast_if_small(found, MOST_FOUND), ["k1", "k2"])
    return both.select(real_id(), F.explode("matches").alias("m")).select("doc_id", "m.*")
