"""Removal of byte strings that occur earlier, decided by suffix arrays.

A window is `width` bytes of one document. Windows that are equal hold the
same 16-byte runs, so the run with the least hash, the window's anchor, is the
same too and stands at the same place in it. If that is in the first half, the
window reaches far behind the anchor, else far before it; so many bytes (half
the width less the anchor, and the anchor) are the window's core. Neighbouring
windows mostly share anchor and half, so core; together they are a context,
the bytes from the first window's start to the last one's end, and every
window is in exactly one context.

1. Each map task finds its documents' contexts. Contexts that are equal are
   sent on once, by the earliest; the windows of the others start earlier too.
2. Contexts meet by their core's hash. Equal ones are again counted once.
   Where the contexts left with a core differ, their windows may still be
   equal in part: these contexts' bytes are fetched from their documents.
3. Such contexts, again dealt out by core, are put in a suffix array with
   common-prefix values by external induced sorting (`induced.py`); the core,
   which they share, is one symbol there. Suffixes at window starts with a
   window's symbols in common are equal windows; all but the earliest go.

So equal contexts are told by two 64-bit hashes together, and windows of
different contexts by the suffix arrays.

A core that more than `most_contexts` different contexts share, as those about
a line that very many documents have, would make one task's work. Such cores
are found beforehand in a sample of documents; their contexts meet by their own
hash in step 2, and in step 3 their windows are dealt out in place of contexts,
each by two 64-bit hashes, of which a task sends each once. Cores that the
sample misses are dealt out so from step 3 on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import blobs
from kinmatch.llm.common import bucket_keys, byte_lists, chunks, keyed, others, partitions, real_id, released
from kinmatch.llm.induced import LIMIT, suffix_array
from kinmatch.llm.rolling import BYTE_SYMBOLS, Slices, merged, mix, sliding_min, spans

WIDTH = 100
RUN = 16
MOST_CONTEXTS = 50_000
#: Bytes whose windows are hashed at once; more would not fit a processor's cache.
SEGMENT = 1 << 19
#: Between contexts in one text; UTF-8 has no such byte.
GAP = 255
#: A second symbol for each byte value, for hashes that owe nothing to the first.
SECOND_SYMBOLS = mix(BYTE_SYMBOLS ^ np.uint64(0xA0761D6478BD642F))

SENT = {"k1": "int64", "k2": "int64", "doc": "int32", "start": "int32", "n": "int32", "at": "uint16", "core": "uint64", "context": "uint64"}
FETCHED = {"k1": "int64", "k2": "int64", "doc": "int32", "start": "int32", "n": "int32", "at": "uint16", "core": "uint64", "bytes": "uint8"}


def core_size(width: int) -> int:
    run = min(RUN, width)
    return (width - run) // 2 + run


def segments(texts: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """(text, from, windows): each text's windows, long texts in parts."""
    return [(k, at, min(SEGMENT, len(t) - width + 1 - at)) for k, t in enumerate(texts) for at in range(0, len(t) - width + 1, SEGMENT)]


def contexts(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """doc, start, windows, where in it its core is, the core's hash and its own, of every context."""
    run = min(RUN, width)
    half = (width - run) // 2
    found, group, size = [], [], 0
    parts = segments(texts, width)
    for k, part in enumerate(parts):
        group.append(part)
        size += part[2] + width
        if size < SEGMENT and k + 1 < len(parts):
            continue
        raw = np.frombuffer(b"".join([texts[d][at : at + n + width - 1] for d, at, n in group]), np.uint8)
        docs, ats, counts = (np.array(x, np.int64) for x in zip(*group, strict=True))
        first = np.cumsum(counts + width - 1) - (counts + width - 1)
        slices = Slices(BYTE_SYMBOLS[raw])
        grams = slices.runs(run)
        low = np.uint64((1 << len(grams).bit_length()) - 1)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - run + 1)
        starts = spans(first, counts)
        anchor = (least[starts] & low).astype(np.int64)
        behind = anchor - starts <= half
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (behind[1:] != behind[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(starts)))
        a = starts[at]
        of = np.searchsorted(first, a, "right") - 1
        whole = slices(a, a + n + width - 1) ^ mix((anchor[at] - a).astype(np.uint64) * np.uint64(1 << 32) + n.astype(np.uint64))
        begin = np.where(behind[at], anchor[at], anchor[at] - half)
        core = slices(begin, begin + half + run) ^ mix(behind[at].astype(np.uint64) + np.uint64(1))
        found.append((docs[of], a - first[of] + ats[of], n, begin - a, core, whole))
        group, size = [], 0
    if not found:
        return tuple(np.zeros(0, t) for t in ("int64", "int64", "int64", "int64", "uint64", "uint64"))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def once(place: np.ndarray, start: np.ndarray, core: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts but for those that equal an earlier one, and those that do.

    A context that only a repeated row of the document has again is in neither.
    """
    order = np.lexsort((start, place, context, core))
    a, c = core[order], context[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return order[new], order[(place[order] != place[lead]) | (start[order] != start[lead])]


def place_of(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return place


def hot_cores(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """Cores that very many different contexts share."""

    def named(texts: list[bytes]) -> np.ndarray:
        *_, core, context = contexts(texts, width)
        return core[np.unique(core ^ context, return_index=True)[1]]

    return blobs.hot_hashes(docs, named, least)


def context_blobs(docs: DataFrame, width: int, hot, flush: int = 16 << 20) -> DataFrame:
    """To each bucket this task's contexts; and what this task has found itself, as intervals without hashes. hot: broadcast hot cores."""
    types, sql = blobs.schema(SENT)
    keys = bucket_keys(docs.sparkSession, partitions(docs.sparkSession))

    def send(parts, k1, k2):
        doc, start, n, at_core, core, context = map(np.concatenate, zip(*parts, strict=True))
        kept, gone = once(place_of(k1, k2)[doc], start, core, context)
        rows = []
        d, a, b = merged(doc[gone], start[gone], start[gone] + n[gone] + width - 1)
        if len(d):
            own1, own2, at = blobs.documents_of(d, k1, k2)
            rows.append((keys[int(k2[d[0]]) % len(keys)], own1, own2, at, a.astype("int32").tobytes(), (b - a).astype("int32").tobytes(), b"", b"", b""))
        named = np.where(blobs.among(core[kept], hot.value), context[kept], core[kept])
        bucket = (mix(named) % np.uint64(len(keys))).astype(np.int32)
        kept = kept[np.lexsort((start[kept], doc[kept], bucket))]
        edges = np.searchsorted(np.sort(bucket), np.arange(len(keys) + 1))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                x = kept[a:b]
                rows.append((keys[k], *blobs.documents_of(doc[x], k1, k2), start[x].astype("int32").tobytes(), n[x].astype("int32").tobytes(), at_core[x].astype("uint16").tobytes(), core[x].tobytes(), context[x].tobytes()))
        return blobs.batch(rows, types)

    @released
    def run(batches):
        parts, keys1, keys2, size, before = [], [], [], 0, 0
        for batch in chunks(batches, 2 << 20):
            texts = byte_lists(batch.column("text"))
            doc, *rest = contexts(texts, width)
            parts.append((doc + before, *rest))
            keys1.append(batch.column("k1").to_numpy())
            keys2.append(batch.column("k2").to_numpy())
            before += len(texts)
            size += sum(map(len, texts))
            if size >= flush:
                yield send(parts, np.concatenate(keys1), np.concatenate(keys2))
                parts, keys1, keys2, size, before = [], [], [], 0, 0
        if parts:
            yield send(parts, np.concatenate(keys1), np.concatenate(keys2))

    return docs.select("k1", "k2", "text").mapInArrow(run, sql)


MET = pa.schema([*blobs.INTERVALS, ("at", pa.int32()), ("core", pa.int64()), ("hot", pa.bool_())])
MET_SQL = blobs.INTERVALS_SQL + ", at int, core long, hot boolean"


def meet(sent: DataFrame, width: int, most_contexts: int, hot_cores) -> DataFrame:
    """Intervals that are decided (core null), and contexts whose bytes are needed (start, stop, at, core, hot)."""

    def rows(a, which, start, stop, at=None, core=None, hot=None):
        columns = [pa.array(x.astype(np.int64)) for x in (a["k1"][which], a["k2"][which], start, stop)]
        if core is None:
            return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(start), MET.field(n).type) for n in ("at", "core", "hot"))], schema=MET)
        return pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(hot)], schema=MET)

    @released
    def run(batches):
        local, held = [], []
        for b in batches:
            alone = np.array([not x for x in b.column("core").to_pylist()], bool)
            local.append(b.filter(pa.array(alone)))
            held.append(b.filter(pa.array(~alone)))
        own = blobs.arrays(local, SENT)
        yield rows(own, own["doc"], own["start"], own["start"].astype(np.int64) + own["n"])
        a = blobs.arrays(held, SENT)
        blobs.same_documents(a)
        kept, gone = once(a["doc"], a["start"], a["core"], a["context"])
        doc, start, stop = merged(a["doc"][gone], a["start"][gone], a["start"][gone].astype(np.int64) + a["n"][gone] + width - 1)
        yield rows(a, doc, start, stop)
        core = a["core"][kept]
        new = np.ones(len(kept), bool)
        new[1:] = core[1:] != core[:-1]
        count = np.diff(np.append(np.flatnonzero(new), len(kept)))[np.cumsum(new) - 1] if len(kept) else np.zeros(0, np.int64)
        known = blobs.among(core, hot_cores.value)
        wanted = known | (count > 1)
        x = kept[wanted]
        yield rows(a, a["doc"][x], a["start"][x], a["start"][x].astype(np.int64) + a["n"][x] + width - 1, a["at"][x], a["core"][x], (known | (count > most_contexts))[wanted])

    return sent.mapInArrow(run, MET_SQL)


def fetch(docs: DataFrame, needed: DataFrame, width: int, flush: int = 16 << 20) -> DataFrame:
    """The bytes of the needed contexts, to buckets by core; of hot cores each window's hashes, to buckets by the first."""
    types, sql = blobs.schema(FETCHED)
    keys = bucket_keys(docs.sparkSession, partitions(docs.sparkSession))
    names = ("start", "stop", "at", "core", "hot")
    wanted = needed.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("w"))
    # all columns, so that the final join can read the same shuffle files
    joined = docs.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select(*docs.columns, *[F.col(f"w.{c}").alias(c) for c in names])

    def send(found, hot, k1, k2):
        rows: dict[int, list] = {}
        for item in found:
            rows.setdefault(item[4] % len(keys), []).append(item)
        out = []
        k1, k2 = np.array(k1), np.array(k2)
        for k, items in rows.items():
            doc, start, n, at, core, parts = zip(*items, strict=True)
            columns = [np.array(x, t).tobytes() for x, t in ((start, "int32"), (n, "int32"), (at, "uint16"), (core, "uint64"))]
            out.append((keys[k], *blobs.documents_of(np.array(doc), k1, k2), *columns, b"".join(parts)))
        return blobs.batch(out + (send_windows(hot, k1, k2) if hot else []), types)

    def send_windows(hot, k1, k2):
        """Rows of windows by their hashes (no `at`), and of the intervals of those that this task has earlier (no `core`)."""
        doc, start, first, second = map(np.concatenate, zip(*hot, strict=True))
        kept, gone = once(place_of(k1, k2)[doc], start, first, second)
        d, a, b = merged(doc[gone], start[gone], start[gone] + width)
        out = []
        if len(d):
            out.append((keys[int(k2[d[0]]) % len(keys)], *blobs.documents_of(d, k1, k2), a.astype("int32").tobytes(), (b - a).astype("int32").tobytes(), b"", b"", b""))
        bucket = (first[kept] % np.uint64(len(keys))).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        kept, bucket = kept[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(len(keys) + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            x = kept[edges[k] : edges[k + 1]]
            out.append((keys[k], *blobs.documents_of(doc[x], k1, k2), start[x].astype("int32").tobytes(), b"", b"", first[x].tobytes(), second[x].tobytes()))
        return out

    @released
    def run(batches):
        found, windows, k1, k2, size = [], [], [], [], 0
        for batch in chunks(batches, 8 << 20):
            columns = [batch.column(c).to_pylist() for c in ("k1", "k2", *names)]
            for text, a, b, *rest in zip(byte_lists(batch.column("text")), *columns, strict=True):
                k1.append(a)
                k2.append(b)
                for start, stop, at, core, hot in zip(*rest, strict=True):
                    n = stop - start - width + 1
                    if not hot:
                        found.append((len(k1) - 1, start, n, at, core & (2**64 - 1), text[start:stop]))
                        size += stop - start
                        continue
                    raw = np.frombuffer(text[start:stop], np.uint8)
                    windows.append((np.full(n, len(k1) - 1), np.arange(start, stop - width + 1), *(Slices(symbols[raw]).runs(width) for symbols in (BYTE_SYMBOLS, SECOND_SYMBOLS))))
                    size += 32 * n
            if size >= flush:
                yield send(found, windows, k1, k2)
                found, windows, k1, k2, size = [], [], [], [], 0
        if found or windows:
            yield send(found, windows, k1, k2)

    return joined.mapInArrow(run, sql)


def later_windows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray, group: np.ndarray, raw: np.ndarray, width: int, limit: int = LIMIT) -> np.ndarray:
    """For each window of the contexts that stand one after another in raw: whether an equal one comes earlier.

    at: where in a context its core is; group: a number for the core.
    """
    sizes, size = n + width - 1, core_size(width)
    base = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(int((sizes + 1).sum()), GAP, np.int64)
    text[spans(base, sizes)] = raw
    text[base + at] = GAP + 1 + group
    of = np.full(len(text), -1, np.int64)
    of[spans(base, n)] = np.arange(int(n.sum()))
    kept = np.ones(len(text), bool)
    kept[spans(base + at + 1, np.full(len(n), size - 1))] = False
    text, of = text[kept], of[kept]
    symbols = width - size + 1
    order, common = suffix_array(text, symbols, limit)
    alike = np.cumsum(common < symbols)
    window = of[order]
    alike, window = alike[window >= 0], window[window >= 0]
    place, where = np.repeat(doc, n), spans(start, n)
    by = np.lexsort((where[window], place[window], alike))
    alike, window = alike[by], window[by]
    later = np.zeros(int(n.sum()), bool)
    new = np.ones(len(window), bool)
    new[1:] = alike[1:] != alike[:-1]
    lead = window[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(window) else window
    # a repeated row of a document is that document: its windows are not earlier
    later[window] = (place[window] != place[lead]) | (where[window] != where[lead])
    return later


def sorted_intervals(fetched: DataFrame, width: int, limit: int, text_bytes: int = 1 << 18) -> DataFrame:
    """The intervals of the windows that the suffix arrays, or hot windows' hashes, show to come later."""

    @released
    def run(batches):
        local, hashed, held = [], [], []
        for b in batches:
            for k, (at, core) in enumerate(zip(b.column("at").to_pylist(), b.column("core").to_pylist(), strict=True)):
                (held if at else hashed if core else local).append(b.slice(k, 1))
        own = blobs.arrays(local, FETCHED)
        if len(own["doc"]):
            yield blobs.interval_batch(own["doc"], own["start"], own["start"].astype(np.int64) + own["n"], own["k1"], own["k2"])
        own = blobs.arrays(hashed, FETCHED)
        blobs.same_documents(own)
        _, gone = once(own["doc"], own["start"], own["core"], own["bytes"].view(np.uint64))
        yield blobs.interval_batch(*merged(own["doc"][gone], own["start"][gone], own["start"][gone].astype(np.int64) + width), own["k1"], own["k2"])
        del own, local, hashed
        a = blobs.arrays(held, FETCHED)
        blobs.same_documents(a)
        sizes = a["n"].astype(np.int64) + width - 1
        first = np.cumsum(sizes) - sizes
        order = np.argsort(a["core"], kind="stable")
        if not len(order):
            return
        core = a["core"][order]
        group = np.cumsum(np.append(True, core[1:] != core[:-1]))
        ends = np.append(np.flatnonzero(core[1:] != core[:-1]) + 1, len(order))
        total = np.cumsum(sizes[order])
        at = 0
        while at < len(order):
            done = total[at - 1] if at else 0
            k = np.searchsorted(total[ends - 1], done + text_bytes, "right")  # whole cores, one at least
            end = max(int(ends[k - 1]) if k else 0, int(ends[np.searchsorted(ends, at, "right")]))
            x = order[at:end]
            doc, start, n = a["doc"][x], a["start"][x].astype(np.int64), a["n"][x].astype(np.int64)
            later = later_windows(doc, start, n, a["at"][x].astype(np.int64), group[at:end] - group[at], a["bytes"][spans(first[x], sizes[x])], width, limit)
            place, where = np.repeat(doc, n)[later], spans(start, n)[later]
            yield blobs.interval_batch(*merged(place, where, where + width), a["k1"], a["k2"])
            at = end

    return fetched.mapInArrow(run, blobs.INTERVALS_SQL)


def earlier_intervals(docs: DataFrame, width: int = WIDTH, most_contexts: int = MOST_CONTEXTS, limit: int = LIMIT) -> DataFrame:
    """k1, k2, start, stop: the bytes of a keyed document that windows cover which also start earlier."""
    p = partitions(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(hot_cores(docs, width, most_contexts))
    met = meet(context_blobs(docs, width, hot).repartition(p, "bucket"), width, most_contexts, hot)
    decided = met.where("core is null").select("k1", "k2", "start", "stop")
    fetched = fetch(docs, met.where("core is not null"), width).repartition(p, "bucket")
    return decided.union(sorted_intervals(fetched, width, limit))


def kept_parts(text: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[bytes, int]:
    """The text without the intervals, and how many runs that removes."""
    if not starts:
        return text, 0
    _, a, b = merged(np.zeros(len(starts), np.int64), np.array(starts), np.array(stops))
    return b"".join([text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)]), len(a)


def _texts(batch: pa.RecordBatch):
    return zip(byte_lists(batch.column("text")), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True)


def remove_earlier(docs: DataFrame, width: int = WIDTH, most_contexts: int = MOST_CONTEXTS, limit: int = LIMIT, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep, kept (the bytes left) of every row.

    Documents come in the order of doc_id, null last, and under one doc_id in
    that of their texts' hashes; rows that agree in both count as one
    document. A null text is empty. Other columns are ignored; no documents
    give no rows. most_contexts and limit change no result.
    """
    rows = keyed(docs)
    types = pa.schema([("k1", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    @released
    def cut(batches):
        for batch in chunks(batches, 8 << 20):
            out = []
            for k1, (text, starts, stops) in zip(batch.column("k1").to_pylist(), _texts(batch), strict=True):
                kept, removed = kept_parts(text, starts, stops)
                out.append((k1, len(text), len(text) - len(kept), removed, hashlib.sha256(kept).hexdigest(), kept if keep else None))
            yield blobs.batch(out, types)

    joined = blobs.with_intervals(rows, earlier_intervals(rows, width, most_contexts, limit))
    done = joined.mapInArrow(cut, "k1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(real_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"][: int(keep)])


def cut_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with texts less their bytes that occur earlier; what is left of a cut character goes too.

    No row goes, a null text becomes empty, and an n_chars column is counted again.
    """
    rows = keyed(docs, others(docs))
    joined = blobs.with_intervals(rows, earlier_intervals(rows, width))
    joined = joined.select("row", "text", "starts", "stops")

    @released
    def cut(batches):
        for batch in chunks(batches, 8 << 20):
            texts = [kept_parts(*x)[0].decode(errors="ignore") for x in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    done = joined.mapInArrow(cut, joined.select("row", "text").schema)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None}
    return done.select(*[new[c] if c in new else F.col(f"row.`{c}`") for c in docs.columns])
