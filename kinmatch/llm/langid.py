"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes forwards and backwards; at every position
the two hidden states give a label by softmax. A document's probabilities are
the mean, over all its positions that hold a letter's bytes, of the positions'
probabilities. It is trained in numpy by backpropagation through time on windows of a
bounded sample of labelled rows; prediction reads every byte of every text, in
windows of the same length, thousands of them at a time.

A network may also learn a class of noise: windows of the sample with their
bytes shuffled, or with letters, digits or characters drawn at random instead.
Then a text that is more likely noise than not has no language.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import bounded_batches, byte_lists, ByValue, chunks, free_name, id_text, others, released

UNKNOWN = "und"
WINDOW = 64
LETTER = r"\p{L}"
#: Languages whose counts are broadcast, at most; beyond that they are joined.
MOST_BROADCAST = 10_000

#: Bytes that count for a document: ASCII letters and all bytes of other characters.
COUNTS = np.zeros(256, bool)
COUNTS[65:91] = COUNTS[97:123] = COUNTS[128:] = True


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    #: Labelled rows that the sample holds for a language, about, and for all together; every language is learned.
    rows_per_language: int = 600
    rows: int = 100_000
    #: Windows that a row gives, one after another, at most.
    windows: int = 4
    #: Windows of noise, as a share of the sample's; 0 for a network that only tells languages apart.
    noise: float = 0.0
    #: Steps of training; a small sample is gone through more often.
    steps: int = 240
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


@dataclass
class Network(ByValue):
    """For each direction: `x` (256, 3H) adds a byte's share to the gates, `u` (3H, H) the state's; gates are reset, update, new."""

    languages: list[str]
    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    out: np.ndarray  # (languages, 2H)
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        def half() -> dict[str, np.ndarray]:
            return {"x": rng.normal(0, 0.3, (256, 3 * hidden)).astype("f4"), "u": rng.normal(0, 0.3, (3 * hidden, hidden)).astype("f4")}

        return cls(languages, half(), half(), rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype("f4"), np.zeros(len(languages), "f4"))

    def arrays(self) -> list[np.ndarray]:
        return [self.forward["x"], self.forward["u"], self.backward["x"], self.backward["u"], self.out, self.bias]


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def states(half: dict[str, np.ndarray], columns: np.ndarray, keep: bool = False):
    """Hidden states (steps, H, windows) for bytes (steps, windows), from zero; with keep, also what the gates were."""
    steps, width = columns.shape
    h3 = half["x"].shape[1]
    size = h3 // 3
    table, u = np.ascontiguousarray(half["x"].T), half["u"]
    out = np.empty((steps, size, width), "f4")
    h, gates = np.zeros((size, width), "f4"), []
    for t in range(steps):
        a = table.take(columns[t], axis=1)
        b = u @ h
        a[: 2 * size] += b[: 2 * size]
        _gate(a[: 2 * size])
        new = a[2 * size :]
        carried = b[2 * size :]
        if keep:
            gates.append((a, carried.copy(), h))
        carried *= a[:size]
        new += carried
        np.tanh(new, out=new)
        nxt = np.subtract(h, new, out=out[t])
        nxt *= a[size : 2 * size]
        nxt += new
        h = nxt
    return (out, gates) if keep else out


def back_through_time(half: dict[str, np.ndarray], columns: np.ndarray, gates: list, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u, from those of the hidden states (steps, H, windows)."""
    size = given.shape[1]
    u, gx, gu = half["u"], np.zeros_like(half["x"]), np.zeros_like(half["u"])
    dh = np.zeros_like(given[0])
    for t in range(len(columns) - 1, -1, -1):
        dh = dh + given[t]
        a, carried, h = gates[t]
        r, z, new = a[:size], a[size : 2 * size], a[2 * size :]
        dz = dh * (h - new) * z * (1 - z)
        dn = dh * (1 - z) * (1 - new * new)
        dr = dn * carried * r * (1 - r)
        to_x = np.concatenate([dr, dz, dn])
        to_u = np.concatenate([dr, dz, dn * r])
        gu += to_u @ h.T
        np.add.at(gx, columns[t], to_x.T)
        dh = dh * z + u.T @ to_u
    return gx, gu


def position_probabilities(net: Network, columns: np.ndarray) -> np.ndarray:
    """(steps, languages, windows): the label probabilities of every position."""
    size = net.out.shape[1] // 2
    ahead = states(net.forward, columns)
    behind = states(net.backward, columns[::-1])[::-1]
    out = net.out[:, :size] @ ahead
    out += net.out[:, size:] @ behind
    out += net.bias[None, :, None]
    np.exp(out, out=out)
    out /= out.sum(1, keepdims=True)
    return out


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], settings: Settings = Settings()) -> Network:
    """windows (rows, WINDOW) of bytes, labels (rows,); Adam on the mean cross-entropy of all positions that count."""
    rng = np.random.default_rng(settings.seed)
    net = Network.new(languages, settings.hidden, rng)
    size, step = settings.hidden, 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.arrays()]
    while step < settings.steps:
        order = rng.permutation(len(windows))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            columns = np.ascontiguousarray(windows[rows].T)
            ahead, gates = states(net.forward, columns, keep=True)
            behind, gates_back = states(net.backward, columns[::-1], keep=True)
            both = np.concatenate([ahead, behind[::-1]], axis=1)
            p = net.out @ both + net.bias[None, :, None]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[:, labels[rows], np.arange(len(rows))] -= 1
            p *= COUNTS[columns][:, None, :] / max(1, COUNTS[columns].sum())
            g_out = np.einsum("tlw,thw->lh", p, both, optimize=True)
            given = net.out.T @ p
            gx, gu = back_through_time(net.forward, columns, gates, given[:, :size])
            bx, bu = back_through_time(net.backward, columns[::-1], gates_back, given[::-1, size:])
            step += 1
            for param, g, (m, v) in zip(net.arrays(), (gx, gu, bx, bu, g_out, p.sum((0, 2))), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                param -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def pooled(net: Network, texts: list[bytes], most: int = 4096) -> np.ndarray:
    """(texts, languages): each text's mean position probabilities; even odds where no position counts."""
    sums = np.zeros((len(texts), len(net.languages)))
    seen = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts])
    cuts = -(-sizes // WINDOW)
    raw = np.zeros(int(cuts.sum()) * WINDOW, np.uint8)
    first = (np.cumsum(cuts) - cuts) * WINDOW
    for a, t in zip(first.tolist(), texts, strict=True):
        raw[a : a + len(t)] = np.frombuffer(t, np.uint8)
    rows = raw.reshape(-1, WINDOW)
    of = np.repeat(np.arange(len(texts)), cuts)
    for at in range(0, len(rows), most):
        columns = np.ascontiguousarray(rows[at : at + most].T)
        p = position_probabilities(net, columns)
        counts = COUNTS[columns].astype("f4")
        total = np.einsum("tlw,tw->wl", p, counts)
        part = of[at : at + most]
        np.add.at(seen, part, counts.sum(0))
        np.add.at(sums, part, total)
    return np.where(seen[:, None] > 0, sums / np.maximum(seen, 1)[:, None], 1 / max(1, len(net.languages)))


def held_out() -> Column:
    return F.crc32(id_text().cast("binary")) % 3 == 1


def sample(docs: DataFrame, settings: Settings = Settings()) -> list[tuple[str, bytes]]:
    """(lang, bytes) of labelled rows that aren't held out: about rows_per_language of each language, by the ids' hashes.

    With many languages it is less, so that all together are about `rows`, and
    twice that at most; a row gives up to `windows` windows in a row, somewhere
    in its text. The languages' names and counts are held by the driver.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = rows.groupBy("lang").count().withColumnRenamed("lang", "_lang")
    languages = counts.count()
    if not languages:
        return []
    each = min(settings.rows_per_language, max(1, settings.rows // languages))
    h = F.xxhash64(id_text(), F.length("text"))
    side = F.broadcast(counts) if languages <= MOST_BROADCAST else counts
    chosen = rows.join(side, F.col("lang") == F.col("_lang")).where(F.pmod(h, F.lit(1 << 20)) < each / F.col("count") * (1 << 20))
    # bytes from a place that the hash picks
    raw = F.col("text").cast("binary")
    at = F.pmod(F.shiftright(h, 20), F.greatest(F.lit(1), F.length(raw) - settings.windows * WINDOW + 1))
    found = chosen.select("lang", F.base64(F.substring(raw, at.cast("int") + 1, F.lit(settings.windows * WINDOW))).alias("w"), h.alias("h")).orderBy("h", "lang", "w").limit(2 * each * languages).collect()
    return [(r["lang"], base64.b64decode(r["w"])) for r in found]


_BASE64 = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def noise_of(windows: np.ndarray, settings: Settings) -> np.ndarray:
    """Windows as long as some of those given, of four kinds in turn: shuffled, small letters and spaces, letters and digits, other characters."""
    rng = np.random.default_rng(settings.seed)
    out = windows[rng.permutation(len(windows))[: math.ceil(settings.noise * len(windows))]]
    for k, row in enumerate(out):
        n = int((row > 0).sum())
        if k % 4 == 0:
            row[:n] = rng.permutation(row[:n])
        elif k % 4 == 1:
            row[:n] = np.where(rng.random(n) < 0.15, 32, rng.integers(97, 123, n))
        elif k % 4 == 2:
            row[:n] = _BASE64[rng.integers(0, 64, n)]
        else:
            row[:n] = np.frombuffer("".join(map(chr, rng.integers(0x80, 0x3000, WINDOW))).encode()[:n], np.uint8)
    return out


def train(docs: DataFrame, settings: Settings = Settings()) -> Network:
    """A network for all languages of the sample, and for noise (as UNKNOWN, the last) if the settings ask for it; without labels one that knows none."""
    rows = [(lang, w[k : k + WINDOW]) for lang, w in sample(docs, settings) for k in range(0, len(w), WINDOW)]
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Network.new([], settings.hidden, np.random.default_rng(0))
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for k, (_, w) in enumerate(rows):
        windows[k, : len(w)] = np.frombuffer(w, np.uint8)
    numbers = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([numbers[lang] for lang, _ in rows])
    if settings.noise:
        more = noise_of(windows, settings)
        windows, labels = np.concatenate([windows, more]), np.append(labels, np.full(len(more), len(languages)))
        languages = [*languages, UNKNOWN]
    return fit(windows, labels, languages, settings)


def identify(docs: DataFrame, net: Network | None = None, settings: Settings = Settings(), columns: list[str] | None = None) -> DataFrame:
    """The columns of docs, or those named, with held_out, lang_pred and score (the pooled probability of lang_pred).

    A text that is null or has no letter is `und` with score 0, as is every
    text if there is nothing to learn from, and one that is noise with more
    than even odds if the network knows noise. Equal texts get equal results;
    rows are kept as they come, and no documents give no rows. Own columns
    named like the three are replaced.
    """
    net = train(docs, settings) if net is None else net
    model = docs.sparkSession.sparkContext.broadcast(net)
    docs = bounded_batches(docs).drop("held_out", "lang_pred", "score")
    columns = [*(docs.columns if columns is None else columns), "held_out"]
    mark = free_name(docs, "letters")

    @released
    def run(batches):
        names = model.value.languages
        known = len(names) - (names[-1:] == [UNKNOWN])
        for batch in chunks(batches, 4 << 20):
            texts = byte_lists(batch.column("text"))
            p = pooled(model.value, texts)
            told = np.array(batch.column(mark).to_pylist(), bool) & (known > 0)
            if known < len(names):
                told &= p[:, -1] <= 0.5
            best = p[:, :known].argmax(1) if known else np.zeros(len(texts), int)
            lang = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), told.tolist(), strict=True)]
            score = [float(min(1.0, p[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), told.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    ready = docs.withColumn("held_out", held_out()).withColumn(mark, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    schema = ready.select(*[F.col(f"`{c}`") for c in columns]).schema.add("lang_pred", "string").add("score", "double")
    return ready.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text", mark])]).mapInArrow(run, schema)


def in_a_language(docs: DataFrame, settings: Settings = Settings(noise=0.25)) -> DataFrame:
    """The rows of docs whose text is in one of the languages that docs' labels teach, with all their columns.

    Null and empty texts, those without a letter, and noise go. If no row has
    a label, all texts with a letter stay. Rows that are equal stay or go
    together; columns may have any names.
    """
    net = train(docs, settings)
    if not net.languages:
        return docs.where(F.col("text").rlike(LETTER))
    rows = docs.select(others(docs), "text", "doc_id")
    told = identify(rows, net, columns=["row", "text"]).where(F.col("lang_pred") != UNKNOWN)
    return told.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
