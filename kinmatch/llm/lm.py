"""Log-bilinear language model, trained by noise-contrastive estimation, and text scores.

Every token of the corpus is counted. The `words` most frequent tokens are
outputs of the model; every other token falls in one of `classes` further
outputs, by its first bytes: these name one of `buckets`, and buckets whose
words stand beside the same frequent words, counted over the whole corpus, are
one class (k-means). The context is the last `context` outputs: their vectors,
each scaled by its place's own vector, add up to a prediction, and an output's
score is its vector times the prediction plus its bias (Mnih and Hinton 2007).
Training sets the score of a token apart from those of noise tokens drawn by
frequency (Gutmann and Hyvarinen 2010), in numpy.

Training mixes parameters and goes over the corpus once, whatever its size:
documents are dealt by a hash to rounds, and in a round to shards of about
`shard_tokens` tokens. Every shard is gone through from the same start, in the
order of its documents' keys, then the shards' parameters are averaged by
tokens. So the model does not depend on how the input is split into tasks.

A text's score adds, over its tokens, the log of the output's probability,
normalised over all outputs by one matrix product for a batch of positions;
for a token outside the vocabulary also that of the token within its class,
by smoothed counts, in which one more type stands for all unseen ones.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import byte_lists, ByValue, checkpoint, chunks, id_text, keyed, real_id, released
from kinmatch.llm.rolling import binary_array, prefix_crcs, slice_hashes, word_places

#: The token that ends a text; no word is empty.
END = b""
SMOOTH = 0.1
#: Bytes of text that are cut into words at once; more would not fit a processor's cache.
CHUNK = 1 << 20
#: Tasks that train at once, at most, each on one shard.
MOST_SHARDS = 4096


@dataclass(frozen=True)
class Settings:
    words: int = 447  # besides the end
    classes: int = 64
    #: First bytes of a word that name its bucket, the number of buckets, and of frequent words whose company tells them apart.
    prefix: int = 4
    buckets: int = 8192
    near: int = 128
    size: int = 16
    context: int = 4
    noise: int = 64
    batch: int = 512
    rate: float = 0.1
    rounds: int = 2
    shard_tokens: int = 1_000_000
    #: Tokens whose counts are broadcast, at most; the counts of all others are joined.
    broadcast_tokens: int = 131_072
    seed: int = 11

    @property
    def outputs(self) -> int:
        return 1 + self.words + self.classes


def held_out() -> Column:
    return F.crc32(id_text().cast("binary")) % 10 == 0


def bucket_of(token: bytes, settings: Settings) -> int:
    return zlib.crc32(token[: settings.prefix]) % settings.buckets


def bucket_column(settings: Settings) -> Column:
    return (F.crc32(F.expr(f"substring(token, 1, {settings.prefix})")) % settings.buckets).cast("int")


@dataclass
class Words:
    """The words of some texts, A-Z lower-cased: the different ones, which of them each place holds, and how many words each text has."""

    text: bytes
    start: np.ndarray
    stop: np.ndarray
    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        text, starts, stops, counts = word_places([t.lower() for t in texts])
        codes, hashes = pd.factorize(slice_hashes(text, starts, stops))
        one = np.zeros(len(hashes), np.int64)
        one[codes] = np.arange(len(codes))
        return cls(text, starts[one], stops[one], hashes, codes, counts)

    def tokens(self, which: np.ndarray) -> pa.BinaryArray:
        return binary_array(self.text, self.start[which], self.stop[which])

    def buckets(self, which: np.ndarray, settings: Settings) -> np.ndarray:
        """As bucket_of, of some of the different words."""
        return prefix_crcs(self.text, self.start[which], self.stop[which], settings.prefix).astype(np.int64) % settings.buckets

    def with_ends(self, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
        """A value for every token, words by their own, ends by `end`; and the number of tokens of each text."""
        sizes = self.counts + 1
        out = np.full(int(sizes.sum()), end, values.dtype)
        out[np.arange(len(self.codes)) + np.repeat(np.arange(len(sizes)), self.counts)] = values[self.codes]
        return out, sizes


def count_tokens(docs: DataFrame, flush: int = 16 << 20) -> DataFrame:
    """token (binary) and c over all texts; tasks count first, so many bytes of text at a time. Words are told apart by 64-bit hashes there."""
    types = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def out(held: list[Words], texts: int):
        before = np.cumsum([0, *(len(w.text) for w in held)])
        start, stop = (np.concatenate([x + at for x, at in zip(side, before, strict=False)]) for side in ([w.start for w in held], [w.stop for w in held]))
        codes, hashes = pd.factorize(np.concatenate([w.hashes for w in held]))
        counts = np.bincount(codes, np.concatenate([np.bincount(w.codes, minlength=len(w.hashes)) for w in held]), len(hashes)).astype(np.int64)
        one = np.zeros(len(hashes), np.int64)
        one[codes] = np.arange(len(codes))
        tokens = binary_array(b"".join(w.text for w in held), start[one], stop[one])
        yield pa.RecordBatch.from_arrays([tokens, pa.array(counts)], schema=types)
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], schema=types)

    @released
    def run(batches):
        held, size, texts = [], 0, 0
        for batch in chunks(batches, CHUNK):
            held.append(Words.of(byte_lists(batch.column("text"))))
            size, texts = size + len(held[-1].text), texts + batch.num_rows
            if size >= flush:
                yield from out(held, texts)
                held, size, texts = [], 0, 0
        if held:
            yield from out(held, texts)

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent tokens with their counts, in that order, and totals of the corpus and of the classes."""

    heads: list[bytes]
    counts: list[int]
    words: int  # how many of the heads are outputs, after the end
    total: int
    types: int
    end_count: int
    class_total: np.ndarray
    class_types: np.ndarray
    table: np.ndarray  # the class of each bucket

    def output_counts(self, settings: Settings) -> np.ndarray:
        counts = np.zeros(settings.outputs)
        counts[0] = self.end_count
        counts[1 : 1 + self.words] = self.counts[: self.words]
        counts[1 + settings.words :] = self.class_total
        return counts


class Lexicon(ByValue):
    """What is known of a token: its output, the log of its share in the base score and within its class. Broadcast, it is made once a worker."""

    def __init__(self, vocab: Vocabulary, settings: Settings):
        self.vocab, self.settings, self.hashes = vocab, settings, None

    def __getstate__(self) -> dict:
        return {"vocab": self.vocab, "settings": self.settings, "hashes": None}

    def _make(self) -> None:
        v, s = self.vocab, self.settings
        stops = np.cumsum([len(t) for t in v.heads], dtype=np.int64)
        hashes = slice_hashes(b"".join(v.heads), stops - [len(t) for t in v.heads], stops) if v.heads else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        number = v.table[np.array([bucket_of(t, s) for t in v.heads], np.int64)]
        share = np.log10(np.array(v.counts, float) + SMOOTH)
        low = math.log10(v.total + SMOOTH * (v.types + 1))
        inside = np.log10(v.class_total + SMOOTH * (v.class_types + 1))
        word = np.arange(len(v.heads)) < v.words
        self.base = 1 + s.words
        out = np.where(word, np.arange(len(v.heads)) + 1, self.base + number)
        self.out, self.low, self.inside = (x[order] for x in (out, share - low, np.where(word, 0.0, share - inside[number]) if len(number) else share))
        self.end_low, self.end_known = math.log10(v.end_count + SMOOTH) - low, v.end_count > 0
        self.hashes = hashes[order]

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the different words: output, base share, share within the class, whether a head. A word that is none has shares of 0, which the join adds."""
        if self.hashes is None:
            self._make()
        at = np.minimum(np.searchsorted(self.hashes, w.hashes), max(0, len(self.hashes) - 1))
        head = self.hashes[at] == w.hashes if len(self.hashes) else np.zeros(len(w.hashes), bool)
        out, low, inside = np.zeros(len(head), np.int64), np.zeros(len(head)), np.zeros(len(head))
        out[head], low[head], inside[head] = self.out[at[head]], self.low[at[head]], self.inside[at[head]]
        rest = np.flatnonzero(~head)
        out[rest] = self.base + self.vocab.table[w.buckets(rest, self.settings)]
        return out, low, inside, head


class Company(ByValue):
    """Numbers of words: those of `heads`, from 1 on, or else behind these the bucket's. Broadcast, it is made once a worker."""

    def __init__(self, heads: list[bytes], settings: Settings):
        self.heads, self.settings, self.hashes = heads, settings, None

    def __getstate__(self) -> dict:
        return {"heads": self.heads, "settings": self.settings, "hashes": None}

    def __call__(self, w: Words) -> np.ndarray:
        if self.hashes is None:
            stops = np.cumsum([len(t) for t in self.heads], dtype=np.int64)
            hashes = slice_hashes(b"".join(self.heads), stops - [len(t) for t in self.heads], stops)
            self.order = np.argsort(hashes)
            self.hashes = hashes[self.order]
        at = np.minimum(np.searchsorted(self.hashes, w.hashes), len(self.hashes) - 1)
        head = self.hashes[at] == w.hashes
        out, rest = self.order[at] + 1, np.flatnonzero(~head)
        out[rest] = len(self.heads) + 1 + w.buckets(rest, self.settings)
        return out


def company(docs: DataFrame, heads: list[bytes], settings: Settings) -> np.ndarray:
    """(buckets, near): how often a word of each bucket has each of the most frequent words one or two places before or behind it."""
    near, parts = settings.near, 16
    numbers = docs.sparkSession.sparkContext.broadcast(Company(heads, settings))
    types = pa.schema([("g", pa.int32()), ("counts", pa.binary())])

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=types)

    @released
    def run(batches):
        total, first, held, size = np.zeros(settings.buckets * near, np.int64), len(heads) + 1, [], 0
        for batch in chunks(batches, CHUNK):
            w = Words.of(byte_lists(batch.column("text")))
            ids, sizes = w.with_ends(numbers.value(w), 0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rare, often = ids >= first, (ids > 0) & (ids < min(near, first))
            for step in (1, 2):
                same = doc[step:] == doc[:-step]
                for own, other in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                    at = np.flatnonzero(same & rare[own] & often[other])
                    held.append((ids[own][at] - first) * near + ids[other][at])
                    size += len(at)
            if size >= len(total):  # a count costs as much as the table has cells
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        yield rows(dict(enumerate(np.array_split(total, parts))))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, x in zip(batch.column("g").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[g] = total.get(g, 0) + np.frombuffer(x, np.int64)
        yield rows(total)

    found = {r["g"]: np.frombuffer(r["counts"], np.int64) for r in docs.select("text").mapInArrow(run, "g int, counts binary").repartition(parts, "g").mapInArrow(add, "g int, counts binary").collect()}  # one row a part
    return np.concatenate([found[g] for g in range(parts)]).reshape(settings.buckets, near) if found else np.zeros((settings.buckets, near), np.int64)


def class_table(counts: np.ndarray, mass: np.ndarray, settings: Settings, steps: int = 12, prior: float = 5.0) -> np.ndarray:
    """The class of each bucket: weighted k-means of the square roots of their company's shares."""
    k, seen = settings.classes, mass > 0
    table = np.arange(len(mass)) % k
    if not counts.sum() or seen.sum() <= k:
        return table
    rng, weight = np.random.default_rng(settings.seed), mass[seen].astype(float)
    shares = (counts[seen] + prior * counts.sum(0) / counts.sum()) / (counts[seen].sum(1, keepdims=True) + prior)
    x = np.sqrt(shares)
    centres = [x[weight.argmax()]]
    far = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        odds = far * weight
        centres.append(x[rng.choice(len(x), p=odds / odds.sum()) if odds.sum() > 0 else rng.integers(len(x))])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(steps):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        total = np.bincount(own, weight, k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x * weight[:, None])
        centres[total > 0] = sums[total > 0] / total[total > 0, None]
    table[seen] = own
    return table


def vocabulary(counts: DataFrame, docs: DataFrame, settings: Settings) -> Vocabulary:
    """From all counts and the company of rare words in docs. The heads are the tokens with counts of at least the least limit that keeps them within broadcast_tokens."""
    words = counts.where(F.length("token") > 0)
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r[0]: r[1] for r in words.groupBy(step.alias("s")).count().collect()}
    limit, kept = max(sizes, default=0) + 1, 0
    for s in sorted(sizes, reverse=True):
        if kept + sizes[s] > settings.broadcast_tokens:
            break
        limit, kept = s, kept + sizes[s]
    heads = sorted(((bytes(r[0]), r[1]) for r in words.where(step >= limit).collect()), key=lambda x: (-x[1], x[0]))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = counts.where(F.length("token") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n = min(settings.words, len(heads))
    mass, kinds = np.zeros(settings.buckets, np.int64), np.zeros(settings.buckets, np.int64)
    for b, c, t in words.groupBy(bucket_column(settings).alias("b")).agg(F.sum("c"), F.count("*")).collect():  # one row a bucket
        mass[b], kinds[b] = c, t
    for t, c in heads[:n]:
        mass[bucket_of(t, settings)] -= c
        kinds[bucket_of(t, settings)] -= 1
    outputs = [t for t, _ in heads[:n]]
    table = class_table(company(docs, outputs, settings) if n else np.zeros((settings.buckets, settings.near)), mass, settings)
    return Vocabulary([t for t, _ in heads], [c for _, c in heads], n, total, types, end, np.bincount(table, mass, settings.classes), np.bincount(table, kinds, settings.classes), table)


@dataclass
class Model(ByValue):
    """r: input vectors, q: output vectors, c: a scale for each place of the context, b: biases."""

    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @classmethod
    def new(cls, shares: np.ndarray, settings: Settings) -> Model:
        rng = np.random.default_rng(settings.seed)
        r, q = rng.normal(0, 0.1, (2, settings.outputs, settings.size)).astype("f4")
        return cls(r, q, np.full((settings.context, settings.size), 1 / settings.context, "f4"), np.log(shares).astype("f4"))

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @classmethod
    def of(cls, flat: np.ndarray, settings: Settings) -> Model:
        shapes = [(settings.outputs, settings.size)] * 2 + [(settings.context, settings.size), (settings.outputs,)]
        parts = np.split(flat.astype("f4"), np.cumsum([math.prod(s) for s in shapes])[:-1])
        return cls(*[p.reshape(s) for p, s in zip(parts, shapes, strict=True)])

    def places(self) -> np.ndarray:
        """What turns the vectors of a context, side by side, into its prediction: the places' scales on diagonals. Products of matrices are faster than rows scaled."""
        k, d = self.c.shape
        out = np.zeros((k, d, d), "f4")
        out[:, np.arange(d), np.arange(d)] = self.c
        return out.reshape(k * d, d)

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray, batch: int = 256) -> np.ndarray:
        """Natural logs, normalised over all outputs."""
        out = np.empty(len(targets), "f4")
        across = np.ascontiguousarray(np.concatenate([self.q, self.b[:, None]], axis=1).T)
        size, many = across.shape
        ones, rows, places = np.ones(many, "f4"), np.arange(batch), self.places()
        # the same memory for every batch
        inputs, held, sums = np.ones((batch, size), "f4"), np.empty((batch, many), "f4"), np.empty(batch, "f4")
        bound, tallest = np.abs(self.q).max(0), float(self.b.max())
        tall = float(np.abs(self.r).max(0) @ np.abs(self.c).sum(0) * bound.sum() + tallest) > 80
        for at in range(0, len(targets), batch):
            near = contexts[at : at + batch]
            n = len(near)
            inputs[:n, :-1] = p = self.r.take(near, 0).reshape(n, -1) @ places
            scores = np.matmul(inputs[:n], across, out=held[:n])
            own = scores[rows[:n], targets[at : at + batch]]
            top = max(0.0, float(np.abs(p).max(0) @ bound + tallest) - 80) if tall else 0.0  # so that no exponential overflows
            if top:
                scores -= np.float32(top)
            np.exp(scores, out=scores)
            out[at : at + n] = own - np.float32(top) - np.log(np.matmul(scores, ones, out=sums[:n]))
        return out


def contexts_of(ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The outputs before each position, nearest first; before a text's first token stands the end."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(ids), width), np.int64)
    for k in range(width):
        out[k + 1 :, k] = ids[: max(0, len(ids) - k - 1)]
        out[place <= k, k] = 0
    return out


class Trainer:
    """Noise-contrastive steps with Adagrad."""

    def __init__(self, model: Model, shares: np.ndarray, settings: Settings, seed: int):
        self.model, self.settings, self.rng = model, settings, np.random.default_rng(seed)
        self.cumulative = np.cumsum(shares)
        self.log_noise = np.log(settings.noise * shares).astype("f4")
        self.squares = [np.full_like(x, 1e-3) for x in model.arrays()]
        self.cells = np.arange(settings.outputs * settings.size).reshape(settings.outputs, settings.size)
        self.seen = 0

    def _sums(self, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows added up by output."""
        return np.bincount(self.cells.take(which, 0).ravel(), rows.ravel(), self.cells.size).reshape(self.cells.shape).astype("f4")

    def _add(self, k: int, grad: np.ndarray) -> None:
        change = grad * grad
        self.squares[k] += change
        np.divide(grad, np.sqrt(self.squares[k], out=change), out=change)
        change *= np.float32(self.settings.rate)
        array = self.model.arrays()[k]
        array -= change

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        m, n, s = self.model, len(targets), self.settings
        noise = np.searchsorted(self.cumulative, self.rng.random(s.noise) * self.cumulative[-1]).clip(0, s.outputs - 1)
        vectors, places = m.r.take(contexts, 0).reshape(n, -1), m.places()
        p = vectors @ places
        q, drawn = m.q.take(targets, 0), m.q.take(noise, 0)
        own = np.einsum("nd,nd->n", p, q) + m.b[targets] - self.log_noise[targets]
        with np.errstate(over="ignore"):  # an infinite exponential gives 0, as it should
            g_own = -1 / (1 + np.exp(own))
            g_other = p @ -drawn.T
            g_other += self.log_noise[noise] - m.b[noise]
            np.exp(g_other, out=g_other)
        g_other += np.float32(1)
        np.divide(np.float32(1), g_other, out=g_other)
        gp = g_other @ drawn
        gp += g_own[:, None] * q
        both = np.concatenate([targets, noise])
        gq = self._sums(both, np.concatenate([g_own[:, None] * p, g_other.T @ p]))
        gb = np.bincount(both, np.concatenate([g_own, g_other.sum(0)]), s.outputs).astype("f4")
        gr = self._sums(contexts.ravel(), gp @ places.T)
        gc = np.einsum("nkd,nd->kd", vectors.reshape(n, s.context, -1), gp)
        for k, g in enumerate((gr, gq, gc, gb)):
            self._add(k, g / np.float32(n))
        self.seen += n


def average(parts: list[tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    weight = sum(w for w, _ in parts)
    return weight, sum(w * x for w, x in parts) / max(weight, 1e-9)


def train(docs: DataFrame, vocab: Vocabulary, lexicon, settings: Settings) -> Model:
    """From all rows of keyed docs, each in one shard of one round. lexicon: a broadcast Lexicon."""
    sc = docs.sparkSession.sparkContext
    counts = vocab.output_counts(settings) + SMOOTH
    shares = counts / counts.sum()
    model = Model.new(shares, settings)
    shards = min(MOST_SHARDS, max(1, round(vocab.total / settings.rounds / settings.shard_tokens)))
    groups = 16
    sql = "g int, shard int, weight double, flat binary"
    types = pa.schema([("g", pa.int32()), ("shard", pa.int32()), ("weight", pa.float64()), ("flat", pa.binary())])

    def row(g, shard, weight, flat):
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([shard], pa.int32()), pa.array([weight]), pa.array([flat.tobytes()])], schema=types)

    def passes(start):
        @released
        def run(batches):
            trainer, shard = None, TaskContext.get().partitionId()
            for batch in chunks(batches, CHUNK):
                w = Words.of(byte_lists(batch.column("text")))
                ids, sizes = w.with_ends(lexicon.value(w)[0], 0)
                if trainer is None:
                    trainer = Trainer(Model.of(start.value, settings), shares, settings, settings.seed + shard)
                contexts = contexts_of(ids, sizes, settings.context)
                for at in range(0, len(ids), settings.batch):
                    trainer.step(contexts[at : at + settings.batch], ids[at : at + settings.batch])
            if trainer is not None:
                yield row(shard % groups, shard, float(trainer.seen), trainer.model.flat().astype("f8"))

        return run

    def mixed(rows: list[tuple[int, float, bytes]]) -> tuple[float, np.ndarray]:
        return average([(w, np.frombuffer(x, "f8")) for _, w, x in sorted(rows)])

    def mix(batches):
        held = [x for b in batches for x in zip(b.column("shard").to_pylist(), b.column("weight").to_pylist(), b.column("flat").to_pylist(), strict=True)]
        if held:
            yield row(0, held[0][0] % groups, *mixed(held))

    key = F.xxhash64("k1", "k2")
    for k in range(settings.rounds):
        start = sc.broadcast(model.flat())
        # in an order that the input's tasks have no part in
        part = docs.where(F.pmod(key, F.lit(settings.rounds)) == k).select("k1", "k2", "text").repartition(shards, key).sortWithinPartitions("k1", "k2").select("text")
        rows = part.mapInArrow(passes(start), sql).repartition(groups, "g").mapInArrow(mix, sql).collect()  # one row a group
        if rows:
            model = Model.of(mixed([(r["shard"], r["weight"], r["flat"]) for r in rows])[1], settings)
    return model


SCORED = "k1 long, k2 long, token binary, n long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORED_TYPES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("token", pa.binary()), ("n", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows that are not held out; a null id counts as the empty
    text there. A null text is empty: it has one token, the end. Equal rows
    get equal scores; other columns are ignored; no documents give no rows,
    and with none to learn from every output is as likely as any other. Of
    tokens of equal count the least by bytes comes first in the vocabulary.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = keyed(docs).withColumn("doc_id", real_id()).withColumn("held_out", held_out())
    learn = rows.where(~F.col("held_out"))
    counts = checkpoint(count_tokens(learn))
    vocab = vocabulary(counts, learn, settings)
    lexicon = sc.broadcast(Lexicon(vocab, settings))
    model = sc.broadcast(train(learn, vocab, lexicon, settings))

    @released
    def run(batches):
        """A row for each document, under a token that no text has, and one for each of its tokens whose count is not broadcast."""
        for batch in chunks(batches, CHUNK):
            w, known_words = Words.of(byte_lists(batch.column("text"))), lexicon.value
            out, low, inside, head = known_words(w)
            ids, sizes = w.with_ends(out, 0)
            logs = model.value.log_probabilities(contexts_of(ids, sizes, settings.context), ids).astype("f8") / math.log(10) + w.with_ends(inside, 0.0)[0]
            first = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, first) for x in (w.with_ends(head.astype(np.int64), int(known_words.end_known))[0], w.with_ends(low, known_words.end_low)[0], logs)]
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            names = pa.array([b" %d %d" % key for key in zip(k1.tolist(), k2.tolist(), strict=True)], pa.binary())
            nulls = lambda n, columns: [pa.nulls(n, SCORED_TYPES.field(c).type) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), names, *nulls(len(k1), ["n"]), batch.column("held_out"), pa.array(sizes), *map(pa.array, sums)], schema=SCORED_TYPES)

            rest = np.flatnonzero(~head)
            number = np.full(len(head), -1, np.int64)
            number[rest] = np.arange(len(rest))
            at = np.flatnonzero(~head[w.codes])
            doc = np.repeat(np.arange(len(w.counts)), w.counts)[at]
            codes, pairs = pd.factorize(doc * max(1, len(rest)) + number[w.codes[at]])
            doc, token = pairs // max(1, len(rest)), pairs % max(1, len(rest))
            words = w.tokens(rest[token])
            often = pa.array(np.bincount(codes, minlength=len(pairs)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k1[doc]), pa.array(k2[doc]), words, often, *nulls(len(pairs), SCORED_TYPES.names[4:])], schema=SCORED_TYPES)

    met = rows.select("k1", "k2", "held_out", "text").mapInArrow(run, SCORED).join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    inside = F.lit(np.log10(vocab.class_total + SMOOTH * (vocab.class_types + 1))[vocab.table].tolist())
    share = F.log10(F.col("c") + SMOOTH)
    low = math.log10(vocab.total + SMOOTH * (vocab.types + 1))
    told = ("held_out", "n_tokens", "n_known", "base_score", "score")
    # rows that agree in id and text bring their tokens once each
    added = met.groupBy("k1", "k2").agg(
        F.count("n_tokens").alias("rows"), *[F.max(c).alias(c) for c in told], F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known"), F.sum(F.col("n") * (share - low)).alias("low"), F.sum(F.col("n") * (share - F.get(inside, bucket_column(settings)))).alias("inside")
    )
    more = lambda c: F.coalesce(F.col(c) / F.col("rows"), F.lit(0.0))
    return added.select("*", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).select(
        real_id(), "held_out", "n_tokens", (F.col("n_known") + F.round(more("known")).cast("long")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base_score") + more("low")).alias("base_score"), (F.col("score") + more("inside")).alias("score")
    )
