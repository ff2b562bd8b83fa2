"""Set similarities of all pairs of a block, counted in tiles.

A block's first side is dealt to rows and its pool to columns by a hash of the
id; a record is copied to each tile of its row or column, and a tile is worked
off by one task. So what goes over the wire grows with the records and their
copies, not with the pairs, and no pair is sent before its measures are known.

In a tile words are numbered. Those that many records of either side have are
counted by a product of matrices, a strip of the first side at a time, the
others by their lists of records; both counts are exact. Weighted vectors'
products, of which only each record's best are given, are summed in the same way;
their tiles have all of the pools of several blocks, which pass by in chunks, so
that a record that is in many blocks' pools is sent once to a tile.
"""

from __future__ import annotations

import itertools
import tempfile
import zlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records of either side in a tile, on average, and pairs in a strip.
ROWS, COLUMNS, STRIP = 2048, 4096, 1 << 20
#: Pairs in a strip that leaves as lists.
LISTED = 1 << 18
#: A word is for the product of matrices if so large a part of a tile's pairs share it.
DENSE = 1 / 150
#: Words in a matrix at once.
WIDTH = 1024
#: Of weighted vectors: records of the first side in a tile, of a pool and entries of theirs in a chunk, pairs in a strip, words in a matrix and products at once.
SIDE, ENTRIES, WIDE_STRIP, FEW, AT_ONCE = 8192, 1 << 20, 1 << 20, 512, 1 << 19
#: Records of the first side and half the pool's, by their own block, of blocks that share a tile, about.
LOAD = 16384
FIRST, POOL, OWNER = 0, 1, 2


def tiled(records: DataFrame, block: list[str], first: Column, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """records with side (FIRST where `first` holds, else POOL), once for each tile of theirs; tile is an array. Blocks that lack a side are left out."""
    sided = records.withColumn("side", F.when(first, FIRST).otherwise(POOL))
    n = sided.groupBy(*block).agg(F.count_if(F.col("side") == FIRST).alias("_a"), F.count_if(F.col("side") == POOL).alias("_b")).where("_a > 0 and _b > 0")
    n = n.select(*block, F.ceil(F.col("_a") / rows).cast("int").alias("_rows"), F.ceil(F.col("_b") / columns).cast("int").alias("_columns"))
    mine = lambda many: F.pmod(F.xxhash64("entity_id"), many).cast("int")
    every = lambda many: F.sequence(F.lit(0), many - 1)
    dealt = sided.join(F.broadcast(n), block)  # a row a block
    dealt = dealt.withColumn("_i", F.explode(F.when(F.col("side") == FIRST, F.array(mine(F.col("_rows")))).otherwise(every(F.col("_rows")))))
    dealt = dealt.withColumn("_j", F.explode(F.when(F.col("side") == FIRST, every(F.col("_columns"))).otherwise(F.array(mine(F.col("_columns"))))))
    return dealt.withColumn("tile", F.xxhash64(*block, "_i", "_j")).drop("_rows", "_columns", "_i", "_j")


def grouped(records: DataFrame, area: str, block: str, first: Column) -> DataFrame:
    """records with tile, side, block (as a number) and wild (its name is ''), once for each tile of theirs.

    A block's pool are the area's pool records of that block and of ''; block '' has all of the area's. Small blocks of an area
    share tiles; block '' and those of over SIDE records of the first side have tiles of their own, one for each SIDE of these.
    Blocks that lack a side are left out.
    """
    sided = records.withColumn("side", F.when(first, FIRST).otherwise(POOL))
    n = sided.groupBy(area, block).agg(F.count_if(F.col("side") == FIRST).alias("_a"), F.count_if(F.col("side") == POOL).alias("_b"))
    own, whole = F.col(block), Window.partitionBy(area)
    n = n.withColumn("_pool", F.when(own == "", F.sum("_b").over(whole)).otherwise(F.col("_b") + F.coalesce(F.sum(F.when(own == "", F.col("_b"))).over(whole), F.lit(0))))
    n = n.where((F.col("_a") > 0) & (F.col("_pool") > 0) & own.isNotNull()).withColumn("_alone", (own == "") | (F.col("_a") > SIDE))
    load = F.when(F.col("_alone"), 0).otherwise(F.col("_a") + F.col("_b") / 2)
    n = n.withColumn("_group", F.when(F.col("_alone"), F.concat(F.lit("b"), own)).otherwise(F.concat(F.lit("g"), F.floor((F.sum(load).over(whole.orderBy(block).rowsBetween(Window.unboundedPreceding, 0)) - load) / LOAD).cast("string"))))
    rows = F.when(F.col("_alone"), F.ceil(F.col("_a") / SIDE)).otherwise(1).cast("int")
    n = n.groupBy(area).agg(F.collect_list(F.struct(own.alias("name"), F.struct(F.col("_group").alias("group"), rows.alias("rows")).alias("tiles"))).alias("_blocks"))
    mine = F.filter("_blocks", lambda b: F.when(F.col("side") == FIRST, b["name"] == own).otherwise((b["name"] == "") | (own == "") | (b["name"] == own)))
    dealt = sided.join(F.broadcast(n), area)  # a row an area
    dealt = dealt.withColumn("_tiles", F.explode(F.array_distinct(F.transform(mine, lambda b: b["tiles"])))).drop("_blocks")
    rows = F.col("_tiles.rows")
    dealt = dealt.withColumn("_i", F.explode(F.when(F.col("side") == FIRST, F.array(F.pmod(F.xxhash64("entity_id"), rows).cast("int"))).otherwise(F.sequence(F.lit(0), rows - 1))))
    dealt = dealt.withColumn("tile", F.xxhash64(area, "_tiles.group", "_i")).drop("_tiles", "_i")
    return dealt.withColumns({"wild": F.coalesce(own == "", F.lit(False)), block: F.xxhash64(area, block)}).withColumnRenamed(block, "block")


def word_ids(*sides: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each side's texts (or packed sets of words), words between spaces: text and word, as numbers, of every different word of a text, in order of the words; and how many words each text has. Only words of all sides are listed, yet all are counted."""
    lists = [unpacked(s) if pa.types.is_binary(s.type) else pc.split_pattern(s, " ") for s in sides]
    words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    codes, values = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    empty = pc.index(values, pa.scalar("", values.type)).as_py()
    found, at = [], 0
    for x in lists:
        text = pc.list_parent_indices(x).to_numpy(zero_copy_only=False).astype(np.int64)
        code = codes[at : at + len(text)]
        at += len(text)
        if empty >= 0:
            text, code = text[code != empty], code[code != empty]
        pair = np.unique(code * len(x) + text)
        found.append((pair % max(1, len(x)), pair // max(1, len(x)), len(x)))
    shared = np.ones(len(values), bool)
    for _, code, _ in found:
        shared &= np.bincount(code, minlength=len(values)) > 0
    number = np.cumsum(shared) - 1
    return [(text[k := shared[code]], number[code[k]], np.bincount(text, minlength=n)) for text, code, n in found]


class Shared:
    """Counts of shared words of strips of the first side with all of the pool."""

    def __init__(self, a: tuple, b: tuple):
        (at, aw, self.a_sizes), (bt, bw, self.b_sizes) = a, b
        self.na, self.nb = len(self.a_sizes), len(self.b_sizes)
        words = int(max(aw.max(initial=-1), bw.max(initial=-1))) + 1
        na, nb = np.bincount(aw, minlength=words), np.bincount(bw, minlength=words)
        self.dense = np.flatnonzero(na * nb > DENSE * self.na * self.nb)
        column = np.full(words, -1)
        column[self.dense] = np.arange(len(self.dense))
        self.b_dense = self._entries(bt, column[bw], column[bw] >= 0)
        self.a_dense = self._by_text(at, column[aw], column[aw] >= 0)
        rare_b = column[bw] < 0
        self.b_of = bt[rare_b]
        self.first = np.searchsorted(bw[rare_b], np.arange(words + 1))
        self.a_rare = self._by_text(at, aw, column[aw] < 0)

    @staticmethod
    def _entries(text, word, keep):
        return text[keep], word[keep]

    def _by_text(self, text, word, keep):
        text, word = text[keep], word[keep]
        order = np.argsort(text, kind="stable")
        return np.searchsorted(text[order], np.arange(self.na + 1)), text[order], word[order]

    def strip(self, low: int, high: int) -> np.ndarray:
        """Counts of the texts from low to high of the first side with each of the pool."""
        out = np.zeros((high - low, self.nb), np.float32)
        starts, text, word = self.a_dense
        text, word = text[starts[low] : starts[high]] - low, word[starts[low] : starts[high]]
        for k in range(0, len(self.dense), WIDTH):
            width = min(WIDTH, len(self.dense) - k)
            a, b = np.zeros((high - low, width), np.float32), self._matrix(k, width)
            inside = (word >= k) & (word < k + width)
            a[text[inside], word[inside] - k] = 1
            out += a @ b
        starts, text, word = self.a_rare
        text, word = text[starts[low] : starts[high]] - low, word[starts[low] : starts[high]]
        many = self.first[word + 1] - self.first[word]
        for part in np.array_split(np.arange(len(word)), int(many.sum() >> 23) + 1):
            m = many[part]
            at = np.repeat(self.first[word[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            met = np.repeat(text[part] * self.nb, m) + self.b_of[at]
            out += np.bincount(met, minlength=out.size).reshape(out.shape)
        return out

    def _matrix(self, k: int, width: int) -> np.ndarray:
        text, word = self.b_dense
        out = np.zeros((width, self.nb), np.float32)
        low, high = np.searchsorted(word, [k, k + width]) if len(word) else (0, 0)
        out[word[low:high] - k, text[low:high]] = 1
        return out


def jaccards(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of counts of shared words and of sizes; 0 where both sets are empty."""
    union = a + b - shared
    return np.divide(shared, union, out=np.zeros(len(shared)), where=union > 0)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where another tile begins."""
    for batch in batches:
        tiles = batch.column("tile").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low < high:
                yield batch.slice(low, high - low)


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile after the other, from batches in the tiles' order."""
    for _, same in itertools.groupby(pieces(batches), lambda x: x.column("tile")[0].as_py()):
        yield pa.Table.from_batches(list(same))


def similar_names(rows: DataFrame, parts: int, carried: bool = False) -> DataFrame:
    """s1_id, cand_id, name_jac, addr_jac and owned of the pairs of a tile with a word of the name in common.

    rows: tile, side, entity_id, name and addr (words between single spaces, or
    both packed); rows of side OWNER have a pool's id and in name that of the
    record it belongs to, as it is, and decide `owned`. With `carried` rows have a text more, extra,
    that pairs have of both sides, as a_extra and b_extra.
    """
    types = pa.schema([("s1_id", pa.string()), ("cand_id", pa.string()), ("name_jac", pa.float64()), ("addr_jac", pa.float64()), ("owned", pa.int32()), *[(f"{x}_extra", pa.string()) for x in "ab" if carried]])

    def run(batches):
        for t in by_tile(batches):
            a, b, owners = sides(t, OWNER)
            if not a.num_rows or not b.num_rows:
                continue
            ids_a, ids_b = one(a, "entity_id"), one(b, "entity_id")
            place = {x: k for k, x in enumerate(ids_a.to_pylist())}
            of = dict(zip(owners["entity_id"].to_pylist(), owners["name"].cast(pa.string()).to_pylist(), strict=True))
            own, owner = np.array([place[x] for x in ids_a.to_pylist()]), np.array([place.get(of.get(x), -1) for x in ids_b.to_pylist()])
            names, addrs = (Shared(*word_ids(one(a, c), one(b, c))) for c in ("name", "addr"))
            step = max(1, STRIP // b.num_rows)
            for low in range(0, a.num_rows, step):
                high = min(a.num_rows, low + step)
                met = names.strip(low, high)
                i, j = np.nonzero(met)
                if not len(i):
                    continue
                c, d = met[i, j].astype(np.float64), addrs.strip(low, high)[i, j].astype(np.float64)
                i += low
                columns = [ids_a.take(pa.array(i)), ids_b.take(pa.array(j)), pa.array(jaccards(c, names.a_sizes[i], names.b_sizes[j])), pa.array(jaccards(d, addrs.a_sizes[i], addrs.b_sizes[j])), pa.array((owner[j] == own[i]).astype(np.int32))]
                columns += [one(x, "extra").take(pa.array(at)) for x, at in ((a, i), (b, j))] if carried else []
                out = pa.RecordBatch.from_arrays(columns, schema=types)
                for k in range(0, out.num_rows, 1 << 16):
                    yield out.slice(k, 1 << 16)

    ordered = rows.select("tile", "side", "entity_id", "name", "addr", *["extra"] * carried).repartition(parts, "tile").sortWithinPartitions("tile")
    return ordered.mapInArrow(run, "s1_id string, cand_id string, name_jac double, addr_jac double, owned int" + ", a_extra string, b_extra string" * carried)


def one(t: pa.Table, column: str) -> pa.Array:
    return t[column].combine_chunks() if isinstance(t[column], pa.ChunkedArray) else t[column]


def sides(t: pa.Table, *more: int) -> list[pa.Table]:
    """A tile's first side and pool, and its rows of other sides."""
    side = t["side"].to_numpy()
    return [t.filter(pa.array(side == k)).combine_chunks() for k in (FIRST, POOL, *more)]


def half_up(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Rounded as Spark rounds: halves of the decimal form up. x: from 0 to 1, about."""
    y = x * 10.0**places
    out = np.floor(y + 0.5) / 10.0**places
    near = np.nonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)
    if len(near[0]):
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values.tolist()])[at]
    return out


#: Of what a tile's first side and pool have: the measure of the records from low to high of the first side with each of the pool.
Measure = Callable[[pa.Array, pa.Array], Callable[[int, int], np.ndarray]]


def length_ratio(a: pa.Array, b: pa.Array) -> Callable[[int, int], np.ndarray]:
    """Of lengths."""
    x, y = (c.to_numpy()[:, None].astype(np.float64) for c in (a, b))
    return lambda low, high: np.minimum(x[low:high], y.T) / np.maximum(np.maximum(x[low:high], y.T), 1)


def containment(a: pa.Array, b: pa.Array) -> Callable[[int, int], np.ndarray]:
    """The share of a text's different words that the other has; 0 if it has none."""
    shared = Shared(*word_ids(a, b))
    sizes = np.maximum(shared.a_sizes, 1)[:, None]
    return lambda low, high: shared.strip(low, high) / sizes[low:high]


def valued_names(rows: DataFrame, parts: int, measure: Measure) -> DataFrame:
    """s1_id, cand_id and value (rounded to six places) of the pairs of a tile with a word of the name in common.

    rows: tile, side, entity_id, name (as in similar_names) and own, what `measure` takes. Pairs leave
    Python as a list for each record of the first side.
    """
    pair = pa.struct([("cand_id", pa.string()), ("value", pa.float64())])
    types = pa.schema([("s1_id", pa.string()), ("pairs", pa.list_(pair))])

    def run(batches):
        for t in by_tile(batches):
            a, b = sides(t)
            if not a.num_rows or not b.num_rows:
                continue
            ids_a, ids_b = one(a, "entity_id"), one(b, "entity_id")
            names, values = Shared(*word_ids(one(a, "name"), one(b, "name"))), measure(one(a, "own"), one(b, "own"))
            step = max(1, LISTED // b.num_rows)
            for low in range(0, a.num_rows, step):
                high = min(a.num_rows, low + step)
                met = names.strip(low, high) > 0
                ends = np.concatenate([[0], np.cumsum(met.sum(1))])
                if not ends[-1]:
                    continue
                found = pa.StructArray.from_arrays([ids_b.take(pa.array(np.nonzero(met)[1])), pa.array(half_up(values(low, high))[met])], fields=list(pair))
                yield pa.RecordBatch.from_arrays([ids_a.slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], schema=types)

    ordered = rows.select("tile", "side", "entity_id", "name", "own").repartition(parts, "tile").sortWithinPartitions("tile")
    listed = ordered.mapInArrow(run, "s1_id string, pairs array<struct<cand_id: string, value: double>>")
    return listed.select("s1_id", F.inline("pairs"))


def _runs(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each start so many numbers from there on."""
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())


class Index:
    """A side's entries (text, word and weight, and how many texts there are) in order of the words."""

    def __init__(self, side: tuple, words: int):
        text, word, x, self.n = side
        order = np.argsort(word, kind="stable")
        self.of, self.x = text[order], x[order]
        self.many = np.bincount(word, minlength=words)
        self.first = np.cumsum(self.many) - self.many


class Weighted:
    """Sums of products of weights, of strips of one side with all of the other, which has an index. A side: text, word and weight of its entries, in order of the texts, and how many texts there are."""

    def __init__(self, a: tuple, b: Index):
        at, aw, ax, self.na = a
        self.b, self.nb = b, b.n
        common = np.bincount(aw, minlength=len(b.many)) * b.many.astype(np.float64)
        self.dense = np.flatnonzero(common > DENSE * self.na * self.nb)
        column = np.full(len(common), -1, np.int32)
        column[self.dense] = np.arange(len(self.dense))
        met = common[aw] > 0
        at, aw, ax = at[met], aw[met], ax[met]
        self.a_dense, self.a_rare = (self._by_text(at[k], w[k], ax[k]) for k, w in ((column[aw] >= 0, column[aw]), (column[aw] < 0, aw)))
        self.made: tuple[int, np.ndarray] | None = None

    def _by_text(self, text, word, x):
        return np.searchsorted(text, np.arange(self.na + 1)), text, word, x

    def _matrix(self, k: int, width: int) -> np.ndarray:
        """The other side's weights of the dense words from k on; the last one made is kept."""
        if self.made is None or self.made[0] != k:
            word, b = self.dense[k : k + width], self.b
            at = _runs(b.first[word], b.many[word])
            self.made = k, np.zeros((width, self.nb))
            self.made[1][np.repeat(np.arange(width), b.many[word]), b.of[at]] = b.x[at]
        return self.made[1]

    def strip(self, low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, self.nb))
        cut = lambda starts, *columns: [c[starts[low] : starts[high]] for c in columns]
        text, word, x = cut(*self.a_dense)
        for k in range(0, len(self.dense), FEW):
            width = min(FEW, len(self.dense) - k)
            a, inside = np.zeros((high - low, width)), (word >= k) & (word < k + width)
            a[text[inside] - low, word[inside] - k] = x[inside]
            out += a @ self._matrix(k, width)
        text, word, x = cut(*self.a_rare)
        b = self.b
        for part in np.array_split(np.arange(len(word)), int(b.many[word].sum() // AT_ONCE) + 1):
            m = b.many[word[part]]
            at = _runs(b.first[word[part]], m)
            met = np.repeat((text[part] - low) * self.nb, m) + b.of[at]
            out += np.bincount(met, np.repeat(x[part], m) * b.x[at], out.size).reshape(out.shape)
        return out


def best_in_rows(scores: np.ndarray, k: int, place: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each row's k greatest scores over zero after rounding; of equal ones those of the columns that come first by `place`."""
    unit = 10.0**places
    least = np.full(len(scores), 0.5 / unit)
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 2 / unit)
    i, j = np.nonzero(scores >= least[:, None])
    x = np.floor(scores[i, j] * unit + 0.5) / unit
    order = np.lexsort((place[j], -x, i))
    i, j, x = i[order], j[order], x[order]
    near = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[near], j[near], x[near]


def packed(tokens: Column) -> Column:
    """A list of tokens, each once, as unpacked() takes it."""
    return F.pandas_udf(lambda s: s.map(lambda x: zlib.compress(x.encode(), 1)), "binary")(F.array_join(F.array_distinct(tokens), "\n"))


def unpacked(tokens: pa.Array) -> pa.Array:
    return pc.split_pattern(pa.array([zlib.decompress(x).decode() for x in tokens.to_pylist()], pa.string()), "\n")


def hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


class Pool:
    """A tile's pool as it passes by in order of `wild` and `block`: its different tokens, told apart by 64-bit hashes, and every record's tokens by number, in a file.

    Of the tokens only the first letters are kept, as most are in few records, and there are millions of them.
    """

    def __init__(self):
        self.hashes, self.numbers, self.letters = np.zeros(0, np.uint64), np.zeros(0, np.int32), []
        self.ids, self.sizes, self.keys, self.codes = [], [], [], tempfile.TemporaryFile()

    def numbered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' numbers, -1 of those not known; hashes, and where these are or belong."""
        h = hashed(words)
        at = np.searchsorted(self.hashes, h)
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32), h, at
        near = np.minimum(at, len(self.hashes) - 1)
        return np.where(self.hashes[near] == h, self.numbers[near], np.int32(-1)), h, at

    def add(self, records: pa.RecordBatch) -> None:
        lists = unpacked(records.column("tokens"))
        flat = lists.flatten().dictionary_encode()
        code, h, at = self.numbered(flat.dictionary)
        fresh = np.flatnonzero(code < 0)
        code[fresh] = len(self.hashes) + np.arange(len(fresh))
        self.letters.append(pc.utf8_slice_codeunits(flat.dictionary.take(pa.array(fresh)), 0, 1))
        fresh = fresh[np.argsort(h[fresh])]
        self.hashes, self.numbers = np.insert(self.hashes, at[fresh], h[fresh]), np.insert(self.numbers, at[fresh], code[fresh])
        self.ids.append(records.column("entity_id"))
        self.sizes.append(pc.list_value_length(lists).to_numpy().astype(np.int64))
        self.keys.append((records.column("wild").to_numpy(zero_copy_only=False), records.column("block").to_numpy()))
        code[flat.indices.to_numpy()].tofile(self.codes)

    def close(self) -> None:
        self.ids, self.sizes, self.letters = pa.concat_arrays(self.ids), np.concatenate(self.sizes), pa.concat_arrays(self.letters)
        self.wild, self.block = (np.concatenate(x) for x in zip(*self.keys, strict=True))
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])

    def ranges(self, wild: bool, block: int) -> list[tuple[int, int]]:
        """First and last record (not included) of the runs that are a block's pool."""
        if wild:
            return [(0, len(self.ids))]
        inside = np.concatenate([[False], self.wild | (self.block == block), [False]])
        return [(int(x), int(y)) for x, y in np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)]

    def read(self, low: int, high: int) -> np.ndarray:
        self.codes.seek(4 * self.ends[low])
        return np.fromfile(self.codes, np.int32, int(self.ends[high] - self.ends[low]))

    def chunks(self, ranges: list[tuple[int, int]], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """First record, text and word of every entry, and records, of so many records at most."""
        for low, end in ranges:
            while low < end:
                high = max(low + 1, min(low + most, end, int(np.searchsorted(self.ends, self.ends[low] + ENTRIES, "right")) - 1))
                yield low, np.repeat(np.arange(high - low, dtype=np.int32), self.sizes[low:high]), self.read(low, high), high - low
                low = high

    def used(self, ranges: list[tuple[int, int]]) -> tuple[np.ndarray | None, np.ndarray]:
        """The words of these records, None if they may be all, and how many records have each."""
        if 8 * sum(self.ends[high] - self.ends[low] for low, high in ranges) < len(self.letters):
            return np.unique(np.concatenate([self.read(*x) for x in ranges]), return_counts=True)
        df = np.zeros(len(self.letters), np.int32)
        for _, _, word, _ in self.chunks(ranges, SIDE):
            np.add.at(df, word, np.int32(1))
        return None, df


def best_cosines(rows: DataFrame, parts: int, k: int, places: int, weigh: Callable[[pa.Array, np.ndarray, int], np.ndarray], by_pool: bool = False) -> DataFrame:
    """block, s1_id, cand_id and score: in each tile the k best of each record of the first side, or with `by_pool` of each of the pool in each block; ties by id.

    rows: tile, side, block, wild, entity_id and tokens (packed), as grouped() deals them. weigh: tokens' first letters, how many of the pool have each,
    and how many the pool is, to weights before vectors are made of unit length; 0: doesn't count.
    """
    types = pa.schema([("block", pa.int64()), ("s1_id", pa.string()), ("cand_id", pa.string()), ("score", pa.float64())])

    def vectors(text, word, n, weight):
        kept = weight[word] != 0
        text, word = text[kept], word[kept]
        x = weight[word]
        return text, word, x / np.sqrt(np.bincount(text, x * x, n))[text], n

    def numbered(pool, records):
        """Text and word of the entries whose word is the pool's."""
        found = []
        for low in range(0, len(records), 2048):
            lists = unpacked(records["tokens"].slice(low, 2048))
            flat = lists.flatten().dictionary_encode()
            code = pool.numbered(flat.dictionary)[0][flat.indices.to_numpy()]
            found.append((pc.list_parent_indices(lists).to_numpy().astype(np.int32)[code >= 0] + low, code[code >= 0]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def in_block(pool, place, block, wild, ids, text, word):
        ranges = pool.ranges(wild, block)
        if not ranges:
            return
        listed, df = pool.used(ranges)
        letters, n = pool.letters if listed is None else pool.letters.take(pa.array(listed)), sum(high - low for low, high in ranges)
        weight = np.concatenate([weigh(letters.slice(k, ENTRIES), df[k : k + ENTRIES], n) for k in range(0, len(df), ENTRIES)])
        del letters, df
        if listed is not None:
            at = np.minimum(np.searchsorted(listed, word), len(listed) - 1)
            text, word = text[listed[at] == word], at[listed[at] == word]
        text, word, x, _ = vectors(text, word, len(ids), weight)
        shared = np.unique(word)  # of the others only the lengths of the pool's vectors need the weights
        number = np.full(len(weight), -1, np.int32)
        number[shared] = np.arange(len(shared))
        first = text, number[word], x, len(ids)
        if by_pool:
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            index = Index(first, len(shared))
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        out = lambda i, j, x: pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), ids.take(pa.array(i)), pool.ids.take(pa.array(j)), pa.array(x)], schema=types)
        for start, text, word, n in pool.chunks(ranges, SIDE):
            text, word, x, _ = vectors(text, word if listed is None else np.searchsorted(listed, word), n, weight)
            word = number[word]
            chunk = text[word >= 0], word[word >= 0], x[word >= 0], n
            sums = Weighted(chunk, index) if by_pool else Weighted(first, Index(chunk, len(shared)))
            step = max(1, WIDE_STRIP // sums.nb)
            for low in range(0, sums.na, step):
                i, j, x = best_in_rows(sums.strip(low, min(sums.na, low + step)), k, place if by_pool else place[start : start + n], places)
                if by_pool:
                    yield out(j, i + low + start, x)
                else:
                    best = [np.concatenate(y) for y in zip(best, (i + low, j + start, x), strict=True)]
            if not by_pool:
                i, j, x = best
                order = np.lexsort((place[j], -x, i))
                order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
                best = [y[order] for y in best]
        for low in range(0, len(best[0]), 1 << 16):
            yield out(*(y[low : low + (1 << 16)] for y in best))

    def tile(parts):
        pool, ours = Pool(), []
        for batch in parts:
            side = batch.column("side")
            first, rest = (batch.filter(pc.equal(side, x)) for x in (FIRST, POOL))
            if first.num_rows:
                ours.append(first.select(["block", "wild", "entity_id", "tokens"]))
            for low in range(0, rest.num_rows, 4096):
                pool.add(rest.slice(low, 4096))
        if not ours or not pool.ids:
            return
        pool.close()
        pa.default_memory_pool().release_unused()
        place = np.empty(len(pool.ids), np.int64)
        place[pc.sort_indices(pool.ids).to_numpy()] = np.arange(len(place))
        s1 = pa.Table.from_batches(ours)
        parts = [s1.filter(pc.equal(s1["block"], x)) for x in pc.unique(s1["block"])]
        parts = [(x["block"][0].as_py(), x["wild"][0].as_py(), x["entity_id"].combine_chunks(), *numbered(pool, x)) for x in parts]
        pool.hashes = pool.numbers = None
        del ours, s1
        for x in parts:
            yield from in_block(pool, place, *x)

    def run(batches):
        for _, parts in itertools.groupby(pieces(batches), lambda x: x.column("tile")[0].as_py()):
            yield from tile(parts)
            pa.default_memory_pool().release_unused()

    ordered = rows.select("tile", "side", "block", "wild", "entity_id", "tokens").repartition(parts, "tile").sortWithinPartitions("tile", "side", "wild", "block")
    return ordered.mapInArrow(run, "block long, s1_id string, cand_id string, score double")
