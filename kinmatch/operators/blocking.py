"""Candidate pairs: six top-k similarity joins on token vectors, within blocks of country and state.

A record is a document of tokens. In a block the pool's documents give each
token its inverse frequency; vectors have unit length; two records' score is
the sum, over the tokens they share, of the products of their weights. Tokens in
too many of a block's documents are dropped first. Records go to tiles of some
blocks (see tiles) with all of these blocks' pool, so that tokens are counted,
products summed and each record's best kept there: neither postings nor pairs
that aren't among a tile's best are ever sent.

Pool records without a state are candidates in every block of their country,
and records of the first side without one meet the whole country; both are
written out as copies of the pool's rows, one for each tile.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import lexicon as L
from kinmatch.functions import text as X
from kinmatch.operators import tiles

BLOCK = ["country_key", "bk"]
PLACES = 6  # scores are compared after rounding, so that sums in any order rank alike


def block_key(country: Column, state: Column) -> Column:
    """The state, small ones merged with their neighbour."""
    return F.coalesce(L.by_country({c: L.pairs(t) for c, t in L.BLOCKS_MERGED.items()}, country, state), state)


def prefixed(prefix: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(prefix), t))


def _address_tokens(df: DataFrame) -> Column:
    words = F.filter(X.words(F.col("addr_norm")), lambda t: ~t.rlike(r"^\d+$"))
    house = F.when(F.col("addr_hn") != "", F.array(F.concat(F.lit("h_"), "addr_hn"))).otherwise(F.array().cast("array<string>"))
    return F.concat(prefixed("a_", words), prefixed("d_", X.words(F.col("addr_nums"))), house)


def word_tokens(df: DataFrame) -> Column:
    whole = F.when(F.col("name_nospace") != "", F.array(F.concat(F.lit("s_"), "name_nospace"))).otherwise(F.array().cast("array<string>"))
    return F.concat(prefixed("n_", X.words(F.col("name_core"))), whole, _address_tokens(df))


def trigram_tokens(df: DataFrame) -> Column:
    usable = (F.col("name_nonlatin") == 0) & (F.col("name_nospace") != "")
    return F.when(usable, X.ngrams(F.col("name_nospace"), 3)).otherwise(F.array().cast("array<string>"))


def address_tokens(df: DataFrame) -> Column:
    return _address_tokens(df)


def skeleton_tokens(df: DataFrame) -> Column:
    grams = F.when(F.col("name_skel") != "", X.ngrams(F.replace(F.col("name_skel"), F.lit(" "), F.lit("#")), 3)).otherwise(F.array().cast("array<string>"))
    return F.concat(prefixed("k_", grams), _address_tokens(df))


@dataclass(frozen=True)
class Channel:
    """One way to find candidates. weights: factors by the tokens' first letter, 1 where none is given. pool: which pool records take part."""

    name: str
    tokens: Callable[[DataFrame], Column]
    k: int
    most: float = 0.02
    floor: int = 100
    weights: dict[str, float] = field(default_factory=dict)
    pool: str = "true"
    reverse: bool = False

    @property
    def rank(self) -> str:
        return "rank" if self.name == "score" else f"{self.name}_rank"


CHANNELS = (
    Channel("score", word_tokens, 20),
    Channel("blk_tri", trigram_tokens, 10),
    Channel("blk_nl", address_tokens, 5, most=1.0, pool="name_nonlatin = 1"),
    Channel("blk_sk", skeleton_tokens, 5, most=1.0, pool="name_nonlatin = 1"),
    Channel("blk_ad", address_tokens, 5),
    Channel("blk_rev", word_tokens, 2, reverse=True),
)


def with_blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("bk", block_key(F.col("country_key"), F.col("addr_state")))


def pool_in_blocks(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """The pool's rows, once for each block of the first side that they are candidates in. Both sides have bk."""
    blocks = s1.where("bk is not null").groupBy("country_key").agg(F.collect_set("bk").alias("_blocks"))
    mine = F.filter("_blocks", lambda b: (b == "") | (F.col("bk") == "") | (b == F.col("bk")))
    return pool.join(F.broadcast(blocks), "country_key").withColumn("bk", F.explode(mine)).drop("_blocks")  # a row a country


def postings(side: DataFrame, *columns: str) -> DataFrame:
    """A row for each token. An inner explode would have Catalyst put a filter on the tokens' number below, with all the work of making them."""
    return side.select(*columns, F.explode_outer("tokens").alias("token")).where("token is not null")


def token_statistics(pool: DataFrame, channel: Channel) -> DataFrame:
    """df, n and idf of every token kept, by block; n counts records without tokens too."""
    n = pool.groupBy(*BLOCK).agg(F.count("*").alias("n"))
    df = postings(pool, *BLOCK).groupBy(*BLOCK, "token").agg(F.count("*").alias("df"))
    kept = df.join(n, BLOCK).where(F.col("df") <= F.greatest(F.lit(channel.most) * F.col("n"), F.lit(float(channel.floor))))
    return kept.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def token_weights(most: float, floor: int, factors: dict[str, float]) -> Callable[[pa.Array, np.ndarray, int], np.ndarray]:
    """What token_statistics gives as idf, by the factor of the token's first letter, or 0 of tokens that aren't kept."""

    def weigh(tokens: pa.Array, df: np.ndarray, n: int) -> np.ndarray:
        w = np.where((df <= max(most * n, floor)) & (df > 0), np.log((1 + n) / (1 + df)) + 1, 0.0)
        w[pc.equal(tokens, "").to_numpy(zero_copy_only=False)] = 0  # of records without tokens; the first letter is enough
        for letter, factor in factors.items():
            w[pc.starts_with(tokens, letter).to_numpy(zero_copy_only=False)] *= factor
        return w

    return weigh


def scored_pairs(s1: DataFrame, pool: DataFrame, channel: Channel) -> DataFrame:
    """block, s1_id, cand_id and score of pairs with a kept token in common: of each record of the first side (in a reverse channel of each of the pool, by block) the channel.k best, and maybe more."""
    tokens = tiles.packed(channel.tokens(s1)).alias("tokens")
    listed = lambda df, first: df.select(*BLOCK, "entity_id", tokens, F.lit(first).alias("first"))
    rows = tiles.grouped(listed(s1, True).unionByName(listed(pool.where(channel.pool), False)), *BLOCK, F.col("first"))
    weigh = token_weights(channel.most, channel.floor, channel.weights)
    return tiles.best_cosines(rows, 4 * int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions")), channel.k, PLACES, weigh, channel.reverse)


def best(pairs: DataFrame, by: list[str], tie: str, k: int, rank: str = "rank") -> DataFrame:
    """Of each group the k rows with the greatest score, numbered."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    return pairs.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def channel_pairs(s1: DataFrame, pool: DataFrame, channel: Channel, targets: DataFrame | None = None) -> DataFrame:
    """s1_id, cand_id, score, rank of one channel. targets: the ids of the first side that candidates are wanted for; by default all.

    The reverse channel takes each pool record's best, among all records of the
    first side, and ranks what that gives a target.
    """
    if channel.reverse:
        found = best(scored_pairs(s1, pool, channel), ["block", "cand_id"], "s1_id", channel.k).drop("rank")
        if targets is not None:
            found = found.join(targets.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        found = found.groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")))
    if targets is not None:
        s1 = s1.join(targets.select("entity_id"), "entity_id", "left_semi")
    return best(scored_pairs(s1, pool, channel), ["s1_id"], "cand_id", channel.k).select("s1_id", "cand_id", "score", "rank")


def candidates(s1: DataFrame, pool: DataFrame, channels: tuple[Channel, ...] = CHANNELS, targets: DataFrame | None = None) -> DataFrame:
    """All channels' pairs in one row each: a score (0 if absent) and a rank (k + 1 if absent) for each channel.

    One union and one aggregation in place of a chain of outer joins.
    """
    rows = None
    for c in channels:
        found = channel_pairs(s1, pool, c, targets).withColumn("channel", F.lit(c.name))
        rows = found if rows is None else rows.unionByName(found)
    columns = []
    for c in channels:
        mine = F.col("channel") == c.name
        columns += [F.coalesce(F.max(F.when(mine, F.col("score"))), F.lit(0.0)).alias(c.name), F.coalesce(F.max(F.when(mine, F.col("rank"))), F.lit(c.k + 1)).alias(c.rank)]
    return rows.groupBy("s1_id", "cand_id").agg(*columns)


def blocking_report(found: DataFrame, truth: DataFrame, scope: DataFrame, channels: tuple[Channel, ...] = CHANNELS) -> DataFrame:
    """metric, value: recall in all and by channel, F0.5 that a perfect matcher would reach, and candidates for each record.

    truth: s1_id, cand_id; scope: the ids (entity_id) that count.
    """
    scope = scope.select(F.col("entity_id").alias("s1_id")).distinct()
    truth = truth.join(scope, "s1_id", "left_semi")
    hits = truth.join(found.withColumn("found", F.lit(1)), ["s1_id", "cand_id"], "left")
    by = {c.name: F.coalesce(F.col(c.rank) <= c.k, F.lit(False)) for c in channels}
    wide = [F.avg(F.coalesce("found", F.lit(0)).cast("double")).alias("candidate_recall_union"), F.count("*").cast("double").alias("n_true_pairs"), F.count_if(F.col("found").isNull()).cast("double").alias("missed_pairs")]
    for name, mine in by.items():
        others = F.lit(False)
        for other, hit in by.items():
            others = others if other == name else others | hit
        wide += [F.avg(mine.cast("double")).alias(f"recall_{name}"), F.count_if(mine & ~others).cast("double").alias(f"only_{name}")]
    per = scope.join(hits.groupBy("s1_id").agg(F.count("*").alias("n_true"), F.count("found").alias("tp")), "s1_id", "left").join(found.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").fillna(0)
    recall = F.col("tp") / F.greatest("n_true", F.lit(1))
    ceiling = F.when(F.col("n_true") == 0, 1.0).when(F.col("tp") > 0, 1.25 * recall / (0.25 + recall)).otherwise(0.0)
    per = per.agg(F.count("*").cast("double").alias("n_s1"), F.avg(ceiling).alias("oracle_f05"), F.avg("n").alias("avg_cands"), F.sum("n").cast("double").alias("total_pairs"))
    return _long(hits.agg(*wide)).unionByName(_long(per))


def _long(row: DataFrame) -> DataFrame:
    """A row of measures as rows of metric and value."""
    parts = ", ".join(f"'{c}', `{c}`" for c in row.columns)
    return row.selectExpr(f"stack({len(row.columns)}, {parts}) as (metric, value)").withColumn("value", F.round("value", 6))
