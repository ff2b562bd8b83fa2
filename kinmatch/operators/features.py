"""The 71 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import similarity as S
from kinmatch.functions import text as X

MOST_IDF = 16.0
RECORD = ("entity_id", "name_core", "name_nospace", "name_legal", "name_skel", "addr_norm", "addr_nums", "addr_zip", "addr_state", "addr_hn", "name_nonlatin", "addr_blank", "addr_state_src")

PAIR = (
    "name_exact nospace_exact name_ratio name_tset name_tsort name_partial nospace_jw nospace_lev name_jac name_overlap name_first_tok_eq name_tok_diff name_len_ratio legal_jac"
    " addr_ratio addr_tset addr_jac addr_len_ratio num_jac num_first_eq num_a_in_b state_eq zip_eq idf_match_a idf_match_b idf_matched_sum idf_b_total unmatched_a unmatched_b"
    " hn_edit hn_logdiff hn_len_eq addr_word_jac name_cos2 name_cos3 addr_cos3 skel_cos3 hn_comp_eq"
).split()
CONTEXT = (
    "blk_rel n_cands is_s3 a_name_freq b_name_freq b_nonlatin b_addr_blank b_state_inferred n_name_close b_name_in_s1 a_name_in_pool idf_match_a_rank comb"
    " name_tset_rank name_tset_gap nospace_jw_rank nospace_jw_gap addr_tset_rank addr_tset_gap comb_rank comb_gap"
).split()


def token_idf(pool: DataFrame) -> DataFrame:
    """token, idf over the pool's names."""
    n = pool.agg(F.count("*").alias("n"))
    df = pool.select(F.explode(F.array_distinct(X.words(F.col("name_core")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(n).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def with_idf(records: DataFrame, idf: DataFrame) -> DataFrame:
    """Adds weights: an array of (token, idf) of the name's distinct tokens."""
    tokens = records.select("entity_id", F.explode(F.array_distinct(X.words(F.col("name_core")))).alias("token")).join(idf, "token", "left")
    lists = tokens.groupBy("entity_id").agg(F.collect_list(F.struct("token", F.coalesce("idf", F.lit(MOST_IDF)).alias("idf"))).alias("weights"))
    return records.join(lists, "entity_id", "left").withColumn("weights", F.coalesce("weights", F.array().cast("array<struct<token:string,idf:double>>")))


def name_counts(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """name_core, and how often it is in the first side and in the pool."""
    both = s1.select("name_core", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(pool.select("name_core", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("name_core").agg(F.sum("a").alias("in_s1"), F.sum("b").alias("in_pool"))


def _weights(side: str):
    return F.col(f"{side}_weights")


def idf_alignment() -> dict:
    """Weights of shared tokens against either side's."""
    total = lambda side: F.aggregate(_weights(side), F.lit(0.0), lambda s, w: s + w["idf"])
    names = lambda side: F.transform(_weights(side), lambda w: w["token"])
    shared = F.aggregate(F.filter(_weights("a"), lambda w: F.array_contains(names("b"), w["token"])), F.lit(0.0), lambda s, w: s + w["idf"])
    part = lambda t: F.when(t > 0, shared / t).otherwise(0.0)
    lone = lambda x, y: F.size(F.array_except(names(x), names(y))).cast("double")
    return {"idf_match_a": part(total("a")), "idf_match_b": part(total("b")), "idf_matched_sum": shared, "idf_b_total": total("b"), "unmatched_a": lone("a", "b"), "unmatched_b": lone("b", "a")}


def pair_columns() -> dict:
    """The measures of a pair's own strings but for alignments; columns have a_ and b_ before them."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    words = lambda c: (X.words(a(c)), X.words(b(c)))
    core, legal, addr, nums, zips = (words(c) for c in ("name_core", "name_legal", "addr_norm", "addr_nums", "addr_zip"))
    both = lambda c, value: F.when((a(c) != "") & (b(c) != ""), value).otherwise(-1.0)
    first = lambda side: F.get(side, F.lit(0))
    no_digits = lambda side: F.filter(side, lambda t: ~t.rlike(r"\d"))
    plain = tuple(map(no_digits, addr))
    return {
        "name_exact": (a("name_core") == b("name_core")).cast("double"), "nospace_exact": (a("name_nospace") == b("name_nospace")).cast("double"),
        "nospace_lev": S.levenshtein_similarity(a("name_nospace"), b("name_nospace")), "name_jac": S.jaccard(*core), "name_overlap": S.overlap(*core), "name_first_tok_eq": S.first_equal(*core),
        "name_tok_diff": F.abs(F.size(core[0]) - F.size(core[1])).cast("double"), "name_len_ratio": S.length_ratio(a("name_nospace"), b("name_nospace")), "legal_jac": both("name_legal", S.jaccard(*legal)),
        "addr_jac": both("addr_norm", S.jaccard(*addr)), "addr_len_ratio": both("addr_norm", S.length_ratio(a("addr_norm"), b("addr_norm"))),
        "num_jac": both("addr_nums", S.jaccard(*nums)), "num_first_eq": both("addr_nums", S.first_equal(*nums)), "num_a_in_b": both("addr_nums", S.containment(*nums)),
        "state_eq": S.equal_or_unknown(a("addr_state"), b("addr_state")), "zip_eq": S.share_any(*zips),
        "hn_edit": both("addr_nums", F.levenshtein(first(nums[0]), first(nums[1])).cast("double")), "hn_logdiff": both("addr_nums", S.log_distance(first(nums[0]), first(nums[1]))),
        "hn_len_eq": both("addr_nums", (F.length(first(nums[0])) == F.length(first(nums[1]))).cast("double")),
        "addr_word_jac": both("addr_norm", F.when((F.size(plain[0]) > 0) | (F.size(plain[1]) > 0), S.jaccard(*plain)).otherwise(-1.0)),
        "addr_cos3": both("addr_norm", F.col("_c.cos3")), "skel_cos3": both("name_skel", F.col("_s.cos3")), "hn_comp_eq": S.equal_or_unknown(a("addr_hn"), b("addr_hn")),
    } | idf_alignment()


def paired(pairs: DataFrame, s1: DataFrame, pool: DataFrame, columns) -> DataFrame:
    """Pairs with both records' columns, a_ and b_ before their names. Every id has to be known; see unknown_ids."""
    for side, key, df in (("a", "s1_id", s1), ("b", "cand_id", pool)):
        pairs = pairs.join(df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in columns if c != "entity_id"]), key)
    return pairs


def unknown_ids(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Ids of pairs that no record has; there should be none."""
    lost = lambda key, df: pairs.select(F.col(key).alias("entity_id")).distinct().join(df.select("entity_id"), "entity_id", "left_anti")
    return lost("s1_id", s1).union(lost("cand_id", pool))


def pair_features(candidates: DataFrame, s1: DataFrame, pool: DataFrame, channels) -> DataFrame:
    """s1_id, cand_id and the 71 features, as doubles. candidates has the channels' columns; records have RECORD's."""
    idf, counts = token_idf(pool), name_counts(s1, pool)
    freq = lambda n: F.log1p(F.col(n).cast("double"))

    def ready(df: DataFrame) -> DataFrame:
        return with_idf(df.select(*RECORD), idf).join(counts, "name_core", "left")

    columns = (*RECORD, "weights", "in_s1", "in_pool")
    df = paired(candidates, ready(s1), ready(pool), columns)
    close = lambda c: tuple(F.replace(F.col(f"{side}_{c}"), F.lit(" "), F.lit("")) for side in "ab")
    names = S.aligned(F.col("a_name_core"), F.col("b_name_core"), "ratio", "tset", "tsort", "partial")
    df = df.withColumns({"_n": names, "_j": S.aligned(F.col("a_name_nospace"), F.col("b_name_nospace"), "jw", "cos2", "cos3"), "_c": S.aligned(*close("addr_norm"), "cos3"), "_s": S.aligned(*close("name_skel"), "cos3"), "_a": S.aligned(F.col("a_addr_norm"), F.col("b_addr_norm"), "ratio", "tset")})
    addressed = (F.col("a_addr_norm") != "") & (F.col("b_addr_norm") != "")
    df = df.withColumns(pair_columns() | {f"name_{m}": F.col(f"_n.{m}") for m in ("ratio", "tset", "tsort", "partial")} | {"nospace_jw": F.col("_j.jw"), "name_cos2": F.col("_j.cos2"), "name_cos3": F.col("_j.cos3")} | {f"addr_{m}": F.when(addressed, F.col(f"_a.{m}")).otherwise(-1.0) for m in ("ratio", "tset")})
    df = df.withColumns({
        "is_s3": F.col("cand_id").startswith("S3-"), "a_name_freq": freq("a_in_s1"), "b_name_freq": freq("b_in_pool"), "b_nonlatin": F.col("b_name_nonlatin"), "b_state_inferred": F.col("b_addr_state_src") == 2,
        "b_name_in_s1": freq("b_in_s1"), "a_name_in_pool": freq("a_in_pool"), "comb": 0.5 * F.col("name_tset") + 0.5 * F.greatest("addr_tset", F.lit(0.0)),
    })
    w = Window.partitionBy("s1_id")
    best = lambda c: F.rank().over(w.orderBy(F.desc(c)))
    context = {"blk_rel": F.col("score") / F.greatest(F.max("score").over(w), F.lit(1e-6)), "n_cands": F.count("*").over(w), "n_name_close": F.count_if(F.col("name_tset") >= 0.9).over(w), "idf_match_a_rank": best("idf_match_a")}
    for c in ("name_tset", "nospace_jw", "addr_tset", "comb"):
        context |= {f"{c}_rank": best(c), f"{c}_gap": F.max(c).over(w) - F.col(c)}
    df = df.withColumns(context)
    block = [(c.name, "blk_score" if c.name == "score" else c.name) for c in channels] + [(c.rank, "blk_rank" if c.name == "score" else c.rank) for c in channels]
    return df.select("s1_id", "cand_id", *[F.col(n).cast("double").alias(n) for n in PAIR], *[F.col(c).cast("double").alias(n) for c, n in block], *[F.col(n).cast("double").alias(n) for n in CONTEXT])


def support_measures(supports: DataFrame, pool: DataFrame) -> DataFrame:
    """Supporters with the measures that support_features takes."""
    columns = ("name_core", "name_nospace", "addr_norm", "addr_nums", "addr_zip", "addr_state")
    for side, key in (("a", "cand_id"), ("b", "other")):
        supports = supports.join(pool.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in columns]), key)
    words = lambda c: (X.words(F.col(f"a_{c}")), X.words(F.col(f"b_{c}")))
    pair = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    df = supports.withColumns({"_n": S.aligned(*pair("name_core"), "tset"), "_j": S.aligned(*pair("name_nospace"), "jw"), "_a": S.aligned(*pair("addr_norm"), "tset")})
    filled = lambda c: (F.col(f"a_{c}") != "") & (F.col(f"b_{c}") != "")
    return df.select("s1_id", "cand_id", "other", "p_other", F.col("_n.tset").alias("name"), F.col("_j.jw").alias("nospace"), F.when(filled("addr_norm"), F.col("_a.tset")).otherwise(-1.0).alias("addr"), F.when(filled("addr_nums"), S.jaccard(*words("addr_nums"))).otherwise(-1.0).alias("num"), S.share_any(*words("addr_zip")).alias("zip"), S.equal_or_unknown(*pair("addr_state")).alias("state"))
