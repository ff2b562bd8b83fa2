"""Pairs of a block in tiles, and similar records by prefixes, against brute force."""

import random
import re

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from kinmatch.operators import decide, evaluate, in_tiles, similar, tiles
from kinmatch.plans import views
from kinmatch.plans.queries import QUERIES, SQL

BY_PAIR = r"hashpartitioning\(s1_id#\d+, (s1_id|cand_id)#\d+|hashpartitioning\((s1_id|cand_id)#\d+, \d+\)"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize(("rows", "columns"), [(1024, 2048), (3, 5)])
def test_tiles(spark, monkeypatch, rows, columns):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choices([f"w{k}" for k in range(12)] + [f"rare{k}" for k in range(300)], [20] * 12 + [1] * 300, k=n))
    recs = [(f"S{1 + k % 3}-{k}", rng.choice(["fr", "de"]), words(rng.randint(1, 4)), words(rng.choice([0, 3, 30]))) for k in range(120)]
    monkeypatch.setattr(tiles, "STRIP", 64)
    df = spark.createDataFrame(recs, "entity_id string, country string, name string, addr string")
    dealt = tiles.tiled(df, ["country"], F.col("entity_id").startswith("S1-"), rows, columns)
    belongs = {r[0]: recs[3 * (k % 40)][0] for k, r in enumerate(recs) if not r[0].startswith("S1-")}
    owned = dealt.where(F.col("side") == tiles.POOL).join(spark.createDataFrame(list(belongs.items()), "entity_id string, owner string"), "entity_id")
    dealt = dealt.select("tile", "side", "entity_id", "name", "addr").unionByName(owned.select("tile", F.lit(tiles.OWNER).alias("side"), "entity_id", F.col("owner").alias("name"), F.lit("").alias("addr")))
    got = sorted(map(tuple, tiles.similar_names(dealt, 4).collect()))
    want = []
    for i, c, n, a in recs:
        for j, c2, n2, a2 in recs:
            if i.startswith("S1-") and not j.startswith("S1-") and c == c2 and set(n.split()) & set(n2.split()):
                want.append((i, j, jaccard(set(n.split()), set(n2.split())), jaccard(set(a.split()), set(a2.split())), int(belongs[j] == i)))
    assert got == sorted(want)


def test_owners(spark):
    rng = random.Random(2)
    base = [[rng.getrandbits(62) for _ in range(rng.choice([1, 4, 5, 40, 3000]))] for _ in range(25)]
    recs = []
    for k in range(200):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(own) // 4))):
            own[rng.randrange(len(own))] = rng.getrandbits(62)
        recs.append((f"S{1 + k % 3}-{k}", own + own[:2]))
    df = spark.createDataFrame(recs, "entity_id string, made array<long>")
    got = {r.cand_id: r.s1_id for r in similar.owners(df, F.col("entity_id").startswith("S1-"), lambda x: x.withColumnRenamed("made", "own")).collect()}
    want = {}
    for j, y in recs:
        found = [i for i, x in recs if i.startswith("S1-") and not j.startswith("S1-") and 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))]
        if found:
            want[j] = min(found)
    assert got == want
    assert len(want) > 20


def test_near_copies_do_not_meet(spark):
    """F5, F10, F20 to F22: of a group whose records share 100 hashes and have 30 each of their own, none is similar to another, and none meet."""
    rng = random.Random(4)
    draw = lambda n: [rng.getrandbits(62) for _ in range(n)]
    shared = draw(100)
    df = spark.createDataFrame([(f"S{1 + k % 3}-{k}", shared + draw(30)) for k in range(60)], "entity_id string, own array<long>")
    last = similar.frequent(df, lambda x: x)
    assert sorted(last[0].tolist()) == sorted(shared) and set(last[1].tolist()) == {60}
    assert not {h for r in similar.signatures(df, last).collect() for h in r.prefix} & set(shared)


def test_sets_are_sent_once(spark):
    """40 records that each meet 100 others: their sets are sent to two pieces or so, and not for each of 4000 pairs; no pair is lost."""
    met = spark.range(40).selectExpr("id as a").crossJoin(spark.range(100, 200).selectExpr("id as b"))
    place, lists = similar._together(met)
    assert place.count() == 100 and lists.count() == 80
    assert lists.join(place, ["g", "piece"]).where(F.array_contains("bs", F.col("b"))).select("a", "b").distinct().count() == 4000


def test_pairs_are_not_sent(spark, sf_dir):
    assert not re.search(BY_PAIR, plan(views.pairs(spark, sf_dir)))


def test_auc_takes_one_pass(spark, sf_dir):
    """F1."""
    assert plan(QUERIES["auc_logloss"](spark, sf_dir)).count("MapInArrow") <= 2  # pairs, and none for the loss


@pytest.mark.parametrize("name", ["mean_of_models", "blend_models"])
def test_scores_stay_where_they_are(spark, sf_dir, name):
    """F8, F12."""
    assert not re.search(BY_PAIR, plan(QUERIES[name](spark, sf_dir)))


def test_decide_drops_unlikely_pairs_first(spark):
    """F2, and with it F3, F4, F6, F7."""
    rows = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.3), ("b", "y", 0.39), ("c", "z", 0.5), ("c", "y", 0.39)], "s1_id string, cand_id string, p double")
    found = decide.decide(rows, 0.35, 0.4)
    assert sorted(map(tuple, found.collect())) == [("a", "x", 0.9), ("c", "z", 0.5)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.rindex("p#") > text.rindex("Window")
    assert re.search(r"Filter \(.*>= 0\.35\)", text[text.rindex("Window") :])


def test_pair_errors_by_few_pairs(spark):
    """F5."""
    pairs = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.3, 1), ("b", "y", 0.8, 0), ("b", "z", 0.2, 1), ("c", "w", 0.7, 0), ("c", "v", 0.01, 0)], "s1_id string, cand_id string, p double, label int")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("d", "u")], "s1_id string, cand_id string")
    matches = pairs.where("p >= 0.6").select("s1_id", "cand_id")
    got = sorted(map(tuple, evaluate.pair_errors(pairs, truth, matches, 0.35).collect()))
    assert got == [("FN", "lost_to_other", 1), ("FN", "near_miss", 1), ("FN", "no_candidate", 1), ("FP", "no_owner", 1), ("FP", "other_owner", 1)]


def test_profile_counts_before_it_joins(spark, sf_dir):
    """F9."""
    text = plan(QUERIES["probability_profile"](spark, sf_dir))
    assert text.rindex("MapInArrow") > text.rindex("partial_max(p")


@pytest.mark.parametrize("name", ["company_levenshtein", "company_jaro_winkler"])
def test_names_are_measured_before_pairs(spark, sf_dir, name):
    """F18, F19."""
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search(r"Join \[(s1_id|cand_id)#", text)
    assert text.index("Generate") < text.index("Join [c_nationkey#")


@pytest.mark.parametrize("name", ["sim_containment", "sim_len_ratio"])
def test_pairs_carry_their_strings(spark, sf_dir, name):
    """F23, F24."""
    assert not re.search(r"Join \[(s1_id|cand_id)#", plan(QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["sim_len_ratio", "sim_containment"])
def test_values_are_found_in_tiles(spark, tmp_path, name):
    """neither strings nor addresses are taken along; a pair's value leaves the tile, in a list of its record's."""
    text = "one 7 9\n" + "7 8 " + "two three " * 1000
    spark.createDataFrame([(k, text, "fr", 7 * (k % 2) + 8) for k in range(1, 13)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    text = plan(df)
    assert "Generate inline" in text and not re.search(r"[ab]_(extra|addr_nums|name_nospace)#", text)
    got = {(r.s1_id, r.cand_id): r.value for r in df.collect()}
    assert len(got) == 32
    nums = lambda i: {"7", "8", str(7 * (i % 2) + 8)}
    share = lambda i, j: len(nums(i) & nums(j)) / len(nums(i)) if name == "sim_containment" else 1.0
    assert all(got[f"S1-{i}", f"S{1 + j % 3}-{j}"] == round(share(i, j), 6) for i in (3, 6, 9, 12) for j in range(1, 13) if j % 3)


def test_values_round_as_spark_rounds(spark):
    """F1, F3."""
    x = [p / q for q in (1, 3, 7, 64, 128, 640, 896, 3200, 80000) for p in range(q + 1)]
    want = [r.v for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("v")).collect()]
    assert tiles.half_up(np.array(x)).tolist() == want


@pytest.mark.parametrize("name", ["mean_of_models", "probability_profile", "band_select", "blend_models"])
def test_tiles_get_words_once_and_packed(spark, tmp_path, name):
    """F8, F9, F11, F12: what is sent grows with a text's different words, and not with its length."""
    text = "one\n" + "two three " * 20_000
    spark.createDataFrame([(k, text, "fr", len(text)) for k in range(1, 13)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    done = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution()
    done.toRdd().count()
    sizes = [int(x) for x in re.findall(r"dataSize=(\d+)", shuffled(done.executedPlan()))]
    assert sizes and max(sizes) < 50_000, "whole texts are 2.4 MB"


@pytest.mark.parametrize("name", ["support_features", "pair_errors"])
def test_small_tiles(spark, sf_dir, duck, monkeypatch, name):
    """no pair is sent, and with small tiles and strips the rows are those of the SQL."""
    monkeypatch.setattr(tiles.tiled, "__defaults__", (13, 17))
    monkeypatch.setattr(in_tiles, "STRIP", 64)
    monkeypatch.setattr(in_tiles, "LISTED", 64)
    df = QUERIES[name](spark, sf_dir)
    if name == "support_features":
        assert not re.search(r"hashpartitioning\(s1_id#\d+, cand_id#\d+|Window.*cand_id", plan(df))
    same_rows(df, duck.execute(SQL[name]))


def test_pair_errors_makes_truth_once(spark, sf_dir, monkeypatch):
    """truth and pairs are made once each, and what is left to do is over few rows."""
    made = []
    for module, name in ((views, "truth"), (in_tiles, "outcomes")):
        monkeypatch.setattr(module, name, lambda *x, f=getattr(module, name), name=name: made.append(name) or f(*x))
    assert "MapInArrow" not in plan(QUERIES["pair_errors"](spark, sf_dir))
    assert sorted(made) == ["outcomes", "truth"]


def test_decided_in_tiles(spark, monkeypatch):
    """matches of outcomes() are decide()'s, ties too, and true pairs have their p."""
    rng = random.Random(5)
    words = lambda n: [f"w{k}" for k in sorted(rng.sample(range(12), n))]
    recs = [(f"S{1 + k % 3}-{k}", rng.choice(["fr", "de"]), words(rng.randint(1, 3)), words(rng.randint(1, 3))) for k in range(150)]
    belongs = {r[0]: recs[3 * rng.randrange(50)][0] for r in recs if not r[0].startswith("S1-")}
    want = []
    for i, c, n, a in recs:
        for j, c2, n2, a2 in recs:
            if i.startswith("S1-") and not j.startswith("S1-") and c == c2 and set(n) & set(n2):
                want.append((i, j, int((0.6 * jaccard(set(n), set(n2)) + 0.4 * jaccard(set(a), set(a2))) * 1e4 + 0.5) / 1e4))
    df = spark.createDataFrame(recs, "entity_id string, country string, name array<string>, addr array<string>").withColumns({c: tiles.packed(F.col(c)) for c in ("name", "addr")})
    dealt = tiles.tiled(df, ["country"], F.col("entity_id").startswith("S1-"), 7, 11).select("tile", "side", "entity_id", "name", "addr")
    owner = spark.createDataFrame(list(belongs.items()), "entity_id string, owner string")
    owned = dealt.where(F.col("side") == tiles.POOL).join(owner, "entity_id").select("tile", F.lit(tiles.OWNER).alias("side"), "entity_id", F.col("owner").cast("binary").alias("name"), F.lit(b"").alias("addr"))
    monkeypatch.setattr(in_tiles, "STRIP", 32)
    found = in_tiles.outcomes(dealt.unionByName(owned), 4, 0.35).cache()
    pairs = spark.createDataFrame(want, "s1_id string, cand_id string, p double")
    got = sorted(map(tuple, in_tiles.decided(found, 0.6).collect()))
    assert got == sorted(map(tuple, decide.decide(pairs, 0.35, 0.6).select("s1_id", "cand_id", "p").collect())) and 20 < len(got) < 100
    assert sorted((r.s1_id, r.cand_id, r.p) for r in found.where("kind = 'true'").collect()) == sorted(x for x in want if belongs[x[1]] == x[0])


def shuffled(plan) -> str:
    """The measured bytes of each exchange of a plan that has run."""
    found, left = [], [plan]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            left.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            found.append(f"dataSize={node.metrics().apply('dataSize').value()}")
        left += [node.children().apply(k) for k in range(node.children().size())]
    return " ".join(found)
