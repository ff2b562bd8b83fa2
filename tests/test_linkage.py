"""Blocking, decisions, evaluation and checks against small brute-force versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinmatch.operators import blocking as B
from kinmatch.operators import decide as D
from kinmatch.operators import evaluate as E
from kinmatch.operators import models, report, tiles
from kinmatch.plans.queries import QUERIES
from kinmatch.sources import tables

RECORD = "entity_id string, country_key string, bk string, name_core string, addr_norm string, addr_nums string"


def recs(spark, rows):
    df = spark.createDataFrame(rows, RECORD)
    return df.withColumns({"name_nospace": F.replace("name_core", F.lit(" "), F.lit("")), "name_nonlatin": F.lit(0), "name_skel": F.lit(""), "addr_hn": F.lit(""), "addr_state": F.col("bk")})


S1 = [("S1-1", "us", "oh", "red oak", "main st", "12"), ("S1-2", "us", "oh", "blue elm", "park ave", "7"), ("S1-3", "us", "", "red elm", "hill rd", ""), ("S1-4", "fr", "idf", "chez paul", "rue x", "3")]
POOL = [("S2-1", "us", "oh", "red oak inn", "main st", "12"), ("S2-2", "us", "", "blue elm", "park ave", "9"), ("S3-1", "us", "tx", "red elm", "hill rd", "1"), ("S3-2", "fr", "idf", "paul", "rue x", "3"), ("S3-3", "us", "oh", "nothing", "alike", "")]


def brute_word(s1, pool, k):
    docs = lambda r: {f"n_{x}" for x in r[3].split()} | {"s_" + r[3].replace(" ", "")} | {f"a_{x}" for x in r[4].split()} | {f"d_{x}" for x in r[5].split()}
    out = {}
    for country, bk in {(r[1], r[2]) for r in s1}:
        inside = [p for p in pool if p[1] == country and (bk == "" or p[2] in ("", bk))]
        df = Counter(t for p in inside for t in docs(p))
        idf = {t: math.log((1 + len(inside)) / (1 + c)) + 1 for t, c in df.items()}
        unit = lambda r, idf=idf: (lambda w: {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()})({t: idf[t] for t in docs(r) if t in idf})
        for s in (r for r in s1 if r[1:3] == (country, bk)):
            a = unit(s)
            scored = [(round(sum(w * b.get(t, 0) for t, w in a.items()), 6), p[0]) for p in inside for b in [unit(p)]]
            for rank, (score, cand) in enumerate(sorted((x for x in scored if x[0] > 1e-9), key=lambda x: (-x[0], x[1]))[:k], 1):
                out[s[0], cand] = (score, rank)
    return out


def test_word_channel(spark):
    got = {(r.s1_id, r.cand_id): (r.score, r["rank"]) for r in B.channel_pairs(recs(spark, S1), recs(spark, POOL), B.CHANNELS[0]).collect()}
    assert got == brute_word(S1, POOL, 20)
    assert got["S1-3", "S3-1"][1] == 1 and ("S1-1", "S2-2") not in got or got["S1-1", "S2-2"][0] < got["S1-1", "S2-1"][0]


def brute_channel(s1, pool, channel):
    """All of a block's scores, from which a channel's rows follow."""
    out = {}
    for country, bk in {(r[1], r[2]) for r in s1}:
        inside = [p for p in pool if p[1] == country and (bk == "" or p[2] in ("", bk))]
        docs = {r[0]: set(r[3].split()) for r in [*s1, *inside]}
        df = Counter(t for p in inside for t in docs[p[0]])
        idf = {t: math.log((1 + len(inside)) / (1 + c)) + 1 for t, c in df.items() if c <= max(channel.most * len(inside), channel.floor)}
        unit = {i: {t: idf[t] / math.sqrt(sum(idf[u] ** 2 for u in d if u in idf)) for t in d if t in idf} for i, d in docs.items()}
        found = [(s[0], p[0], round(sum(x * unit[p[0]].get(t, 0) for t, x in unit[s[0]].items()), 6)) for s in s1 if s[1:3] == (country, bk) for p in inside]
        found = [x for x in found if x[2] > 1e-9]
        if channel.reverse:
            for p in inside:
                for s, c, x in sorted((x for x in found if x[1] == p[0]), key=lambda x: (-x[2], x[0]))[: channel.k]:
                    out[s, c] = max(x, out.get((s, c), 0))
        else:
            out |= {(s, c): x for s, c, x in found}
    ranked = {}
    for s in {s for s, _ in out}:
        best = sorted(((x, c) for (i, c), x in out.items() if i == s), key=lambda x: (-x[0], x[1]))
        ranked |= {(s, c): (x, n) for n, (x, c) in enumerate(best if channel.reverse else best[: channel.k], 1)}
    return ranked


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize(("most", "floor", "reverse"), [(1.0, 100, False), (0.1, 5, False), (1.0, 100, True)])
def test_channels_in_tiles(spark, monkeypatch, small, most, floor, reverse):
    """F13 to F17. Small: many tiles, chunks and strips."""
    rng = random.Random(3)
    words = lambda: " ".join(rng.choices([f"w{k}" for k in range(8)] + [f"rare{k}" for k in range(60)], [20] * 8 + [1] * 60, k=rng.choice([0, 1, 4, 9])))
    made = [(f"S{1 + k % 3}-{k}", rng.choice(["us", "fr"]), rng.choice(["", "a", "b", "c"]), words()) for k in range(150)]
    s1, pool = ([r for r in made if r[0].startswith("S1-") == own] for own in (True, False))
    for name, size in (("SIDE", 7), ("ENTRIES", 40), ("WIDE_STRIP", 16), ("FEW", 3), ("AT_ONCE", 10)) if small else ():
        monkeypatch.setattr(tiles, name, size)
    channel = B.Channel("c", lambda df: F.split("value", " "), 3, most, floor, reverse=reverse)
    df = lambda rows: spark.createDataFrame(rows, "entity_id string, country_key string, bk string, value string")
    got = {(r.s1_id, r.cand_id): (r.score, r["rank"]) for r in B.channel_pairs(df(s1), df(pool), channel).collect()}
    want = brute_channel(s1, pool, channel)
    assert got == want
    assert len(want) > 50


@pytest.mark.parametrize("name", ["block_ad", "block_nl", "block_rev", "block_sk", "block_word"])
def test_channels_send_no_postings(spark, sf_dir, name):
    """F13 to F17."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(Join|hashpartitioning)[^\n]*\btoken#", plan)


@pytest.mark.parametrize("reverse", [False, True])
def test_channels_send_pools_to_tiles_not_blocks(spark, monkeypatch, reverse):
    """a pool record goes once to a tile of many blocks, and once to that of block ''."""
    s1 = [(f"S1-{k}", "us", chr(97 + k % 26) if k % 10 else "", f"w{k % 7} v{k % 5}") for k in range(120)]
    pool = [(f"S2-{k}", "us", chr(97 + k % 26) if k % 10 else "", f"w{k % 7} v{k % 3}") for k in range(200)]
    pool += [("S2-null", "us", None, "w1 v1"), ("S2-none", "us", "#", "w2 v2"), ("S2-far", "fr", "a", "w1 v1")]
    sent, run = [], tiles.best_cosines
    monkeypatch.setattr(tiles, "best_cosines", lambda rows, *args: sent.append(rows) or run(rows, *args))
    channel = B.Channel("c", lambda df: F.split("value", " "), 3, reverse=reverse)
    df = lambda rows: spark.createDataFrame(rows, "entity_id string, country_key string, bk string, value string")
    got = {(r.s1_id, r.cand_id): (r.score, r["rank"]) for r in B.channel_pairs(df(s1), df(pool), channel).collect()}
    assert got == brute_channel(s1, pool, channel)
    assert sent[0].count() <= len(s1) + 2 * len(pool)


def test_targets_and_union(spark):
    s1, pool = recs(spark, S1), recs(spark, POOL)
    some = B.candidates(s1, pool, targets=s1.where("entity_id = 'S1-1'"))
    assert {r.s1_id for r in some.collect()} == {"S1-1"}
    row = B.candidates(s1, pool).where("s1_id = 'S1-1' and cand_id = 'S2-1'").first()
    assert row["rank"] == 1 and row.blk_nl == 0 and row.blk_nl_rank == 6 and row.blk_rev > 0


def test_token_cap(spark):
    pool = recs(spark, [(f"S2-{k}", "us", "oh", f"same n{k}", "", "") for k in range(150)])
    stats = {r.token for r in B.token_statistics(pool.withColumn("tokens", B.word_tokens(pool)), B.CHANNELS[0]).collect()}
    assert "n_same" not in stats and "n_n3" in stats


PAIRS = [("S1-1", "S2-1", 0.9, 1), ("S1-1", "S2-2", 0.5, 0), ("S1-2", "S2-1", 0.8, 0), ("S1-2", "S3-1", 0.75, 1), ("S1-3", "S2-2", 0.4, 0), ("S1-4", "S3-2", 0.2, 0), ("S1-2", "S3-9", 0.75, 0)]


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame(PAIRS, "s1_id string, cand_id string, p double, label int")


def brute_decide(rows, t, top):
    best = {}
    for s, c, p, _ in rows:
        if c not in best or (-p, s) < (-best[c][1], best[c][0]):
            best[c] = (s, p)
    most = {s: max(p for x, _, p, _ in rows if x == s) for s, *_ in rows}
    return {(s, c) for c, (s, p) in best.items() if p >= t and most[s] >= top}


@pytest.mark.parametrize(("t", "top"), [(0.3, 0.3), (0.5, 0.8), (0.7, 0.8), (0.2, 0.9)])
def test_decide(pairs, t, top):
    assert {(r.s1_id, r.cand_id) for r in D.decide(pairs, t, top).collect()} == brute_decide(PAIRS, t, top)


def brute_f(rows, truth, scope, t, top):
    m, total = brute_decide(rows, t, top), 0
    for s in scope:
        pred, true = {c for x, c in m if x == s}, {c for x, c in truth if x == s}
        tp = len(pred & true)
        total += (not pred) if not true else (1.25 * (tp / len(pred)) * (tp / len(true)) / (0.25 * tp / len(pred) + tp / len(true)) if tp else 0)
    return total / len(scope)


def test_tune(spark, pairs):
    truth = [("S1-1", "S2-1"), ("S1-2", "S3-1"), ("S1-2", "S3-7")]
    t = spark.createDataFrame(truth, "s1_id string, cand_id string")
    grid = D.coarse_settings()
    assert len(grid) == 136
    got = {(r.t, r.t_top): r.f05 for r in D.tune_grid(pairs, t, grid).collect()}
    want = {(a, b): round(brute_f(PAIRS, truth, sorted({r[0] for r in PAIRS}), a, b), 6) for a, b in grid}
    assert got == pytest.approx(want, abs=1e-6)
    best = D.tune(pairs, t).first()
    assert best.f05 == pytest.approx(max(want.values()), abs=1e-6) or best.f05 > max(want.values())


def test_group_statistics(pairs):
    rows = {(r.s1_id, r.cand_id): r for r in D.group_statistics(pairs).collect()}
    r = rows["S1-2", "S3-1"]
    assert (r.p1_rank, r.p1_gap, r.p1_second, r.n_ge50, r.n_cands, r.is_s3) == (2, 0.05, 0.75, 3, 3, 1)
    assert rows["S1-4", "S3-2"].p1_second == 0


def test_bands(pairs):
    assert {(r.s1_id, r.cand_id) for r in D.band(pairs, 0.3, 0.8, 1).collect()} == {("S1-1", "S2-2"), ("S1-2", "S2-1"), ("S1-3", "S2-2")}
    assert D.prune(pairs, 0.3, 1).count() == 3


def test_fall_back(spark):
    df = spark.createDataFrame([("a", "x", 0.9, 0.1), ("a", "y", 0.1, 0.2), ("b", "x", 0.5, 0.3), ("b", "y", 0.4, 0.6)], "s1_id string, cand_id string, p1 double, p2 double")
    assert {(r.s1_id, r.cand_id): r.p for r in D.fall_back(df).collect()} == {("a", "x"): 0.9, ("a", "y"): 0.1, ("b", "x"): 0.3, ("b", "y"): 0.6}


def test_scorer(spark):
    ids = spark.createDataFrame([("a", "us"), ("b", "us"), ("c", "fr")], "entity_id string, country_key string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "s1_id string, cand_id string")
    perfect = E.entity_scores(truth, truth, ids)
    assert {r.f for r in perfect.collect()} == {1.0}
    nothing = E.entity_scores(truth.limit(0), truth, ids)
    m = {r.metric: r.value for r in E.metric_pack(nothing).collect()}
    assert m["f05_macro"] == pytest.approx(1 / 3, abs=1e-6) and m["singleton_accuracy"] == 1 and m["false_empty_rate"] == 1
    loss = {(r["by"], r.outcome): r.n for r in E.loss_table(nothing).collect()}
    assert loss["all", "false_empty"] == 2 and loss["all", "singleton_ok"] == 1


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "p double, label int")
    pos, neg = [0.35, 0.8, 0.4], [0.1, 0.4]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 6
    assert E.auc_logloss(df).first().auc == pytest.approx(want)


def test_violations(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    pool = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    sub = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-9,X1,S2-5"), ("S1-8", "S3-1")], "source1_entity_id string, matched_entity_ids string")
    got = {r.rule: r.n for r in report.violations(sub, s1, pool).collect()}
    assert got == {"duplicate_row": 1, "repeated_id": 1, "self_match": 1, "wrong_prefix": 1, "missing_s1": 1, "extra_s1": 1, "unknown_id": 1}
    lines = spark.createDataFrame([("source1_entity_id,matched_entity_ids",), ("S1-1",)], "value string")
    assert {r.rule: r.n for r in report.file_violations(lines).collect()} == {"empty_file": 0, "no_header": 1, "malformed_row": 2, "comma_separated": 1}


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.tsv")
    (tmp_path / "a.tsv").write_text('\ufeffentity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" \\x\t\tUS\n', encoding="utf-8")
    row = tables.read_tsv(spark, path).first()
    assert tuple(row) == ("S1-1", '"Quoted" \\x', "", "US")
    out = str(tmp_path / "out")
    tables.write_tsv(spark.createDataFrame([("a", "")], "source1_entity_id string, matched_entity_ids string").coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "source1_entity_id\tmatched_entity_ids\na\t\n"
    truth = tmp_path / "t.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,\nS1-2\t\n")
    assert [tuple(r) for r in tables.truth_pairs(tables.read_ground_truth(spark, str(truth))).collect()] == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert [r[0] for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]


def test_cache_and_frozen(spark, tmp_path):
    build = lambda: spark.range(5)
    assert tables.cached(spark, str(tmp_path / "c"), build).count() == 5
    with pytest.raises(ValueError):
        tables.cached(spark, str(tmp_path / "c"), build, rows=6)
    tables.write_frozen(spark.range(1), str(tmp_path / "f"))
    with pytest.raises(Exception, match="exist"):
        tables.write_frozen(spark.range(1), str(tmp_path / "f"))


def test_split_is_exact(spark):
    s1 = spark.createDataFrame([(f"S1-{k}", "us" if k % 3 else "fr") for k in range(100)], "entity_id string, country string")
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(0, 100, 2)], "s1_id string, cand_id string")
    rows = report.stratified_split(s1, truth).collect()
    for stratum in {r.stratum for r in rows}:
        own = [r for r in rows if r.stratum == stratum]
        assert sum(r.fold == "holdout" for r in own) == math.floor(0.2 * len(own) + 0.5)


def test_models(spark):
    rows = [(f"S1-{k // 4}", f"S2-{k}", float(k % 4 == 0) + (k % 7) / 20, None if k % 3 else 0.5, int(k % 4 == 0)) for k in range(240)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, x double, p_llm double, label int")
    got = models.out_of_fold(df, ["x", "p_llm"], learner=models.boosted_trees(5)).collect()
    assert len(got) == 240
    assert min(r.p for r in got if r.label) > max(r.p for r in got if not r.label)
    folds = {}
    for r in got:
        folds.setdefault(r.s1_id, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values())


def test_combine(spark):
    t = "source1_entity_id string, matched_entity_ids string"
    out = D.combine(spark.createDataFrame([("a", "1"), ("b", "2")], t), spark.createDataFrame([("a", "9")], t), spark.createDataFrame([("a", "fr"), ("b", "us"), ("c", "fr")], "entity_id string, country_key string"), ["fr"])
    assert {r[0]: r[1] for r in out.collect()} == {"a": "9", "b": "2", "c": ""}


def test_incremental(spark, tmp_path):
    from kinmatch.streaming.incremental import match_new_records

    s1, pool = recs(spark, S1), recs(spark, POOL)
    pool.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pool.schema).parquet(str(tmp_path / "in"))
    q = match_new_records(stream, s1, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert {(r.s1_id, r.cand_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {("S1-1", "S2-1"), ("S1-3", "S3-1")}


def test_whole_chain(spark, tmp_path):
    from kinmatch.plans.linkage import Linkage

    streets = ["Oak", "Elm", "Pine", "Hill", "Lake", "Park", "Main", "Mill"]
    s1 = [(f"S1-{k}", f"{streets[k % 8]} {streets[k // 8]} Trading Inc", f"{100 + k} {streets[k % 7]} Street, Columbus, Ohio", "US") for k in range(40)]
    pool = [(f"S{2 + k % 2}-{k}", f"{streets[k % 8]} {streets[k // 8]} trading", f"{100 + k} {streets[k % 7]} St, Columbus, OH", "USA") for k in range(0, 40, 2)]
    names = "entity_id string, business_name string, business_address string, country string"
    truth = spark.createDataFrame([(f"S1-{k}", f"S{2 + k % 2}-{k}") for k in range(0, 40, 2)], "s1_id string, cand_id string")
    chain = Linkage(spark, str(tmp_path), spark.createDataFrame(s1, names), spark.createDataFrame(pool, names), rounds=3)
    assert len(chain.features().columns) == 2 + 71
    found = {(r.s1_id, r.cand_id) for r in chain.matches(truth).collect()}
    want = {(r.s1_id, r.cand_id) for r in truth.collect()}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 2
