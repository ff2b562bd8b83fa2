import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import similarity as S


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    assert S.common_length(a, b) == brute_common(a, b)


@given(st.text("abc ", max_size=10), st.text("abc ", max_size=10))
@settings(max_examples=100, deadline=None)
def test_ranges(a, b):
    for f in S.MEASURES.values():
        assert -1 <= f(a, b) <= 1 + 1e-9
        assert f(a, b) == pytest.approx(f(b, a))
        if a.split():
            assert f(a, a) == pytest.approx(1)


def test_known_values():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro_winkler("abc", "xyz") == 0
    assert S.ratio("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert S.token_sort_ratio("new york mets", "mets york new") == 1
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert S.token_set_ratio("", "a") == 0
    assert S.partial_ratio("this is a test", "this is a test!") == 1
    assert S.partial_ratio("york", "new york mets") == 1
    assert S.ratio("", "") == 1


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sets(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    r = one(spark, S.jaccard(arr("a", "b"), arr("b", "c")), S.jaccard(arr(), arr()), S.jaccard(arr(), arr(), 1.0), S.overlap(arr("a", "b"), arr("b", "c", "d")), S.overlap(arr(), arr("a")), S.containment(arr("a", "b"), arr("b")), S.share_any(arr("a"), arr()), S.share_any(arr("a"), arr("a")), S.first_equal(arr("a"), arr("a", "b")), S.first_equal(arr(), arr()))
    assert tuple(r) == (1 / 3, 0, 1, 0.5, 0, 0.5, -1, 1, 1, 0)


def test_gram_cosine():
    assert S.gram_cosine("aab", "aab", 2) == pytest.approx(1)
    assert S.gram_cosine("ab", "ac", 2) == pytest.approx(1 / 3)  # #a ab b# and #a ac c#
    assert S.gram_cosine("", "ab", 3) == -1


def test_log_distance(spark):
    r = one(spark, S.log_distance(F.lit("12"), F.lit("15")), S.log_distance(F.lit("1234567890123"), F.lit("1")), S.log_distance(F.lit("x"), F.lit("1")))
    assert r[0] == pytest.approx(math.log1p(3)) and r[1] == pytest.approx(math.log1p(123456788)) and r[2] is None


def test_levenshtein(spark):
    r = one(spark, S.levenshtein_similarity(F.lit("kitten"), F.lit("sitting")), S.levenshtein_similarity(F.lit(""), F.lit("")), S.length_ratio(F.lit("ab"), F.lit("abcd")), S.length_ratio(F.lit(""), F.lit("")), S.equal_or_unknown(F.lit(""), F.lit("a")))
    assert r[0] == pytest.approx(1 - 3 / 7) and tuple(r)[1:] == (1, 0.5, 0, -1)


def test_f_beta(spark):
    f = lambda tp, n, t: S.f_beta(F.lit(tp), F.lit(n), F.lit(t))
    r = one(spark, f(0, 0, 0), f(0, 1, 0), f(0, 0, 2), f(1, 1, 2), f(2, 2, 2))
    assert tuple(r) == (1, 0, 0, pytest.approx(1.25 * 0.5 / 0.75), 1)
