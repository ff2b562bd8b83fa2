"""Text functions over Columns. Only Unicode folding of texts that aren't ASCII leaves the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions import lexicon as L

# fixed value: what counts as a mark
MARKS = r"[!-/:-@\[-`{-~ -¿×÷ -⁯₠-⃏℀-⅏।॥　-〿]"
ASCII = r"^[\x00-\x7F]*$"


def squash(c: Column) -> Column:
    """Runs of white space made one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_text(text: str) -> str:
    """Compatibility forms, accents off ASCII letters (marks after other letters stay), lower case."""
    s = unicodedata.normalize("NFKC", text)
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.translate(str.maketrans(L.pairs(L.LETTERS, " "))))
        marks = "".join(re.escape(c) for c in sorted(set(s)) if unicodedata.combining(c))
        if marks:
            s = re.sub(f"([\\x00-\\x7f])[{marks}]+", r"\1", s)
        s = unicodedata.normalize("NFC", s)
    return s.lower()


def _series(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")


def base_clean(c: Column) -> Column:
    """fold_text; ASCII texts, which only need lower case, don't go to Python's work."""
    c = F.coalesce(c, F.lit(""))
    odd = F.when(~c.rlike(ASCII), c)
    return F.coalesce(_series(fold_text)(odd), F.lower(c))


def compatible(c: Column) -> Column:
    """NFKC."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(_series(lambda s: unicodedata.normalize("NFKC", s))(F.when(~c.rlike(ASCII), c)), c)


def has_nonlatin(c: Column) -> Column:
    return c.rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]").cast("int")


def marks_to_space(c: Column) -> Column:
    return F.regexp_replace(c, MARKS, " ")


def light_norm(c: Column) -> Column:
    """What profiling compares by: NFKC, lower case, no marks."""
    return squash(F.regexp_replace(F.lower(compatible(c)), r"(?U)[^\w\s]", " "))


def words(c: Column) -> Column:
    """The words between spaces; none in an empty text."""
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def country_key(c: Column) -> Column:
    """Known spellings made one; any other country stays, in lower case."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(L.lookup(L.pairs(L.COUNTRIES), low), low)


def unwrap_domain(c: Column) -> Column:
    return F.regexp_replace(c, rf"\b(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:{L.DOMAINS.replace(' ', '|')})\b", " $1 ")


def drop_hash_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"#\s*\d+", " ")


def drop_long_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<![a-z0-9])\d{6,}(?![a-z0-9])", " ")


def leet_fix(c: Column) -> Column:
    """A digit between two letters read as the letter that it looks like."""
    for digit, letter in L.pairs(L.DIGITS_AS_LETTERS, " ").items():
        c = F.regexp_replace(c, f"(?<=[a-z]){digit}(?=[a-z])", letter)
    return c


def drop_possessive(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)['’`]s\\b", "")


def name_tokens(raw: Column) -> Column:
    """A name's words, spelled out."""
    s = drop_possessive(leet_fix(drop_long_numbers(drop_hash_numbers(unwrap_domain(base_clean(raw))))))
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    names = L.pairs(L.NAME_WORDS)
    return F.transform(words(marks_to_space(s)), lambda t: F.coalesce(L.lookup(names, t), t))


def split_legal(tokens: Column) -> tuple[Column, Column]:
    """A name's core words, and the words of its legal form, sorted."""
    anywhere, at_end, dropped = L.word_array(L.LEGAL_ANYWHERE), L.word_array(L.LEGAL_AT_END), L.word_array(f"{L.LEGAL_AT_END} {L.DROPPED_AT_END}")
    rest = F.filter(tokens, lambda t: ~F.array_contains(anywhere, t))
    ends = F.coalesce(F.array_max(F.filter(F.transform(rest, lambda t, i: F.when(~F.array_contains(dropped, t), i + 1)), lambda i: i.isNotNull())), F.lit(0))
    body, tail = F.slice(rest, F.lit(1), ends), F.slice(rest, ends + 1, F.size(rest))
    begins = F.coalesce(F.array_min(F.filter(F.transform(body, lambda t, i: F.when(t != L.DROPPED_AT_START, i + 1)), lambda i: i.isNotNull())), F.size(body) + 1)
    core = F.slice(body, begins, F.size(body))
    legal = F.concat(F.filter(tokens, lambda t: F.array_contains(anywhere, t)), F.filter(tail, lambda t: F.array_contains(at_end, t)))
    return F.when(F.size(core) > 0, core).otherwise(tokens), F.sort_array(F.array_distinct(legal))


def _latin_skeleton(word: Column) -> Column:
    for pair, one in L.pairs(L.PAIRS, " ").items():
        word = F.replace(word, F.lit(pair), F.lit(one))
    letters = L.pairs(L.CONSONANTS, " ")
    word = F.replace(F.regexp_replace(word, f"[^{''.join(letters)}]", ""), F.lit("x"), F.lit(letters.pop("x")))
    return F.translate(word, "".join(letters), "".join(letters.values()))


def skeleton_word(word: Column) -> Column:
    """A word's consonants by class, runs made one; Latin and Indic scripts meet in them."""
    source, target = L.indic_table()
    indic = F.translate(F.regexp_replace(word, f"[^{source}]", ""), source, target)
    return F.regexp_replace(F.when(word.rlike(ASCII), _latin_skeleton(word)).otherwise(indic), r"(.)\1+", "$1")


def skeleton_plain(word: str) -> str:
    """skeleton_word of an ASCII word, for the list of legal words."""
    for pair, one in L.pairs(L.PAIRS, " ").items():
        word = word.replace(pair, one)
    letters = L.pairs(L.CONSONANTS, " ")
    return re.sub(r"(.)\1+", r"\1", "".join(letters.get(c, "") for c in word))


def skeleton(tokens: Column) -> Column:
    """The skeletons of a name's words but for legal ones, as one text."""
    legal = F.lit(sorted({skeleton_plain(w) for w in L.LEGAL_FOR_SKELETON.split()} - {""}))
    return F.array_join(F.filter(F.transform(tokens, skeleton_word), lambda w: (w != "") & ~F.array_contains(legal, w)), " ")


def no_zeros(digits: Column) -> Column:
    """A number without zeros before it; nothing but zeros is 0."""
    return F.regexp_replace(digits, r"^0+(?=.)", "")


def numbers(c: Column) -> Column:
    """A text's distinct numbers, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), no_zeros))


def alnum_split(c: Column) -> Column:
    """Letters off numbers before (three or more) and behind (two or more)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\d)(?=[a-z]{3,})", " "), r"(?<=[a-z]{2})(?=\d)", " ")


def composite_number(c: Column) -> Column:
    """The first house number of several parts, joined by slashes; empty if there is none."""
    part = r"(?:[a-z]{1,2}|[a-z]?\d+[a-z]?)"
    found = F.regexp_extract_all(c, F.lit(rf"(?<![a-z0-9])({part}(?:\s?[/-]\s?{part})+)(?![a-z0-9])"), 1)
    fits = F.filter(found, lambda m: m.rlike(r"\d") & ~m.rlike(r"^\d{5,}\s?[/-]"))
    parts = F.transform(F.split(F.get(fits, F.lit(0)), r"\s?[/-]\s?"), no_zeros)
    return F.coalesce(F.array_join(parts, "/"), F.lit(""))


def ngrams(c: Column, n: int) -> Column:
    """Runs of n characters of the text between two hash signs; none of a text that is too short."""
    padded = F.concat(F.lit("#"), c, F.lit("#"))
    count = F.length(padded) - n + 1
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def pair_text(name: Column, address: Column) -> Column:
    """A record as the pair model reads it."""
    return F.format_string("name: %s addr: %s", F.coalesce(name, F.lit("")), F.coalesce(address, F.lit("")))


def hygiene(name: Column, address: Column) -> dict[str, Column]:
    """Flags of how a record is written."""
    out = {}
    for what, c in (("name", name), ("address", address)):
        out |= {f"{what}_outer_space": c != F.trim(c), f"{what}_double_space": c.contains("  "), f"{what}_not_ascii": ~c.rlike(ASCII), f"{what}_all_caps": (F.upper(c) == c) & (F.lower(c) != c)}
    return out | {"name_short": F.length(F.trim(name)) <= 2, "name_is_address": F.trim(name) == F.trim(address)}
