"""Records made comparable: names, addresses, and states learned from address parts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import lexicon as L
from kinmatch.functions import text as X

NAME_COLUMNS = ("name_norm", "name_core", "name_legal", "name_nospace", "name_nonlatin", "name_skel")
ADDRESS_COLUMNS = ("addr_norm", "addr_nums", "addr_zip", "addr_state", "addr_blank", "addr_hn")


@cache
def address_words() -> dict[str, dict[str, str]]:
    common = L.pairs(L.ADDRESS_WORDS[""])
    return {c: common | L.pairs(words) for c, words in L.ADDRESS_WORDS.items()}


@cache
def states() -> dict[str, dict[str, str]]:
    return {c: L.with_values(L.cleaned_keys(L.pairs(text))) for c, text in L.STATES.items()}


def with_names(df: DataFrame) -> DataFrame:
    """Adds the NAME_COLUMNS."""
    df = df.withColumn("_words", X.name_tokens(F.col("business_name")))
    core, legal = X.split_legal(F.col("_words"))
    df = df.withColumn("_core", core).withColumn("name_legal", F.array_join(legal, " "))
    return df.withColumns({
        "name_norm": F.array_join("_words", " "), "name_core": F.array_join("_core", " "), "name_nospace": F.array_join("_core", ""),
        "name_nonlatin": X.has_nonlatin(X.base_clean(F.col("business_name"))), "name_skel": X.skeleton(F.col("_core")),
    }).drop("_words", "_core")


def address_parts(clean: Column, country: Column) -> Column:
    """An address's parts between commas, without marks; parted postcodes made one."""
    marked = F.transform(F.split(clean, ","), lambda c: X.squash(X.marks_to_space(c)))

    def joined(c: Column) -> Column:
        india = F.regexp_replace(c, r"(?<!\d)([1-8]\d{2}) (\d{3})(?!\d)", "$1$2")
        us = F.regexp_replace(c, r"(?<!\d)(\d{5}) (\d{4})$", "$1")
        return F.when(country == "india", india).when(country == "us", us).otherwise(c)

    return F.filter(F.transform(marked, joined), lambda c: c != "")


def is_postcode(token: Column, at: Column, n: Column, country: Column) -> Column:
    """In the US five digits are one only at the end of a part, and not at its start unless alone."""
    fits = F.lit(False)
    for c, pattern in L.POSTCODES.items():
        fits = F.when(country == c, token.rlike(f"^{pattern}$")).otherwise(fits)
    return fits & ((country != "us") | ((at == n - 1) & ((n == 1) | (at > 0))))


def mapped_words(words: Column, country: Column) -> Column:
    tables = address_words()
    known = {c: t for c, t in tables.items() if c}
    return F.transform(words, lambda t: F.coalesce(F.when(country.isin(list(known)), L.by_country(known, country, t)).otherwise(L.lookup(tables[""], t)), t))


def with_addresses(df: DataFrame) -> DataFrame:
    """Adds the ADDRESS_COLUMNS; needs country_key."""
    country = F.col("country_key")
    raw = F.coalesce(F.col("business_address"), F.lit(""))
    blank = F.trim(X.squash(raw)) == ""
    df = df.withColumn("_clean", F.replace(X.base_clean(raw), F.lit("&"), F.lit(" and ")))

    def part(c: Column) -> Column:
        words = F.split(c, " ")
        code = lambda t, i: is_postcode(t, i, F.size(words), country)
        return F.struct(F.filter(words, code).alias("zips"), F.array_join(F.filter(words, lambda t, i: ~code(t, i)), " ").alias("rest"))

    df = df.withColumn("_parts", F.transform(address_parts(F.col("_clean"), country), part))
    named = F.transform(F.filter("_parts", lambda p: p["rest"] != ""), lambda p: F.struct(p["rest"].alias("rest"), L.by_country(states(), country, p["rest"]).alias("state")))
    df = df.withColumn("_named", named)
    codes = F.filter("_named", lambda p: p["state"] == p["rest"])
    spelled = F.filter("_named", lambda p: p["state"].isNotNull())
    state = F.coalesce(F.when(F.size(codes) > 0, F.element_at(codes, -1)["state"]), F.get(spelled, F.lit(0))["state"], F.lit(""))
    norm = F.transform("_named", lambda p: F.coalesce(p["state"], F.array_join(mapped_words(X.words(X.alnum_split(p["rest"])), country), " ")))
    numbers = F.array_distinct(F.flatten(F.transform(F.filter("_named", lambda p: p["state"].isNull()), lambda p: X.numbers(p["rest"]))))
    filled = lambda c: F.when(blank, F.lit("")).otherwise(c)
    return df.withColumns({
        "addr_norm": filled(F.array_join(norm, " ")), "addr_nums": filled(F.array_join(numbers, " ")), "addr_zip": filled(F.array_join(F.array_distinct(F.flatten(F.col("_parts.zips"))), " ")),
        "addr_state": filled(state), "addr_blank": blank.cast("int"), "addr_hn": filled(X.composite_number(F.col("_clean"))),
    }).drop("_clean", "_parts", "_named")


def normalize(df: DataFrame) -> DataFrame:
    """Raw records with all normalised columns; addr_state_src is 1 where the address names its state."""
    df = df.withColumn("country", F.trim(F.coalesce("country", F.lit("")))).withColumn("country_key", X.country_key(F.col("country")))
    df = with_addresses(with_names(df))
    return df.withColumn("addr_state_src", (F.col("addr_state") != "").cast("int"))


def component_keys(address: Column, country: Column) -> Column:
    """An address's parts as look-up keys: words spelled alike, those with digits dropped."""
    clean = F.replace(X.base_clean(address), F.lit("&"), F.lit(" and "))
    keys = F.transform(address_parts(clean, country), lambda c: F.array_join(mapped_words(F.filter(F.split(c, " "), lambda t: ~t.rlike(r"\d")), country), " "))
    return F.filter(keys, lambda k: k != "")


def with_components(df: DataFrame) -> DataFrame:
    return df.withColumn("components", component_keys(F.col("business_address"), F.col("country_key")))


def learn_states(df: DataFrame, least: int = 20, purity: float = 0.98) -> DataFrame:
    """country_key, component, addr_state, n, purity: parts (array column `components`) that nearly always go with one state.

    Learned from records with a state; a part that is itself a state's name is skipped.
    """
    rows = df.where("addr_state <> ''").select("country_key", "addr_state", F.explode(F.array_distinct("components")).alias("component"))
    rows = rows.where(L.by_country(states(), F.col("country_key"), F.col("component")).isNull())
    counts = rows.groupBy("country_key", "component", "addr_state").agg(F.count("*").alias("n"))
    total = counts.groupBy("country_key", "component").agg(F.sum("n").alias("total"))
    found = counts.join(total, ["country_key", "component"]).withColumn("purity", F.col("n") / F.col("total"))
    return found.where((F.col("n") >= least) & (F.col("purity") >= purity)).drop("total")


def fill_states(df: DataFrame, learned: DataFrame) -> DataFrame:
    """Fills an empty state by its parts' votes, one a part; a tie for the most leaves it empty. Sets addr_state_src to 2."""
    missing = df.where("addr_state = '' and addr_blank = 0").select("entity_id", "country_key", F.explode("components").alias("component"))
    votes = missing.join(learned.select("country_key", "component", F.col("addr_state").alias("state")), ["country_key", "component"]).groupBy("entity_id", "state").count()
    ranked = votes.withColumn("second", F.lead("count").over(order := Window.partitionBy("entity_id").orderBy(F.desc("count"), "state"))).withColumn("place", F.row_number().over(order))
    winners = ranked.where("place = 1 and (second is null or count > second)").select("entity_id", "state")
    out = df.join(winners, "entity_id", "left")
    filled = F.col("state").isNotNull()
    return out.withColumn("addr_state_src", F.when(filled, 2).otherwise(F.col("addr_state_src"))).withColumn("addr_state", F.coalesce("state", "addr_state")).drop("state")


def normalize_sources(s1: DataFrame, pool: DataFrame, least: int = 20, purity: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """Both sides normalised, the pool's states filled from what the first side's addresses teach."""
    a, b = with_components(normalize(s1)), with_components(normalize(pool))
    return a.drop("components"), fill_states(b, learn_states(a, least, purity)).drop("components")


PAIR_STATS = ("same_country", "norm_equal", "core_equal", "nospace_equal", "light_equal", "name_jac", "name_none", "addr_equal", "addr_jac", "num_share", "state_equal")


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """Averages that show how alike pairs are; pairs hold both records' columns with a_ and b_ before them."""
    from kinmatch.functions import similarity as S

    both = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    tokens = lambda side, c: X.words(F.col(f"{side}_{c}"))
    name, addr = S.jaccard(tokens("a", "name_core"), tokens("b", "name_core"), 1.0), S.jaccard(tokens("a", "addr_norm"), tokens("b", "addr_norm"), 1.0)
    shared = F.arrays_overlap(tokens("a", "addr_nums"), tokens("b", "addr_nums"))
    measures = [both("country_key"), both("name_norm"), both("name_core"), both("name_nospace"), X.light_norm(F.col("a_business_name")) == X.light_norm(F.col("b_business_name")), name, name == 0, both("addr_norm"), addr, shared, both("addr_state")]
    return pairs.agg(F.count("*").alias("n"), *[F.avg(m.cast("double")).alias(n) for n, m in zip(PAIR_STATS, measures, strict=True)])
