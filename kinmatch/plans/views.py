"""Record-linkage inputs made from the driver's documents table.

A document is a record: its first line is the name, its length and all its
other lines the address, its language the country. The name's first letter
stands for the state, which every tenth record lacks. Documents of one language
match if the sets of their texts' runs of five words are similar by 0.8 at least.

Companies made by rule from customers and nations have names and addresses as
records have them, for the queries of normalisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import text as X
from kinmatch.operators import in_tiles, similar, tiles
from kinmatch.sources.tables import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(c):
    """Letters and digits of a text, in lower case, between single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.split("text", "\n")
    prefix = F.when(F.col("doc_id") % 3 == 0, "S1-").when(F.col("doc_id") % 3 == 1, "S2-").otherwise("S3-")
    df = docs.select(
        F.concat(prefix, F.col("doc_id").cast("string")).alias("entity_id"), "doc_id", "text", F.get(lines, F.lit(0)).alias("business_name"),
        F.concat(F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit(" "), F.substring("text", F.length(F.get(lines, F.lit(0))) + 2, F.length("text"))).alias("business_address"), F.coalesce("lang", F.lit("")).alias("country"),
    )
    letter = F.lower(F.substring("business_name", 1, 1))
    df = df.withColumns({"country_key": F.col("country"), "letter": letter, "name_core": plain(F.col("business_name")), "addr_norm": plain(F.col("business_address")), "name_nonlatin": (~F.col("business_name").rlike(X.ASCII)).cast("int")})
    return df.withColumns({
        "name_nospace": F.replace("name_core", F.lit(" "), F.lit("")), "addr_nums": F.array_join(X.numbers(F.col("business_address")), " "), "addr_state": F.when(F.col("doc_id") % 10 == 0, "").otherwise(letter),
        "bk": F.when(F.col("doc_id") % 10 == 0, "").otherwise(letter), "name_skel": X.skeleton(X.words(F.col("name_core"))), "addr_hn": F.lit(""), "addr_zip": F.lit(""), "name_legal": F.lit(""), "addr_blank": F.lit(0), "addr_state_src": (F.col("doc_id") % 10 != 0).cast("int"),
    })


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir)
    return r.where(F.col("entity_id").startswith("S1-")), r.where(~F.col("entity_id").startswith("S1-"))


def with_shingles(df: DataFrame, width: int = 5) -> DataFrame:
    """Adds own: hashes of the country and each of the text's runs of five words, repeats included; of all its words if there are fewer."""
    last = F.greatest(F.size("w") - width + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda k: F.xxhash64("country", F.array_join(F.slice("w", k, F.lit(width)), " ")))
    return df.withColumn("w", X.words(plain(F.col("text")))).withColumn("own", runs).drop("w")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id: each pool record belongs to the least record of the first side that its text is similar to."""
    return similar.owners(records(spark, sf_dir).select("entity_id", "country", "text"), F.col("entity_id").startswith("S1-"), with_shingles)


def rounded(c, places: int = 4):
    return F.floor(c * 10.0**places + 0.5) / 10.0**places


def pairs(spark: SparkSession, sf_dir: str, labelled: bool = True, carried: str | None = None) -> DataFrame:
    """s1_id, cand_id, name_jac, addr_jac, p, p2, label of pairs of one country and first letter with a name's word in common.

    Without `labelled` there is no label. carried, without labels: a column that
    pairs have of both records, with a_ and b_ before its name. A doc_id names one document.
    """
    block, first = ["country", "letter"], F.col("entity_id").startswith("S1-")
    named = records(spark, sf_dir).where("name_core <> ''")
    words = lambda c: tiles.packed(F.split(c, " "))  # of a text only its different words are sent
    rows = tiles.tiled(named.select(*block, "entity_id", words("name_core").alias("name"), words("addr_norm").alias("addr"), *[F.col(c).alias("extra") for c in [carried] if c]), block, first).select("tile", "side", "entity_id", "name", "addr", *["extra"] * bool(carried))
    if labelled:
        places = tiles.tiled(named.select(*block, "entity_id"), block, first).where(F.col("side") == tiles.POOL).select("tile", "entity_id")
        owners = places.join(truth(spark, sf_dir).select(F.col("cand_id").alias("entity_id"), F.col("s1_id").alias("name")), "entity_id")
        rows = rows.unionByName(owners.select("tile", F.lit(tiles.OWNER).alias("side"), "entity_id", F.col("name").cast("binary"), F.lit(b"").alias("addr")))
    found = tiles.similar_names(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), bool(carried))
    name, addr = F.col("name_jac"), F.col("addr_jac")
    return found.select("s1_id", "cand_id", name, addr, rounded(0.6 * name + 0.4 * addr).alias("p"), rounded(0.5 * name + 0.5 * addr).alias("p2"), *([F.col("owned").alias("label")] if labelled else []), *[F.col(f"{x}_extra").alias(f"{x}_{carried}") for x in "ab" if carried])


def pair_values(spark: SparkSession, sf_dir: str, own: Column, measure: tiles.Measure) -> DataFrame:
    """s1_id, cand_id and value, rounded to six places, of the same pairs. own: what `measure` takes, of a record."""
    block = ["country", "letter"]
    named = records(spark, sf_dir).where("name_core <> ''")
    rows = tiles.tiled(named.select(*block, "entity_id", tiles.packed(F.split("name_core", " ")).alias("name"), own.alias("own")), block, F.col("entity_id").startswith("S1-"))
    return tiles.valued_names(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), measure)


def packed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a name, by block: different words of name, address and numbers packed; nospace, a hash of the name; state."""
    words = lambda c: tiles.packed(F.split(c, " "))
    named = records(spark, sf_dir).where("name_core <> ''")
    return named.select("country", "letter", "entity_id", words("name_core").alias("name"), words("addr_norm").alias("addr"), words("addr_nums").alias("nums"), F.xxhash64("name_nospace").alias("nospace"), F.col("addr_state").alias("state"))


def outcomes(spark: SparkSession, sf_dir: str, true: DataFrame, t: float) -> DataFrame:
    """in_tiles.outcomes() of the same pairs. true: what truth() gives."""
    block, first = ["country", "letter"], F.col("entity_id").startswith("S1-")
    packed = checkpoint(packed_records(spark, sf_dir).select(*block, "entity_id", "name", "addr"))
    columns = ["tile", "side", "entity_id", "name", "addr"]
    places = tiles.tiled(packed.select(*block, "entity_id"), block, first).where(F.col("side") == tiles.POOL).select("tile", "entity_id")
    owners = places.join(true.select(F.col("cand_id").alias("entity_id"), F.col("s1_id").cast("binary").alias("name")), "entity_id")
    rows = tiles.tiled(packed, block, first).select(*columns).unionByName(owners.select("tile", F.lit(tiles.OWNER).alias("side"), "entity_id", "name", F.lit(b"").alias("addr")))
    return in_tiles.outcomes(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), t)


def supports(spark: SparkSession, sf_dir: str, most: int = 6, sure: float = 0.3) -> DataFrame:
    """s1_id, cand_id, k_size and in_tiles.SUPPORTS of the same pairs. Names without spaces are told apart by 64-bit hashes."""
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    block, first = ["country", "letter"], F.col("entity_id").startswith("S1-")
    packed = checkpoint(packed_records(spark, sf_dir))
    likely = checkpoint(in_tiles.likeliest(tiles.tiled(packed.select(*block, "entity_id", "name", "addr"), block, first), parts, most + 1, sure))
    dealt = tiles.tiled(packed.select(*block, "entity_id"), block, first).select("tile", "side", "entity_id")
    return in_tiles.supported(in_tiles.support_rows(packed, likely, dealt), parts, most)


#: What companies are made of; numbers pick from the lists. Slots: segment, number.
NAMES = ["The {s} Pvt. Ltd.", "{s} & Sons Co.", "www.{s}-shop.co.in", "{s} Intl. Corp # 12", "{s}'s Bros LLC", "{s} 1234567 Mfg Inc.", "M0bi1e {s} Svcs and Co of the", "The Limited", "Ets {s} S.A.R.L.", "{s} {n} Grp Ctr"]
STREETS = ["{n} North Main Street", "00{n} Oak Avenue, Apartment 7b", "Building {n}15south, fl13", "{n} Rue de la Paix", "Plot {n}, Sector 4, Opposite Park", " {n}  MG Road "]
PLACES = ["Springfield, Ohio 44117", "Dover, DE", "Ada, Texas, NY, 75001 1234", "Chennai, 600 042, Tamil Nadu", "Pune, Maharashtra", "75002 Paris, Ile de France", "Lyon, 69001", "Lima", "Telangana", "Ohio, Texas"]
COUNTRIES = ["USA", "india", " United States ", "France", "Peru", "IN"]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address and country of every customer; every seventeenth has no address."""
    k = F.col("c_custkey")
    pick = lambda values, n: F.get(F.lit(values), F.pmod(n, F.lit(len(values))).cast("int"))
    fill = lambda c: F.replace(F.replace(c, F.lit("{s}"), F.initcap("c_mktsegment")), F.lit("{n}"), k.cast("string"))
    address = F.concat(fill(pick(STREETS, k)), F.lit(", "), pick(PLACES, F.floor(k / 7)))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), k.cast("string")).alias("entity_id"), fill(pick(NAMES, F.floor(k / 3))).alias("business_name"), F.when(k % 17 == 0, "  ").otherwise(address).alias("business_address"), pick(COUNTRIES, F.floor(k / 5)).alias("country"))
