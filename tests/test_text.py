from pyspark.sql import functions as F

from kinmatch.functions import text as X
from kinmatch.functions.lexicon import indic_table
from kinmatch.operators import normalize as N


def values(spark, f, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("t"))).collect()]


def test_squash(spark):
    assert values(spark, X.squash, "  a \t b\u00a0\u3000c ", "") == ["a b c", ""]


def test_fold():
    assert X.fold_text("Élan ŒUVRE Straße") == "elan oeuvre strasse"
    assert X.fold_text("ＡＢＣ") == "abc"
    assert X.fold_text("हिन्दी") == "हिन्दी"


def test_base_clean(spark):
    assert values(spark, X.base_clean, "ABC", "Crème", None) == ["abc", "creme", ""]


def test_nonlatin(spark):
    assert values(spark, X.has_nonlatin, "abc", "Łódź", "दिल्ली", "Ω") == [0, 0, 1, 1]


def test_leet(spark):
    assert values(spark, X.leet_fix, "s0lut1on", "a0", "0a", "b8ker 24", "a01b") == ["solutlon", "a0", "0a", "bbker 24", "a01b"]


def test_cleaning(spark):
    assert values(spark, X.unwrap_domain, "www.tucker-metro.com", "shop.co.in now") == [" tucker-metro ", " shop  now"]
    assert values(spark, X.drop_long_numbers, "x 1234567 y", "x12345678") == ["x   y", "x12345678"]
    assert values(spark, X.drop_possessive, "joe's bar", "joe’s") == ["joe bar", "joe"]


def test_name_parts(spark):
    df = spark.createDataFrame([(1, "The Oak Pvt. Ltd. & Co"), (2, "Company"), (3, "Yazzie Empire Enterprises LLC"), (4, "Sons of the")], "k int, business_name string")
    rows = {r.k: r for r in N.with_names(df).collect()}
    assert (rows[1].name_norm, rows[1].name_core, rows[1].name_legal) == ("the oak private limited and company", "oak", "company limited private")
    assert rows[2].name_core == "company"
    assert (rows[3].name_core, rows[3].name_legal, rows[3].name_nospace) == ("yazzie empire enterprises", "llc", "yazzieempireenterprises")
    assert rows[4].name_core == "sons"


def test_skeleton(spark):
    sk = lambda c: X.skeleton(X.words(c))
    assert values(spark, sk, "mumbai", "bombay limited", "taxi", "shah", "") == ["mnp", "pnp", "tks", "sh", ""]
    assert values(spark, sk, "दिल्ली", "delhi") == ["tl", "tlh"]
    assert len(indic_table()[0]) == len(indic_table()[1]) == 9 * 45  # scripts by letters of a script
    assert len(set(indic_table()[0])) == 9 * 45


def test_skeleton_of_every_indic_script(spark):
    """The word `kamal` has the skeleton `kml` in each script, as its letters stand at the same places."""
    sk = lambda c: X.skeleton(X.words(c))
    kamal = [chr(block + 0x15) + chr(block + 0x2E) + chr(block + 0x32) for block in range(0x0900, 0x0D80, 0x80)]
    assert kamal[0] == "कमल" and kamal[5] == "கமல"
    assert values(spark, sk, *kamal, "kamal") == ["kml"] * 10
    assert values(spark, sk, "मुंबई", "ਸਿੰਘ", "પટેલ", "বাংলা", "சென்னை", "బెంగళూరు", "ಕರ್ನಾಟಕ", "കേരളം") == ["mnp", "sk", "ptl", "pnl", "cn", "pnklr", "krntk", "krln"]


def test_numbers(spark):
    assert values(spark, X.numbers, "007 a 0 12 7", "none") == [["7", "0", "12"], []]


def test_alnum_split(spark):
    assert values(spark, X.alnum_split, "15south", "fl13", "3906a", "33rd", "d1") == ["15 south", "fl 13", "3906a", "33rd", "d1"]


def test_composite_number(spark):
    assert values(spark, X.composite_number, "71/1 main", "no 3-30-28/b/1", "d-21 x", "75001-1234 y", "a/b", "plain", "012/05 q") == ["71/1", "3/30/28/b/1", "d/21", "", "", "", "12/5"]


def test_ngrams(spark):
    assert values(spark, lambda c: X.ngrams(c, 3), "ab", "", "a") == [["#ab", "ab#"], [], ["#a#"]]


def test_country(spark):
    assert values(spark, X.country_key, " USA ", "India", "fr", "Peru", None) == ["us", "india", "france", "peru", ""]


def address(spark, *rows):
    df = spark.createDataFrame([(k, a, c) for k, (a, c) in enumerate(rows)], "k int, business_address string, country_key string")
    return N.with_addresses(df).orderBy("k").collect()


def test_us_address(spark):
    a, b, c = address(spark, ("24800 Euclid Avenue, Euclid, Ohio 44117", "us"), ("24800 Euclid Ave, Euclid, OH", "us"), ("12345 Main St, 75001 1234", "us"))
    assert (a.addr_norm, a.addr_nums, a.addr_zip, a.addr_state) == ("24800 euclid ave euclid oh", "24800", "44117", "oh")
    assert (b.addr_norm, b.addr_state) == ("24800 euclid ave euclid oh", "oh")
    assert (c.addr_nums, c.addr_zip) == ("12345", "75001")


def test_state_preference(spark):
    a, b = address(spark, ("Washington, Texas, NY, CA", "us"), ("Ohio, Texas", "us"))
    assert a.addr_state == "ca" and b.addr_state == "oh"


def test_indian_address(spark):
    a, b = address(spark, ("D-21 Sector 5, Chennai, 600 042, Tamil Nadu", "india"), ("71/1 पथ, दिल्ली", "india"))
    assert (a.addr_zip, a.addr_state, a.addr_hn, a.addr_norm) == ("600042", "tn", "d/21", "d 21 sec 5 chennai tn")
    assert (b.addr_state, b.addr_hn) == ("dl", "71/1")


def test_blank_and_other_country(spark):
    a, b = address(spark, ("  ", "us"), ("1 Building Street, Floor 2", "peru"))
    assert (a.addr_blank, a.addr_norm, a.addr_state, a.addr_hn) == (1, "", "", "")
    assert (b.addr_blank, b.addr_norm) == (0, "1 bldg street fl 2")


def test_learned_states(spark):
    s1 = [(f"S1-{k}", "x", f"{k} Road, Pune, Maharashtra", "India") for k in range(30)] + [("S1-a", "x", "Surat, Gujarat", "India")]
    pool = [("S2-1", "x", "5 Road, Pune", "India"), ("S2-2", "x", "Surat", "India"), ("S2-3", "x", "", "India"), ("S2-4", "x", "Pune, Kerala", "India")]
    names = "entity_id string, business_name string, business_address string, country string"
    a, b = N.normalize_sources(spark.createDataFrame(s1, names), spark.createDataFrame(pool, names))
    rows = {r.entity_id: (r.addr_state, r.addr_state_src) for r in b.collect()}
    assert rows == {"S2-1": ("mh", 2), "S2-2": ("", 0), "S2-3": ("", 0), "S2-4": ("kl", 1)}
    assert "components" not in a.columns
