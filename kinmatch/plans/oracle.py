"""DuckDB SQL for the inputs that the queries share."""

from __future__ import annotations

from kinmatch.functions import lexicon as L
from kinmatch.functions.text import skeleton_plain


def _skeleton(word: str) -> str:
    for pair, one in L.pairs(L.PAIRS, " ").items():
        word = f"replace({word}, '{pair}', '{one}')"
    letters = L.pairs(L.CONSONANTS, " ")
    word = f"replace(regexp_replace({word}, '[^{''.join(letters)}]', '', 'g'), 'x', '{letters.pop('x')}')"
    word = f"translate({word}, '{''.join(letters)}', '{''.join(letters.values())}')"
    for c in sorted(set("".join(letters.values()))):
        word = f"regexp_replace({word}, '{c}+', '{c}', 'g')"
    return word


_LEGAL = ", ".join(f"'{x}'" for x in sorted({skeleton_plain(w) for w in L.LEGAL_FOR_SKELETON.split()} - {""}))
_PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

RECORDS = rf"""
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(n_chars, 0) AS n_chars, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL),
rec0 AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END || doc_id AS entity_id, doc_id, text, l[1] AS business_name,
         n_chars || ' ' || substr(text, length(l[1]) + 2) AS business_address, lang AS country FROM docs),
rec1 AS (SELECT *, lower(substr(business_name, 1, 1)) AS letter, {_PLAIN.format("business_name")} AS name_core, {_PLAIN.format("business_address")} AS addr_norm,
         CASE WHEN regexp_matches(business_name, '^[\x00-\x7F]*$') THEN 0 ELSE 1 END AS name_nonlatin,
         list_transform(regexp_extract_all(business_address, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS nums0 FROM rec0),
rec AS (SELECT *, replace(name_core, ' ', '') AS name_nospace, list_filter(string_split(name_core, ' '), lambda x: x <> '') AS nt, list_filter(string_split(addr_norm, ' '), lambda x: x <> '') AS at_,
        list_filter(nums0, lambda x, i: list_position(nums0, x) = i) AS nums, CASE WHEN doc_id % 10 = 0 THEN '' ELSE letter END AS addr_state,
        '' AS name_skel FROM rec1),
s1 AS (SELECT * FROM rec WHERE starts_with(entity_id, 'S1-')),
pool AS (SELECT * FROM rec WHERE NOT starts_with(entity_id, 'S1-'))"""

#: The same with name_skel: the skeleton of every different word once, then put together again.
SKELETONS = rf"""
sw AS MATERIALIZED (SELECT w, {_skeleton("w")} AS k FROM (SELECT DISTINCT unnest(nt) AS w FROM rec_) WHERE regexp_matches(w, '^[\x00-\x7F]*$')),
sj AS (SELECT entity_id, string_agg(k, ' ' ORDER BY i) AS name_skel FROM (SELECT entity_id, generate_subscripts(nt, 1) AS i, unnest(nt) AS w FROM rec_) JOIN sw USING (w) WHERE k <> '' AND k NOT IN ({_LEGAL}) GROUP BY 1),
rec AS MATERIALIZED (SELECT rec_.* EXCLUDE (name_skel), coalesce(sj.name_skel, '') AS name_skel FROM rec_ LEFT JOIN sj USING (entity_id)),"""
RECORDS_WITH_SKELETONS = RECORDS.replace("\nrec AS (", "\nrec_ AS MATERIALIZED (").replace("\ns1 AS (", SKELETONS + "\ns1 AS (")

TRUTH = f"""
truth_wd AS (SELECT entity_id, country, list_filter(string_split({_PLAIN.format("text")}, ' '), lambda x: x <> '') AS w FROM rec),
truth_sh AS (SELECT DISTINCT entity_id, country, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM truth_wd),
truth_ns AS (SELECT entity_id, count(*) AS n FROM truth_sh GROUP BY 1),
truth_lk AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, count(*) AS c FROM truth_sh a JOIN truth_sh b USING (country, s) WHERE starts_with(a.entity_id, 'S1-') AND NOT starts_with(b.entity_id, 'S1-') GROUP BY ALL),
gt AS (SELECT min(s1_id) AS s1_id, cand_id FROM truth_lk JOIN truth_ns x ON x.entity_id = s1_id JOIN truth_ns y ON y.entity_id = cand_id WHERE 5 * c >= 4 * (x.n + y.n - c) GROUP BY cand_id)"""


def jac(a: str, b: str, empty: str = "0.0") -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


PAIRS = f"""
ka AS (SELECT DISTINCT country, letter, unnest(nt) AS token, entity_id FROM s1),
kb AS (SELECT DISTINCT country, letter, unnest(nt) AS token, entity_id FROM pool),
met AS (SELECT DISTINCT ka.entity_id AS s1_id, kb.entity_id AS cand_id FROM ka JOIN kb USING (country, letter, token)),
jac AS (SELECT s1_id, cand_id, {jac("a.nt", "b.nt")} AS name_jac, {jac("a.at_", "b.at_")} AS addr_jac FROM met JOIN s1 a ON a.entity_id = s1_id JOIN pool b ON b.entity_id = cand_id),
pairs AS (SELECT jac.*, floor((0.6::DOUBLE * name_jac + 0.4::DOUBLE * addr_jac) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS p,
          floor((0.5::DOUBLE * name_jac + 0.5::DOUBLE * addr_jac) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS p2, CASE WHEN gt.s1_id IS NULL THEN 0 ELSE 1 END AS label
          FROM jac LEFT JOIN gt USING (s1_id, cand_id))"""


def _grams(text: str, n: int, prefix: str = "") -> str:
    return f"list_transform(CASE WHEN length({text}) < {n} THEN [] ELSE range(1, length({text}) - {n} + 2) END, lambda i: '{prefix}' || substr({text}, i, {n}))"


_ADDRESS = "list_concat(list_transform(list_filter(at_, lambda x: NOT regexp_matches(x, '^[0-9]+$')), lambda x: 'a_' || x), list_transform(nums, lambda x: 'd_' || x))"
TOKENS = {
    "score": f"list_concat(list_concat(list_transform(nt, lambda x: 'n_' || x), CASE WHEN name_nospace <> '' THEN ['s_' || name_nospace] ELSE [] END), {_ADDRESS})",
    "blk_tri": f"CASE WHEN name_nonlatin = 0 AND name_nospace <> '' THEN {_grams(chr(39) + '#' + chr(39) + ' || name_nospace || ' + chr(39) + '#' + chr(39), 3)} ELSE [] END",
    "blk_ad": _ADDRESS,
    "blk_sk": "list_concat(CASE WHEN name_skel <> '' THEN " + _grams("('#' || replace(name_skel, ' ', '#') || '#')", 3, "k_") + f" ELSE [] END, {_ADDRESS})",
}
TOKENS |= {"blk_nl": _ADDRESS, "blk_rev": TOKENS["score"]}
TOKENS["blk_tri"] = "CASE WHEN name_nonlatin = 0 AND name_nospace <> '' THEN " + _grams("('#' || name_nospace || '#')", 3) + " ELSE [] END"


def channel(name: str, k: int, most: float, pool: str, reverse: bool) -> str:
    """CTEs that end with {name}_top (s1_id, cand_id, score, rank)."""
    n, t = name, TOKENS[name]
    ranked = f"SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM {n}_pr"
    if reverse:
        best = f"SELECT *, row_number() OVER (PARTITION BY country, bk, cand_id ORDER BY score DESC, s1_id) AS r FROM {n}_pr"
        ranked = f"SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM (SELECT s1_id, cand_id, max(score) AS score FROM ({best}) WHERE r <= {k} GROUP BY ALL)"
    limit = "" if reverse else f" WHERE rank <= {k}"
    return f"""
{n}_in AS (SELECT p.country, b.bk, p.entity_id, {t} AS tokens FROM pool p JOIN (SELECT DISTINCT country, addr_state AS bk FROM s1) b ON p.country = b.country AND (b.bk = '' OR p.addr_state = '' OR p.addr_state = b.bk) WHERE {pool}),
{n}_pt AS MATERIALIZED (SELECT DISTINCT country, bk, entity_id, unnest(tokens) AS token FROM {n}_in),
{n}_n AS (SELECT country, bk, count(*) AS n FROM {n}_in GROUP BY ALL),
{n}_st AS MATERIALIZED (SELECT country, bk, token, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT country, bk, token, count(*) AS df FROM {n}_pt GROUP BY ALL) JOIN {n}_n USING (country, bk) WHERE df <= greatest({most}::DOUBLE * n, 100.0)),
{n}_b AS (SELECT country, bk, token, entity_id, idf / sqrt(sum(idf * idf) OVER (PARTITION BY country, bk, entity_id)) AS w FROM {n}_pt JOIN {n}_st USING (country, bk, token)),
{n}_at AS MATERIALIZED (SELECT DISTINCT country, addr_state AS bk, entity_id, unnest({t}) AS token FROM s1),
{n}_a AS (SELECT country, bk, token, entity_id, idf / sqrt(sum(idf * idf) OVER (PARTITION BY country, bk, entity_id)) AS w FROM {n}_at JOIN {n}_st USING (country, bk, token)),
{n}_pr AS MATERIALIZED (SELECT * FROM (SELECT country, bk, a.entity_id AS s1_id, b.entity_id AS cand_id, round(sum(a.w * b.w), 6) AS score FROM {n}_a a JOIN {n}_b b USING (country, bk, token) GROUP BY ALL) WHERE score > 1e-9),
{n}_top AS (SELECT * FROM ({ranked}){limit})"""


def having(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def channel_list():
    from kinmatch.operators.blocking import CHANNELS

    return [(c.name, c.k, c.most, c.pool, c.reverse) for c in CHANNELS]


def candidates() -> str:
    """CTEs that end with cand (s1_id, cand_id, a score and a rank for each channel)."""
    parts, rows, columns = [], [], []
    for name, k, most, pool, reverse in channel_list():
        parts.append(channel(name, k, most, pool, reverse))
        rows.append(f"SELECT '{name}' AS channel, * FROM {name}_top")
        rank = "rank" if name == "score" else f"{name}_rank"
        columns += [f"coalesce(max(CASE WHEN channel = '{name}' THEN score END), 0.0) AS {name}", f"coalesce(max(CASE WHEN channel = '{name}' THEN rank END), {k + 1}) AS {rank}"]
    return ",".join([*parts, f"\ncand AS (SELECT s1_id, cand_id, {', '.join(columns)} FROM ({' UNION ALL '.join(rows)}) GROUP BY s1_id, cand_id)"])


# ------------------------------------------------------------ companies and their normalisation
def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _by_country(tables: dict[str, dict[str, str]], key: str) -> str:
    return "CASE ck " + " ".join(f"WHEN '{c}' THEN {_map(t)}[{key}]" for c, t in tables.items()) + " END"


def companies() -> str:
    """CTE co (entity_id, business_name, business_address, country, ck)."""
    from kinmatch.plans import views as V

    pick = lambda values, n: f"{_list(values)}[1 + ({n}) % {len(values)}]"
    fill = lambda c: f"replace(replace({c}, '{{s}}', upper(c_mktsegment[1]) || lower(c_mktsegment[2:])), '{{n}}', k::VARCHAR)"
    known = _map(L.pairs(L.COUNTRIES))
    return f"""
co0 AS (SELECT c_custkey AS k, c_mktsegment FROM customer),
co1 AS (SELECT 'S1-' || k AS entity_id, {fill(pick(V.NAMES, "k // 3"))} AS business_name, CASE WHEN k % 17 = 0 THEN '  ' ELSE {fill(pick(V.STREETS, "k"))} || ', ' || {pick(V.PLACES, "k // 7")} END AS business_address, {pick(V.COUNTRIES, "k // 5")} AS country FROM co0),
co AS (SELECT *, coalesce({known}[lower(trim(country))], lower(trim(country))) AS ck FROM co1)"""


_ASCII_MARKS = r"[!-/:-@\[-`{-~]"


def company_names() -> str:
    """CTE nm (entity_id and the name columns), of co."""
    s = "lower(business_name)"
    s = rf"regexp_replace({s}, '\b(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:{L.DOMAINS.replace(' ', '|')})\b', ' \1 ', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '#\s*[0-9]+', ' ', 'g'), '(^|[^a-z0-9])[0-9]{{6,}}($|[^a-z0-9])', '\1 \2', 'g')"
    for digit, letter in L.pairs(L.DIGITS_AS_LETTERS, " ").items():
        for _ in range(2):  # the letter between two digits is in two matches
            s = rf"regexp_replace({s}, '([a-z]){digit}([a-z])', '\1{letter}\2', 'g')"
    s = rf"replace(replace(regexp_replace({s}, '[''`]s\b', '', 'g'), '&', ' and '), '.', '')"
    anywhere = ", ".join(f"'{w}'" for w in L.LEGAL_ANYWHERE.split())
    at_end = ", ".join(f"'{w}'" for w in L.LEGAL_AT_END.split())
    tail = "|".join([*L.LEGAL_AT_END.split(), *L.DROPPED_AT_END.split()])
    return rf"""
nm0 AS (SELECT entity_id, list_transform(list_filter(string_split(regexp_replace({s}, '{_ASCII_MARKS}', ' ', 'g'), ' '), lambda t: t <> ''), lambda t: coalesce({_map(L.pairs(L.NAME_WORDS))}[t], t)) AS t FROM co),
nm1 AS (SELECT *, array_to_string(list_transform(list_filter(t, lambda x: x NOT IN ({anywhere})), lambda x: ' ' || x), '') AS rest FROM nm0),
nm2 AS (SELECT *, regexp_replace(rest, '(?: (?:{tail}))+$', '') AS body FROM nm1),
nm3 AS (SELECT *, list_filter(string_split(regexp_replace(trim(body), '^(?:the(?: |$))+', ''), ' '), lambda x: x <> '') AS c0, string_split(substr(rest, length(body) + 1), ' ') AS cut FROM nm2),
nm4 AS (SELECT entity_id, t, CASE WHEN len(c0) = 0 THEN t ELSE c0 END AS c, list_sort(list_distinct(list_concat(list_filter(t, lambda x: x IN ({anywhere})), list_filter(cut, lambda x: x IN ({at_end}))))) AS legal FROM nm3),
nm AS (SELECT entity_id, array_to_string(t, ' ') AS name_norm, array_to_string(c, ' ') AS name_core, array_to_string(legal, ' ') AS name_legal, array_to_string(c, '') AS name_nospace, 0 AS name_nonlatin,
       array_to_string(list_filter(list_transform(c, lambda w: {_skeleton("w")}), lambda w: w <> '' AND w NOT IN ({_LEGAL})), ' ') AS name_skel FROM nm4)"""


def company_addresses() -> str:
    """CTE ad (entity_id and the address columns but for addr_hn), of co; and block, its block."""
    from kinmatch.operators import normalize as N

    words = {c: t for c, t in N.address_words().items() if c}
    zips = "CASE ck WHEN 'us' THEN regexp_matches(t, '^[0-9]{5}$') AND j = n AND (n = 1 OR j > 1) WHEN 'france' THEN regexp_matches(t, '^[0-9]{5}$') WHEN 'india' THEN regexp_matches(t, '^[1-8][0-9]{5}$') ELSE false END"
    merged = {c: L.pairs(t) for c, t in L.BLOCKS_MERGED.items()}
    return rf"""
ad0 AS (SELECT entity_id, ck, generate_subscripts(p, 1) AS i, unnest(p) AS c FROM (SELECT entity_id, ck, string_split(replace(lower(business_address), '&', ' and '), ',') AS p FROM co)),
ad1 AS (SELECT entity_id, ck, i, trim(regexp_replace(regexp_replace(c, '{_ASCII_MARKS}', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM ad0),
ad2 AS (SELECT entity_id, ck, i, CASE ck WHEN 'india' THEN regexp_replace(c, '(^|[^0-9])([1-8][0-9]{{2}}) ([0-9]{{3}})($|[^0-9])', '\1\2\3\4', 'g') WHEN 'us' THEN regexp_replace(c, '(^|[^0-9])([0-9]{{5}}) ([0-9]{{4}})$', '\1\2') ELSE c END AS c FROM ad1 WHERE c <> ''),
ad3 AS (SELECT entity_id, ck, i, generate_subscripts(w, 1) AS j, len(w) AS n, unnest(w) AS t FROM (SELECT *, string_split(c, ' ') AS w FROM ad2)),
ad4 AS (SELECT entity_id, ck, i, coalesce(list(t ORDER BY j) FILTER (NOT z), []) AS w, coalesce(list(t ORDER BY j) FILTER (z), []) AS zips FROM (SELECT *, {zips} AS z FROM ad3) GROUP BY ALL),
ad5 AS (SELECT *, array_to_string(w, ' ') AS rest, {_by_country(N.states(), "array_to_string(w, ' ')")} AS state FROM ad4),
ad6 AS (SELECT *, list_transform(string_split(regexp_replace(regexp_replace(rest, '([0-9])([a-z]{{3,}})', '\1 \2', 'g'), '([a-z]{{2}})([0-9])', '\1 \2', 'g'), ' '), lambda t: coalesce(CASE WHEN ck IN ({", ".join(f"'{c}'" for c in words)}) THEN {_by_country(words, "t")} ELSE {_map(N.address_words()[""])}[t] END, t)) AS spelled,
        CASE WHEN state IS NULL THEN list_transform(regexp_extract_all(rest, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) ELSE [] END AS nums FROM ad5),
ad7 AS (SELECT entity_id, string_agg(coalesce(state, array_to_string(spelled, ' ')), ' ' ORDER BY i) FILTER (rest <> '') AS norm, flatten(list(nums ORDER BY i)) AS nums, flatten(list(zips ORDER BY i)) AS zips,
        list(state ORDER BY i) FILTER (rest <> '' AND state = rest) AS codes, list(state ORDER BY i) FILTER (rest <> '' AND state IS NOT NULL) AS names FROM ad6 GROUP BY 1),
ad8 AS (SELECT co.entity_id, ck, coalesce(norm, '') AS addr_norm, coalesce(array_to_string(list_filter(nums, lambda x, i: list_position(nums, x) = i), ' '), '') AS addr_nums, coalesce(array_to_string(list_filter(zips, lambda x, i: list_position(zips, x) = i), ' '), '') AS addr_zip,
        coalesce(codes[len(codes)], names[1], '') AS addr_state, CASE WHEN trim(business_address) = '' THEN 1 ELSE 0 END AS addr_blank FROM co LEFT JOIN ad7 USING (entity_id)),
ad AS (SELECT *, CASE WHEN addr_state <> '' THEN 1 ELSE 0 END AS addr_state_src, coalesce({_by_country(merged, "addr_state")}, addr_state) AS block FROM ad8)"""
