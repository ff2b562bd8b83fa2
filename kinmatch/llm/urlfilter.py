"""URL lists with dates: which captures a list forbade when they were fetched.

A list is a log of dated entries, (pattern, action, at): from `add` on a
pattern holds, until the next entry for it says `remove`. A pattern is a host,
which holds for its subdomains too, or a host and the first part of a path.
Each entry becomes a validity interval that ends at the pattern's next entry,
so that the interval that holds at a time is the latest entry as of then.

Captures bring few different sites (host and first path part). The intervals of
a site's patterns are gathered once a site; captures join them by site and look
up, as of their fetch time, the interval that holds in a list of a few. A site
with a large share of all captures is dealt out over several keys, and its one
row on the other side is copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import free_name, partitions

FIRST_DAY = "2024-01-01"


def site_of(url: Column) -> tuple[Column, Column]:
    """A URL's host, in lower case, without user, port and final dot; and the first part of its path. Null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    part = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return F.when(host != "", host), F.when(part != "", part)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until (null: open) of every stretch in which a pattern holds.

    Of entries at one time `add` counts last. Entries with a null are ignored.
    """
    order = Window.partitionBy("pattern").orderBy("at", F.desc("action"))
    known = entries.where("pattern is not null and at is not null and action in ('add', 'remove')").select(F.lower("pattern").alias("pattern"), "action", "at").distinct()
    dated = known.withColumn("until", F.lead("at").over(order))
    return dated.where("action = 'add' and (until is null or until > at)").select("pattern", F.col("at").alias("since"), "until")


def dealt(captures: DataFrame, site: str, parts: str) -> DataFrame:
    """site and parts: over how many keys the captures of a site with many are dealt, so that each has an even share of a task.

    No more than four sites a partition can have so many, so the result is small.
    """
    tasks = 4 * partitions(captures.sparkSession)
    each = max(1, -(-captures.count() // tasks))
    counts = captures.groupBy(site).agg(F.count("*").alias(parts)).where(F.col(parts) > each)
    return counts.withColumn(parts, F.ceil(F.col(parts) / each).cast("int"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures with host, blocked, pattern and since: of the patterns that held when it was fetched the longest.

    Of equally long ones the last in order, of its intervals the latest. A null
    or odd URL, or a null time, is not blocked; an interval holds at its first
    moment and no more at its last. Captures are kept row by row, repeated ones
    too, with their other columns, whatever their names; those named like the
    four are replaced. Repeated entries count once. Without entries nothing is
    blocked; no captures give no rows.
    """
    host, part = site_of(F.col(url))
    captures = captures.drop("host", "blocked", "pattern", "since").withColumn("host", host)
    columns = [F.col(f"`{c}`") for c in captures.columns]
    site, parts, salt, held = (free_name(captures, n) for n in ("site", "parts", "salt", "held"))
    captures = captures.withColumn(site, F.concat_ws("/", F.coalesce("host", F.lit("")), F.lower(part)))
    hot = F.broadcast(dealt(captures, site, parts))
    labels = F.split(F.split_part(site, F.lit("/"), F.lit(1)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = F.array_distinct(F.concat(suffixes, F.array(site)))
    sites = captures.select(site).distinct().where(F.col(site) != "").select(site, F.explode(keys).alias("pattern"))
    found = sites.join(intervals(entries), "pattern").groupBy(site).agg(F.collect_list(F.struct(F.length("pattern").alias("size"), "pattern", "since", "until")).alias(held))
    found = found.join(hot, site, "left").select(site, held, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1)).alias(salt))
    salted = captures.join(hot, site, "left").withColumn(salt, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col(parts)).cast("int")))
    now = F.col(f"`{fetched}`")
    best = F.array_max(F.filter(held, lambda x: (x["since"] <= now) & (x["until"].isNull() | (x["until"] > now))))
    joined = salted.join(found, [site, salt], "left").withColumn(held, F.array(best))
    best = F.get(held, F.lit(0))
    return joined.select(*columns, best.isNotNull().alias("blocked"), best["pattern"].alias("pattern"), best["since"].alias("since"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages' table has no fetch times; a page's number gives its day in the year."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(365)).cast("int")).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list made from the pages' own hosts, by a hash of each: a third of the hosts come on it, leave it, and half of those come back; of a tenth the path `en` is listed for good."""
    host, _ = site_of(F.col("url"))
    hosts = pages.select(host.alias("h")).where("h is not null").distinct()
    u = F.conv(F.substring(F.md5(F.col("h").cast("binary")), 1, 8), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    hosts = hosts.withColumn("u", u)
    first, gone = F.col("u") % 200, F.col("u") % 200 + 30 + F.col("u") % 90
    entry = lambda when, pattern, action, at: F.when(when, F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), day(at).alias("at")))
    third = F.col("u") % 3 == 0
    listed = F.array(
        entry(third, F.col("h"), "add", first), entry(third, F.col("h"), "remove", gone), entry(third & (F.col("u") % 2 == 0), F.col("h"), "add", gone + 20), entry(F.col("u") % 10 == 1, F.concat("h", F.lit("/en")), "add", F.col("u") % 300)
    )
    return hosts.select(F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("e")).select("e.*")


def filter_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, fetched_at, blocked, pattern and since of every page, by the made-up fetch times and list.

    Odd and null URLs have no host and are not blocked; a null page_id has no
    fetch time and is not either; repeated pages are kept; no pages give none.
    """
    done = evaluate(captures_of(pages), entries_of(pages))
    return done.select("page_id", "host", F.col("fetched_at").cast("string").alias("fetched_at"), "blocked", "pattern", F.col("since").cast("string").alias("since"))


def oracle_sql() -> str:
    host = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '')"
    day = lambda n: f"CAST(DATE '{FIRST_DAY}' + CAST({n} AS INTEGER) AS DATE)"
    return rf"""
    WITH c AS (SELECT page_id, nullif({host}, '') AS host, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1), '')) AS part,
               {day("page_id % 365")} AS fetched_at FROM pages),
    h AS (SELECT h, CAST(('0x' || substr(md5(h), 1, 8)) AS BIGINT) AS u FROM (SELECT DISTINCT host AS h FROM c WHERE host IS NOT NULL)),
    e AS (SELECT h AS pattern, 'add' AS action, {day("u % 200")} AS at_day FROM h WHERE u % 3 = 0
          UNION SELECT h, 'remove', {day("u % 200 + 30 + u % 90")} FROM h WHERE u % 3 = 0
          UNION SELECT h, 'add', {day("u % 200 + 50 + u % 90")} FROM h WHERE u % 3 = 0 AND u % 2 = 0
          UNION SELECT h || '/en', 'add', {day("u % 300")} FROM h WHERE u % 10 = 1),
    held AS (SELECT c.page_id, c.host, c.fetched_at, e.pattern, e.action, e.at_day,
                    row_number() OVER (PARTITION BY c.page_id, c.host, c.fetched_at, e.pattern ORDER BY e.at_day DESC, e.action) AS k
             FROM c JOIN e ON e.at_day <= c.fetched_at AND (c.host = e.pattern OR ends_with(c.host, '.' || e.pattern) OR c.host || '/' || c.part = e.pattern)),
    best AS (SELECT *, row_number() OVER (PARTITION BY page_id, host, fetched_at ORDER BY length(pattern) DESC, pattern DESC) AS r FROM held WHERE k = 1 AND action = 'add')
    SELECT c.page_id, c.host, CAST(c.fetched_at AS VARCHAR) AS fetched_at, best.pattern IS NOT NULL AS blocked, best.pattern, CAST(best.at_day AS VARCHAR) AS since
    FROM c LEFT JOIN best ON best.page_id = c.page_id AND best.host = c.host AND best.r = 1
    """
