"""URL filters by a temporal list join.

A list is a history of dated entries (pattern, action add or remove, listed, category). Patterns are
`d:` and a domain, which covers its subdomains, or `p:` and host and path, which covers everything
below. The entries of a pattern and category, in the order of their dates (on one date remove comes
last), become validity intervals: from the date of an add, until the next entry of that category or
the removal of the pattern without a category, which ends all. An as-of join evaluates every capture
against all entries active when it was fetched: each capture is put under the patterns that can cover
it (its host and the parents of it, the prefixes of its path) and meets intervals by pattern,
from <= fetched < to. Only as many parents and prefixes are made as the list's longest pattern of
either kind has parts, so long URLs cost no more than the list can use.

A list of at most SMALL intervals is broadcast, which is checked by counting them; a larger one is
joined by shuffle, captures salted in SALT parts and intervals copied to each, so that a host with a
third of all captures is no single task.

Edge cases: a URL that is null or has no scheme and host is covered by nothing; a capture without a
fetch date is never blocked; entries with a null in pattern, action or date don't count; equal
captures come out once; equal entries count once; of several active entries the first by pattern and
category is named; an empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most intervals that are broadcast.
SMALL = 50_000
SALT = 16


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) of each time that a pattern is on the list; valid_to is null while it still is."""
    rows = entries.select("pattern", F.lower("action").alias("action"), "listed", "category")
    known = rows.where(F.col("pattern").isNotNull() & F.col("listed").isNotNull() & F.col("action").isin("add", "remove")).distinct()
    following = F.lead("listed").over(Window.partitionBy("pattern", "category").orderBy("listed", "action"))
    # a removal without a category ends every category of the pattern: the next one from each date on
    ahead = Window.partitionBy("pattern").orderBy("listed").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    closed = F.min(F.when((F.col("action") == "remove") & F.col("category").isNull(), F.col("listed"))).over(ahead)
    spans = known.select("*", F.least(following, closed).alias("valid_to")).where("action = 'add' and (valid_to is null or valid_to > listed)")
    return spans.select("pattern", "category", F.col("listed").alias("valid_from"), "valid_to")


def patterns_of(host: Column, path: Column, labels_most: int, parts_most: int) -> Column:
    """The patterns of at most so many labels and path parts that can cover a capture; a name of one label is a domain only if it is the host."""
    labels, parts = F.split(host, "\\."), F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, max(parts_most, 1))
    n = F.size(labels)
    first = F.greatest(F.lit(1), n - labels_most + 1)
    last = F.greatest(F.lit(1), n - 1)
    domains = F.when((first <= last) & (F.lit(labels_most) > 0), F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), "."))))
    paths = F.when((F.size(parts) > 0) & (F.lit(parts_most) > 0), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.concat(F.coalesce(domains, none), F.coalesce(paths, none)))


def evaluate(captures: DataFrame, entries: DataFrame, small: int = SMALL) -> DataFrame:
    """(page_id, url, host, fetched, n_active, pattern, category, blocked) of each distinct capture (page_id, url, fetched)."""
    rows = captures.select("page_id", "url", "fetched").distinct().withColumn("host", F.coalesce(host_of("url"), F.lit("")))
    spans = intervals(entries)
    longest = spans.agg(F.max(F.when(F.col("pattern").startswith("d:"), F.size(F.split("pattern", "\\.")))), F.max(F.when(F.col("pattern").startswith("p:"), F.size(F.split("pattern", "/")) - 1))).first()
    keyed = rows.select("page_id", "url", "fetched", F.explode(patterns_of(F.col("host"), F.coalesce(path_of("url"), F.lit("")), longest[0] or 0, longest[1] or 0)).alias("pattern"))
    if spans.limit(small + 1).count() <= small:
        joined = keyed.join(F.broadcast(spans), "pattern")
    else:
        salted = keyed.withColumn("_s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
        copies = spans.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        joined = salted.join(copies, ["pattern", "_s"])
    active = joined.where((F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    met = active.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_active"), F.min(F.struct("pattern", "category")).alias("m"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "url", "fetched")]
    out = rows.alias("a").join(met.alias("b"), same, "left")
    return out.select("a.page_id", "a.url", "a.host", "a.fetched", F.coalesce("b.n_active", F.lit(0).cast("long")).alias("n_active"), F.col("b.m.pattern").alias("pattern"), F.col("b.m.category").alias("category"), F.col("b.n_active").isNotNull().alias("blocked"))


# ---- the query's captures and list: pages have no dates, so both get theirs from ids and hosts
def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with fetch dates spread over four years by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1461)).cast("int")).alias("fetched"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A list history over the hosts of the pages: listed, delisted and listed anew on dates by the hash of the host."""
    hosts = pages.select(host_of("url").alias("host")).where("host <> ''").distinct().withColumn("m", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n)
    host = F.concat(F.lit("d:"), "host")
    entry = lambda pattern, action, listed, category: F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), listed.alias("listed"), F.lit(category).alias("category"))
    events = hosts.where("m % 4 = 0").select(F.explode(F.array(entry(host, "add", day(F.col("m") % 500), "spam"), entry(host, "remove", day(500 + F.col("m") % 300), "spam"))).alias("e"))
    again = hosts.where("m % 8 = 0").select(entry(host, "add", day(900 + F.col("m") % 200), "malware").alias("e"))
    paths = hosts.where("m % 16 = 1").select(entry(F.concat(F.lit("p:"), "host", F.lit("/en")), "add", day(F.col("m") % 700), "section").alias("e"))
    parents = hosts.where("host rlike '(spam-farm|cheap-pills)[.]'").select(entry(F.concat(F.lit("d:"), F.regexp_extract("host", "((?:spam-farm|cheap-pills)[.].*)$", 1)), "add", day(F.lit(366)), "junk").alias("e")).distinct()
    return events.union(again).union(paths).union(parents).select("e.*")


SQL = """
WITH p AS (
  SELECT DISTINCT page_id, url, CAST(DATE '2020-01-01' + CAST((page_id * 37) % 1461 AS INTEGER) AS DATE) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS m FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
e AS (
  SELECT 'd:' || host AS pattern, 'add' AS action, CAST(DATE '2020-01-01' + m % 500 AS DATE) AS listed, 'spam' AS category FROM h WHERE m % 4 = 0
  UNION SELECT 'd:' || host, 'remove', CAST(DATE '2020-01-01' + (500 + m % 300) AS DATE), 'spam' FROM h WHERE m % 4 = 0
  UNION SELECT 'd:' || host, 'add', CAST(DATE '2020-01-01' + (900 + m % 200) AS DATE), 'malware' FROM h WHERE m % 8 = 0
  UNION SELECT 'p:' || host || '/en', 'add', CAST(DATE '2020-01-01' + m % 700 AS DATE), 'section' FROM h WHERE m % 16 = 1
  UNION SELECT 'd:' || regexp_extract(host, '((?:spam-farm|cheap-pills)[.].*)$', 1), 'add', CAST(DATE '2020-01-01' + 366 AS DATE), 'junk' FROM h WHERE regexp_matches(host, '(spam-farm|cheap-pills)[.]')),
s AS (
  SELECT * FROM (SELECT pattern, action, category, listed AS valid_from, lead(listed) OVER (PARTITION BY pattern, category ORDER BY listed, action) AS valid_to FROM e)
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > valid_from)),
k AS (
  SELECT page_id, url, fetched, 'd:' || array_to_string(string_split(host, '.')[i:], '.') AS pattern FROM p, LATERAL (SELECT unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i) WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, 'p:' || host || '/' || array_to_string(parts[1:i], '/') FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE host <> ''),
m AS (
  SELECT page_id, url, fetched, count(*) AS n_active, min(pattern || ' ' || category) AS best FROM k JOIN s USING (pattern)
  WHERE valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY ALL)
SELECT page_id, url, host, fetched, coalesce(n_active, 0) AS n_active, split_part(best, ' ', 1) AS pattern, split_part(best, ' ', 2) AS category, n_active IS NOT NULL AS blocked
FROM p LEFT JOIN m USING (page_id, url, fetched)
"""
