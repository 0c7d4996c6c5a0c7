"""Temporal list join: which list entries were active for a URL when it was fetched.

Dated entries on a pattern become validity intervals that end where the pattern's next entry begins. A
capture asks for every pattern that could cover its URL: its host, the domains above it, its
folders and its path. An as-of join on pattern and month finds the intervals open at fetch time, and
the longest of their patterns decides. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Of entries of one pattern and day, the last of these holds.
ACTIONS = ["remove", "allow", "block"]


def host_of(url: Column) -> Column:
    """The host in lower case: no scheme, user, port or final dot. Null for a null URL."""
    rest = F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(rest, r"[/?#].*$", "")), r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def path_of(url: Column) -> Column:
    """The path from its first slash on, without query and fragment; a slash alone if there is none."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
    path = F.regexp_replace(rest, r"^[^/]*", "")
    return F.when(path == "", "/").otherwise(path)


def patterns_of(host: Column, path: Column, sizes: Column) -> Column:
    """The patterns of a listed length that cover a URL: the host and the domains above it but the last label, the host's folders, the whole path.

    sizes: the lengths of listed domains (``domains``) and of listed folders and paths (``paths``). A long URL is cut at listed lengths only, so
    what is made from it is bounded by the list.
    """
    whole, n = F.concat(host, path), F.length(host)
    full = n + F.length(path)
    above = F.transform(F.filter(sizes["domains"], lambda k: (k < n) & (F.substring(host, n - k, F.lit(1)) == ".")), lambda k: F.right(host, k))
    domains = F.concat(F.array(host), F.filter(above, lambda d: F.contains(d, F.lit("."))))
    folders = F.filter(sizes["paths"], lambda k: (k > n) & (k < full) & (F.substring(whole, k, F.lit(1)) == "/"))
    return F.concat(domains, F.transform(folders, lambda k: F.left(whole, k)), F.array(whole))


def listed_sizes(entries: DataFrame) -> DataFrame:
    """One row of two arrays: the distinct lengths of listed domains, and of listed folders and paths."""
    path = F.contains("pattern", F.lit("/"))
    n = F.length("pattern")
    return entries.agg(F.struct(F.collect_set(F.when(~path, n)).alias("domains"), F.collect_set(F.when(path, n)).alias("paths")).alias("sizes"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, listed_on, until, action): dated entries as intervals, open at the end where ``until`` is null.

    Entries without pattern, date or known action are left out. Of several entries of a pattern and a day
    the last of ``ACTIONS`` holds, so repeated entries count once.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    # Only the host's case doesn't matter.
    lowered = F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)"))
    known = entries.select(lowered.alias("pattern"), F.col("listed_on").cast("date").alias("listed_on"), rank.alias("rank"))
    daily = known.where("pattern is not null and listed_on is not null and rank > 0").groupBy("pattern", "listed_on").agg(F.max("rank").cast("int").alias("rank"))
    following = Window.partitionBy("pattern").orderBy("listed_on")
    spans = daily.withColumn("until", F.lead("listed_on").over(following)).where("rank > 1")
    return spans.select("pattern", "listed_on", "until", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank")).alias("action"))


def temporal_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """(id, host, fetched_on, pattern, listed_on, action, blocked) for every capture.

    The longest pattern active at fetch time decides (of equally long ones the last in the alphabet); without one the
    action is ``none``. An entry is active from its day on, up to the day before the next one of its pattern. A null or empty URL
    or a null time matches nothing. Repeated captures give repeated rows; an empty list gives ``none`` throughout, an empty table of
    captures no rows. Other columns, however named, are pruned. A URL's length costs no more than reading it.
    Intervals are dealt over the months they touch up to the last capture's, so a host with a third of
    all captures is met in as many parts as there are months, and further split where it is skewed.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("date").alias("day"), host.alias("host"), path.alias("path"))
    month = lambda c: F.year(c) * 12 + F.month(c)
    spans = intervals(entries)
    sizes = listed_sizes(spans)  # one row, of as many numbers as patterns have lengths
    patterns = F.when((F.col("host") != "") & F.col("day").isNotNull(), F.array_distinct(patterns_of(F.col("host"), F.col("path"), F.col("sizes"))))
    asked = own.groupBy("id", "url", "day", "host", "path").agg(F.count(F.lit(1)).alias("copies")).crossJoin(F.broadcast(sizes))
    asked = asked.withColumn("pattern", F.explode_outer(patterns)).drop("sizes", "path").withColumn("month", month(F.col("day")))
    last = captures.agg(F.max(F.col(time_col).cast("date")).alias("last"))  # one row
    spans = spans.crossJoin(F.broadcast(last)).where("listed_on <= last")
    ends = F.least(F.coalesce(F.date_sub("until", 1), F.col("last")), F.col("last"))
    spans = spans.select("pattern", "listed_on", "until", "action", F.explode(F.sequence(month(F.col("listed_on")), F.greatest(month(F.col("listed_on")), month(ends)))).alias("month"))
    a, s = asked.alias("a"), spans.alias("s")
    active = (F.col("a.pattern") == F.col("s.pattern")) & (F.col("a.month") == F.col("s.month")) & (F.col("s.listed_on") <= F.col("a.day")) & (F.col("s.until").isNull() | (F.col("a.day") < F.col("s.until")))
    met = a.join(s, active, "left").select("a.id", "a.url", "a.day", "a.host", "a.copies", F.when(F.col("s.pattern").isNotNull(), F.struct(F.length("s.pattern").alias("size"), F.col("s.pattern").alias("pattern"), "s.listed_on", "s.action")).alias("hit"))
    best = met.groupBy("id", "url", "day", "host").agg(F.max("hit").alias("hit"), F.first("copies").alias("copies"))
    action = F.coalesce("hit.action", F.lit("none"))
    out = best.select(F.col("id").alias(id_col), "host", F.col("day").alias(time_col), "hit.pattern", "hit.listed_on", action.alias("action"), (action == "block").alias("blocked"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a made-up day of fetching in 2023 and 2024, which the tables lack."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(731)).cast("int")).alias("fetched_on"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A made-up dated list: every host is blocked, taken off and put on again, the latter as blocked or allowed; every
    language folder is listed for 90 days; every domain of two labels is blocked for 45 days."""
    host = pages.select(host_of(F.col("url")).alias("h"), F.split(path_of(F.col("url")), "/")[1].alias("f")).where("h <> ''")
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n)

    def listed(keys: DataFrame, *steps) -> DataFrame:
        rows = keys.distinct().withColumn("n", number(F.col("k").cast("binary")))
        return rows.select(F.col("k").alias("pattern"), F.explode(F.array(*(F.struct(day(when).alias("listed_on"), what.alias("action")) for when, what in steps))).alias("e")).select("pattern", "e.*")

    n = F.col("n")
    hosts = listed(host.select(F.col("h").alias("k")), (n % 300, F.lit("block")), (n % 300 + 60 + n % 200, F.lit("remove")), (n % 300 + 400, F.when(n % 2 == 0, "block").otherwise("allow")))
    folders = listed(host.select(F.concat("h", F.lit("/"), "f", F.lit("/")).alias("k")), (n % 500, F.when(n % 3 == 0, "allow").otherwise("block")), (n % 500 + 90, F.lit("remove")))
    domains = listed(host.select(F.substring_index("h", ".", -2).alias("k")), (n % 200, F.lit("block")), (n % 200 + 45, F.lit("remove")))
    return hosts.unionByName(folders).unionByName(domains)


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest,
         DATE '2023-01-01' + CAST((page_id * 7919) % 731 AS INTEGER) AS fetched_on
  FROM pages),
c AS (
  SELECT page_id, url, fetched_on,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(rest, '[/?#].*$', '')), '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS host,
         CASE WHEN regexp_replace(regexp_replace(rest, '[?#].*$', ''), '^[^/]*', '') = '' THEN '/'
              ELSE regexp_replace(regexp_replace(rest, '[?#].*$', ''), '^[^/]*', '') END AS path
  FROM p),
keys AS (
  SELECT DISTINCT host AS k, 1 AS kind FROM c WHERE host <> ''
  UNION ALL SELECT DISTINCT host || '/' || string_split(path, '/')[2] || '/', 2 FROM c WHERE host <> ''
  UNION ALL SELECT DISTINCT regexp_replace(host, '^.*\.([^.]*\.[^.]*)$', '\1'), 3 FROM c WHERE host <> ''),
n AS (SELECT k, kind, CAST('0x' || substr(md5(k), 1, 6) AS BIGINT) AS n FROM keys),
entries AS (
  SELECT k AS pattern, n % 300 AS d, 'block' AS action FROM n WHERE kind = 1
  UNION ALL SELECT k, n % 300 + 60 + n % 200, 'remove' FROM n WHERE kind = 1
  UNION ALL SELECT k, n % 300 + 400, CASE WHEN n % 2 = 0 THEN 'block' ELSE 'allow' END FROM n WHERE kind = 1
  UNION ALL SELECT k, n % 500, CASE WHEN n % 3 = 0 THEN 'allow' ELSE 'block' END FROM n WHERE kind = 2
  UNION ALL SELECT k, n % 500 + 90, 'remove' FROM n WHERE kind = 2
  UNION ALL SELECT k, n % 200, 'block' FROM n WHERE kind = 3
  UNION ALL SELECT k, n % 200 + 45, 'remove' FROM n WHERE kind = 3),
daily AS (
  SELECT pattern, DATE '2023-01-01' + CAST(d AS INTEGER) AS listed_on,
         max(CASE action WHEN 'remove' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS rank
  FROM entries GROUP BY 1, 2),
spans AS (
  SELECT pattern, listed_on, rank, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS until FROM daily),
asked AS (
  SELECT DISTINCT page_id, url, host, fetched_on, unnest(
    [array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') FOR k IN range(1, greatest(1, len(string_split(host, '.')) - 1) + 1)]
    || [host || array_to_string(list_slice(string_split(path, '/'), 1, k), '/') || '/' FOR k IN range(1, len(string_split(path, '/')))]
    || [host || path]) AS pattern
  FROM c WHERE host <> ''),
hits AS (
  SELECT a.page_id, s.pattern, s.listed_on, s.rank,
         row_number() OVER (PARTITION BY a.page_id ORDER BY length(s.pattern) DESC, s.pattern DESC) AS place
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND s.listed_on <= a.fetched_on AND (s.until IS NULL OR a.fetched_on < s.until)
  WHERE s.rank > 1)
SELECT c.page_id, c.host, c.fetched_on, h.pattern, h.listed_on,
       CASE h.rank WHEN 3 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS action,
       coalesce(h.rank = 3, FALSE) AS blocked
FROM c LEFT JOIN hits h ON h.page_id = c.page_id AND h.place = 1
"""
