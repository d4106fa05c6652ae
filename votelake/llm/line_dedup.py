"""Boilerplate lines by site-relative frequency.

Pages are turned into lines (markup cut at block tags), grouped by host, and
the pages that contain a line are divided by the host's pages.  A line is
dropped where that share is over ``RATIO`` beyond chance: the lower end of its
confidence interval (Wilson's, ``Z`` standard deviations; 0 takes the bare
share) is what is compared, so the same rule decides on hosts of every size,
and a line on fewer than ``LEAST_PAGES`` pages (0: none) is never boilerplate.

A page counts a line once, so counting is one map-side combined aggregation on
(host, line hash), whatever a host's size.  Shares of a host's lines add up to
its lines a page, so at most ``lines a page / RATIO`` lines can be over the
ratio: what a host drops is a bounded list of 64-bit hashes, gathered in
``SALTS`` parts, and joins back by host with hot hosts kept apart
(``attach_per_key``).

Parsing takes time in proportion to a page's length: an open comment, script
or style ends with the page, and a tag has no ``<`` inside.

Edge cases: null html is an empty page; a null or unreadable url has host ''
and such pages share it; empty lines count nowhere and are not returned; lines
are compared after trimming and case is kept; a share equal to the ratio
stays; very long pages and lines are read whole; repeated rows are pages of
their own; a null page_id is kept; other columns, whatever their names, are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.llm.common import ROW, attach_per_key, materialize

#: A line that more than one page in twenty of its site repeats is the site's, not the page's; certain to 95 %.
RATIO = 0.05
Z = 1.645
LEAST_PAGES = 2
SALTS = 64

_HIDDEN = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
_BLOCK = r"(?i)</?(?:address|article|aside|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*+>"
_ANY = r"<[^<>]*+>"
_BLANKS = " \t\n\x0b\x0c\r"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """Trimmed lines of a page that are not empty, in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), _ANY, "")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")


def least_share(n: Column, pages: Column, z: float = Z) -> Column:
    """The lower end of the confidence interval of the share n / pages."""
    p, zz = n / pages, F.lit(z) * F.lit(z)
    return (p + zz / (2 * pages) - F.lit(z) * F.sqrt(p * (1 - p) / pages + zz / (4 * pages * pages))) / (1 + zz / pages)


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, z: float = Z, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, text of the lines that stay, n_lines, n_dropped and dropped_lines."""
    split = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"), F.monotonically_increasing_id().alias(ROW)))
    per_host = split.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    line = split.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counted = materialize(line.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages))
    totals = materialize(counted.groupBy("host").agg(F.count(F.lit(1)).alias("lines")).join(per_host, "host"))
    often = attach_per_key(counted, totals, "host", "lines", F.col("line")).filter(least_share(F.col("n").cast("double"), F.col("pages").cast("double"), z) > ratio)
    parts = often.groupBy("host", F.pmod("line", F.lit(SALTS)).alias("salt")).agg(F.collect_list("line").alias("part"))
    drops = parts.groupBy("host").agg(F.flatten(F.collect_list("part")).alias("drops"))
    hosts = materialize(per_host.join(drops, "host", "left").select("host", "pages", F.coalesce("drops", F.array().cast("array<bigint>")).alias("drops")))
    met = attach_per_key(split, hosts, "host", "pages", F.col(ROW))
    # the page's own share of the list first, by a hash set; then each line is looked up in that
    own = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), "drops")
    bad = once(own, lambda o: F.transform("lines", lambda x: F.array_contains(o, F.xxhash64(x))))
    pick = lambda b: F.struct(F.filter("lines", lambda x, i: ~F.get(b, i)).alias("kept"), F.filter("lines", lambda x, i: F.get(b, i)).alias("dropped"))
    return met.withColumn("parts", once(bad, pick)).select(
        "page_id",
        "host",
        F.array_join("parts.kept", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("parts.dropped").cast("long").alias("n_dropped"),
        F.array_join("parts.dropped", "\n").alias("dropped_lines"),
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once; a column that is used inside a lambda may else be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH a AS (SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
             regexp_replace(coalesce(html, ''), '(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)', '', 'g') AS t FROM pages),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '(?i)</?(?:address|article|aside|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>', chr(10), 'g'), '<[^<>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, host, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines FROM c),
h AS (SELECT host, cast(count(*) AS DOUBLE) AS m FROM d GROUP BY host),
n AS (SELECT host, line, cast(count(*) AS DOUBLE) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM d) GROUP BY host, line),
w AS (SELECT n.host, line, n, m, n / m AS p, 1.645::DOUBLE * 1.645::DOUBLE AS zz FROM n JOIN h USING (host) WHERE n >= 2),
o AS (SELECT host, list(line) AS drops FROM w
      WHERE (p + zz / (2 * m) - 1.645::DOUBLE * sqrt(p * (1 - p) / m + zz / (4 * m * m))) / (1 + zz / m) > 0.05::DOUBLE GROUP BY host),
e AS (SELECT d.page_id, d.host, d.lines, coalesce(o.drops, []) AS drops FROM d LEFT JOIN o USING (host))
SELECT page_id, host, array_to_string(list_filter(lines, lambda x: NOT list_contains(drops, x)), chr(10)) AS text, cast(len(lines) AS BIGINT) AS n_lines,
  cast(len(list_filter(lines, lambda x: list_contains(drops, x))) AS BIGINT) AS n_dropped,
  array_to_string(list_filter(lines, lambda x: list_contains(drops, x)), chr(10)) AS dropped_lines FROM e
"""
