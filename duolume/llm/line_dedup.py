"""Operator 6: site-relative line frequency, in DataFrame functions only.

A page's lines are its HTML cut at line breaks and at the tags of blocks, without tags and
outer white space. For each host, the pages that contain a line are divided by
the host's pages; lines above a ratio are dropped from that host's pages.

Lines and pages are known by 64-bit hashes. A host is a URL's without user and port, in lower case.
Only (host, line hash) pairs are shuffled, once for each page that has them, and
pre-aggregated. The lines to drop are few; they are copied over SALTS salts, so a
host or line that most pages share is looked up by many tasks. Texts move
once, by page.

Hosts with fewer than `least_pages` pages keep all lines. Null HTML has no lines;
a null or odd URL has the empty host. Repeated rows count as pages of their own,
and get equal results; null ids are ids like others, and input columns of any name do no harm. Empty tables give an empty result. The result has the named
columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SALTS = 16
#: What starts or ends a line, what is no text at all.
BLOCK_TAGS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:\s[^>]*)?/?>"
HIDDEN = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
ANY_TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
WHITE = r"[ \t\x0B\f\r]+"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """Non-empty lines of a page, in order."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK_TAGS, "\n"), ANY_TAG, "")
    return F.filter(F.transform(F.split(F.regexp_replace(text, WHITE, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_site_lines(pages: DataFrame, ratio: float = 0.3, least_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept (text) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.coalesce(lines_of(F.col(html_col)), F.array().cast("array<string>")).alias("lines"))
    # what a page is known by: rows that are equal in all three get equal results
    rows = materialize(rows.withColumn("page", F.xxhash64("page_id", "host", "lines")), "page-lines")  # pages are parsed once
    seen = rows.select("page", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    often = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    # a host may have most of the lines: they meet its total under many salts
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    often = often.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int")).join(totals.select("host", "pages", every_salt), ["host", "salt"]).filter(F.col("n") > ratio * F.col("pages"))
    salted = often.select("host", "line", every_salt)
    dropped = seen.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"]).groupBy("page").agg(F.collect_set("line").alias("drop"))
    kept = F.filter("lines", lambda x: ~F.array_contains("drop", F.xxhash64(x)))
    out = rows.join(dropped, "page", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<long>"))).withColumn("kept", kept)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))


ORACLE = r"""
WITH rows AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '{host}', 1)), '') AS host, row_number() OVER () AS page,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '{block}', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
seen AS (SELECT page, host, unnest(list_distinct(lines)) AS line FROM rows),
totals AS (SELECT host, count(*) AS pages FROM rows GROUP BY host HAVING count(*) >= 5),
often AS (SELECT host, line FROM seen JOIN totals USING (host) GROUP BY host, line, pages HAVING count(*) > 1 AND count(*) > 0.3 * pages),
dropped AS (SELECT page, list(line) AS gone FROM seen JOIN often USING (host, line) GROUP BY page),
kept AS (SELECT r.page_id, r.host, r.lines, list_filter(r.lines, lambda x: NOT list_contains(coalesce(d.gone, []), x)) AS kept FROM rows r LEFT JOIN dropped d USING (page))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS kept FROM kept
""".replace("{block}", BLOCK_TAGS).replace("{host}", HOST)
