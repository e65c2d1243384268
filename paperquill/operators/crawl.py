"""Links of pages and crawling them to a fixpoint, over tables of pages."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.papers import follow_link, is_not_paper, is_paper, paper_details
from ..functions.text import last_slug, page_url, url_host, url_path
from .joins import longest_match

HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


@F.pandas_udf(StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as seen from its page; null for what is no URL."""

    def one(b, x):
        try:
            return None if b is None or x is None else urljoin(b, x.strip())
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)])


def hrefs(html: Column) -> Column:
    """All href values of a page's anchors, in order."""
    parts = [F.regexp_extract_all(html, F.lit(HREF), F.lit(i)) for i in (1, 2, 3)]
    one = F.zip_with(F.zip_with(parts[0], parts[1], lambda a, b: F.concat(a, b)), parts[2], lambda a, b: F.concat(a, b))
    return F.transform(one, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, pos (0-based), href, link (resolved against the page) of each anchor."""
    found = pages.select(F.col(url).alias("url"), F.posexplode(hrefs(F.col(html))).alias("pos", "href"))
    return found.withColumn("link", url_join("url", "href"))


def crawl_fixpoint(links: DataFrame, start: DataFrame, save, max_rounds: int = 1000) -> DataFrame:
    """(url, depth) of all pages that links (url, link) reach from start (url), by rounds of joins.

    save writes a table and reads it again, which cuts the lineage; a round reads the last round's pages only.
    """
    edges = links.select("url", "link").filter("link is not null and link <> url").distinct()
    seen = save(start.select("url").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for depth in range(1, max_rounds + 1):
        new = edges.join(last.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        last = save(new.withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            return seen
        seen = save(seen.unionByName(last))
    raise RuntimeError("the crawl hasn't ended")


def paper_links(pages: DataFrame, names: DataFrame, hosts: tuple[str, ...], grade: int) -> tuple[DataFrame, DataFrame]:
    """(papers, follow): the exam papers that pages link to, and the pages to visit next.

    names: name, subject (null: known but not wanted). A paper's subject is that of its own file name if it names one,
    else its page's. papers: grade, subject, pdf_url, source_page, term, year, region, has_answers; a PDF counts for the
    first page (in the order of URLs) that links to it.
    """
    links = extract_links(pages).filter("link is not null")
    is_pdf = F.lower(url_path(F.col("link"))).endswith(".pdf")
    links = links.withColumn("page_slug", last_slug(F.col("url"))).withColumn("slug", F.when(is_pdf, F.regexp_replace(last_slug(F.col("link")), r"\.pdf$", "")).otherwise(last_slug(page_url(F.col("link")))))
    links = longest_match(links, F.col("slug"), names).withColumnRenamed("site_name", "own_name")
    links = longest_match(links, F.col("page_slug"), names).withColumnRenamed("site_name", "page_name")
    subject = lambda c: names.select(F.col("name").alias(c), F.col("subject").alias(f"{c}_subject")).dropDuplicates([c])
    links = links.join(subject("own_name"), "own_name", "left").join(subject("page_name"), "page_name", "left")
    named = F.col("own_name").isNotNull()
    of_grade = F.concat_ws(" ", "slug", "page_slug").rlike(f"grade-?0?{grade}(?![0-9])")
    medium = F.contains("slug", F.lit("tamil-medium")) | F.contains("slug", F.lit("english-medium"))
    pdf = links.filter(is_pdf).withColumn("subject", F.when(named, F.col("own_name_subject")).otherwise(F.col("page_name_subject")))
    pdf = pdf.filter(F.col("subject").isNotNull() & of_grade & ~medium & is_paper(F.col("slug"), F.col("page_slug")))
    about = paper_details(F.when(named, F.col("slug")).otherwise(F.col("page_slug")), F.when(named, F.col("own_name")).otherwise(F.col("page_name")))
    rows = pdf.select(F.lit(grade).alias("grade"), "subject", F.col("link").alias("pdf_url"), F.col("url").alias("source_page"), "pos", *[c.alias(n) for n, c in about.items()])
    row = F.struct(*[F.col(c) for c in rows.columns])
    papers = rows.groupBy("pdf_url").agg(F.min_by(row, F.struct("source_page", "pos")).alias("r")).select("r.*").drop("pos")
    go = links.filter(~is_pdf).withColumn("next", page_url(F.col("link")))
    go = go.filter(follow_link(F.col("next"), url_host(F.col("next")), hosts, grade) & ~(named & F.col("own_name_subject").isNull()) & ~is_not_paper(F.col("slug")))
    return papers, go.select("url", F.col("next").alias("link")).distinct()
