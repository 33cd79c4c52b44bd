"""Raw web pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of an article that are not its text.
ASIDE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->"
ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def plain(html):
    """The text of a stretch of HTML: no asides, no tags, entities decoded, spaces folded."""
    out = F.regexp_replace(F.regexp_replace(html, ASIDE, " "), "<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, "[ \\t\\r\\n]+", " "))


def pages_to_text(pages: DataFrame) -> DataFrame:
    """Language, title and article text of each page; empty where the page has none."""
    html = F.col("html")
    return pages.select(
        "page_id",
        F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1).alias("lang"),
        plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)).alias("title"),
        plain(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)).alias("text"),
    )


def canonical_pages(pages: DataFrame) -> DataFrame:
    """Pages by URL without scheme, www. or m., query and fragment, the host in lower case: the smallest id and their number."""
    rest = F.regexp_replace("url", r"^[A-Za-z]+://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), r"^(www\.|m\.)", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), r"(?s)/?([?#].*)?$", "")
    return pages.groupBy(F.concat(host, path).alias("canonical_url")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n_pages"))
