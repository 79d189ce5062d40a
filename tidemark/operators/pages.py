"""Web pages: article fields, links and labelled facts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field sources in order of preference and text limits.
TITLE_KEYS = ("og:title", "twitter:title")
DESCRIPTION_KEYS = ("og:description", "description", "twitter:description")
PUBLISHED_KEYS = ("article:published_time", "datePublished")
AUTHOR_KEYS = ("author", "article:author")
MIN_BODY, MIN_PARAGRAPH = 200, 50
TITLE_LENGTH = (18, 350)
FACT_WINDOW = 3


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


class _Article(HTMLParser):
    """Collects meta values, the title, paragraphs and embedded JSON of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title: list[str] = []
        self.paragraphs: list[list[str]] = []
        self.scripts: list[list[str]] = []
        self.into: list[str] | None = None
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("content"):
            for key in (a.get("property"), a.get("name")):
                if key:
                    self.meta.setdefault(key, a["content"])
        elif tag == "title":
            self.into = self.title
        elif tag == "p":
            self.paragraphs.append([])
            self.into = self.paragraphs[-1]
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.scripts.append([])
            self.into = self.scripts[-1]
        elif tag in ("script", "style"):
            self.silent += 1

    def handle_endtag(self, tag):
        if tag in ("title", "p", "article", "div"):
            self.into = None
        elif tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
            self.into = None

    def handle_data(self, data):
        if self.into is not None and not self.silent:
            self.into.append(data)


def _nested(value):
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for item in value:
            yield from _nested(item)


def _author(value) -> str | None:
    people = value if isinstance(value, list) else [value]
    return ", ".join(clean(p.get("name")) for p in people if isinstance(p, dict) and p.get("name")) or None


def read_article(html: str) -> dict:
    page = _Article()
    page.feed(html or "")
    first = lambda keys: next((clean(page.meta[k]) for k in keys if k in page.meta), None)
    out = {"article_title": first(TITLE_KEYS) or clean(" ".join(page.title)) or None,
           "article_description": first(DESCRIPTION_KEYS), "article_published": first(PUBLISHED_KEYS), "author": first(AUTHOR_KEYS)}
    body = None
    for script in page.scripts:
        try:
            found = json.loads("".join(script) or "{}")
        except ValueError:
            continue
        for item in _nested(found):
            if body or "article" not in str(item.get("@type", "")).lower():
                continue
            out["article_title"] = out["article_title"] or clean(item.get("headline")) or None
            out["article_description"] = out["article_description"] or clean(item.get("description")) or None
            out["article_published"] = out["article_published"] or clean(item.get("datePublished")) or None
            out["author"] = out["author"] or _author(item.get("author"))
            text = clean(item.get("articleBody"))
            body = text if len(text) > MIN_BODY else None
    if not body:
        texts = [clean(" ".join(p)) for p in page.paragraphs]
        body = "\n".join(x for x in texts if len(x) >= MIN_PARAGRAPH) or None
    out["article_text"] = body
    return out


def extract_articles(pages: DataFrame, *, key: str, url: str, html: str) -> DataFrame:
    """Article fields per page.  HTML nesting is beyond regular expressions, so the
    parse runs in Python on Arrow batches; everything after it is columns.  Text is kept whole."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fields = pd.DataFrame([read_article(x) for x in batch[html]], index=batch.index)
            yield pd.concat([batch[[key, url]], fields], axis=1)
    schema = (f"{key} {dict(pages.dtypes)[key]}, {url} string, article_title string, article_description string, "
              "article_published string, author string, article_text string")
    d = pages.select(key, url, html).mapInPandas(run, schema)
    text = F.col("article_text")
    return d.withColumns({
        "article_word_count": F.when(text.isNull(), 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))),
        "source_domain": domain(F.col(url)),
        "enrichment_status": F.when(text.isNotNull() | F.col("article_description").isNotNull(), "enriched").otherwise("headline_only"),
    })


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def harvest_links(pages: DataFrame, *, key: str, url: str, html: str, skip_domains: tuple[str, ...] = (),
                  title_length: tuple[int, int] = TITLE_LENGTH, limit: int | None = None) -> DataFrame:
    """Story links of each page: titled, resolved, first per address; all, or the first ``limit``.
    A page's own anchors are handled inside its row, so nothing is shuffled.  The first of
    an address is found by sorting (address, position) once."""
    anchor = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    base = F.regexp_extract(F.col(url), r"^([a-zA-Z]+://[^/?#]*)", 1)
    d = pages.select(key, base.alias("_base"), F.arrays_zip(
        F.regexp_extract_all(html, F.lit(anchor), 1).alias("href"), F.regexp_extract_all(html, F.lit(anchor), 2).alias("title")).alias("_a"))
    made = F.transform("_a", lambda a: F.struct(
        F.when(a["href"].startswith("/"), F.concat("_base", a["href"])).otherwise(a["href"]).alias("href"),
        collapse(F.regexp_replace(a["title"], "<[^>]+>", " ")).alias("title")))
    good = F.filter(made, lambda a: a["href"].startswith("http") & F.length(a["title"]).between(*title_length)
                    & ~domain(a["href"]).isin(*skip_domains or ("",)))
    d = d.withColumn("_g", good)
    d = d.withColumn("_s", F.array_sort(F.transform("_g", lambda a, i: F.struct(a["href"].alias("href"), i.alias("at"), a["title"].alias("title")))))
    fresh = F.filter("_s", lambda a, i: (i == 0) | (F.get("_s", i - 1)["href"] != a["href"]))
    first = F.array_sort(F.transform(fresh, lambda a: F.struct(a["at"].alias("at"), a["title"].alias("title"), a["href"].alias("href"))))
    return d.select(key, F.posexplode(first if limit is None else F.slice(first, 1, limit)).alias("position", "_l")).select(
        key, "position", "_l.title", "_l.href")


def text_lines(html: Column) -> Column:
    """Visible text pieces of a page, in order."""
    shown = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "\n")
    pieces = F.split(F.regexp_replace(shown, "<[^>]+>", "\n"), "\n")
    return F.filter(F.transform(pieces, collapse), lambda x: x != "")


def labelled_facts(pages: DataFrame, *, key: str, html: str, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """For each fact the first text within three pieces after one of its labels."""
    d = pages.select(key, text_lines(F.col(html)).alias("_t")).withColumn("_low", F.transform("_t", F.lower))
    return d.select(key, *[_fact([w.lower() for w in wanted]).alias(name) for name, wanted in labels.items()])


def _fact(known: list[str]) -> Column:
    """First unlabelled piece after any of the ``known`` labels, over ``_t``/``_low``."""
    def after(x, i):
        near = F.filter(F.slice("_t", i + 2, FACT_WINDOW), lambda v: ~F.lower(v).isin(*known))
        return F.when(x.isin(*known), F.slice(near, 1, 1)).otherwise(F.array().cast("array<string>"))
    return F.try_element_at(F.flatten(F.transform("_low", after)), F.lit(1))


def relative_time(text: Column, now: Column) -> Column:
    """"3 hours ago", "20 min ago", "yesterday" against ``now``; else null."""
    low = collapse(F.lower(text))
    amount = lambda unit: F.regexp_extract(low, rf"(\d+)\s*(?:{unit})\s+ago", 1).try_cast("long")
    minutes, hours, days = amount("minutes?|mins?"), amount("hours?|hrs?"), amount("days?")
    back = F.coalesce(minutes * 60, hours * 3600, days * 86400, F.when(low.contains("yesterday"), F.lit(86400)))
    return F.timestamp_micros(F.unix_micros(now) - back * 1_000_000)
