"""Queries over articles, pages and vendor JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import news as ops
from tidemark.operators import pages as page_ops
from tidemark.sources import payloads
from tidemark.workloads.adapters import NEWS, day_text, k_of, news, r, rounded
from tidemark.workloads.registry import workload

# The texts are invented words, so the queries take a lexicon of their common tokens.
LEXICON = ops.Lexicon(
    positive=("the", "and", "que", "der", "los"), negative=("of", "le", "die", "to"), surprise=("in", "un", "en", "that"),
    events=(("earnings", ("tionon", "eauxon")), ("guidance", ("ununter", "lecti")), ("analyst", ("erenth", "scht")),
            ("macro", ("ingthe", "mentla"))))


def sql_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sql_category(low: str) -> str:
    cases = " ".join("when " + " or ".join(f"contains({low}, '{x}')" for x in terms) + f" then '{name}'" for name, terms in LEXICON.events)
    return f"case {cases} else 'other' end"


_WORDS = f"""
w as (select *, regexp_extract_all(lower(text), '[a-z]+') as words, length(text) - length(replace(text, '!', '')) as bang,
   case when doc_id % 10 = 0 then 'positive' when doc_id % 10 = 1 then 'negative, mixed' when doc_id % 10 < 5 then 'neutral' end as provider from news),
h as (select *, len(list_filter(words, lambda x: x in {sql_in(LEXICON.positive)})) as p, len(list_filter(words, lambda x: x in {sql_in(LEXICON.negative)})) as n,
   len(list_filter(words, lambda x: x in {sql_in(LEXICON.surprise)})) as s from w),
b as (select *, case when len(words) > 0 then (p - n) / greatest(1, p + n) else 0 end as base from h),
scored as (select *, case when provider like '%positive%' then greatest(base, 0.65) when provider like '%negative%' then least(base, -0.65)
     when provider like '%neutral%' and abs(base) < 0.25 then 0 else base end as sentiment,
   case when len(words) > 0 then least(1, (p + n) / 6 + bang * 0.08) else 0 end as emotion, case when len(words) > 0 then least(1, s / 3) else 0 end as surprise from b)
"""


def _provider():
    at = F.col("doc_id") % 10
    return F.when(at == 0, "positive").when(at == 1, "negative, mixed").when(at < 5, "neutral")


@workload("lexicon_score", sql=f"""
with {NEWS}, {_WORDS}
select doc_id, round(sentiment, 6) as sentiment_score, round(emotion, 6) as emotion_intensity, round(surprise, 6) as surprise_score from scored
""")
def lexicon_score(t):
    """Polarity, emotion and surprise of every whole text, provider verdict applied."""
    d = ops.score_text(news(t).withColumn("provider", _provider()), "text", LEXICON, provider="provider")
    return d.select("doc_id", *rounded(d, ["sentiment_score", "emotion_intensity", "surprise_score"]))


@workload("event_category", sql=f"""
with {NEWS} select doc_id, {sql_category('lower(text)')} as event_category from news
""")
def event_category(t):
    """First matching event category of every whole text."""
    return news(t).select("doc_id", ops.event_category(F.col("text"), LEXICON).alias("event_category"))


@workload("news_source_pref", sql=f"""
with {NEWS}, {_WORDS},
k as (select *, date_trunc('day', published) as day, case when cast(substr(source, 4) as integer) % 3 = 0 then 1 when cast(substr(source, 4) as integer) % 3 = 1 then 2 else 3 end as rk from scored),
m as (select *, min(rk) over (partition by ticker, day) as best from k)
select doc_id, ticker, strftime(day, '%Y-%m-%d') as day, rk as source_rank, round(sentiment, 6) as sentiment_score, {sql_category('lower(text)')} as event_category
from m where rk = best
""")
def news_source_pref(t):
    """Articles of the best source per ticker-day, scored and categorised."""
    rank = F.substring("source", 4, 9).cast("int") % 3 + 1
    d = news(t).withColumns({"day": F.to_date("published"), "source_rank": rank, "provider": _provider()})
    d = ops.prefer_source(d, keys=["ticker", "day"], rank="source_rank")
    d = ops.score_text(d, "text", LEXICON, provider="provider")
    return d.select("doc_id", "ticker", day_text(F.col("day")).alias("day"), "source_rank", r("sentiment_score").alias("sentiment_score"),
                    ops.event_category(F.col("text"), LEXICON).alias("event_category"))


@workload("page_extract")
def page_extract(t):
    """Title, description, author, date and whole article text of every page."""
    d = page_ops.extract_articles(t.pages, key="page_id", url="url", html="html")
    return d.select("page_id", "article_title", "article_description", "article_published", "author", "article_word_count",
                    "source_domain", "enrichment_status", F.md5("article_text").alias("text_digest"))


@workload("page_links", sql=r"""
with a as (select page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) as base,
   unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) as raw, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) as tt,
   generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) as i from pages),
b as (select page_id, i, case when raw like '/%' then base || raw else raw end as href, trim(regexp_replace(regexp_replace(tt, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as title from a),
c as (select *, row_number() over (partition by page_id, href order by i) as d from b
      where href like 'http%' and length(title) between 6 and 350 and not regexp_replace(lower(regexp_extract(href, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') in ('m.ththth.example.net')),
e as (select page_id, title, href, row_number() over (partition by page_id order by i) - 1 as position from c where d = 1)
select page_id, position, title, href from e
""")
def page_links(t):
    """Titled links of every page, resolved, without repeats."""
    d = page_ops.harvest_links(t.pages, key="page_id", url="url", html="html", skip_domains=("m.ththth.example.net",), title_length=(6, 350))
    return d.select("page_id", F.col("position").cast("long").alias("position"), "title", "href")


_FACTS = {"first": ("The", "Que", "Der"), "second": ("and", "le", "die"), "third": ("of", "un", "und")}


def _sql_fact(name: str, labels) -> str:
    known = sql_in(x.lower() for x in labels)
    return (f"list_filter(flatten(list_transform(range(1, len(l) + 1), lambda i: case when lower(l[i]) in {known} then "
            f"list_filter(l[i + 1:i + 3], lambda v: lower(v) not in {known})[1:1] else [] end)), lambda z: true)[1] as \"{name}\"")


@workload("page_facts", sql=rf"""
with p as (select page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]+>', chr(10), 'g'), chr(10)),
   lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as l from pages)
select page_id, {', '.join(_sql_fact(n, v) for n, v in _FACTS.items())} from p
""")
def page_facts(t):
    """Value that follows each label in the visible text of a page."""
    return page_ops.labelled_facts(t.pages, key="page_id", html="html", labels=_FACTS)


@workload("json_flatten", sql="""
with e as (select event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as integer) as k from events)
select event_id, 'pub' || (user_id % 7) as publisher, event_type || ',' || 'T' || (k % 5) as tickers,
  array_to_string(list_sort(list_distinct(list_filter([case k % 3 when 0 then 'positive' when 1 then 'negative' end, case k % 4 when 0 then 'neutral' else 'positive' end], lambda x: x is not null))), ',') as sentiment,
  round(case when k % 5 <> 0 then (value * 0.9::double + value * 1.1::double) / 2 else case when k % 2 = 0 then value * 1.05::double else value end end, 6) as mid,
  cast(k as bigint) as open_interest, round(value, 6) as close, cast(k as bigint) as volume
from e
""")
def json_flatten(t):
    """Vendor JSON (news with insights, an option quote, a bar) flattened to columns."""
    k = k_of()
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = lambda c: c.cast("string")
    value = F.col("value")
    first = F.when(k % 3 == 0, F.lit('{"sentiment":"positive"},')).when(k % 3 == 1, F.lit('{"sentiment":"negative"},')).otherwise('{"sentiment":null},')
    second = F.when(k % 4 == 0, F.lit('{"sentiment":"neutral"}')).otherwise('{"sentiment":"positive"}')
    article = F.concat(F.lit('{"publisher":{"name":'), text(F.concat(F.lit("pub"), (F.col("user_id") % 7).cast("string"))), F.lit('},"tickers":['),
                       text(F.col("event_type")), F.lit(","), text(F.concat(F.lit("T"), (k % 5).cast("int").cast("string"))), F.lit('],"insights":['), first, second, F.lit("]}"))
    quote = F.when(k % 5 != 0, F.concat(F.lit('{"bid_price":'), number(value * 0.9), F.lit(',"ask_price":'), number(value * 1.1), F.lit("}"))).otherwise("null")
    last = F.when(k % 2 == 0, F.concat(F.lit('{"price":'), number(value * 1.05), F.lit("}"))).otherwise("null")
    chain = F.concat(F.lit('{"details":{"ticker":"x"},"last_quote":'), quote, F.lit(',"last_trade":'), last, F.lit(',"day":{"close":'), number(value),
                     F.lit('},"open_interest":'), number(k.cast("long")), F.lit("}"))
    bar = F.concat(F.lit('{"results":[{"o":1,"c":'), number(value), F.lit(',"v":'), number(k), F.lit(',"t":1704067200000}]}'))
    d = t.events.select("event_id", article.alias("article"), chain.alias("chain"), bar.alias("bar"))
    d = payloads.flatten_news(d, "article", keep=["event_id", "chain", "bar"])
    d = payloads.flatten_chain(d, "chain", keep=["event_id", "publisher", "tickers", "sentiment", "bar"])
    d = payloads.flatten_bars(d, "bar", keep=["event_id", "publisher", "tickers", "sentiment", "mid", "open_interest"])
    return d.select("event_id", "publisher", "tickers", "sentiment", r("mid").alias("mid"), "open_interest", r("close").alias("close"),
                    F.col("volume").cast("long").alias("volume"))
