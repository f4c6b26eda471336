"""Web documents: readable text, sections, links, citations and retrieval over given tables.

Nothing here touches a network: transports are callables or frames of fetched bodies.
"""

from __future__ import annotations

import html as html_
import re
import time
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.fixed import ARXIV_KEY, CITATION_KINDS, DOI_KEY, ISBN_KEY, JSTOR_KEY, JUNK_LINKS, NOT_A_TITLE, PAGE_SUFFIX, SITE_SUFFIX, TRUSTED_DOMAINS

_SILENT = {"script", "style", "nav", "header", "footer"}
_BLOCK = {"p", "div", "li", "ul", "ol", "tr", "table", "br", "section", "article", "pre", "blockquote"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n" + "=" * int(tag[1]) + " ")
        elif tag == "math":
            alt = dict(attrs).get("alttext")
            if alt:
                self.out.append(f" ${alt}$ ")
            self.silent += 1
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _SILENT or tag == "math":
            self.silent = max(0, self.silent - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append(" " + "=" * int(tag[1]) + "\n")
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def plain_text(source: str | None) -> str:
    """Readable text of HTML: headings as ``== h ==``, formulas as ``$..$``, a line per block."""
    if not source:
        return ""
    p = _Text()
    p.feed(source)
    p.close()
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


#: Texts of a batch that are Python strings at a time.
AT_ONCE = 200


def plain_texts(source: pa.Array) -> pa.Array:
    """``plain_text`` of each value, some at a time, so a batch is held as Arrow's bytes alone."""
    parts = (source.slice(k, AT_ONCE) for k in range(0, len(source), AT_ONCE))
    done = [pa.array([plain_text(x.as_py()) for x in part], pa.string()) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


@F.arrow_udf(StringType())
def html_text(source: pa.Array) -> pa.Array:
    return plain_texts(source)


@F.pandas_udf(StringType())
def ascii_slug(name: pd.Series) -> pd.Series:
    """NFKD, ASCII only, lower case, runs of other characters one underscore."""

    def one(x):
        if x is None:
            return None
        plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "_", plain).strip("_")

    return name.map(one)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html_.unescape(x))


def sections(docs: DataFrame) -> DataFrame:
    """docs (doc, text) -> (doc, pos, level, title, body): bodies run to the next heading of the same rank or above."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^(=+) *(.*?) *=+ *$", 1)
    heads = lines.where(mark != "").select("doc", "pos", F.length(mark).alias("level"), F.regexp_extract("line", r"^(=+) *(.*?) *=+ *$", 2).alias("title"))
    from ..operators.windows import extents

    spans = extents(heads)
    whole = docs.select("doc", F.split("text", "\n").alias("lines"))
    size = F.coalesce(F.col("stop"), F.size("lines").cast("long")) - F.col("pos") - 1
    return spans.join(whole, "doc").select("doc", "pos", "level", "title", F.array_join(F.slice("lines", F.col("pos") + 2, F.greatest(size, F.lit(0)).cast("int")), "\n").alias("body"))


def pinned_section(docs: DataFrame, pins: DataFrame) -> DataFrame:
    """pins (doc, section) -> with the body of the section whose title starts with it; a missing one raises."""
    s = sections(docs)
    j = pins.join(s, (pins["doc"] == s["doc"]) & (F.lower(s["title"]).startswith(F.lower(pins["section"]))), "left").select(pins["doc"], pins["section"], s["body"])
    missing = F.raise_error(F.concat(F.lit("no section "), F.col("section"), F.lit(" in "), F.col("doc").cast("string")))
    return j.withColumn("body", F.when(F.col("body").isNotNull(), F.col("body")).otherwise(missing))


def external_links(pages: DataFrame, trusted=TRUSTED_DOMAINS, limit: int = 6) -> DataFrame:
    """pages (page, html) -> (page, place, url, kind, title): trusted links, one per host and path, kinds in turn.

    Links go by the first trusted domain that the URL holds, in the list's order, then by
    their place on the page; kinds take turns in the order in which that finds them.
    """
    from ..operators.windows import round_robin

    hrefs = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(r"""href=["'](https?://[^"']+)["']"""), F.lit(1))).alias("pos", "url"))
    hrefs = hrefs.where(~F.col("url").rlike(JUNK_LINKS))
    rank, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (domain, k) in reversed(list(enumerate(trusted))):
        held = F.col("url").contains(domain)
        rank, kind = F.when(held, i).otherwise(rank), F.when(held, k).otherwise(kind)
    h = hrefs.withColumn("kind", kind).where("kind is not null").withColumn("ord", rank.cast("long") * 2**32 + F.col("pos"))
    h = h.withColumn("key", F.regexp_extract("url", r"^https?://([^?#]*)", 1))
    first = h.groupBy("page", "key").agg(F.min(F.struct("ord", "url", "kind")).alias("f")).select("page", "f.*")
    return round_robin(first, "page", "kind", "ord", limit).select("page", "place", "url", "kind", title_from_url(F.col("url")).alias("title"))


def citation_kind(url: Column) -> Column:
    """Which record a URL cites: arxiv, doi, jstor, isbn, pdf or page."""
    kind = F.lit("page")
    for name, pattern in reversed(CITATION_KINDS):
        kind = F.when(F.lower(url).rlike(pattern), name).otherwise(kind)
    return kind


def title_from_url(url: Column) -> Column:
    """The last path segment as words and the host, or the host alone."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(F.when(last == "", host).otherwise(last), PAGE_SUFFIX, "")
    stem = F.trim(F.regexp_replace(stem, r"[_\-+]+", " "))
    return F.when(stem == "", host).otherwise(F.concat(stem, F.lit(" \u2014 "), host))


def citation_key(url: Column) -> Column:
    """What identifies the document of a URL in its registry: an arXiv id, a DOI, an ISBN's digits, else null."""
    arxiv = F.regexp_extract(url, ARXIV_KEY, 1)
    doi = F.url_decode(F.regexp_replace(F.regexp_extract(url, DOI_KEY, 1), r"%(?![0-9A-Fa-f]{2})", "%25"))
    jstor = F.regexp_extract(url, JSTOR_KEY, 1)
    isbn = F.regexp_replace(F.regexp_extract(url, ISBN_KEY, 1), r"\D", "")
    return F.when(arxiv != "", arxiv).when(doi != "", doi).when(jstor != "", F.concat(F.lit("10.2307/"), jstor)).when(isbn != "", isbn)


def tidy_title(title: Column) -> Column:
    """A title without a trailing site name, unless that leaves under eight characters."""
    short = F.trim(F.regexp_replace(title, SITE_SUFFIX, ""))
    return F.when(F.length(short) >= 8, short).otherwise(title)


def cite_pages(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> (url, title): the page's own title, null where it names no document."""
    plain = F.regexp_replace(unescape(F.regexp_replace(page_title(F.col("html")), "<[^>]+>", "")), r"\s+", " ")
    p = pages.select("url", F.trim(plain).alias("t"))
    good = (F.length("t") >= 4) & ~F.col("t").rlike(NOT_A_TITLE)
    return p.select("url", F.when(good, F.substring(tidy_title(F.col("t")), 1, 160)).alias("title"))


def cite(urls: DataFrame, records: DataFrame) -> DataFrame:
    """urls (url) and records (key, title, names, year) -> (url, kind, title, byline).

    A record is found by the URL's key in its registry. The byline names three authors at
    most and the year; a PDF or a URL without a record has no title.
    """
    u = urls.select("url", citation_kind(F.col("url")).alias("kind"), citation_key(F.col("url")).alias("key"))
    j = u.join(records, "key", "left")
    who = F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.when(F.size("names") > 3, " et al.").otherwise(""))
    byline = F.concat_ws(" \u00b7 ", F.nullif(who, F.lit("")), F.col("year").cast("string"))
    return j.select("url", "kind", F.regexp_replace(F.trim("title"), r"\s+", " ").alias("title"), F.when(F.col("title").isNotNull(), byline).alias("byline"))


def page_title(source: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t-\r]+", " "))


def encyclopedia(bodies: DataFrame) -> DataFrame:
    """(title, body) API replies -> (title, id, article, text): pages that exist, hold text and are no disambiguation."""
    from ..operators.windows import disambiguation

    schema = "query struct<pages:map<string,struct<title:string,extract:string,pageprops:map<string,string>>>>"
    j = bodies.select("title", F.explode(F.from_json("body", schema)["query"]["pages"]).alias("id", "p"))
    flag = F.map_contains_key(F.coalesce("p.pageprops", F.create_map().cast("map<string,string>")), F.lit("disambiguation"))
    good = (F.col("id") != "-1") & (F.coalesce(F.trim("p.extract"), F.lit("")) != "") & ~disambiguation(F.col("p.extract"), flag)
    return j.where(good).select("title", "id", F.col("p.title").alias("article"), F.col("p.extract").alias("text"))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, summary) of an Atom feed; a feed that can't be read has no entries."""
    return spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema("id string, title string, summary string").load(path)


def fetch(url: str, transport: Callable[[str], bytes], retries: int = 4, pause: float = 0.5, sleeper=time.sleep) -> bytes:
    """A body through ``transport``, again after growing pauses on throttling and server errors."""
    for k in range(retries):
        try:
            return transport(url)
        except OSError as e:
            code = getattr(e, "code", None)
            if k == retries - 1 or not (code is None or code == 429 or code >= 500):
                raise
            sleeper(pause * 2**k)
    raise AssertionError


def retrieve(nodes: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """nodes (id, name), aliases (id, titles), sources (title, source, text, kind) -> (id, source, state).

    Titles are the aliases, else the name and its variant with later words in lower case.
    An empty alias list is known to have no source. Else the first title with a
    substantive source grounds the node.
    """
    from ..functions.text import title_variant
    from ..operators.windows import substantive

    j = nodes.join(aliases.select("id", "titles"), "id", "left")
    titles = F.coalesce("titles", F.array_distinct(F.array("name", title_variant(F.col("name")))))
    t = j.select("id", F.posexplode(titles).alias("ord", "title"))
    good = sources.where(substantive(F.length("text"), F.col("kind"))).select("title", "source")
    best = t.join(good, "title").groupBy("id").agg(F.min(F.struct("ord", "source")).alias("b"))
    return j.join(best, "id", "left").select("id", F.col("b.source").alias("source"), F.when(F.size("titles") == 0, "known_absent").when(F.col("b").isNotNull(), "grounded").otherwise("ungrounded").alias("state"))


def ground_from_consumers(ungrounded: DataFrame, consumers: DataFrame, sources: DataFrame, limit: int = 3) -> DataFrame:
    """Derived sources: passages about a node (id, name) in the sources (id, source, text) of its consumers (id, consumer, place)."""
    c = ungrounded.join(consumers, "id").join(sources.select(F.col("id").alias("consumer"), "source", "text"), "consumer")
    p = c.select("id", "place", "source", "name", F.posexplode(F.split("text", "\n")).alias("pos", "passage")).where((F.length("passage") >= 80) & F.lower("passage").contains(F.lower("name")))
    w = Window.partitionBy("id").orderBy("place", "pos")
    return p.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("id", F.concat("source", F.lit("#"), F.col("id").cast("string")).alias("derived"), "passage")


def retry(states: DataFrame, again: DataFrame) -> DataFrame:
    """states (id, state, source) with the rows in error or ungrounded replaced by a second attempt where it found something."""
    a = again.select("id", F.col("state").alias("s2"), F.col("source").alias("r2")).where("s2 = 'grounded'")
    j = states.join(a, "id", "left")
    use = F.col("state").isin("error", "ungrounded") & F.col("s2").isNotNull()
    return j.select("id", F.when(use, F.col("s2")).otherwise(F.col("state")).alias("state"), F.when(use, F.col("r2")).otherwise(F.col("source")).alias("source"))
