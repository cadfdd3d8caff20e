"""Stored web pages: elements, links, phones and names in text.

HTML has no Spark function: one Arrow job parses each page once with the standard library, and gives element rows; all
that follows is DataFrame work.
"""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import any_of
from ..functions.text import (
    RELEVANT_PATH_TERMS,
    canonical_url,
    clean_spaces,
    has_path_term,
    is_allowed_url,
    normalize_public_phone,
    normalize_text,
    phone_type,
    registrable_scope,
    plain_text as plain_name,
    text_of,
    url_host,
)
from ..storage import saved
from .intervals import text_within, within
from .signals import around, positions

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Fixed values of the data rules: words near a number that make it a phone number, and what a number looks like.
PHONE_CUES = ("phone", "telephone", "tel", "call", "mobile", "contact", "office", "reception", "switchboard", "media", "press", "investor")
PHONE_SHAPE = r"(?<![\w])(?:\+?\d{1,3}[\s()./-]*)?(?:\(?\d{2,5}\)?[\s()./-]*){1,3}\d{3,5}(?![\w])"
CONTAINERS = ("li", "p", "address", "div", "section")


class Elements(html.parser.HTMLParser):
    """A page's elements and text pieces in document order, under a root of number 0. A row: parent, tag, class, own text,
    href, type, testid, inside (a piece's element), led (something stands before it in its parent), after (the element
    that it directly follows, else -1), last (its last descendant)."""

    def __init__(self, body: str) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.latest: list[int] = []  # of each open element, its latest child: -2 none yet, -1 text
        self._add("#root", {})
        self.open.append(0)
        self.latest.append(-2)
        self.feed(body)
        self.close()
        while self.open:
            self.rows[self.open.pop()]["last"] = len(self.rows) - 1

    def _add(self, tag: str, got: dict[str, str | None], text: str = "", inside: str = "") -> None:
        before = self.latest[-1] if self.latest else -2
        node = len(self.rows)
        self.rows.append({
            "node": node, "parent": self.open[-1] if self.open else -1, "last": node, "tag": tag, "class": got.get("class") or "", "text": text,
            "href": got.get("href") or "", "type": got.get("type") or "", "testid": got.get("data-testid") or "", "inside": inside,
            "led": before > -2, "after": max(before, -1),
        })
        if self.latest:
            self.latest[-1] = -1 if tag == "#text" else node

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._add(tag, dict(attrs))
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)
            self.latest.append(-2)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._add(tag, dict(attrs))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.rows[self.open[k]]["tag"] == tag:
                for node in self.open[k:]:
                    self.rows[node]["last"] = len(self.rows) - 1
                del self.open[k:], self.latest[k:]
                return

    def handle_data(self, data: str) -> None:
        owner = self.rows[self.open[-1]]
        if not data.strip():
            self.latest[-1] = -1
            return
        self._add("#text", {}, data.strip(), owner["tag"])
        if owner["tag"] != "#root":
            owner["text"] = f"{owner['text']} {data.strip()}".strip()


NODES = (
    "page_id bigint, url string, node bigint, parent bigint, last bigint, levels int, tag string, class string, text string, href string, "
    "type string, testid string, inside string, led boolean, after bigint"
)
#: Rows of element tables that a task holds before it passes them on.
HELD_ROWS = 20_000


def html_nodes(pages: DataFrame) -> DataFrame:
    """The elements of pages (page_id, url, html) and their text pieces (tag #text), in document order: an element holds
    the numbers from node to last. levels: bits of the page's largest number. Each page is parsed once, in linear time; a
    null page has its root only. Write the result out where several steps read it."""
    columns = [f.split()[0] for f in NODES.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for batch in batches:
            for page, url, body in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                found = Elements(body or "").rows
                levels = (len(found) - 1).bit_length()
                rows += [{"page_id": page, "url": url, "levels": levels, **r} for r in found]
                if len(rows) >= HELD_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)

    return pages.select("page_id", "url", "html").mapInPandas(parse, NODES)


def tel_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, candidate, evidence: numbers in tel: links with the text of the nearest list item, paragraph,
    address, division or section around them (else the link's own)."""
    some = pages.where(F.col("html").contains("tel:")).select("page_id", F.lit("").alias("url"), "html")
    nodes = saved(html_nodes(some), "nodes")
    links = nodes.where((F.col("tag") == "a") & F.col("href").startswith("tel:")).select("page_id", "node", "last", "href")
    boxes = within(nodes.where(F.col("tag").isin(*CONTAINERS)).select("page_id", "node", "last", "levels"), links)
    boxes = boxes.groupBy("page_id", "node").agg(F.max("outer").alias("box"))  # the innermost begins last
    links = links.join(boxes, ["page_id", "node"], "left").withColumn("box", F.coalesce("box", "node"))
    texts = text_within(nodes, links.select("page_id", F.col("box").alias("node")).distinct())
    links = links.join(texts.select("page_id", F.col("node").alias("box"), "text"), ["page_id", "box"], "left")
    number = F.regexp_extract(F.substring("href", 5, 1_000_000), r"^([^?]*)", 1)
    return links.select("page_id", F.col("node").alias("pos"), number.alias("candidate"), F.coalesce("text", F.lit("")).alias("evidence"))


def absolute(href: Column, base: Column) -> Column:
    """A link's address seen from its page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike("^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, link: canonical addresses of a page's links, once each."""
    hrefs = F.explode(F.regexp_extract_all(F.col("html"), F.lit("<a [^>]*href=\"([^\"]*)\""), F.lit(1)))
    found = pages.select("page_id", "url", hrefs.alias("href")).where(
        (F.col("href") != "") & ~F.col("href").rlike("^(?i)(#|mailto:|tel:|javascript:)"))
    return found.select("page_id", "url", canonical_url(absolute(F.col("href"), F.col("url"))).alias("link")).distinct()


def relevant_links(pages: DataFrame) -> DataFrame:
    """Same-site links whose path has a telling term and no blocked one."""
    links = page_links(pages)
    path = F.regexp_extract("link", r"^https?://[^/?#]+([^?#]*)", 1)
    ok = is_allowed_url(F.col("link"), registrable_scope(url_host(F.col("url")))) & has_path_term(path, RELEVANT_PATH_TERMS)
    return links.where(ok).select("page_id", "link")


def plain_text(c: Column) -> Column:
    """Text without scripts, styles and tags."""
    bare = F.regexp_replace(text_of(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, "<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s*\n\s*", "\n"))


def phones_from_pages(pages: DataFrame, leader: str = "") -> DataFrame:
    """page_id, phone, kind, attribution, confidence, evidence: numbers of tel: links, then phone-shaped numbers
    anywhere in the visible text with a cue word within 180 characters before or after; each number of a page once,
    the first. pages: page_id, html."""
    shape = F.lit(PHONE_SHAPE)
    shown = pages.where(F.col("html").rlike(r"\d{3}")).select("page_id", clean_spaces(plain_text(F.col("html"))).alias("t"))
    seen = shown.select("page_id", "t", F.posexplode(positions(F.col("t"), shape)).alias("pos", "at"))
    near = around(F.col("t"), F.col("at.start"), F.length("at.match"), 180, 180)
    seen = seen.select("page_id", F.lit(1).alias("step"), "pos", F.col("at.match").alias("candidate"), near.alias("evidence"))
    found = tel_links(pages).select("page_id", F.lit(0).alias("step"), "pos", "candidate", "evidence").unionByName(seen)
    found = found.withColumn("phone", normalize_public_phone(F.col("candidate"))).where("phone != ''")
    found = found.withColumn("evidence", F.substring(clean_spaces(F.col("evidence")), 1, 280)).withColumn("key", normalize_text(F.col("evidence")))
    cue = any_of([F.col("key").contains(c) for c in PHONE_CUES])
    name = plain_name(leader)
    theirs = F.col("key").contains(name) if name else F.lit(False)
    link = F.col("step") == 0
    found = found.where(link | cue).withColumns({
        "attribution": F.when(theirs, "leader_context").otherwise("company_general"),
        "confidence": F.when(link & theirs, "high").when(link | theirs, "medium").otherwise("low"),
    })
    one = F.row_number().over(Window.partitionBy("page_id", "phone").orderBy("step", "pos"))
    return found.withColumn("n", one).where("n = 1").select(
        "page_id", "phone", phone_type(F.col("phone"), F.col("evidence")).alias("kind"), "attribution", "confidence", "evidence")


def message_links(df: DataFrame, key: str, html_column: str) -> DataFrame:
    """One row for each http link of a message, with a token that a rerun gives again."""
    found = F.posexplode(F.regexp_extract_all(F.col(html_column), F.lit("<a [^>]*href=\"(https?://[^\"]*)\""), F.lit(1)))
    rows = df.select(key, found.alias("pos", "destination_url"))
    token = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("pos").cast("string"), "destination_url"), 256)
    return rows.withColumn("token", token)
