"""Main text of web pages by consensus paths of their host.

Each page's containers are scored by the text that is not in links; the best one's
generalised path (tags and classes from the body down, digits left out) is the
page's vote.  Spark counts the votes of each host; then the text of each page is
taken again from its blocks, by those that lie in elements at the host's winning
path.  A page that has no such element is read at its own best container.

For the votes a page is parsed to its best path alone, then to its blocks of text, each
with the paths around it; only these blocks meet the host's path, in Spark
expressions.  No html is shuffled.

Elements with a class, id or role that says nothing but `MARKS` and `FILLERS`, such as
"sidebar-left" but not "related-work", are left out, elements of running text only by
the marks of adverts; so are forms, headers, asides and dialogs, and what is named for
readers' comments among other words.  But all of these only unless the page itself says
that they hold the article (see `Page.spared`): then it is read again with them as any
other.  An article's own header is part of it.  Of several articles at one path those
that are short beside the longest are others' teasers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let
from .text import find_package, slices

OPENING = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Tags whose content is not text, that are left out, that hold text, that end a block.
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object video audio".split())
OUT = frozenset("head nav footer button select menu".split())
#: Tags that are left out unless they hold the article; words for readers' comments, and words beside which these say nothing of an element.
SOFT = frozenset("form header aside dialog".split())
COMMENTS = frozenset("comment comments commentlist commenter disqus replies".split())
NOT_OF = frozenset("no not has have with without hide hidden show open closed on off enabled disabled allow count counts number link links".split())
CASED = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HOLDS = frozenset("body main article section div td".split())
BREAKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert contentinfo complementary search login modal overlay skip toc respond reply replies".split())
WORD = re.compile(r"[A-Za-z]+")
#: Words beside which a mark is still one; elements of running text, and the marks that leave these out.
FILLERS = frozenset("area article bar block body bottom bottoms box button buttons center column container content div fixed floating form global group head id inline inner item items js left link links list main mobile module outer page panel post reader region right row section site sticky title top unit user widgets wp wrap wrapper zone".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figure figcaption code em strong b i span".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adslot banner consent cookie cookies gdpr promo promoted sponsor sponsored subscribe newsletter".split())
#: Containers or marked elements in each other that are told apart; what is deeper counts as its ancestor's.
DEPTH = 64
#: Parts in which the pages of each host are joined to its winning path.
SALTS = 1024


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(rest)} if rest else {}


def left_out(tag: str, own: dict[str, str]) -> bool:
    return tag in OUT or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()


def marked(tag: str, own: dict[str, str], inside: bool = False) -> bool:
    """inside: whether an article is open, in which headers are its own and ids of sections are names of headings."""
    marks = ADVERTS if tag in RUNNING or tag == "header" and inside else MARKS
    named = "" if tag == "section" and inside else own.get("id", "")
    for token in f"{own.get('class', '')} {named} {own.get('role', '')}".split():
        said = [w.lower() for w in WORD.findall(token)]
        if any(w in marks for w in said) and all(w in MARKS or w in FILLERS for w in said):
            return True
    return False


def commented(tag: str, own: dict[str, str]) -> bool:
    """Whether an element is named for readers' comments, whatever else it is named for."""
    if tag in RUNNING:
        return False
    said = [{w.lower() for w in CASED.findall(token)} for token in f"{own.get('class', '')} {own.get('id', '')}".split()]
    return any(words & COMMENTS and not words & NOT_OF for words in said)


def tag_end(html: str, at: int) -> int:
    """Where the `>` of a tag is whose name ends at `at`: the first outside quotes, or if they do not close, the first."""
    j = at
    while m := QUOTE_OR_END.search(html, j):
        if m[0] == ">":
            return m.start()
        j = html.find(m[0], m.end()) + 1
        if not j:
            break
    return html.find(">", at)


def name(tag: str, own: dict[str, str]) -> str:
    """A tag with its classes, digits left out."""
    classes = sorted({re.sub(r"[0-9]+", "", c) for c in own.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


class Page:
    """One pass over a page's tokens: its containers with their paths, and the blocks of text in each."""

    def __init__(self, html: str):
        self.paths: list[str] = ["body"]  # of each container, by number; 0 stands for the whole page
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["body"]
        self.score: list[float] = [0.0]
        self.blocks: list[tuple[list[int], str]] = []  # the open containers, and a block's text
        self.marks: list[list[int]] = []  # of each marked element: text outside links, titles, articles, whether it is in another, whether it is named for comments
        self.all, self.kept, self.titles, self.articles = 0, 0, 0, 0  # text outside links, that of it outside marked elements; titles; articles
        self._read(html, frozenset())
        if spared := self.spared():
            self.paths, self.parents, self.tags, self.score, self.blocks = ["body"], [-1], ["body"], [0.0], []
            self._read(html, spared)

    def spared(self) -> frozenset[int]:
        """Marked elements that hold the article: most of the text outside links, while no article is elsewhere, and a title or article; or three quarters of it, but not readers' comments, while no title is elsewhere either; or nothing is outside of marked elements."""
        found = set()
        for i, (text, titles, articles, inner, talk) in enumerate(self.marks):
            leads = (titles or articles) and articles == self.articles
            whole = 4 * text > 3 * self.all and not talk and (titles, articles) == (self.titles, self.articles)
            if 2 * text > self.all and (leads or whole or not self.kept and not inner):
                found.add(i)
        return frozenset(found)

    def _read(self, html: str, spared: frozenset[int]) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, container or -1 (-2 for a marked element), left out
        open_: list[int] = [0]
        marks: list[int] = []  # the open marked elements
        skipped = links = nth = 0
        self.marks, self.all, self.kept, self.titles, self.articles = [], 0, 0, 0, 0
        text: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal text, linked
            if text:
                block = " ".join(unescape("".join(text)).split())
                if block:
                    self.blocks.append((list(open_), block))
                    worth = max(0, len(block) - 2 * linked)
                    self.score[open_[-1]] += worth
                    if (up := self.parents[open_[-1]]) >= 0:
                        self.score[up] += worth / 2
                text, linked = [], 0

        def add(piece: str) -> None:
            nonlocal linked
            text.append(piece)
            if links:
                linked += len(piece.strip())

        def take(piece: str) -> None:
            if skipped == len(marks) and not links:  # only marks leave it out, if anything does
                n = len(piece.strip())
                self.all += n
                self.kept += 0 if marks else n
            if not skipped:
                add(piece)

        def turn(mark: int, sign: int) -> None:
            """A mark's counts are what has been counted when it closes less what had been when it opened."""
            for k, n in enumerate((self.all, self.titles, self.articles)):
                self.marks[mark][k] += sign * n

        def push(item: tuple[str, int, bool]) -> None:
            stack.append(item)
            open_tags[item[0]] += 1

        at, size, last = 0, len(html), html.rfind(">")
        open_tags: Counter = Counter()  # of the stack
        while at < size:
            m = OPENING.search(html, at)
            while m and not m[1] and m.start() > last:  # without a `>` to come only a comment can begin
                m = OPENING.search(html, k) if (k := html.find("<!--", m.end())) >= 0 else None
            if not m:
                take(html[at:])
                break
            if m.start() > at:
                take(html[at : m.start()])
            if m[1]:
                at = html.find("-->", m.end()) + 3
                if at < 3:
                    break
                continue
            tag = (m[3] or "").lower()
            end = tag_end(html, m.end()) if tag else html.find(">", m.end())
            rest = html[m.end() : end] if tag else ""
            at = end + 1
            if not tag:
                continue
            if m[2]:  # an end tag closes its element and all that is open in it
                if tag in BREAKS and not skipped:
                    flush()
                if tag == "a":
                    links = max(0, links - 1)
                for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                    if stack[k][0] == tag:
                        open_tags.subtract(s[0] for s in stack[k:])
                        for _, container, out in reversed(stack[k:]):
                            if out:
                                skipped -= 1
                                if container == -2:
                                    turn(marks.pop(), 1)
                            elif container > 0 and not skipped:
                                open_.pop()
                        del stack[k:]
                        break
                continue
            if tag in RAW:
                if tag in ("svg", "math") and rest.endswith("/"):  # the only ones of these that can close themselves
                    continue
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag in BREAKS and not skipped:
                flush()
            if tag in VOID or rest.endswith("/"):
                continue
            if tag == "a":
                links += 1
                continue
            own = attributes(rest) if rest else {}
            inside = open_tags["article"] > 0
            soft = tag in SOFT and not (tag == "header" and inside)
            out = tag in OUT if not own else left_out(tag, own)
            out = out or soft and len(marks) >= DEPTH
            talk = bool(own) and commented(tag, own)
            mark = not out and len(marks) < DEPTH and (soft or talk or bool(own) and marked(tag, own, inside))
            if not out and skipped == len(marks) and (tag in ("h1", "main") or tag == "article" and not mark):
                self.titles += tag == "h1"
                self.articles += tag != "h1"
            if mark and tag not in ("body", "html", "main") and (talk or tag != "article"):
                nth += 1
                mark = nth - 1 not in spared
                self.marks.append([0, 0, 0, len(marks), talk])
                turn(nth - 1, -1)
                if not mark:  # read as any other, and not counted again
                    self.marks[nth - 1] = [0, 0, 0, 0, talk]
            else:
                mark = False
            if out or mark:
                flush()
                skipped += 1
                if mark:
                    marks.append(nth - 1)
                push((tag, -2 if mark else -1, True))
            elif tag in HOLDS:
                container = -1
                if not skipped and tag != "body" and len(open_) <= DEPTH:
                    container = len(self.paths)
                    self.paths.append(f"{self.paths[open_[-1]]}>{name(tag, own)}")
                    self.parents.append(open_[-1])
                    self.tags.append(tag)
                    self.score.append(0.0)
                    open_.append(container)
                if tag != "body":
                    push((tag, container, False))
            elif own:
                push((tag, -1, False))
        flush()
        while marks:
            turn(marks.pop(), 1)

    def names(self) -> list[str | None]:
        """The path of each container; none of an article that has less than a third of the text of another one at its path."""
        held = [0] * len(self.paths)
        for containers, block in self.blocks:
            for i in containers:
                held[i] += len(block)
        most: dict[str, int] = {}
        for path, n in zip(self.paths, held, strict=True):
            most[path] = max(n, most.get(path, 0))
        return [None if tag == "article" and 3 * n < most[path] else path for path, tag, n in zip(self.paths, self.tags, held, strict=True)]

    def best(self) -> str:
        """The path of the best container; an article or main element around it takes its place."""
        if not self.blocks:
            return ""
        at = max(range(len(self.score)), key=lambda i: self.score[i])
        up = at
        while up >= 0:
            if self.tags[up] in ("article", "main"):
                at = up
            up = self.parents[up]
        return self.paths[at]

    def text(self, path: str) -> str | None:
        """The blocks in all elements at the path; None if there is no such element."""
        wanted = {i for i, p in enumerate(self.names()) if p == path}
        if not wanted:
            return None
        return "\n".join(block for containers, block in self.blocks if wanted.intersection(containers))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    pages: page_id, url, html; other columns are not read.  Null, empty and text-free
    pages give an empty text.  Pages without a host vote together.  Ties between paths
    go to the higher total score, then to the path that sorts first.  One row comes
    out for each row that goes in.  Votes are summed before they are shuffled; the
    winning paths are joined by host and, as far as a host has pages, SALTS salts, so
    that neither step brings the pages of a large host together.
    """
    find_package(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    block = pa.struct([("text", pa.string()), ("at", pa.list_(pa.int32()))])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            read = [(of, Page(html or "")) for of, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [(of, path, int(max(page.score))) for of, page in read if (path := page.best())]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["host", "path", "score"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            best, paths, blocks = [], [], []
            for html in batch.column(4).to_pylist():
                page = Page(html or "")
                places: dict[str, int] = {}
                numbers = [-1 if p is None else places.setdefault(p, len(places)) for p in page.names()]
                best.append(page.best())
                paths.append(list(places))
                blocks.append([{"text": text, "at": sorted({numbers[i] for i in containers} - {-1})} for containers, text in page.blocks])
            made = [pa.array(best, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(blocks, pa.list_(block))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], ["page_id", "url", "host", "salt", "best", "paths", "blocks"])

    salt = F.when(F.col("page_id").isNull(), F.spark_partition_id()).otherwise(F.xxhash64("page_id"))
    source = pages.select("page_id", "url", host.alias("host"), F.pmod(salt, F.lit(SALTS)).cast("int").alias("salt"), "html")
    votes = source.select("host", "html").mapInArrow(vote, "host string, path string, score bigint")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    won = counted.groupBy("host").agg(F.min(F.struct(-F.col("n"), -F.col("score"), F.col("path"))).alias("best")).select("host", F.col("best.path").alias("path"))
    # A host has as many rows as its pages fill salts.
    spread = source.select("host", "salt").distinct().join(won, "host")
    parsed = source.mapInArrow(parse, f"page_id {kind}, url string, host string, salt int, best string, paths array<string>, blocks array<struct<text:string,at:array<int>>>")
    joined = parsed.join(spread, ["host", "salt"], "left")

    def at(path: str) -> Column:
        """The blocks in all elements at a path, one to a line."""
        of = lambda place: F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains(b.at, place)), lambda b: b.text), "\n")
        return F.coalesce(let(F.array_position("paths", F.col(path)).cast("int") - 1, of), F.lit(""))

    text = let(at("path"), lambda t: F.when(t != "", t).otherwise(at("best")))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
