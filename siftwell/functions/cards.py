"""Postings on list pages: titles in anchors and in plain text, each with the address that its anchor or its nearest card gives."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that have no end, and elements whose content is not read.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset(("noscript", "script", "style"))

POSTINGS = "array<struct<title:string,url:string,kind:string>>"


@dataclass(frozen=True)
class PostingRules:
    """What a title, a card and a link to details look like; all are patterns that are searched for, without regard to case."""

    title: str  #: a title must hold this
    noise: str = r"(?!)"  #: and must not hold this
    card: str = r"(?!)"  #: what the text of a card holds
    detail: str = r"detail|apply|view"  #: the text of a card's link to its details
    elsewhere: str = r"(?!)"  #: paths that lead to no posting
    skip: str = r"(?!)"  #: anchors whose text holds this give no titles to the texts within them
    hosts: frozenset[str] = frozenset()  #: hosts that hold no postings
    shortest: int = 4
    longest: int = 40
    levels: int = 7  #: how many elements up a card may be
    card_size: int = 1600  #: the most characters that a card's text has, runs of white space counted as one


class _Outline(HTMLParser):
    """Elements in the order of their beginnings, each with its parent, its range of elements and its range of texts.

    An end without a beginning is ignored; one that skips open elements ends them too; what is open at the end of the page ends there.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.href, self.parent = [""], [None], [-1]
        self.text_from, self.text_to, self.last = [0], [-1], [-1]
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.open = [0]
        self.held: dict[str, int] = {}
        self.unread = 0

    def handle_starttag(self, tag, attrs):
        if tag in UNREAD:
            self.unread += 1
        if self.unread:
            return
        self.tag.append(tag)
        self.href.append(next(((v or "").strip() for k, v in attrs if k == "href"), None))
        self.parent.append(self.open[-1])
        self.text_from.append(len(self.texts))
        self.text_to.append(len(self.texts))
        self.last.append(len(self.tag))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
            self.held[tag] = self.held.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if tag not in UNREAD:
            self.handle_starttag(tag, attrs)
            if not self.unread and tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in UNREAD:
            self.unread = max(self.unread - 1, 0)
        elif not self.unread and self.held.get(tag):
            while self.end_last() != tag:
                pass

    def end_last(self) -> str:
        at = self.open.pop()
        self.text_to[at], self.last[at] = len(self.texts), len(self.tag)
        self.held[self.tag[at]] = self.held.get(self.tag[at], 1) - 1
        return self.tag[at]

    def handle_data(self, data):
        shown = " ".join(data.split())
        if shown and not self.unread:
            self.texts.append(shown)
            self.owner.append(self.open[-1])


class _Page:
    """An outline with the questions that postings ask of it."""

    def __init__(self, html: str, url: str, rules: PostingRules):
        self.rules, self.url = rules, url
        self.tree = _Outline()
        self.tree.feed(html)
        self.tree.close()
        while self.tree.open:
            self.tree.end_last()
        self.upto = [0, *itertools.accumulate(len(t) + 1 for t in self.tree.texts)]
        self.find: Callable[[str, str], object] = lambda pattern, text: re.search(pattern, text, re.IGNORECASE)

    def text(self, at: int) -> str:
        return " ".join(self.tree.texts[self.tree.text_from[at] : self.tree.text_to[at]])

    def size(self, at: int) -> int:
        return self.upto[self.tree.text_to[at]] - self.upto[self.tree.text_from[at]] - 1

    def title(self, text: str) -> str | None:
        """The text without bullets and runs of white space, if it is a title."""
        own = re.sub(r"^[\s·•●○\-—:：]+", "", " ".join(text.split()))
        fits = self.rules.shortest <= len(own) <= self.rules.longest
        return own if fits and self.find(self.rules.title, own) and not self.find(self.rules.noise, own) else None

    def leads(self, at: int) -> bool:
        """Whether an anchor has an address at all."""
        href = self.tree.href[at] or ""
        return bool(href) and href != "#" and not href.lower().startswith("javascript:")

    def target(self, at: int) -> str | None:
        """An anchor's whole address, if a posting may be there."""
        try:
            whole = urljoin(self.url, self.tree.href[at])
            parts = urlsplit(whole)
        except ValueError:
            return None
        bad = whole == self.url or parts.netloc.casefold() in self.rules.hosts or self.find(self.rules.elsewhere, parts.path)
        return None if bad else whole

    def ancestors(self, at: int):
        while at > 0:
            yield at
            at = self.tree.parent[at]

    def card_target(self, at: int) -> str | None:
        """The first link to details in the nearest card around an element."""
        for around in itertools.islice(self.ancestors(at), self.rules.levels):
            if self.size(around) > self.rules.card_size:
                return None
            if self.find(self.rules.card, self.text(around)):
                links = (a for a in range(around + 1, self.tree.last[around]) if self.tree.tag[a] == "a" and self.leads(a))
                return next((t for a in links if self.find(self.rules.detail, self.text(a)) and (t := self.target(a))), None)
        return None

    def postings(self) -> list[tuple[str, str, str]]:
        found: dict[str, tuple[str, str]] = {}
        for at, tag in enumerate(self.tree.tag):
            if tag == "a" and self.leads(at) and self.size(at) <= 16 * self.rules.longest:
                title = self.title(self.text(at))
                if title and title not in found and (to := self.target(at)):
                    found[title] = (to, "detail")
        for text, owner in zip(self.tree.texts, self.tree.owner, strict=True):
            title = self.title(text)
            if not title or title in found:
                continue
            anchor = next((a for a in self.ancestors(owner) if self.tree.tag[a] == "a"), None)
            if anchor is None:
                to = self.card_target(owner)
            elif self.find(self.rules.skip, self.text(anchor)):
                continue
            elif self.leads(anchor):
                to = self.target(anchor)
                if to is None:
                    continue
            else:
                to = None
            found[title] = (to, "detail") if to else (self.url, "list")
        return [(title, *rest) for title, rest in found.items()]


def read_postings(html: str | None, url: str | None, rules: PostingRules) -> list[tuple[str, str, str]]:
    """title, url and kind of every posting of a page, each title once: those that are whole anchors first, then those in texts,
    within anchors too. Comments are no text. Bullets before a title may be 15 times as long as the longest title.

    ``kind`` is detail, or list where nothing better than the page itself is known. A page that is null or can't be read has none.
    """
    try:
        return _Page(html or "", url or "", rules).postings()
    except (AssertionError, ValueError):  # markup that the parser gives up on
        return []


def postings(html: str | Column, url: str | Column, rules: PostingRules) -> Column:
    """Postings of pages, to be exploded; only the two columns go to Python."""

    @F.pandas_udf(POSTINGS)
    def read(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("title", "url", "kind"), p, strict=True)) for p in read_postings(h, u, rules)] for h, u in zip(pages, urls, strict=True)], index=pages.index)

    return read(html, url)
