"""Made-up web pages with a label for each block, to train the page model on.

A page is a random layout: banners, menus, adverts, notices, an article in one of many containers (with a header or footer
of its own, adverts, forms and notices inside it), reader comments, side bars and a footer. Words are random letters, so nothing can be learned
from vocabulary, only from ancestors and the look of the text. Part of the pages name their containers in words that
say nothing, as a page in any other language does; roles, which the standard fixes, stay.
"""

from __future__ import annotations

import random

MAIN = [
    ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"),
    ("div", "post-content"), ("section", "entry"), ("div", "story"), ("div", "main-text"), ("section", "article"),
    ("div", "entry-content"), ("div", "body-copy"), ("div", "text"),
]
SHELL = [("div", "page"), ("div", "container"), ("div", "wrapper"), ("div", "row"), ("div", "site"), ("div", "")]
PARTS = {
    "menu": [("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "navigation"), ("ol", "breadcrumb"), ("div", "links"), ("nav", "toc")],
    "banner": [("header", ""), ("div", "header"), ("div", "banner"), ("div", "masthead"), ("div", "topbar"), ("header", "site-header")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "advertisement"), ("div", "sponsored"), ("section", "promo"), ("div", "adbox")],
    "notice": [("div", "notice"), ("div", "cookie-banner"), ("div", "alert"), ("section", "consent"), ("div", "newsletter"), ("div", "paywall"), ("div", "popup")],
    "form": [("form", ""), ("form", "search"), ("form", "subscribe"), ("div", "login-form")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "related"), ("section", "widget"), ("div", "share"), ("div", "tags"), ("aside", "recommended")],
    "comments": [("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "discussion"), ("div", "replies"), ("section", "responses"), ("div", "disqus")],
    "byline": [("header", ""), ("header", "entry-header"), ("div", "header")],
    "colophon": [("footer", ""), ("footer", "entry-footer"), ("footer", "post-meta")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site-footer"), ("div", "legal")],
}

#: Roles of the standard that pages give to these parts.
ROLES = {
    "menu": "navigation", "banner": "banner", "notice": "dialog", "form": "search", "side": "complementary", "footer": "contentinfo",
}


def _words(r: random.Random, n: int) -> str:
    letters = "aeioulnrstdmcpé"
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(n))


def _sentences(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        words = _words(r, r.randint(3, 22)).capitalize()
        if r.random() < 0.05:
            words = words.replace(" ", r.choice([" | ", "*** ", " © ", "; "]))
        out.append(words + r.choice("....!?"))
    text = " ".join(out)
    # Some texts go without their last mark, or without any.
    return text if r.random() < 0.95 else text.replace(".", "") if r.random() < 0.5 else text[:-1]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []
        #: Whether this site names its parts in words that say nothing.
        self.foreign = self.r.random() < 0.45

    def block(self, tag: str, text: str, label: int, inner: str = "") -> None:
        self.out.append(f"<{tag}>{inner or text}</{tag}>")
        self.labels.append(label)

    def wrap(self, shell: tuple[str, str], role: str | None = None) -> str:
        tag, name = shell
        if self.foreign and name:
            name = _words(self.r, 1)
        said = f' {self.r.choice(["class", "id"])}="{name}"' if name else ""
        said += f' role="{role}"' if role and self.r.random() < 0.3 else ""
        self.out.append(f"<{tag}{said}>")
        return f"</{tag}>"

    def part(self, kind: str) -> None:
        r, end = self.r, self.wrap(self.r.choice(PARTS[kind]), ROLES.get(kind))
        if kind in ("menu", "banner", "side", "footer") and r.random() < 0.8:
            for _ in range(r.randint(1, 7)):
                text = _words(r, r.randint(1, 5))
                self.block(r.choice(["li", "p", "div"]), text, 0, f'<a href="/x">{text}</a>')
        if kind in ("advert", "notice", "side", "form", "banner"):
            for _ in range(r.randint(1, 2)):
                self.block(r.choice(["p", "div", "p", "h3"]), _sentences(r, 1, 3), 0)
        if kind in ("byline", "colophon"):
            for _ in range(r.randint(1, 2)):
                text = _words(r, r.randint(2, 6))
                self.block(r.choice(["p", "div"]), text + r.choice(["", "", "."]), 0)
        if kind == "form":
            self.block(r.choice(["button", "div", "p"]), _words(r, 2), 0)
        if kind == "comments":
            self.comments()
        if kind == "footer":
            self.block(r.choice(["p", "div"]), "", 0, f"&copy; {_words(r, 3)} {r.choice(['&middot; ', '| ', ''])}{_sentences(r, 1, 1)}")
        self.out.append(end)

    def comments(self) -> None:
        """A heading, perhaps a form, and entries: bare blocks, or items of one look with a name, a time and a text."""
        r = self.r
        if r.random() < 0.8:
            self.block(r.choice(["h2", "h3", "p"]), _words(r, r.randint(1, 3)), 0)
        item, name = r.choice([("div", _words(r, 1)), ("li", ""), ("article", _words(r, 1)), ("div", "comment")]) if r.random() < 0.6 else ("", "")
        for _ in range(r.randint(1, 6)):
            end = self.wrap((item, name)) if item and not self.foreign else ""
            if item and self.foreign:
                self.out.append(f'<{item} class="{name}">')
                end = f"</{item}>"
            if item and r.random() < 0.7:
                self.block(r.choice(["p", "div", "h4"]), _words(r, r.randint(1, 4)), 0)
            self.block(r.choice(["p", "div"] if item else ["p", "div", "li"]), _sentences(r, 1, 6), 0)
            self.out.append(end)
        if r.random() < 0.3:
            self.part("form")

    def article(self) -> None:
        r = self.r
        ends = [self.wrap(r.choice(SHELL)) for _ in range(r.randint(0, 2))]
        # Sites name their containers as they like: a third have names that say nothing.
        shell = r.choice(MAIN)
        ends.append(self.wrap((shell[0], _words(r, 1)) if r.random() < 0.33 else shell))
        if r.random() < 0.15:
            self.part("byline")
        if r.random() < 0.9:
            self.block(r.choice(["h1", "h1", "h2"]), _words(r, r.randint(2, 12)), 1)
        # Some articles are a line or two.
        brief = r.random() < 0.12
        for _ in range(r.randint(1, 2) if brief else r.randint(1, 10)):
            kind = r.random()
            if brief:
                self.block("p", _words(r, r.randint(1, 6)).capitalize() + r.choice([".", ".", "", "!"]), 1)
            elif kind < 0.72:
                self.block("p", _sentences(r, 1, 7), 1)
            elif kind < 0.78:
                self.block(r.choice(["h2", "h3"]), _words(r, r.randint(1, 7)), 1)
            elif kind < 0.84:
                for _ in range(r.randint(2, 4)):
                    self.block("li", _words(r, r.randint(2, 14)), 1)
            elif kind < 0.88:
                self.block(r.choice(["blockquote", "pre", "td", "figcaption"]), _sentences(r, 1, 2), 1)
            else:
                self.part(r.choice(["advert", "notice", "form", "side"]))
        if r.random() < 0.2:
            self.part("colophon")
        # Some sites keep what readers say, and notices, inside the article's own container.
        if r.random() < 0.25:
            self.part("comments")
        self.out.extend(reversed(ends))

    def html(self) -> str:
        r = self.r
        for kind in ("notice", "banner", "menu", "advert"):
            if r.random() < 0.6:
                self.part(kind)
        self.article()
        for kind in ("comments", "side", "advert", "form", "footer"):
            if r.random() < 0.6:
                self.part(kind)
        return f"<html><head><title>{_words(r, 3)}</title></head><body>{''.join(self.out)}</body></html>"


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    """`count` pages as (html, one label per block: 1 for the article's own)."""
    found = []
    for i in range(count):
        page = _Page(seed * 1_000_003 + i)
        found.append((page.html(), page.labels))
    return found
