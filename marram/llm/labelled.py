"""Labelled pages for the page model: layouts drawn from a seeded generator.

Each page is a list of (html, blocks) pieces; ``blocks`` holds the label of every leaf block
that the piece adds, in order.  Words are made of random syllables, so a model can learn
nothing from them.
"""

from __future__ import annotations

import random

MAIN, REST = 1, 0

#: Class and id words in common use for each part of a page.
PARTS = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "toc", "pagination", "pager", "tabs"),
    "header": ("header", "masthead", "site-header", "topbar", "branding", "logo"),
    "footer": ("footer", "site-footer", "colophon", "copyright", "legal", "bottom", "credits"),
    "aside": ("sidebar", "side", "widget", "related", "rail", "recommended", "popular", "tags", "more-stories", "trending"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsense", "commercial"),
    "notice": ("cookie", "notice", "banner", "consent", "alert", "gdpr", "privacy-notice", "popup", "modal", "newsletter", "subscribe", "paywall"),
    "share": ("share", "social", "sharing", "follow", "like-buttons"),
    "comments": ("comments", "comment", "comment-list", "commentlist", "responses", "reply", "replies", "disqus", "discussion", "comment-body", "reviews"),
    "content": ("content", "article", "post", "entry", "story", "article-body", "entry-content", "post-body", "text", "main", "body-text", "story-body"),
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice(("ba", "co", "di", "el", "fu", "gor", "hin", "jo", "ka", "lum", "mer", "no", "pra", "qui", "ro", "sten", "tu", "ver")) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice((".", ".", ".", "?", ", " + self.words(2, 6) + ".")) for _ in range(self.r.randint(low, high)))

    def put(self, html: str, *labels: int) -> None:
        self.out.append(html)
        self.labels += labels

    def open(self, part: str, tags: tuple[str, ...], bare: float = 0.25) -> str:
        tag = self.r.choice(tags)
        plain = tag not in ("div", "section", "ul", "ol") and self.r.random() < bare
        name = "" if plain else f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(PARTS[part])}"'
        self.put(f"<{tag}{name}>")
        return f"</{tag}>"

    def links(self, low: int = 2, high: int = 8) -> None:
        self.put("<ul>")
        for _ in range(self.r.randint(low, high)):
            self.put(f'<li><a href="/{self.word()}">{self.words(1, 4)}</a></li>', REST)
        self.put("</ul>")

    def nav(self) -> None:
        end = self.open("nav", ("nav", "nav", "div", "ul"))
        if end == "</ul>":
            for _ in range(self.r.randint(2, 7)):
                self.put(f'<li><a href="#">{self.words(1, 3)}</a></li>', REST)
        else:
            self.links()
        self.put(end)

    def header(self) -> None:
        end = self.open("header", ("header", "header", "div"))
        if self.r.random() < 0.7:
            self.put(f"<{(t := self.r.choice(('h1', 'p', 'div', 'h2')))}>{self.words(1, 5)}</{t}>", REST)
        if self.r.random() < 0.6:
            self.nav()
        self.put(end)

    def footer(self) -> None:
        end = self.open("footer", ("footer", "footer", "div"))
        if self.r.random() < 0.5:
            self.links(1, 5)
        text = self.r.choice(("&copy; ", "", "Copyright ", "&copy; 2021 ")) + self.words(1, 4) + self.r.choice((".example.com &middot; ", " ", " | ")) + self.r.choice((self.words(2, 6), self.prose(1, 2)))
        tag = self.r.choice(("p", "div", ""))
        self.put(f"<{tag}>{text}</{tag}>" if tag else text, REST)
        self.put(end)

    def aside(self) -> None:
        end = self.open("aside", ("aside", "div", "section"))
        for _ in range(self.r.randint(1, 3)):
            self.put(f"<h3>{self.words(1, 4)}</h3>", REST)
            if self.r.random() < 0.6:
                self.links(1, 5)
            else:
                self.put(f"<p>{self.prose(1, 2)}</p>", REST)
        self.put(end)

    def ad(self) -> None:
        end = self.open("ad", ("div", "div", "section", "aside"))
        tag = self.r.choice(("p", "", "", "span"))
        text = self.prose(1, 3) if self.r.random() < 0.7 else f'<a href="#">{self.words(2, 6)}</a>'
        self.put(f"<{tag}>{text}</{tag}>" if tag else text, REST)
        self.put(end)

    def notice(self) -> None:
        end = self.open("notice", ("div", "div", "section"))
        self.put(f"<p>{self.prose(1, 3)}</p>", REST)
        if self.r.random() < 0.5:
            self.put(f"<button>{self.words(1, 2)}</button>", REST)
        self.put(end)

    def form(self) -> None:
        self.put(f'<form action="/{self.word()}">')
        if self.r.random() < 0.6:
            self.put(f"<p>{self.words(2, 9)}</p>", REST)
        self.put(f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>", REST, *([REST]))
        self.put("</form>")

    def share(self) -> None:
        end = self.open("share", ("div", "ul"))
        for _ in range(self.r.randint(1, 4)):
            self.put(f'<li><a href="#">{self.words(1, 2)}</a></li>', REST)
        self.put(end)

    def comments(self) -> None:
        end = self.open("comments", ("section", "div", "ol"))
        if self.r.random() < 0.6:
            self.put(f"<h2>{self.words(1, 3)}</h2>", REST)
        for _ in range(self.r.randint(1, 5)):
            inner = self.r.choice(("div", "li", "article"))
            name = f' class="{self.r.choice(("comment", "reply", "comment-body"))}"' if self.r.random() < 0.6 else ""
            self.put(f"<{inner}{name}>")
            if self.r.random() < 0.5:
                self.put(f"<h4>{self.words(1, 2)}</h4>", REST)
            self.put(f"<p>{self.prose(1, 4)}</p>", REST)
            self.put(f"</{inner}>")
        if self.r.random() < 0.3:
            self.form()
        self.put(end)

    def article(self) -> None:
        kind = self.r.random()
        if kind < 0.45:
            end = self.open("content", ("article",), 0.7)
        elif kind < 0.6:
            end = self.open("content", ("main",), 0.7)
        elif kind < 0.9:
            end = self.open("content", ("div", "section"))
        else:
            self.put("<div>")
            end = "</div>"
        if self.r.random() < 0.85:
            head = self.r.random() < 0.2
            self.put(("<header>" if head else "") + f"<h1>{self.words(2, 9).capitalize()}{self.r.choice(('', '.'))}</h1>" + ("</header>" if head else ""), MAIN)
        for _ in range(self.r.randint(1, 14)):
            kind = self.r.random()
            if kind < 0.66:
                self.put(f"<p>{self.prose(1, 8)}" + self.r.choice(("</p>", "</p>", "")), MAIN)
            elif kind < 0.74:
                self.put(f"<p><b>{self.prose(1, 1)}<br>", MAIN)
            elif kind < 0.8:
                self.put(f"<{(t := self.r.choice(('h2', 'h3')))}>{self.words(1, 8)}</{t}>", MAIN)
            elif kind < 0.85:
                self.put("<ul>")
                for _ in range(self.r.randint(1, 5)):
                    self.put(f"<li>{self.words(2, 12)}" + self.r.choice((".</li>", "</li>", "")), MAIN)
                self.put("</ul>")
            elif kind < 0.88:
                self.put(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>", MAIN)
            elif kind < 0.9:
                self.put("<table>")
                for _ in range(self.r.randint(1, 3)):
                    self.put(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>", MAIN, MAIN)
                self.put("</table>")
            elif kind < 0.92:
                self.put(f"<figure><figcaption>{self.words(3, 9)}</figcaption></figure>", MAIN)
            elif kind < 0.94:
                self.put(f"<pre>{self.words(3, 12)}</pre>", MAIN)
            elif kind < 0.96:
                self.put(f'<p>{self.words(2, 6)} <a href="/x">{self.words(1, 4)}</a> {self.prose(1, 3)}</p>', MAIN)
            else:
                self.r.choice((self.ad, self.share, self.aside, self.notice, self.form))()
        if self.r.random() < 0.15:
            self.comments()
        self.put(end)

    def bare(self) -> tuple[str, list[int]]:
        """A page of paragraphs alone."""
        tag = self.r.choice(("p", "p", "div", ""))
        for _ in range(self.r.randint(1, 4) if tag else 1):
            text = self.prose(1, 4) if self.r.random() < 0.7 else self.words(1, 6)
            self.put(f"<{tag}>{text}</{tag}>" if tag else text, MAIN)
        return "".join(self.out), self.labels

    def build(self) -> tuple[str, list[int]]:
        chance = self.r.random
        if chance() < 0.1:
            return self.bare()
        self.put("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body>")
        for part, p in ((self.notice, 0.25), (self.header, 0.5), (self.nav, 0.6), (self.form, 0.15), (self.ad, 0.4), (self.aside, 0.2)):
            if chance() < p:
                part()
        wrapped = chance() < 0.2
        if wrapped:
            self.put(self.r.choice(('<div id="page">', '<div class="wrapper">', '<div class="container">')))
        self.article()
        for part, p in ((self.share, 0.15), (self.ad, 0.2), (self.comments, 0.3), (self.aside, 0.3)):
            if chance() < p:
                part()
        if wrapped:
            self.put("</div>")
        for part, p in ((self.form, 0.15), (self.nav, 0.1), (self.footer, 0.75), (self.notice, 0.15)):
            if chance() < p:
                part()
        self.put("</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[int]]]:
    """``n`` pages with the label of every leaf block; the same for equal arguments."""
    return [_Page(seed * 1_000_003 + i).build() for i in range(n)]
