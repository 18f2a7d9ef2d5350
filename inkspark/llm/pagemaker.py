"""Labelled web pages, composed from prose in many layouts, for training an extractor.

Every page has an article and some of: menus, headers, footers, sidebars,
notices, adverts, forms, shares, related links and reader comments. Layouts
differ in their elements, in how they name them (plainly, in ways of their own,
or not at all) and in what is missing; markup is sometimes broken. Blocks of the
article carry ``MARK``, which the reader of the labels takes off.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

MARK = "\ue000"

# fixed values: how sites name the parts of a page
NAMES = {
    "article": ["article", "post", "post-content", "entry-content", "content", "main-content", "story", "story-body", "article-body", "articleText", "text", "page-content", "blog-post", "body-copy"],
    "nav": ["nav", "menu", "main-menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "tabs", "pagination", "site-nav"],
    "header": ["header", "site-header", "masthead", "top", "banner", "topbar", "branding", "page-header", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "imprint", "foot"],
    "aside": ["sidebar", "side", "widget", "widget-area", "rail", "right-column", "aside", "secondary", "toc", "tags"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "message", "paywall", "newsletter", "subscribe", "popup", "modal", "announcement", "disclaimer", "privacy"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "ad-slot", "partner", "teaser"],
    "form": ["form", "search", "search-form", "login", "signup", "contact-form", "subscribe-form"],
    "related": ["related", "related-posts", "more", "recommended", "trending", "popular", "read-next", "latest", "see-also"],
    "share": ["share", "social", "share-buttons", "follow", "meta-actions", "toolbar"],
    "comments": ["comments", "comment-list", "comment", "comment-body", "discussion", "responses", "replies", "reader-comments", "disqus", "feedback"],
}
#: Elements that a part may stand in beside a plain div.
ELEMENTS = {
    "nav": ["nav", "nav", "ul", "menu"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div"],
    "aside": ["aside", "aside", "section", "div"],
    "notice": ["div", "aside", "section", "dialog", "p"],
    "ad": ["div", "div", "aside", "section", "p", "ins"],
    "form": ["form"],
    "related": ["section", "aside", "div", "nav"],
    "share": ["div", "ul", "section"],
    "comments": ["section", "div", "aside", "ol"],
}
SHORT = ["Home", "About us", "Contact", "Log in", "Sign up", "Share", "Tweet", "Print", "Read more", "Next", "Previous", "Search", "Menu", "Accueil", "Startseite", "Inicio", "Impressum", "Datenschutz", "RSS"]


class Page:
    """One page under way."""

    def __init__(self, rng: random.Random, sentences: list[str]):
        self.rng, self.sentences = rng, sentences
        # how this site names its parts: plainly, or with signs of its own, or not
        self.naming = rng.choices(["plain", "odd", "none"], [6, 1.5, 2.5])[0]
        self.broken = rng.random() < 0.25

    def words(self, few: int, many: int) -> str:
        s = self.rng.choice(self.sentences).split()
        return " ".join(s[: self.rng.randint(few, many)]) or "word"

    def prose(self, few: int, many: int) -> str:
        return " ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(few, many)))

    def attributes(self, part: str) -> str:
        if self.naming == "none" or (self.naming == "plain" and self.rng.random() < 0.15):
            return ""
        if self.naming == "odd":
            return f' class="{"".join(self.rng.choice("bcdfgklmnprstvz") for _ in range(4))}-{self.rng.randint(1, 9)}"'
        name = self.rng.choice(NAMES[part])
        return self.rng.choice([f' class="{name}"', f' class="{name} col"', f' id="{name}"', f" class='{name}'", f' class="{name}" data-n="1"'])

    def inside(self, part: str, html: str) -> str:
        name = self.rng.choice(ELEMENTS[part])
        return f"<{name}{self.attributes(part)}>{html}</{name}>"

    def links(self, few: int, many: int) -> str:
        label = lambda: escape(self.rng.choice([self.rng.choice(SHORT), self.words(1, 3), self.words(3, 9)]))
        items = [f'<a href="/{i}">{label()}</a>' for i in range(self.rng.randint(few, many))]
        return self.rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"])

    # parts that are no article

    def nav(self) -> str:
        return self.inside("nav", self.links(2, 8))

    def header(self) -> str:
        return self.inside("header", self.rng.choice(["", f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1><p>{self.words(3, 8)}</p>", f"<div>{self.words(1, 4)}</div>"]) + self.rng.choice(["", self.nav()]))

    def footer(self) -> str:
        line = self.rng.choice([f"&copy; {self.words(1, 2)} &middot; {self.prose(1, 1)}", f"&copy; 2024 {self.words(1, 3)}", self.prose(1, 2), f"{self.words(1, 3)} | {self.words(1, 3)}"])
        line = self.rng.choice([line, f"<p>{line}</p>", f"<div>{line}</div>"])
        return self.inside("footer", self.rng.choice([line, self.links(2, 6) + line, line + self.links(2, 5)]))

    def aside(self) -> str:
        body = self.rng.choice([self.links(2, 7), f"<p>{self.prose(1, 3)}</p>", f"<p>{self.words(4, 12)}</p>" + self.links(2, 4), self.prose(1, 2)])
        return self.inside("aside", self.rng.choice([f"<h3>{self.words(1, 4)}</h3>", "", f"<h2>{self.words(1, 3)}</h2>"]) + body)

    def notice(self) -> str:
        text = self.prose(1, 2)
        return self.inside("notice", self.rng.choice([text, f"<p>{text}</p>", f"<p>{text} <a href='/privacy'>{self.words(1, 3)}</a></p>", f"<span>{text}</span><button>OK</button>"]))

    def ad(self) -> str:
        text = self.rng.choice([self.prose(1, 2), self.words(3, 9), f'<a href="/go">{self.words(3, 9)}</a>', self.prose(1, 1)])
        return self.inside("ad", self.rng.choice([text, f"<p>{text}</p>", f"<div>{text}</div>", f"<span>{text}</span>"]))

    def form(self) -> str:
        return self.inside("form", f"<label>{self.words(1, 4)}</label> <input name='q'> " + self.rng.choice(["", f"<p>{self.prose(1, 1)}</p>", f"<button>{self.words(1, 2)}</button>", f"<legend>{self.words(1, 4)}</legend>", f"<div>{self.words(2, 6)}</div>"]))

    def related(self) -> str:
        body = self.rng.choice([self.links(2, 6), "".join(f"<div><h3><a href='/{i}'>{self.words(3, 8)}</a></h3><p>{self.words(6, 20)}</p></div>" for i in range(self.rng.randint(2, 4)))])
        return self.inside("related", self.rng.choice([f"<h2>{self.words(1, 4)}</h2>", f"<h3>{self.words(1, 3)}</h3>", ""]) + body)

    def share(self) -> str:
        return self.inside("share", self.links(2, 5))

    def comments(self) -> str:
        each = []
        for _ in range(self.rng.randint(1, 5)):
            said, who = self.prose(1, 3), self.words(1, 2)
            body = self.rng.choice([f"<p>{said}</p>", f"<div>{said}</div>", said, f"<blockquote>{said}</blockquote>", f"<article><p>{said}</p></article>"])
            by = self.rng.choice([f"<b>{who}</b> ", f"<div>{who}, 12:30</div>", f"<cite>{who}</cite> ", f"<h4>{who}</h4>", ""])
            name = self.rng.choice(["div", "li", "div", "article"])
            each.append(f"<{name}{self.attributes('comments')}>{by}{body}</{name}>")
        return self.inside("comments", self.rng.choice([f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>", ""]) + "".join(each))

    # the article

    def inline(self, text: str) -> str:
        words = escape(text, quote=self.rng.random() < 0.5).split(" ")
        for i in range(len(words)):
            if self.rng.random() < 0.02:
                words[i] = self.rng.choice([f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", f'<a href="/x">{words[i]}</a>', f"<code>{words[i]}</code>", f"{words[i]}<br>", f"<span>{words[i]}</span>"])
        return " ".join(words)

    def paragraph(self, name: str) -> str:
        text = MARK + self.inline(self.rng.choices([self.prose(1, 1), self.prose(2, 6), self.words(1, 4), self.prose(6, 14)], [3, 6, 1, 1])[0])
        if self.broken and self.rng.random() < 0.4:
            return self.rng.choice([f"<{name}><b>{text}<br>", f"<{name}>{text}", f"<{name}><i>{text}</{name}>"]) if name == "p" else f"<{name}><b>{text}</{name}>"
        return f"<{name}>{text}</{name}>"

    def title(self, name: str) -> str:
        return f"<{name}>{MARK}{self.inline(self.words(2, 12))}</{name}>"

    def article(self) -> str:
        name = self.rng.choices(["p", "div"], [6, 1])[0]
        parts = [self.title("h1")] if self.rng.random() < 0.75 else []
        if parts and self.rng.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(self.rng.choices([self.rng.randint(1, 4), self.rng.randint(4, 14), self.rng.randint(14, 40)], [4, 5, 1])[0]):
            kind = self.rng.random()
            if kind < 0.08:
                parts.append(self.title(self.rng.choice(["h2", "h3"])))
            elif kind < 0.13:
                listed = self.rng.choice(["ul", "ol"])
                parts.append(f"<{listed}>" + "".join(f"<li>{MARK}{self.inline(self.rng.choice([self.words(2, 9), self.prose(1, 2)]))}</li>" for _ in range(self.rng.randint(2, 5))) + f"</{listed}>")
            elif kind < 0.16:
                parts.append(f"<blockquote>{self.paragraph('p')}</blockquote>")
            elif kind < 0.18:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 3)}</td></tr>" for _ in range(self.rng.randint(1, 3))) + "</table>")
            elif kind < 0.19:
                parts.append(f"<pre>{MARK}{self.inline(self.words(3, 12))}</pre>")
            else:
                parts.append(self.paragraph(name))
            if self.rng.random() < 0.1:
                parts.append(self.rng.choice([self.ad, self.share, self.related, self.aside, self.notice])())
        for extra in (self.share, self.related, self.ad, self.form):
            if self.rng.random() < 0.06:
                parts.append(extra())
        body = "".join(parts)
        place = self.rng.choices(["article", "main", "div", "section", "bare", "both"], [6, 2, 4, 1, 1.5, 2])[0]
        if place == "bare":
            return body
        if place == "both":
            return f"<main><article{self.attributes('article')}>{body}</article></main>"
        return f"<{place}{self.attributes('article')}>{body}</{place}>"

    def html(self) -> str:
        maybe = lambda p, *parts: "".join(f() for f in self.rng.sample(parts, len(parts)) if self.rng.random() < p)
        article = self.article()
        before = maybe(0.55, self.nav, self.header) + maybe(0.3, self.notice, self.ad, self.form, self.aside)
        after = maybe(0.3, self.share, self.related, self.aside, self.ad, self.notice, self.form) + maybe(0.35, self.comments) + maybe(0.7, self.footer)
        if self.rng.random() < 0.3:
            around = self.rng.choice(["wrapper", "container", "page", "site", "layout"])
            body = before + f'<div class="{around}">' + article + (after + "</div>" if self.rng.random() < 0.5 else "</div>" + after)
        else:
            body = before + article + after
        if self.rng.random() < 0.1:
            body = article
        end = "</body></html>" if self.rng.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style></head><body><!-- {self.words(1, 3)} -->{body}<script>var t = '</p>';</script>{end}"


def pages(prose: list[str], count: int, seed: int) -> Iterator[str]:
    """``count`` pages; where the prose has fewer than 50 sentences, sentences of made-up words are added."""
    rng = random.Random(seed)
    sentences = [s.strip() + "." for text in prose for line in text.replace(MARK, " ").split("\n") for s in line.split(". ") if len(s.strip()) > 3]
    sentences = [s.replace("..", ".") for s in sentences]
    while len(sentences) < 50:
        words = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 18))]
        sentences.append(" ".join(words).capitalize() + ".")
    for _ in range(count):
        yield Page(rng, sentences).html()
