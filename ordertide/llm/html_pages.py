"""Labelled pages for training: invented pages whose text blocks are known to be content or not.

Templates vary what real sites vary: where the article lies and under which names, which
other parts surround it, whether tags are closed. Every text piece is written between
marks that say what it is; the parser takes them off again.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Characters from the private-use area that mark a piece as content or not.
CONTENT, OTHER = "", ""

#: Names under which sites keep these parts.
WRAPPERS = ("article", "main", "section", "div.content", "div.post", "div.entry-content", "div.story-body", "div#main", "div.article-text", "td.text", "div", "div.page")
ASIDES = ("aside", "div.sidebar", "div#right-column", "section.related", "div.widget", "ul.related-links", "div.promo-box", "div.recommended")
NOTICES = ("div.cookie-notice", "div#consent", "div.alert", "div.notice", "p.disclaimer", "div.banner", "div.newsletter", "div.paywall")
ADVERTS = ("div.ad", "div.ads", "div.advert", "div.sponsored", "div#banner-ad", "aside.ad-slot", "ins.adsbygoogle", "section.promo")
HEADERS = ("header", "div.header", "div#masthead", "div.topbar", "div.site-title")
FOOTERS = ("footer", "div.footer", "div#footer", "div.copyright", "div.bottom")
MENUS = ("nav", "ul.menu", "div.navigation", "div.breadcrumb", "ol.breadcrumbs", "div#nav", "div.tabs", "div.share", "ul.social", "div.pagination", "div.tags")
LAYOUTS = ("div.wrapper", "div#page", "div.container", "main", "form", "div.with-sidebar", "div.has-header", "div.comments-open", "div.no-ads", "div.main-menu-left", "div.page-footer-fixed", "div")
COMMENTS = ("div.comments", "section#comments", "ol.comment-list", "div#disqus_thread", "div.replies", "div.user-reviews")

_SYLLABLES = ("ba", "re", "ti", "on", "the", "an", "le", "mo", "su", "er", "ing", "éa", "ü", "ch", "que", "ko", "ny", "da")


class Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.strict = rng.random() < 0.6  # whether tags are closed

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        words = [w + "," if self.rng.random() < 0.08 else w for w in words]
        if self.rng.random() < 0.12:
            words = [w + self.rng.choice(("***", "###", "&amp;&amp;&amp;", "%%%", "$$$", "!!")) for w in words]
        return " ".join(words).capitalize() + self.rng.choice(("." * 1, ".", ".", "!", "?", ""))

    def prose(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def wrap(self, name: str, inner: str, closed: bool = True) -> str:
        tag, _, cls = name.replace("#", ".#").partition(".")
        attr = f' id="{cls[1:]}"' if cls.startswith("#") else f' class="{cls}"' if cls else ""
        return f"<{tag}{attr}>{inner}" + (f"</{tag}>" if closed else "")

    def links(self, n: int, mark: str) -> str:
        items = [f'<a href="/{self.word()}">{mark}{" ".join(self.word() for _ in range(self.rng.randint(1, 3)))}</a>' for _ in range(n)]
        style = self.rng.random()
        if style < 0.5:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if self.strict else "") for x in items) + "</ul>"
        return (" | " if style < 0.7 else " ").join(items)

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.85:
            title = f"<h1>{CONTENT}{self.sentence(2, 9)}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.12 else title)
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            kind = r.random()
            if kind < 0.68:
                text = CONTENT + (self.prose() if r.random() < 0.85 else self.word().capitalize() + ".")
                if r.random() < 0.25:
                    text = f"<b>{text}" + ("</b>" if self.strict else "<br>")
                if r.random() < 0.2:
                    text += f' <a href="/x">{self.word()}</a> {self.sentence()}'
                out.append(f"<p>{text}" + ("</p>" if self.strict else ""))
            elif kind < 0.78:
                out.append(f"<h{r.randint(2, 4)}>{CONTENT}{self.sentence(1, 6)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{CONTENT}{self.sentence(2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote>{CONTENT}{self.prose(3)}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{CONTENT}{self.word()}<td>{CONTENT}{r.randint(1, 999)}" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                out.append(self.wrap(r.choice(ADVERTS), OTHER + self.sentence()))
        if r.random() < 0.12:
            out.append(self.wrap(r.choice(FOOTERS), OTHER + self.sentence(1, 6)))
        return "".join(out)

    def other(self) -> dict[str, list[str]]:
        r, o = self.rng, OTHER
        top, side, end = [], [], []
        if r.random() < 0.4:
            name = f"{o}{self.sentence(1, 4)}"
            if r.random() < 0.4:
                name = self.wrap(r.choice(("h1", "h2", "h1.logo", "p.tagline")), f'<a href="/">{name}</a>' if r.random() < 0.4 else name)
            top.append(self.wrap(r.choice(HEADERS), name + (self.links(r.randint(2, 6), o) if r.random() < 0.5 else "")))
        if r.random() < 0.85:
            top.append(self.wrap(r.choice(MENUS), self.links(r.randint(2, 10), o)))
        if r.random() < 0.35:
            top.append(self.wrap(r.choice(NOTICES), f"{o}{self.prose(2)}" + ("<button>OK</button>" if r.random() < 0.4 else "")))
        if r.random() < 0.6:
            top.append(self.wrap(r.choice(ADVERTS), o + self.sentence() + (f"<p>{o}{self.prose(2)}</p>" if r.random() < 0.3 else "")))
        if r.random() < 0.45:
            inner = self.links(r.randint(2, 8), o) if r.random() < 0.6 else f"<h3>{o}{self.sentence(1, 4)}</h3><p>{o}{self.prose(2)}</p>"
            side.append(self.wrap(r.choice(ASIDES), inner))
        if r.random() < 0.3:
            side.append(f"<form><label>{o}{self.sentence(1, 4)}</label><input><p>{o}{self.sentence()}</p></form>")
        if r.random() < 0.35:
            shapes = ("<p>{}</p>", "<li>{}</li>", "<div>{}</div>", '<div class="comment"><p>{}</p></div>', '<div class="reply"><b>{}</b><p>{}</p></div>', '<article class="comment"><p>{}</p></article>')
            inner = f"<h3>{o}{self.sentence(1, 3)}</h3>" if r.random() < 0.7 else ""
            for shape in r.choices(shapes, k=r.randint(1, 6)):
                inner += shape.replace("{}", o + self.sentence(1, 3), shape.count("{}") - 1).replace("{}", o + self.prose(3))
            end.append(self.wrap(r.choice(COMMENTS), inner))
        if r.random() < 0.85:
            end.append(self.wrap(r.choice(FOOTERS), f"{o}{r.choice(('&copy; ', '© 2020 ', ''))}{self.sentence(1, 9)}" + (f" &middot; {self.sentence()}" if r.random() < 0.5 else "") + (self.links(3, o) if r.random() < 0.3 else ""), self.strict))
        return {"top": top, "side": side, "end": end}

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.05:  # hardly any markup
            text = CONTENT + self.prose()
            return text if r.random() < 0.5 else f"<html><body>{text}<br>{self.prose()}</body></html>"
        parts = self.other()
        body = self.wrap("article" if r.random() < 0.3 else r.choice(WRAPPERS), self.article(), self.strict or r.random() < 0.5)
        if r.random() < 0.4:
            body = self.wrap(r.choice(LAYOUTS), body + "".join(parts["side"]))
            parts["side"] = []
        if r.random() < 0.12:
            cell = r.choice(("td", "td.nav", "td.sidebar", "td.menu"))
            body = "<table><tr>" + self.wrap(cell, self.links(r.randint(2, 6), OTHER)) + self.wrap(r.choice(("td", "td.text", "td.main")), body) + "</tr></table>"
        if r.random() < 0.3:
            body = self.wrap(r.choice(LAYOUTS), body + "".join(parts["end"]))
            parts["end"] = []
        if r.random() < 0.3:
            r.shuffle(parts["top"])
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts["top"] + parts["side"][:1] + [body] + parts["side"][1:] + parts["end"])


def pages(n: int, seed: int = 0) -> Iterator[str]:
    """`n` labelled pages, the same for the same seed."""
    for i in range(n):
        yield Writer(random.Random(f"{seed}:{i}")).page()
