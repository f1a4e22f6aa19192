"""Made-up web pages with known main text, on which the extraction model is trained.

A page is drawn from many layouts: where the article stands, which elements and names it uses, which menus,
notices, adverts, forms, sidebars and comments surround it, and how carelessly the markup is written. Words
are random syllables, so the model can only learn structure. Everything follows from the seed.
"""

from __future__ import annotations

import random

#: Names that sites give to parts of a page.
CONTENT_NAMES = ("content", "article", "post", "entry", "story", "main", "body", "text", "article-body", "post-content", "entry-content", "story-body", "prose", "page-content", "blog-post", "hentry")
JUNK_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "main-menu", "toc", "pagination", "pager", "tabs"),
    "header": ("header", "masthead", "site-header", "branding", "banner", "top", "logo"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon"),
    "sidebar": ("sidebar", "aside", "widget", "related", "related-posts", "recommended", "trending", "popular", "tags", "author-box", "archive"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor", "ad-slot"),
    "notice": ("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "overlay", "message"),
    "form": ("search", "login", "signup", "contact-form", "search-form", "subscribe-form"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments", "reviews"),
    "share": ("share", "social", "sharing", "share-buttons", "follow", "meta", "byline"),
}
_TAG_OF = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(x) for x in ("bcdfghklmnprstvw", "aeiouäéó", ("n", "r", "s", "", "t"))) for _ in range(90)]

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(self.syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentence(self, a: int = 4, b: int = 18) -> str:
        return self.words(a, b).capitalize() + self.r.choice((".", ".", ".", "!", "?", ","))

    def paragraph(self) -> str:
        r = self.r
        n = 1 if r.random() < 0.3 else r.randint(1, 7)
        return " ".join(self.sentence(1 if r.random() < 0.15 else 4) for _ in range(n))

    def name(self, names) -> str:
        r = self.r
        own = r.choice(names)
        if r.random() < 0.2:
            own = r.choice(("site-", "page-", "l-", "js-", "c-")) + own
        more = f" {self.words(1, 1)}" if r.random() < 0.3 else ""
        return r.choice((f' class="{own}{more}"', f' class="{own}{more}"', f' id="{own}"', f' class="{own}" id="{self.words(1, 1)}"'))

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(1, 5)}</a>'

    def junk(self, kind: str) -> str:
        """A part that is no main text."""
        r = self.r
        tag = _TAG_OF.get(kind, "div") if r.random() < 0.55 else r.choice(("div", "div", "section", "ul" if kind == "menu" else "div"))
        names = self.name(JUNK_NAMES[kind]) if tag == "div" or r.random() < 0.5 else ""
        if kind in ("menu", "share"):
            items = [self.link() if r.random() < 0.9 else self.words(1, 3) for _ in range(r.randint(2, 12))]
            inner = "".join(f"<li>{x}</li>" for x in items)
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if r.random() < 0.8 else " | ".join(items)
        elif kind == "header":
            inner = r.choice((f"<h1>{self.words(1, 4)}</h1>", f'<a href="/"><img src="l.png" alt="{self.words(1, 2)}"></a><p>{self.words(2, 8)}</p>', f"<div>{self.words(1, 5)}</div>{self.link()}"))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.paragraph()}", f"<p>&copy; 20{r.randint(10, 30)} {self.words(1, 4)}</p><p>{self.link()} | {self.link()}</p>", f"<ul><li>{self.link()}</li><li>{self.link()}</li></ul><small>{self.sentence()}</small>"))
        elif kind == "comments":
            def item() -> str:
                t = r.choice(("div", "li", "p"))
                said = self.paragraph() if t == "p" else f"<p>{self.paragraph()}</p>"
                return f'<{t}{self.name(("comment", "reply", "comment-body", "review"))}><b>{self.words(1, 2)}</b> {said}</{t}>'

            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(item() for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input type="text" placeholder="{self.words(1, 3)}"><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>'
            inner = inner if tag == "form" or r.random() < 0.5 else f"<form>{inner}</form>"
        elif kind == "sidebar":
            inner = f"<h3>{self.words(1, 4)}</h3><ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(1, 8))) + "</ul>" if r.random() < 0.6 else f"<h4>{self.words(1, 4)}</h4><p>{self.paragraph()}</p>"
        else:
            inner = self.paragraph() if r.random() < 0.6 else f"<p>{self.paragraph()}</p>" + (f"<button>{self.words(1, 2)}</button>" if r.random() < 0.5 else self.link())
        return f"<{tag}{names}>{inner}</{tag}>"

    def block(self) -> str:
        """A part of the main text, marked by \x01."""
        r = self.r
        x, mark = r.random(), "\x01"
        if x < 0.72:
            text = self.paragraph()
            if r.random() < 0.25:
                text = text.replace(" ", r.choice((" <b>", " <i>", ' <a href="/x">')), 1) + r.choice(("</b>", "</i>", "</a>"))
            if r.random() < 0.15:
                return f"<p{mark}><b>{text}<br>"
            return r.choice((f"<p{mark}>{text}</p>", f"<p{mark}>{text}</p>", f"<p{mark}>{text}", f"<div{mark}>{text}</div>"))
        if x < 0.82:
            return f"<h{r.randint(1, 4)}{mark}>{self.words(2, 9)}</h2>"
        if x < 0.9:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}{mark}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if x < 0.94:
            return f"<blockquote{mark}><p>{self.paragraph()}</p></blockquote>"
        if x < 0.97:
            return f"<table{mark}>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<pre{mark}>{self.words(4, 20)}</pre>"

    def page(self) -> str:
        """HTML in which the tags of main-text elements carry \x01 before their end."""
        r = self.r
        title = f"<h1\x01>{self.words(2, 9)}</h1>" if r.random() < 0.8 else ""
        x = r.random()
        own = [self.block() for _ in range(1 if x < 0.15 else r.randint(20, 120) if x > 0.9 else r.randint(2, 14))]
        for kind in ("ad", "share", "sidebar", "notice", "form"):
            if r.random() < 0.15:
                own.insert(r.randint(0, len(own)), self.junk(kind))
        if r.random() < 0.12:
            own.append(self.junk("comments"))
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        names = self.name(CONTENT_NAMES) if tag in ("div", "section") or r.random() < 0.3 else ""
        article = f"<{tag}{names}>{title}{''.join(own)}</{tag}>"
        if r.random() < 0.25:
            wrap = r.choice(("main", "div", "section"))
            inside = [article] + [self.junk(k) for k in ("sidebar", "ad", "menu", "comments") if r.random() < 0.3]
            r.shuffle(inside)
            article = f"<{wrap}>{''.join(inside)}</{wrap}>"
        before = [self.junk(k) for k, p in (("header", 0.5), ("menu", 0.75), ("notice", 0.3), ("ad", 0.4), ("form", 0.2), ("sidebar", 0.15)) if r.random() < p]
        after = [self.junk(k) for k, p in (("comments", 0.35), ("sidebar", 0.35), ("ad", 0.25), ("form", 0.2), ("notice", 0.25), ("footer", 0.8), ("share", 0.2)) if r.random() < p]
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";track({r.randint(0, 99)});</script></head>"
        return head + f"<body>{''.join(before)}<!-- {self.words(1, 3)} -->{article}{''.join(after)}" + ("</body></html>" if r.random() < 0.9 else "")


def pages(n: int, seed: int = 1) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
