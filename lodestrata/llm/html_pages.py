"""Labelled pages to train the extraction model on: made from layouts that vary in markup, order and naming.

Every piece of text starts with MAIN or REST, which the trainer reads as the label of the block it ends up in.
"""

from __future__ import annotations

import random

MAIN, REST = "\ue000", "\ue001"

# Names that pages give to their parts; fixed values.
NAMES = {
    "header": "header site-header page-header masthead topbar banner top head branding".split(),
    "menu": "nav navbar menu main-menu navigation breadcrumb breadcrumbs submenu toc links pagination pager tabs".split(),
    "footer": "footer site-footer page-footer foot bottom colophon copyright legal credits".split(),
    "sidebar": "sidebar side aside widget widgets related related-posts recommended popular trending more-stories teaser rail secondary".split(),
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert banner message popup modal overlay paywall disclaimer warning info-box".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense commercial partner".split(),
    "form": "form newsletter subscribe signup login search contact-form search-box register".split(),
    "comments": "comments comment comment-list commentlist reader-comments responses respond discussion disqus replies reply feedback thread".split(),
    "share": "share social social-share sharing tools toolbar buttons actions".split(),
    "main": "content main main-content article article-body post post-content entry entry-content story story-body text body page-content prose".split(),
}
ROLES = {"header": ["banner"], "menu": ["navigation", "menubar"], "footer": ["contentinfo"], "sidebar": ["complementary"], "notice": ["alert", "dialog", "alertdialog", "status"], "form": ["search", "form"], "main": ["main", "article"]}
_LETTERS = "aeioubcdfghklmnprstvwz"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(_LETTERS) for _ in range(self.r.randint(1, 9))) for _ in range(300)]

    def text(self, lo: int, hi: int, mark: str, stop: bool = True) -> str:
        r = self.r
        w = [r.choice(self.words) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(lo, hi))]
        out = " ".join(w).capitalize() + ("." if stop else "")
        if r.random() < 0.15:
            k = out.find(" ")
            out = f"<b>{out[:k]}</b>{out[k:]}" if k > 0 else out
        if r.random() < 0.1:
            out += r.choice([" &amp; ", " &quot;", "### ", "%%%"]) + r.choice(self.words)
        return mark + out

    def wrap(self, kind: str, inner: str, tags: list[str], named: float = 1.0) -> str:
        r = self.r
        tag = r.choice(tags)
        attr = ""
        if kind in ROLES and r.random() < 0.12:
            return f'<{tag} role="{r.choice(ROLES[kind])}">{inner}</{tag}>'
        if r.random() < named or tag == "div":
            name = r.choice(NAMES[kind])
            name = r.choice([name, name, f"{name} {r.choice(self.words)}", f"{r.choice(self.words)}-{name}", f"js-{name}"])
            attr = f' {r.choice(["class", "class", "id"])}="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{self.r.choice(self.words)}">{self.text(1, 4, REST, False)}</a>' for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.75:
            t = self.r.choice(["ul", "ol", "ul"])
            return f"<{t}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{t}>"
        return self.r.choice([" ", " | ", "<br>"]).join(items)

    def rest(self, kind: str) -> str:
        r, t = self.r, self.text
        if kind == "menu":
            return self.wrap("menu", self.links(2, 8), ["nav", "nav", "div", "ul"], 0.5)
        if kind == "header":
            inner = r.choice([t(1, 5, REST, False), f"<a href='/'>{t(1, 3, REST, False)}</a>", f"<h1>{t(1, 4, REST, False)}</h1><p>{t(3, 9, REST)}</p>", f"<span>{t(1, 3, REST, False)}</span>" + self.links(2, 5)])
            return self.wrap("header", inner, ["header", "header", "div"], 0.5)
        if kind == "footer":
            inner = r.choice([f"&copy; {t(1, 12, REST)}", f"<p>{t(2, 20, REST)}</p>", self.links(2, 7) + f"<p>&copy; {t(1, 9, REST)}</p>", t(3, 25, REST)])
            return self.wrap("footer", inner, ["footer", "footer", "div"], 0.4)
        if kind == "sidebar":
            inner = f"<h3>{t(1, 4, REST, False)}</h3>" + r.choice([self.links(2, 7), "".join(f"<p>{t(4, 50, REST)}</p>" for _ in range(r.randint(1, 4)))])
            return self.wrap("sidebar", inner, ["aside", "aside", "div", "section"], 0.6)
        if kind in ("notice", "ad"):
            inner = r.choice([t(2, 25, REST), f"<p>{t(3, 60, REST)}</p>", f"<h4>{t(1, 4, REST, False)}</h4><p>{t(3, 40, REST)}</p>", f"<a href='/x'>{t(2, 12, REST)}</a>", f"<p>{t(3, 20, REST)}</p><button>{t(1, 2, REST, False)}</button>"])
            if r.random() < 0.1:
                return r.choice([f"<noscript>{t(3, 15, REST)}</noscript>", f"<dialog open>{inner}</dialog>", f"<ins class='adsbygoogle'>{t(2, 9, REST)}</ins>"])
            return self.wrap(kind, inner, ["div", "div", "aside", "section", "p"] if "<p" not in inner and "<h4" not in inner else ["div", "div", "aside", "section"])
        if kind == "form":
            inner = f"<label>{t(1, 5, REST, False)}</label><input name=q>" + r.choice(["", "", f"<p>{t(4, 30, REST)}</p>", f"<select><option>{t(1, 2, REST, False)}<option>{t(1, 2, REST, False)}</select>", f"<fieldset><legend>{t(1, 3, REST, False)}</legend><textarea>{t(1, 6, REST, False)}</textarea></fieldset>"]) + f"<button>{t(1, 2, REST, False)}</button>"
            return r.choice([f"<form action='/s'>{inner}</form>", self.wrap("form", f"<form>{inner}</form>", ["div", "section"]), self.wrap("form", f"<p>{t(4, 20, REST)}</p>", ["div", "form"])])
        if kind == "share":
            return self.wrap("share", self.links(2, 5), ["div", "ul", "div"])
        one = lambda: f"<{(g := r.choice(['div', 'li', 'article', 'div']))} class='{r.choice(['comment', 'reply', r.choice(self.words)])}'><b>{t(1, 2, REST, False)}</b><p>{t(3, 70, REST)}</p></{g}>"
        inner = f"<h2>{t(1, 3, REST, False)}</h2>" + "".join(one() for _ in range(r.randint(1, 5)))
        return self.wrap("comments", inner, ["section", "div", "div", "ol"])

    def main(self) -> str:
        r, t = self.r, self.text
        parts = []
        if r.random() < 0.85:
            h = f"<h1>{t(2, 14, MAIN, r.random() < 0.4)}</h1>"
            parts.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.66:
                end = "" if r.random() < 0.2 else "</p>"
                parts.append(f"<p>{t(1, 110 if r.random() < 0.8 else 4, MAIN)}{end}")
            elif k < 0.72:
                parts.append(f"<h2>{t(1, 7, MAIN, False)}</h2>")
            elif k < 0.78:
                parts.append("<ul>" + "".join(f"<li>{t(2, 25, MAIN)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.82:
                parts.append(f"<blockquote>{t(5, 50, MAIN)}</blockquote>")
            elif k < 0.85:
                parts.append("<table>" + "".join(f"<tr><td>{t(1, 4, MAIN, False)}</td><td>{t(1, 6, MAIN, False)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.88:
                parts.append(f"<figure><img src=x><figcaption>{t(2, 14, MAIN)}</figcaption></figure>")
            elif k < 0.92:
                parts.append(f"<div>{t(3, 60, MAIN)}</div>")
            elif k < 0.95:
                parts.append(f"<p>{t(2, 20, MAIN)}<br>{t(2, 30, MAIN)} <a href='/y'>{t(1, 5, MAIN, False)}</a></p>")
            else:
                parts.append(f"<pre>{t(2, 30, MAIN)}</pre>")
            if r.random() < 0.2:
                parts.append(self.rest(r.choice(["ad", "ad", "sidebar", "form", "share", "notice"])))
        if r.random() < 0.12:
            parts.append(self.rest(r.choice(["comments", "share", "form", "footer", "menu"])))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        inner = self.main()
        k = r.random()
        body = f"<article>{inner}</article>" if k < 0.45 else self.wrap("main", inner, ["article", "main", "div", "div", "section"]) if k < 0.85 else f"<main><article>{inner}</article></main>" if k < 0.92 else inner
        before = [self.rest(x) for x in ("header", "menu", "notice", "ad", "form", "menu") if r.random() < 0.5]
        after = [self.rest(x) for x in ("share", "comments", "sidebar", "ad", "form", "notice", "menu") if r.random() < 0.35]
        r.shuffle(after)
        if r.random() < 0.25:
            before.append(self.rest("sidebar"))
        parts = [*before, body, *after, *([self.rest("footer")] if r.random() < 0.85 else [])]
        whole = "".join(parts)
        if r.random() < 0.4:
            whole = f"<div {r.choice(['class', 'id'])}='{r.choice(['container', 'wrapper', 'page', 'site', 'layout', 'app'])}'>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{REST}t</title></head><body>{whole}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled_pages(n: int, seed: int) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
