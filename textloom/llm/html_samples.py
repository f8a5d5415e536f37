"""Labelled pages that the block classifier is fitted on, made up from common kinds of articles and furniture.

Words of main text are spelled with letters up to m, all others with letters from n on, so that a block shows its label.
"""

from __future__ import annotations

import random
import re

BODY_CLASSES = ("", "", "home", "has-sidebar", "single post", "no-sidebar comments-open", "with-header page", "menu-open", "theme-light")


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, good: bool, least: int, most: int) -> str:
        letters = "abcdefghijklm" if good else "nopqrstuvwxyz"
        return " ".join("".join(self.rng.choice(letters) for _ in range(self.rng.randint(1, 9))) for _ in range(self.rng.randint(least, most)))

    def sentences(self, good: bool, least: int, most: int) -> str:
        return " ".join(self.words(good, 3, 16).capitalize() + self.rng.choice("..!?") for _ in range(self.rng.randint(least, most)))

    def links(self, least: int, most: int, good: bool = False) -> list[str]:
        return [f"<a href='/{i}'>{self.words(good, 1, 4)}</a>" for i in range(self.rng.randint(least, most))]

    def listed(self, items: list[str], attributes: str = "") -> str:
        return f"<ul{attributes}>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def content(self, plain: bool) -> str:
        """One part of an article."""
        r, tag = self.rng.random(), "div" if plain else "p"
        if r < 0.55:
            return f"<{tag}>{self.sentences(True, 1, 7)}</{tag}>"
        if r < 0.70:
            return f"<{tag}>{self.words(True, 1, 6)}{self.rng.choice(['', '.', ':'])}</{tag}>"
        if r < 0.80:
            return f"<{self.rng.choice(('h2', 'h3'))}>{self.words(True, 1, 6)}</h2>"
        if r < 0.87:
            return self.listed([self.words(True, 1, 14) for _ in range(self.rng.randint(2, 6))])
        if r < 0.90:
            return f"<blockquote>{self.sentences(True, 1, 2)}</blockquote><pre>{self.words(True, 2, 12)}</pre>"
        if r < 0.93:
            return "<table>" + "".join(f"<tr><td>{self.words(True, 1, 3)}</td><td>{self.words(True, 1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        if r < 0.96:
            return f"<figure><img src=x><figcaption>{self.words(True, 2, 9)}</figcaption></figure>"
        return f"<{tag}>{self.words(True, 2, 12)} {self.links(1, 1, True)[0]} {self.words(True, 0, 6)}.</{tag}>"

    def furniture(self, inside: bool = False) -> str:
        """One part that is not the article; inside: such as stands among its paragraphs."""
        text = lambda a=1, b=3: self.sentences(False, a, b)
        name = lambda *names: self.rng.choice(("class", "id")) + f"='{self.rng.choice(names)}'"
        kinds = [
            lambda: f"<div {name('ad', 'advert', 'ads-box', 'sponsored', 'promo-box')}>{text()}</div>",
            lambda: f"<aside>{text(1, 4)}</aside>",
            lambda: self.listed(self.links(2, 5), f" {name('share', 'social-links', 'tags')}"),
            lambda: f"<div {name('related', 'recommended', 'more-stories')}><h3>{self.words(False, 1, 3)}</h3>{self.listed(self.links(2, 5))}<p>{text()}</p></div>",
            lambda: f"<form><p>{text(1, 2)}</p><label>{self.words(False, 1, 3)}</label><button>{self.words(False, 1, 2)}</button></form>",
            lambda: f"<div {name('newsletter', 'subscribe', 'cookie-notice', 'alert')}><p>{text(1, 3)}</p></div>",
            lambda: f"<div>{' | '.join(self.links(1, 4))}</div>",
        ]
        if not inside:
            kinds += [
                lambda: f"<nav>{self.listed(self.links(3, 9))}</nav>",
                lambda: f"<header><h2>{self.words(False, 1, 4)}</h2><p>{text(1, 2)}</p></header>",
                lambda: f"<footer><p>&copy; {text(1, 3)}</p>{self.listed(self.links(1, 5))}</footer>",
                lambda: f"<div {name('sidebar', 'siteFooter', 'widget-area', 'breadcrumbs', 'site-menu', 'topbar')}><h3>{self.words(False, 1, 3)}</h3><p>{text(1, 4)}</p></div>",
                lambda: f"<section {name('comments', 'comment-list', 'discussion')}>" + "".join(f"<article class='comment'><p>{text(1, 6)}</p></article>" for _ in range(self.rng.randint(1, 8))) + "</section>",
                lambda: f"<aside>{'<article><h3>' + self.words(False, 2, 5) + '</h3><p>' + text(1, 2) + '</p></article>'}</aside>",
                lambda: f"<div role='{self.rng.choice(('navigation', 'complementary', 'contentinfo', 'banner'))}'><p>{text(1, 3)}</p></div>",
                lambda: self.listed(self.links(3, 8)),
                lambda: f"<div>&copy; {self.words(False, 1, 5)}</div>",
                lambda: f"<div><p>{' '.join(self.links(1, 2))}</p></div>",
                lambda: f"<p>{self.words(False, 1, 3)}</p>",
                lambda: f"<div><p>{self.words(False, 3, 10)}.</p></div>",
                lambda: f"<div style='display:none'><p>{text(1, 4)}</p></div>",
            ]
        return self.rng.choice(kinds)()

    def masked(self, body: str) -> str:
        """The same without names and elements that tell furniture, as build tools make it."""
        body = re.sub(r"(?:class|id|role)='[^']*'", lambda m: f"class='css-{self.rng.randint(1000, 9999)}'", body)
        body = re.sub(r"<(/?)(?:nav|aside|footer|header|form|section|label|button)\b", r"<\1div", body)
        return re.sub(r"<(/?)(?:article|main)\b", r"<\1div", body) if self.rng.random() < 0.3 else body

    def page(self) -> str:
        rng, plain = self.rng, self.rng.random() < 0.1
        parts = [self.content(plain) for _ in range(rng.choice((2, 3, 4, 6, 9, 14, 20)))]
        if rng.random() < 0.5:
            parts.append(f"<p>{self.sentences(True, 1, 5)}</p>")
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            parts.insert(rng.randint(1, len(parts)), self.furniture(inside=True))
        title = f"<h1>{self.words(True, 1, 9)}</h1>"
        parts.insert(0, rng.choice((title, title, title, f"<header>{title}</header>", f"<div class='article-header'>{title}</div>")))
        text = "".join(parts)
        r = rng.random()
        if r < 0.45:
            text = f"<article>{text}</article>"
        elif r < 0.55:
            text = f"<main>{text}</main>"
        elif r < 0.65:
            text = f"<main><div class='wrap'><article>{text}</article></div></main>"
        elif r < 0.85:
            text = f"<div class='{rng.choice(('content', 'post-content', 'story-body', 'entry', 'text'))}'>{text}</div>".replace("<header>", "<div>").replace("</header>", "</div>")
        else:
            text = (f"<div>{text}</div>" if rng.random() < 0.7 else text).replace("<header>", "<div>").replace("</header>", "</div>")
        before, after = ("".join(self.furniture() for _ in range(rng.randint(0, 3))) for _ in range(2))
        body = f"{before}{text}{after}"
        if rng.random() < 0.3:
            body = f"<div id='{rng.choice(('page', 'wrapper', 'has-sidebar', 'container'))}'>{body}</div>"
        if rng.random() < 0.4:
            body = self.masked(body)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body class='{rng.choice(BODY_CLASSES)}'>{body}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]


def label(text: str) -> bool:
    """Whether a block of such a page is main text."""
    return next((c < "n" for c in text.lower() if c.isascii() and c.isalpha()), False)
