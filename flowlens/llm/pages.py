"""Operator 2: main text of web pages by a conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf

# HTML elements by how a browser lays them out.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACES = set("br img input hr wbr td th".split()) - {"wbr"}
HIDDEN = "script style template textarea title select svg button datalist head".split()
# Elements whose end tag may be left out, and what closes them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

# Elements that a browser reads up to their end tag or the page's end, whatever stands between.
TO_THE_END = "script style textarea title".split()

_RAW = frozenset(h for h in HIDDEN if h != "head" and h not in TO_THE_END)
_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^"'>])*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{"|".join(TO_THE_END)})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|<\Z""",
    re.DOTALL | re.IGNORECASE,
)
#: Starts and ends of the other hidden elements: a start with its tag's end, if it has one, and an end that is one.
_MARK = re.compile(rf"""<(?P<slash>/?)(?P<name>{"|".join(sorted(_RAW))})(?=[\s/>])(?P<rest>\s*>)?""", re.IGNORECASE)
_START = re.compile(rf"{_ATTRS}>", re.DOTALL)


class HiddenElements:
    """Where the hidden elements of a page end, from one walk over its tags.

    An element has content if its end tag comes before another start of its
    name; whole elements of that name, without a third inside, may stand in it.
    """

    def __init__(self, page: str):
        self.page, self.at, self.kinds = page, {}, {}
        for m in _MARK.finditer(page):
            name = m["name"].lower()
            self.at.setdefault(name, []).append(m.start())
            self.kinds.setdefault(name, []).append((bool(m["slash"]), m.end() if m["rest"] else -1, m.end("name")))

    def end(self, name: str, start: int, after: int) -> int:
        """Where the element goes on to whose start tag is from ``start`` to ``after``; ``after`` if it has no content."""
        if self.page[after - 2] == "/":
            return after
        places, kinds = self.at.get(name, []), self.kinds.get(name, [])
        i = bisect_left(places, after)
        while i < len(places):
            closes, to, tag = kinds[i]
            if closes:
                return to if to >= 0 else after
            inner = _START.match(self.page, tag)
            if not inner:
                return after
            if self.page[inner.end() - 2] == "/":
                i = bisect_left(places, inner.end())
                continue
            i = bisect_left(places, inner.end())
            if i == len(places) or not kinds[i][0] or kinds[i][1] < 0:
                return after
            i = bisect_left(places, kinds[i][1])
        return after


NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int
    apart: bool = False


@lru_cache(maxsize=20_000)
def _names(attrs: str) -> tuple[str, ...]:
    """Words of an element's class, id and role in small letters."""
    found = [a or b or c for a, b, c in NAMES.findall(attrs)]
    return tuple(sorted({p.lower() for f in found for p in PARTS.findall(f)}))


def leaf_blocks(page: str | None) -> list[Block]:
    """Text between block tags, in page order, with its open elements, outermost first.

    Markup, comments, scripts, styles, drawings and the controls of forms are
    dropped, a script, style, textarea, title or tag that the page's end cuts off
    too. Formulas and what stands in for a frame, a film or a script stay. Of other such elements that are closed in themselves or never
    closed only the tag goes.
    Character references are decoded after the markup is taken away; white space
    becomes one space; blocks without text are left out. A block is apart if the
    page says where its article is and the block is elsewhere.
    """
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    chunks: list[str] = []
    linked, anchor, head = 0, 0, False

    def text(chunk: str) -> None:
        nonlocal linked
        if chunk and not head:
            chunks.append(chunk)
            if anchor:
                linked += len(chunk)

    def close() -> None:
        nonlocal linked
        if chunks:
            raw = "".join(chunks)
            joined = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if joined:
                out.append(Block(joined, tuple(path), linked))
            chunks.clear()
        linked = 0

    def leave(names: set[str], bounds: set[str]) -> None:
        for i in range(len(path) - 1, -1, -1):
            if path[i][0] in names:
                del path[i:]
                return
            if path[i][0] in bounds:
                return

    at = 0
    page = page or ""
    hidden = HiddenElements(page)
    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m["end"] or m["end2"])
        if tag in _RAW and not ends and m["tag"]:
            at = hidden.end(tag, m.start(), at)
            continue
        if tag == "head":
            close()
            head = not ends
        elif tag == "a":
            anchor = 0 if ends else 1
        elif tag in BLOCKS:
            close()
            if tag == "body":
                head = False
            if ends:
                leave({tag}, set())
            else:
                leave({"p"}, BLOCKS - {"p"})
                if tag in CLOSES:
                    leave(CLOSES[tag], BOUNDS[tag])
                if tag not in VOID:
                    path.append((tag, _names(m["attrs"] or m["attrs2"] or "")))
        elif tag in SPACES:
            text(" ")
    text(page[at:])
    close()
    if any(_in_article(b.path) for b in out):
        for b in out:
            b.apart = not _in_article(b.path)
    return out


# Names that page authors give to parts of a page.
MAIN_NAMES = ["article", "article-body", "content", "main-content", "post", "post-content", "entry-content", "story", "story-body", "text", "page-content", "body-text"]
AD_NAMES = ["ad", "ads", "ad-slot", "advert", "advertisement", "banner", "promo", "promotion", "sponsored", "sponsor"]
SIDE_NAMES = ["sidebar", "side", "widget", "related", "recommended", "trending", "popular", "teaser", "rail", "more"]
NOTICE_NAMES = ["cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "message", "disclaimer", "paywall", "privacy"]
FORM_NAMES = ["newsletter", "subscribe", "signup", "search", "login", "contact", "form"]
COMMENT_NAMES = ["comments", "comment-list", "discussion", "replies", "respond", "reader-comments", "disqus", "reactions", "feedback", "reviews"]
MENU_NAMES = ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pager", "pagination", "share", "social", "tags", "toolbar", "skip", "links"]
HEAD_NAMES = ["header", "masthead", "top", "topbar", "site-header", "logo", "branding", "hero"]
FOOT_NAMES = ["footer", "site-footer", "bottom", "colophon", "copyright", "legal"]
#: Words of those names and what they speak of; words that main parts use too speak of nothing.
KINDS = {
    w: kind
    for kind, group in (("advert", AD_NAMES), ("side", SIDE_NAMES), ("notice", NOTICE_NAMES), ("form", FORM_NAMES), ("comment", [*COMMENT_NAMES, "comment", "reply"]), ("menu", MENU_NAMES), ("header", HEAD_NAMES), ("footer", FOOT_NAMES))
    for n in group
    for w in n.split("-")
    if w not in {x for m in MAIN_NAMES for x in m.split("-")} | {"list", "site"}
}


#: Words of main parts' names that no whole page and no line of text is called.
ARTICLE_WORDS = {w for m in MAIN_NAMES for w in m.split("-")} - {"page", "body", "text"}


@lru_cache(maxsize=20_000)
def _in_article(path: tuple[tuple[str, tuple[str, ...]], ...]) -> bool:
    """Whether an open element is an article by its tag or its names, with nothing around it that speaks of another part."""
    for tag, names in path:
        if tag in ("nav", "aside", "footer", "form", "dialog") or any(n in KINDS for n in names):
            return False
        if tag in ("article", "main") or (tag in ("div", "section", "td") and not ARTICLE_WORDS.isdisjoint(names)):
            return True
    return False


@lru_cache(maxsize=20_000)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    """Features of the open elements. Lists, tables and plain boxes say nothing by being there."""
    found = {f"tag {path[-1][0]}" if path else "tag none"}
    main = False
    for tag, names in path:
        if tag in ("article", "main"):
            main = True
        if tag not in ("html", "body", "div", "p", "section", "span"):
            found.add(f"in {tag}")
        if tag in ("header", "footer", "aside", "form", "nav"):
            found.add(f"{tag} inside main" if main else f"{tag} outside main")
        found.update(f"named {n}" for n in names)
        found.update(f"kind {KINDS[n]}" for n in names if n in KINDS)
    if main:
        found.add("inside main")
    return tuple(sorted(found))


# Phrases that pages say of themselves.
PHRASES = {
    "cookie": re.compile(r"\bcookies?\b|\bconsent\b|\bprivacy\b", re.IGNORECASE),
    "rights": re.compile(r"©|\bcopyright\b|all rights reserved|\(c\) ?\d{4}", re.IGNORECASE),
    "sign up": re.compile(r"\bsubscribe\b|\bnewsletter\b|\bsign (?:up|in)\b|\blog ?in\b|\bregister\b", re.IGNORECASE),
    "share": re.compile(r"\bshare (?:this|on)\b|\btweet\b|\bfollow us\b", re.IGNORECASE),
    "advert": re.compile(r"\badvert\w*\b|\bsponsored\b|\bpromo\w*\b", re.IGNORECASE),
    "reply": re.compile(r"\brepl(?:y|ies)\b|\bcomments?\b", re.IGNORECASE),
    "related": re.compile(r"\bread more\b|\brelated\b|\byou may also\b|\bmost read\b", re.IGNORECASE),
}


def _text_features(block: Block) -> list[str]:
    n, text = len(block.text), block.text
    share = block.linked / max(n, 1)
    out = ["chars " + str(min(n, 1000).bit_length()), "links " + ("none" if not share else "few" if share < 0.3 else "many" if share < 0.8 else "all")]
    out.append("ends" if text[-1] in ".!?…»”\"'" else "open")
    for name, p in PHRASES.items():
        said = sum(m.end() - m.start() for m in p.finditer(text)) / max(n, 1)
        if said:
            out.append(f"says {name} " + ("much" if said >= 0.1 else "some" if said >= 0.02 else "little"))
    return out


def block_features(block: Block) -> list[str]:
    """Features of a block's open elements and of its text."""
    return [*_path_features(block.path), *_text_features(block), *(["apart"] if block.apart else [])]


def extractor(chain: crf.Chain) -> Callable[[str | None], str]:
    """A function from a page to the blocks that the chain labels as main text, joined by one line feed."""
    known = chain.weights.get
    apart = known("apart", 0.0)
    of_path = lru_cache(maxsize=20_000)(lambda path: chain.bias + sum(known(f, 0.0) for f in _path_features(path)))

    def main_text(page: str | None) -> str:
        blocks = leaf_blocks(page)
        scores = [of_path(b.path) + sum(known(f, 0.0) for f in _text_features(b)) + (apart if b.apart else 0.0) for b in blocks]
        return "\n".join(b.text for b, y in zip(blocks, chain.best(scores), strict=True) if y)

    return main_text


def extract(pages: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A page that is null, empty or without main text has an empty text. Repeated
    rows come back as often, null ids and urls stay, and other columns are not
    read. One pass over the rows; memory follows the longest page.
    """
    chain = chain or trained()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        main_text = extractor(chain)
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": [main_text(p) for p in batch["html"].array]})

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(each, "page_id long, url string, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@lru_cache(maxsize=4)
def trained(pages: int = 1200, seed: int = 5) -> crf.Chain:
    """A chain trained on ``pages`` labelled pages of many layouts, once in a session."""
    sequences, labels = [], []
    for page, main in labelled_pages(pages, seed):
        blocks = leaf_blocks(page)
        sequences.append([block_features(b) for b in blocks])
        labels.append([int(b.text in main) for b in blocks])
    return crf.train(sequences, labels, rounds=150, l2=0.02)


SYLLABLES = "an ar be co da de el en er es ha in ka lo ma mi na or pe ra re ri sa se st ta te ti to un ur ve".split()


def labelled_pages(count: int, seed: int, unnamed: float = 0.35) -> Iterator[tuple[str, set[str]]]:
    """Made pages of varied layout, each with the texts of its main blocks; a share has articles in plain boxes, boxes of any name or none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    sentence = lambda: words(3, 18).capitalize() + rng.choice([".", ".", ".", "?", "!"])
    prose = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    link = lambda a=1, b=4: f'<a href="/{word()}">{words(a, b)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 9))) + "</ul>"

    def name(names: list[str]) -> str:
        n = rng.choice(names)
        return rng.choice([f' class="{n}"', f' id="{n}"', f' class="{word()} {n}"', f" class='{n} {word()}'", f' role="{n}" class="{n}"'])

    def box(tags: str, names: list[str], inner: str, bare: float = 0.3) -> str:
        tag = rng.choice(tags.split())
        plain = tag not in ("div", "section", "ul", "p", "span") and rng.random() < bare
        return f"<{tag}{'' if plain else name(names)}>{inner}</{tag}>"

    def short() -> str:
        return rng.choice([sentence(), words(1, 6), link(2, 7), f"<p>{sentence()}</p>", f"<h3>{words(1, 5)}</h3><p>{prose()}</p>", f"<h2>{words(1, 4)}</h2>{links()}", links(), f"<p>{prose()}</p>"])

    def menu() -> str:
        return box("nav nav nav div ul", MENU_NAMES, links() if rng.random() < 0.7 else " | ".join(link() for _ in range(4)), 0.7)

    def advert() -> str:
        return box("div div aside section", AD_NAMES, short(), 0.0)

    def side() -> str:
        return box("aside aside div section", SIDE_NAMES, "".join(short() for _ in range(rng.randrange(1, 4))), 0.6)

    def notice() -> str:
        said = rng.choice([f"We use cookies. {sentence()}", f"Accept our privacy terms: {words(2, 6)}", sentence(), prose()])
        return box("div div section aside dialog", NOTICE_NAMES, rng.choice([said, f"<p>{said}</p><button>OK</button>"]), 0.0)

    def form() -> str:
        inner = f"<label>{words(1, 4)}</label><input type=text><button>{word()}</button>"
        made = f"<form{rng.choice(['', name(FORM_NAMES)])}>{rng.choice(['', f'<p>{sentence()}</p>', f'<h3>{words(1, 4)}</h3>'])}{inner}</form>"
        return rng.choice([made, box("div section", FORM_NAMES, f"<p>Subscribe to the newsletter. {sentence()}</p>{made}")])

    def header() -> str:
        return box("header header div", HEAD_NAMES, rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 7)}</p>", f"<h2>{link()}</h2>{menu()}", link(1, 4), words(1, 5)]), 0.7)

    def footer() -> str:
        said = rng.choice([f"&copy; {word()} &middot; {sentence()}", f"Copyright {rng.randrange(1999, 2026)} {words(1, 4)}. All rights reserved.", sentence(), links(), f"<p>{sentence()}</p>{links()}"])
        return box("footer footer div", FOOT_NAMES, said, 0.7)

    def comments() -> str:
        said = lambda: rng.choice([f"<p>{prose()}</p>", prose(), f"<b>{word()}</b> <p>{prose()}</p>"])
        one = lambda: rng.choice([f'<li class="comment">{said()}</li>', f'<div class="comment">{said()}</div>', f"<article class='comment'>{said()}</article>", f"<li>{said()}</li>", said()])
        return box("section div ol ul aside", COMMENT_NAMES, f"<h2>{rng.choice(['Comments', words(1, 3)])}</h2>" * rng.randrange(2) + "".join(one() for _ in range(rng.randrange(1, 6))), 0.0)

    for _ in range(count):
        main: set[str] = set()

        def keep(text: str, main: set[str] = main) -> str:
            main.add(" ".join(text.split()))
            first, _, rest = text.partition(" ")
            return rng.choice([text, text, text.replace(" ", "\n ", 1), f"<b>{text}", f"<em>{text}</em>", f"{text}<br>", f"<a href='/{word()}'>{first}</a> {rest}" if rest else text])

        def part(keep=keep) -> str:
            kind = rng.random()
            if kind < 0.62:
                t = rng.choice(["p", "p", "p", "p", "p", "div"])
                return f"<{t}>{keep(prose())}" + (rng.choice(["</p>", "</p>", ""]) if t == "p" else "</div>")
            if kind < 0.72:
                return f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{keep(words(1, 8).capitalize())}</{h}>"
            if kind < 0.82:
                return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{keep(rng.choice([words(1, 6), sentence(), prose()]))}</li>" for _ in range(rng.randrange(1, 5))) + f"</{t}>"
            if kind < 0.88:
                return f"<blockquote>{rng.choice(['', '<p>'])}{keep(prose())}</blockquote>"
            if kind < 0.92:
                return "<table>" + "".join(f"<tr><td>{keep(words(1, 4))}</td><td>{keep(words(1, 4))}</td></tr>" for _ in range(3)) + "</table>"
            if kind < 0.96:
                return f"<pre>{keep(words(2, 20))}</pre>"
            return f"<figure><img src=x><figcaption>{keep(sentence())}</figcaption></figure>"

        parts = [part() for _ in range(rng.choice([1, 2, 4, 8, 14]))]
        for made in rng.sample([advert, notice, form, side, menu, comments], rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randrange(len(parts) + 1), made())
        title = f"<h1>{keep(words(2, 9).capitalize())}</h1>"
        title = rng.choice([title, title, f"<header>{title}</header>", f"<header>{title}<p>{keep(sentence())}</p></header>", ""])
        inner = title + "".join(parts)
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        body = f"<{tag}{name(MAIN_NAMES) if tag in ('div', 'section') or rng.random() < 0.3 else ''}>{inner}</{tag}>"
        bare = rng.random() < unnamed
        if bare:
            if title.startswith("<header"):
                main.difference_update({" ".join(b.text.split()) for b in leaf_blocks(title)})
                inner = "".join(parts)
            box_of = lambda x: rng.choice([f"<div>{x}</div>", f'<div class="{word()}">{x}</div>', f'<div id="{word()}-{word()}">{x}</div>', f"<section>{x}</section>", f"<center>{x}</center>"])
            body = rng.choice([inner, box_of(inner), box_of(inner), box_of(box_of(inner)), f"<table><tr><td>{inner}</td></tr></table>"])
            if rng.random() < 0.3:
                body = f"{links()}{body}" if rng.random() < 0.5 else f"{body}<div>{' | '.join(link() for _ in range(3))}</div>"
        elif rng.random() < 0.25 and tag != "main":
            body = f"<main>{rng.choice(['', menu()])}{body}{rng.choice(['', comments(), side()])}</main>"
        before = [f() for f in rng.sample([menu, menu, header, advert, notice, form, side], rng.randrange(0, 5))]
        after = [f() for f in rng.sample([comments, side, advert, form, footer, footer, notice, menu], rng.randrange(0, 5))]
        if bare and rng.random() < 0.2:
            before, after = [], []
        page = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head><body>{''.join(before)}<!-- {words(1, 3)} -->{body}{''.join(after)}</body></html>"
        yield page, main
