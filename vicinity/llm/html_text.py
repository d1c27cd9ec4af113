"""Main text of web pages: a conditional random field over the leaf blocks of the DOM.

A lenient tokenizer follows open elements, also of broken markup, and cuts the
page into leaf blocks: runs of text between block elements. A linear-chain
field over them, whose features are ancestor tags, words of their classes and
ids, and the text's length, links and punctuation, is trained on generated
labelled pages of many layouts and decoded by Viterbi. Scripts, styles, the
head and other elements without text never form blocks.

A null, empty or text-free page gives an empty text. Very long pages are read
whole; repeated rows give equal rows; an empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.crf import best_path, fit_chain

#: A quoted value holds no "<", or so few characters that a missing quote doesn't cost the rest of the page.
TOKEN = re.compile(
    r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"(?:[^"<]*+"|[^"]{0,1024}+")|'(?:[^'<]*+'|[^']{0,1024}+'))*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<"""
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
#: Elements that start and end blocks; those without content; those whose content is never text of the page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template iframe canvas select textarea button title head".split())
#: Elements set apart from the words around them, whose text (formulas, labels, fallbacks) is inline text of its block.
APART = frozenset("math svg object audio video noscript".split())
RAW = frozenset("script style textarea title iframe".split())
#: Tags whose presence above a block is a feature, and those that aren't the article's own text within one.
LANDMARKS = frozenset("article main nav header footer aside form section figure table ul ol li blockquote dialog address p h1 h2 h3 h4 h5 h6 pre td details".split())
ASIDES = frozenset("nav aside footer form header".split())
#: Elements that a new one of the first kind ends, up to the given border.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
#: Words of classes, ids and roles, by what they tell.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs pager pagination toc",
    "ad": "ad ads adbox adslot adunit advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reaction reactions responses guestbook",
    "side": "sidebar side aside rail related recommended recommendations widget widgets popular trending more teaser teasers",
    "foot": "footer foot copyright legal colophon imprint bottom contentinfo",
    "head": "header head masthead topbar logo top site brand",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog privacy warning message paywall",
    "share": "share sharing social subscribe subscription newsletter signup login register follow search form tags tag meta byline author date",
    "content": "content article post entry story text body main maincontent articlebody page blog prose copy news document",
}
HINT = {w: k for k, words in HINTS.items() for w in words.split()}


def _names(attrs: str) -> frozenset[str]:
    """What an element's class, id, role and style tell."""
    if not attrs or attrs.isspace():
        return frozenset()
    out = set()
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            out.add("hidden")
        elif key in ("class", "id", "role"):
            out.update(HINT[w] for w in NAME.findall(value) if w in HINT)
    return frozenset(out)


class Element(NamedTuple):
    """An open element and what all open elements together tell, so that a block's features don't walk the tree."""

    tag: str
    names: frozenset[str]
    above: Element | None
    tags: frozenset[str]  # landmarks, itself included
    hints: frozenset[str]
    inner: bool  # within an article, and within one of ASIDES there

    @classmethod
    def open(cls, tag: str, names: frozenset[str], above: Element | None) -> Element:
        tags, hints, inner = (above.tags, above.hints, above.inner) if above else (frozenset(), frozenset(), False)
        inner = tag != "article" and (inner or tag in ASIDES and "article" in tags)
        return cls(tag, names, above, tags if tag in tags or tag not in LANDMARKS else tags | {tag}, hints if names <= hints else hints | names, inner)


def leaf_blocks(page: str) -> list[tuple[str, Element | None, int]]:
    """Text, innermost open element and characters within links of each leaf block."""
    out: list = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = links = 0

    def leave(k: int) -> None:
        """Closes the elements from the kth on."""
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def close() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            whole = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if whole:
                out.append((whole, stack[-1] if stack else None, linked))
            text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        got = m.group()
        if got[0] != "<" or got == "<":
            text.append(got)
            if links:
                linked += len(got)
            continue
        if got == "<!--":
            z = page.find("-->", at)
            at = n if z < 0 else z + 3
            continue
        ends, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag in APART:
            text.append(" ")
            continue
        if tag == "a":
            links = 0 if ends else 1
            continue
        if tag in SKIPPED:
            if ends or attrs.endswith("/"):
                continue
            if tag == "head":  # its text is in elements that are skipped
                continue
            text.append(" ")
            z = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if z:
                at = z.end()
            elif tag in RAW:
                at = n
            continue
        if tag not in BLOCKS:
            continue
        close()
        if ends:
            if opened[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            links = 0
            continue
        if tag in EMPTY:
            continue
        if stack and stack[-1].tag == "p":
            leave(len(stack) - 1)
        if tag in ENDS and any(opened[x] for x in ENDS[tag][0]):
            kinds, border = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in border:
                    break
                if stack[k].tag in kinds:
                    leave(k)
                    break
        stack.append(Element.open(tag, _names(attrs), stack[-1] if stack else None))
        opened[tag] += 1
    close()
    return out


def block_features(block) -> list[str]:
    text, top, linked = block
    n = len(text)
    tags, hints = (top.tags, top.hints) if top else (frozenset(), frozenset())
    own = top.tag if top else "none"
    near = (top.names | top.above.names if top.above else top.names) if top else frozenset()
    stops = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?…:;\"”»'")
    link = min(4, int(4 * linked / n)) if n else 0
    size = min(10, n.bit_length())
    inside = "in" if tags & {"article", "main"} or "content" in hints else "out"
    out = ["bias", f"own={own}", f"size={size}", f"link={link}", f"stops={min(3, stops)}", f"inside={inside}", f"{inside}&own={own}", f"link={link}&size={size // 2}", f"{inside}&stops={min(2, stops)}"]
    out += [f"above={t}" for t in tags]
    out += [f"hint={h}" for h in hints]
    out += [f"near={h}" for h in near]
    if top and top.inner:
        out.append("article&inner")
    if "©" in text[:40] or "copyright" in text[:60].lower():
        out.append("copyright")
    if not hints and not tags & {"article", "main", "nav", "header", "footer", "aside", "form"}:
        out.append(f"bare&size={size // 2}")
    return out


MARK = "\ue000"  # stands before main text in generated pages


class _Maker:
    """Generated labelled pages: layouts, class names and texts drawn at random."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        parts = "an ber con del en for gra hin is jo kel lan men nor os pra qui re sta ter un vel wer za".split()
        self.vocabulary = ["".join(self.r.choice(parts) for _ in range(self.r.randint(1, 4))) for _ in range(400)]

    def words(self, a: int, b: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(a, b)))

    def prose(self, a: int = 1, b: int = 6) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice(["."] * 6 + ["!", "?", ";"]) for _ in range(self.r.randint(a, b)))

    def named(self, kind: str, plain: float = 0.15) -> str:
        """An attribute with a class or id that tells the kind, sometimes none."""
        if self.r.random() < plain:
            return ""
        w = self.r.choice(HINTS[kind].split())
        w = self.r.choice([w, w, f"{w}-{self.r.choice(['box', 'wrap', 'inner', 'list', 'area', '1'])}", f"{self.r.choice(['site', 'page', 'c', 'x'])}-{w}"])
        return f' {self.r.choice(["class", "class", "id"])}="{w}"'

    def links(self, a: int = 3, b: int = 8) -> str:
        items = [f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' + self.r.choice(["</li>", ""]) for _ in range(self.r.randint(a, b))]
        return "<ul>" + "".join(items) + "</ul>" if self.r.random() < 0.7 else " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in items)

    def menu(self) -> str:
        return self.r.choice([f"<nav{self.named('menu', 0.5)}>{self.links()}</nav>", f"<div{self.named('menu', 0.2)}>{self.links()}</div>"])

    def header(self) -> str:
        x = f"<h{self.r.choice('123')}>{self.words(1, 4)}</h{self.r.choice('123')}>" if self.r.random() < 0.5 else f"<p>{self.words(1, 5)}</p>"
        return self.r.choice([f"<header{self.named('head', 0.5)}>{x}{self.menu()}</header>", f"<div{self.named('head', 0)}>{x}{self.menu() if self.r.random() < 0.5 else ''}</div>"])

    def ad(self) -> str:
        return f"<{(t := self.r.choice(['div', 'div', 'aside', 'section', 'p']))}{self.named('ad', 0)}>{self.prose(1, 3) if self.r.random() < 0.7 else self.links(1, 3)}</{t}>"

    def notice(self) -> str:
        return f"<div{self.named('notice', 0)}>{self.r.choice(['<p>{}</p>', '{}'])}<button>OK</button></div>".replace("{}", self.prose(1, 3))

    def sidebar(self) -> str:
        body = "".join(self.r.choice([f"<h3>{self.words(1, 3)}</h3>", self.links(2, 6), f"<p>{self.prose(1, 2)}</p>"]) for _ in range(self.r.randint(1, 4)))
        return self.r.choice([f"<aside{self.named('side', 0.4)}>{body}</aside>", f"<div{self.named('side', 0)}>{body}</div>"])

    def form(self) -> str:
        return f"<form{self.named('share', 0.5)}><label>{self.words(1, 3)}</label><input><p>{self.prose(1, 2)}</p></form>"

    def comments(self) -> str:
        one = lambda: f"<{(t := self.r.choice(['div', 'li', 'p']))}{self.named('comment', 0.5)}><b>{self.words(1, 2)}</b> {self.r.choice(['<p>', '', '<br>'])}{self.prose(1, 5)}</{t}>"
        t = self.r.choice(["div", "section", "ol", "aside"])
        return f"<{t}{self.named('comment', 0)}>" + (f"<h2>{self.words(1, 3)}</h2>" if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randint(1, 6))) + f"</{t}>"

    def footer(self) -> str:
        x = self.r.choice([f"&copy; {self.words(1, 2)} &middot; {self.prose(1, 2)}", f"<p>Copyright {self.words(1, 4)}</p>{self.links(2, 5)}", f"{self.prose(1, 2)}", self.links(2, 6)])
        return self.r.choice([f"<footer{self.named('foot', 0.6)}>{x}</footer>", f"<div{self.named('foot', 0)}>{x}</div>"])

    def main(self) -> str:
        out = []
        heading = self.r.random() < 0.8
        if heading:
            out.append(f"<h1>{MARK}{self.words(2, 9).capitalize()}{self.r.choice(['', '.', '?'])}</h1>")
        if self.r.random() < 0.25:
            out.append(f"<div{self.named('share', 0)}>{self.words(2, 5)}</div>")
        for _ in range(self.r.randint(1, 12)):
            x, m = self.r.random(), MARK
            if x < 0.7:
                t = self.prose(1, 7)
                if self.r.random() < 0.15:
                    t += f' <a href="#">{self.words(1, 3)}</a> {self.prose(1, 2)}'
                out.append(self.r.choice([f"<p>{m}{t}</p>", f"<p>{m}{t}</p>", f"<p>{m}{t}", f"<p><b>{m}{t}<br>"]))
            elif x < 0.78:
                out.append(f"<h{(k := self.r.choice('234'))}>{m}{self.words(1, 7)}</h{k}>")
            elif x < 0.84:
                out.append(f"<{(k := self.r.choice(['ul', 'ol']))}>" + "".join(f"<li>{m}{self.words(2, 12)}</li>" for _ in range(self.r.randint(2, 5))) + f"</{k}>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{m}{self.prose(1, 3)}</p></blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 3)}</td><td>{m}{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif x < 0.93:
                out.append(f"<figure><img src=x><figcaption>{m}{self.words(3, 10)}</figcaption></figure>")
            elif x < 0.95:
                out.append(f"<pre>{m}{self.words(3, 10)}</pre>")
            else:
                out.append(self.r.choice([self.ad, self.sidebar, self.form])())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.04:  # no layout at all
            return self.main() if r.random() < 0.7 else MARK + self.prose(2, 12)
        body = self.main()
        kind = r.random()
        if kind < 0.45:
            body = f"<article{self.named('content', 0.5)}>{body}" + (self.comments() if r.random() < 0.12 else "") + "</article>"
        elif kind < 0.6:
            body = f"<main{self.named('content', 0.5)}>{body}</main>"
        elif kind < 0.9:
            body = f"<div{self.named('content', 0)}>{body}</div>"
        else:
            body = f"<div>{body}</div>"
        if r.random() < 0.3:
            body = f"<{(t := r.choice(['main', 'div', 'section']))}{self.named('content', 0.4)}>{body}{self.sidebar() if r.random() < 0.4 else ''}</{t}>"
        before = [f() for f, p in ((self.header, 0.4), (self.menu, 0.6), (self.notice, 0.3), (self.ad, 0.5), (self.sidebar, 0.2), (self.form, 0.1)) if r.random() < p]
        after = [f() for f, p in ((self.ad, 0.3), (self.comments, 0.4), (self.sidebar, 0.3), (self.form, 0.2), (self.menu, 0.2), (self.footer, 0.8), (self.notice, 0.15)) if r.random() < p]
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a='<p>';</script></head><body>{''.join(before)}{body}{''.join(after)}" + r.choice(["</body></html>", ""])


def train(pages: int = 900, seed: int = 11) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, weights and transitions from generated labelled pages."""
    maker = _Maker(seed)
    blocks, labels, first = [], [], [0]
    for _ in range(pages):
        for text, stack, linked in leaf_blocks(maker.page()):
            labels.append(int(MARK in text))
            blocks.append(block_features((text.replace(MARK, ""), stack, linked)))
        first.append(len(blocks))
    number: dict[str, int] = {}
    numbered = [[number.setdefault(f, len(number)) for f in b] for b in blocks]
    w, trans = fit_chain(numbered, np.array(labels, np.int64), np.array(first, np.int64), len(number))
    return number, w, trans


def main_text(page: str | None, model) -> str:
    """Blocks of the main text, in page order."""
    weight, trans = model
    blocks = leaf_blocks(page or "")
    u = [sum(weight.get(f, 0.0) for f in block_features(b)) for b in blocks]
    return "\n\n".join(b[0] for b, keep in zip(blocks, best_path(u, trans), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns page_id and url, text and n_chars of every page; no shuffle."""
    number, w, trans = train()
    sent = pages.sparkSession.sparkContext.broadcast(({f: float(w[k]) for f, k in number.items()}, trans))  # some hundred weights
    kinds = dict(pages.dtypes)

    def work(batches):
        for b in batches:
            html_at = b.column(2)
            for i in range(0, len(html_at), 256):
                text = [main_text(x.as_py(), sent.value) for x in html_at.slice(i, 256)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), b.column(1).slice(i, 256), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(html_col).cast("string")).mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
