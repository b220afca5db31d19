"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: stretches of text between block-level tags,
each with its chain of open tags. Elements that are not shown have no blocks. The
page is read once from front to back, in time that grows with its length alone,
however broken it is. A block's features are its ancestors' tags and
the words of their class, id and role, and facts of its text (length, share of
linked text, sentence marks, place on the page). The model scores each block's
label (article or other) by these features and each pair of neighbouring labels
by a transition weight; Viterbi finds the best labelling of the page.

The model is trained here by maximum likelihood on labelled pages that
``labelled_pages`` composes from page parts with known labels. It is of fixed
size and goes with the tasks; extraction is one pass over the pages without a
shuffle.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import map_slices

# Tag names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; their text is never a block.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never shown as running text.
HIDDEN_TAGS = frozenset("head noscript template svg math object select option datalist canvas audio video".split())
#: Tags that end an open paragraph.
ENDS_P = BLOCK_TAGS - frozenset("body button caption head html legend option select tbody td tfoot th thead title tr".split())
SECTIONS = frozenset("article aside footer form header main nav section dialog address".split())
# End of fixed values.

#: Open tags that a page's chain has at most; deeper elements are read as parts of the last one.
DEEPEST = 512
#: Features of a chain of open tags, and words of one tag's names, that are looked at.
MOST_FEATURES, MOST_WORDS = 256, 32

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|style)(?![^\s=/>])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NOT_SHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TAGS}
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    """Text of a leaf block, its open tags' features and the share of its characters in links."""

    text: str
    path: tuple[str, ...]
    linked: float


@dataclass(slots=True)
class Open:
    """An open tag with the features of the chain down to it; tags opened alike below it are made once."""

    name: str
    hidden: bool
    features: tuple[str, ...]
    box: str
    near: tuple[str, ...]
    kind: str
    path: tuple[str, ...] = ()
    below: dict = field(default_factory=dict)


def _hints(attributes: str) -> tuple[bool, tuple[str, ...]]:
    """Whether an element is not shown, and the words of its names."""
    hidden, words = False, []
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key == "hidden":
            hidden = hidden or value != "until-found"
        elif key == "style":
            hidden = hidden or _NOT_SHOWN.search(value) is not None
        else:
            words.extend(_WORD.findall(value, 0, 4096)[: MOST_WORDS - len(words)])
    return hidden, tuple(words)


def _opened(parent: Open, name: str, attributes: str) -> Open:
    """The tag below ``parent``: its chain has all hints, the innermost sectioning tag and the innermost telling names."""
    key = (name, attributes) if len(attributes) < 256 else None
    found = parent.below.get(key) if key else None
    if found is None:
        hidden, words = _hints(attributes)
        held = parent.features
        new = tuple(dict.fromkeys(h for h in ("t:" + name, *("w:" + w for w in words)) if h not in held))
        features = held + new[: MOST_FEATURES - len(held)] if new and len(held) < MOST_FEATURES else held
        found = Open(
            name,
            hidden or name in HIDDEN_TAGS,
            features,
            name if name in SECTIONS else parent.box,
            tuple(dict.fromkeys(w for w in words if w in _TELLING)) or parent.near,
            name if name in BLOCK_TAGS else parent.kind,
        )
        if key and len(parent.below) < 64:
            parent.below[key] = found
    return found


def _path(tag: Open) -> tuple[str, ...]:
    """The features of a chain of open tags."""
    if not tag.path:
        tag.path = (*tag.features, "box:" + tag.box, *("near:" + n for n in tag.near), "kind:" + tag.kind)
    return tag.path


class _Tags:
    """The tags of a page in order; broken markup is read as far as it goes, each character a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        #: Quotes that do not come again.
        self.last: set[str] = set()

    def end_of_tag(self, at: int) -> int:
        """The place after the tag whose name ends at ``at``; -1 where the page ends inside it."""
        page = self.page
        while True:
            m = _STOP.search(page, at)
            if m is None:
                return -1
            if m[0] == ">":
                return m.end()
            at, before = m.end(), m.start() - 1
            while page[before].isspace():
                before -= 1
            # a quote that does not begin a value is a character like others
            if page[before] == "=" and m[0] not in self.last:
                end = page.find(m[0], at)
                if end < 0:
                    self.last.add(m[0])
                else:
                    at = end + 1

    def __iter__(self) -> Iterator[tuple[str, str, str, int, int]]:
        """(kind, name, attributes, start, end) of each tag: kind is open, close or gone (comments, declarations)."""
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= len(page):
                return
            mark = page[start + 1]
            name = _NAME.match(page, start + (2 if mark == "/" else 1))
            if name is not None:
                end = self.end_of_tag(name.end())
                if end < 0:
                    yield "gone", "", "", start, len(page)
                    return
                kind = "close" if mark == "/" else "open"
                yield kind, name[0].lower(), page[name.end() : end - 1], start, end
                if kind == "open" and (name := name[0].lower()) in RAW_TAGS:
                    close = _RAW_END[name].search(page, end)
                    if close is None:
                        yield "gone", "", "", end, len(page)
                        return
                    stop = page.find(">", close.end())
                    stop = len(page) if stop < 0 else stop + 1
                    yield "gone", "", "", end, stop
                    end = stop
                at = end
            elif mark in "!?/":
                closing = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
                end = page.find(closing, start + 2)
                end = len(page) if end < 0 else end + len(closing)
                yield "gone", "", "", start, end
                at = end
            else:
                at = start + 1


def leaf_blocks(page: str) -> list[Block]:
    """A page's blocks in order. Broken markup is read as far as it goes."""
    root = Open("", False, (), "none", ("none",), "none")
    chain: list[Open] = [root]
    deeper: dict[str, int] = {}
    opened: dict[str, int] = {}
    out: list[Block] = []
    pieces: list[str] = []
    linked, links, hidden = 0, 0, 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, _path(chain[-1]), min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def close(index: int) -> None:
        nonlocal links, hidden
        for tag in chain[index:]:
            opened[tag.name] -= 1
            links -= tag.name == "a"
            hidden -= tag.hidden
        del chain[index:]

    at = 0
    for kind, name, attributes, start, end in _Tags(page):
        put(page[at:start])
        at = end
        if kind == "gone":
            continue
        if kind == "close":
            if deeper.get(name):
                close_block() if name in BLOCK_TAGS else None
                deeper[name] -= 1
                continue
            if name in BLOCK_TAGS:
                close_block()
            for i in range(len(chain) - 1, 0, -1) if opened.get(name) else ():
                if chain[i].name == name:
                    close(i)
                    break
                # the end of a link or of bold text does not end the block around it
                if name not in BLOCK_TAGS and chain[i].name in BLOCK_TAGS:
                    break
            continue
        if name in RAW_TAGS:
            close_block() if name in BLOCK_TAGS else None
            continue
        if name == "br":
            pieces.append(" ") if not hidden else None
            continue
        if name in BLOCK_TAGS:
            close_block()
            if name in ENDS_P or name == "li":
                for i in range(len(chain) - 1, 0, -1):
                    if chain[i].name == "p" or (chain[i].name == name and name in ("li", "dt", "dd", "option", "tr", "td", "th")) or (name in ("dt", "dd") and chain[i].name in ("dt", "dd")):
                        close(i)
                        break
                    if chain[i].name in BLOCK_TAGS:
                        break
        if name not in VOID_TAGS and not attributes.endswith("/"):
            if len(chain) > DEEPEST:
                deeper[name] = deeper.get(name, 0) + 1
                continue
            tag = _opened(chain[-1], name, attributes)
            chain.append(tag)
            opened[name] = opened.get(name, 0) + 1
            links += name == "a"
            hidden += tag.hidden
    put(page[at:])
    close_block()
    return out


_END = re.compile(r"[.!?…][\"'»”)]*$")


def features(blocks: list[Block]) -> list[tuple[tuple[str, ...], list[str]]]:
    """Feature names of each block: those of its chain, which blocks of one chain share, and those of its text."""
    total = len(blocks)
    out = []
    for i, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        size = "1" if n < 2 else "4" if n < 5 else "10" if n < 11 else "25" if n < 26 else "60" if n < 61 else "many"
        link = "none" if b.linked == 0 else "some" if b.linked < 0.5 else "most"
        marks = b.text.count(".") + b.text.count("!") + b.text.count("?")
        names = ["bias", "size:" + size, "link:" + link, f"size:{size}&link:{link}", "place:" + str(10 * i // total)]
        names.append("ends:" + ("yes" if _END.search(b.text, max(0, len(b.text) - 32)) else "no"))
        names.append("sentences:" + ("0" if not marks else "1" if marks == 1 else "more"))
        if b.text[0] == "©" or "©" in b.text[:40]:
            names.append("copyright")
        out.append((b.path, names))
    return out


@dataclass
class ChainModel:
    """Feature weights (of label 1 against label 0), transition and start weights."""

    number: dict[str, int]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)

    def emissions(self, names: list[tuple[tuple[str, ...], list[str]]]) -> list[float]:
        weight = self.cache.get("by_name")
        if weight is None:
            weight = self.cache["by_name"] = {k: float(self.weights[i]) for k, i in self.number.items()}
        of_path = {id(path): path for path, _ in names}
        of_path = {k: sum([weight.get(n, 0.0) for n in path]) for k, path in of_path.items()}
        return [of_path[id(path)] + sum([weight.get(n, 0.0) for n in own]) for path, own in names]

    def viterbi(self, names: list[tuple[tuple[str, ...], list[str]]]) -> list[int]:
        """The best labels of a page's blocks; label 0 wins ties."""
        if not names:
            return []
        gain = self.emissions(names)
        (t00, t01), (t10, t11) = self.transition.tolist()
        s0, s1 = float(self.start[0]), float(self.start[1]) + gain[0]
        back = []
        for g in gain[1:]:
            from0, from1 = (0, s0 + t00) if s0 + t00 >= s1 + t10 else (1, s1 + t10), (0, s0 + t01) if s0 + t01 >= s1 + t11 else (1, s1 + t11)
            back.append((from0[0], from1[0]))
            s0, s1 = from0[1], from1[1] + g
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, rate: float = 0.4, decay: float = 1e-4) -> ChainModel:
    """Maximum likelihood by gradient ascent with forward-backward marginals."""
    named = [([[*path, *own] for path, own in features(b)], y) for b, y in pages if b]
    number = {n: i for i, n in enumerate(sorted({n for f, _ in named for row in f for n in row}))}
    rows = np.array([k for k, row in enumerate(r for f, _ in named for r in f) for _ in row])
    cols = np.array([number[n] for f, _ in named for row in f for n in row])
    y = np.array([v for _, labels in named for v in labels])
    lengths = np.array([len(f) for f, _ in named])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    w, t, s = np.zeros(len(number)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full_like(a, 1e-6) for a in (w, t, s)]
    longest = int(lengths.max())
    place = np.full((len(named), longest), -1)
    for i, (a, n) in enumerate(zip(starts, lengths, strict=True)):
        place[i, :n] = np.arange(a, a + n)
    there = place >= 0
    truth = np.where(there, y[place], 0)
    onehot = np.stack([1 - truth, truth], 2) * there[:, :, None]
    pair_truth = np.einsum("pti,ptj->ij", onehot[:, :-1], onehot[:, 1:])
    for _ in range(rounds):
        e = np.bincount(rows, weights=w[cols], minlength=len(y))
        em = np.zeros((len(named), longest, 2))
        em[:, :, 1] = np.where(there, e[place], 0)
        forward, backward = np.zeros_like(em), np.zeros_like(em)
        forward[:, 0] = s + em[:, 0]
        for k in range(1, longest):
            step = _log_sum(forward[:, k - 1, :, None] + t, 1) + em[:, k]
            forward[:, k] = np.where(there[:, k, None], step, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = _log_sum(t + (em[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(there[:, k + 1, None], step, 0)
        z = _log_sum(forward[:, -1], 1)
        marginal = np.exp(forward + backward - z[:, None, None]) * there[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + t + (em[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        error = np.zeros(len(y))
        error[place[there]] = (truth - marginal[:, :, 1])[there]
        grads = [
            np.bincount(cols, weights=error[rows], minlength=len(number)) / len(named) - decay * w,
            (pair_truth - pair.sum((0, 1))) / len(named) - decay * t,
            (onehot[:, 0].sum(0) - marginal[:, 0].sum(0)) / len(named) - decay * s,
        ]
        for a, g, q in zip((w, t, s), grads, squares, strict=True):
            q += g * g
            a += rate * g / np.sqrt(q)
    return ChainModel(number, w, t, s)


# Words of the class and id names that web pages give to their parts.
_MAIN_NAMES = "article content post entry story main body text page news blog single detail primary".split()
_OTHER_PARTS = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links tabs pagination pager toc",
    "header": "header masthead banner top branding logo site topbar hero",
    "footer": "footer bottom copyright legal colophon imprint foot",
    "aside": "sidebar aside related widget recommended trending popular more rail secondary tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo adsbygoogle dfp commercial affiliate",
    "notice": "cookie consent notice gdpr banner popup modal alert newsletter subscribe overlay privacy",
    "form": "form search login signup contact subscribe field newsletter",
    "comments": "comments comment reply discussion respond disqus thread user feedback replies",
    "share": "share social follow buttons toolbar author meta byline date tools",
}
#: Names that say nothing of what they hold.
_PLAIN_NAMES = "wrapper container page layout row col inner box grid section block mw-parser-output css-1a2b3c c12 jsx-77 module panel item wide".split()
_COMMENT_BLOCKS = ("comment", "reply", "comment-body", "comment-text", "user-comment", "discussion-post")


#: Names that tell what a part is; others say as much as none.
_TELLING = frozenset([*_MAIN_NAMES, *" ".join(_OTHER_PARTS.values()).split(), *_WORD.findall(" ".join(_COMMENT_BLOCKS))])


def _prose(rng: random.Random, least: int, most: int, ends: bool = True) -> str:
    """Words of random syllables: the text itself must teach nothing but its form."""
    syllables = ("ta", "re", "mi", "son", "lek", "vor", "und", "est", "que", "ha", "ing", "ón", "é", "sch")
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(least, most))]
    style = rng.random()
    if style < 0.08:
        return " ".join(w.upper() + "!!" for w in words)
    if style < 0.16:
        return " ".join(w + rng.choice(("***", "$$$", "%%%", "###", "&amp;&amp;")) for w in words)
    if style < 0.22:
        return " | ".join(words)
    for i in range(0, len(words), rng.randint(6, 14)):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += rng.choice((".", ".", ",", "?", "!"))
    return " ".join(words) + ("." if ends and rng.random() < 0.85 else "")


def _unknown_name(rng: random.Random) -> str:
    """A name in no known language, as parts of foreign pages have."""
    while True:
        name = "".join(rng.choice(("pi", "fus", "inha", "kom", "leis", "con", "teni", "bar", "ra", "mek", "ped", "zo")) for _ in range(rng.randint(1, 3)))
        if name not in _TELLING:
            return name


def _any_block(rng: random.Random, mark: str) -> str:
    """A list, a table, a definition list, a quote, a caption or a heading with paragraphs; every text begins with ``mark``."""
    text = lambda a, b, ends=True: mark + _prose(rng, a, b, ends)
    kind = rng.choice(("ul", "ol", "table", "dl", "quote", "pre", "figure", "heading"))
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{text(1, 18)}</li>" for _ in range(rng.randint(1, 5))) + f"</{kind}>"
    if kind == "table":
        return "<table>" + "".join(f"<tr><td>{text(1, 4, False)}</td><td>{text(1, 20, False)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
    if kind == "dl":
        return "<dl>" + "".join(f"<dt>{text(1, 4, False)}</dt><dd>{text(2, 30)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
    if kind == "quote":
        return f"<blockquote><p>{text(5, 40)}</p></blockquote><p>{text(3, 30)}</p>"
    if kind == "pre":
        return f"<pre>{text(4, 20)}</pre>"
    if kind == "figure":
        return f"<figure><img src=x><figcaption>{text(3, 14)}</figcaption></figure>"
    return f"<h{(k := rng.randint(2, 5))}>{text(1, 8, False)}</h{k}><p>{text(4, 60)}</p>"


def labelled_pages(count: int = 1100, seed: int = 20_240_602) -> list[tuple[list[Block], list[int]]]:
    """Pages composed from parts with known labels, cut into blocks.

    Parts come in the ways pages are written: by semantic tags, by class or id
    names on plain tags, or by both; articles hold headings, paragraphs, lists,
    quotes, tables and captions, with unclosed tags among them, and the other parts
    hold all of these too, now and then under a name that tells nothing. Every text of an
    article carries a mark that gives its block the label 1 and is taken off.
    """
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        source = _page(rng)
        blocks = leaf_blocks(source)
        labels = [int("⁂" in b.text) for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace("⁂", "").split()) or "-"
        out.append((blocks, labels))
    return out


def _page(rng: random.Random) -> str:
    own = lambda least, most, ends=True: "⁂" + _prose(rng, least, most, ends)

    def named(tag: str, words: str, content: str, semantic: bool) -> str:
        word = rng.choice(words.split()) if rng.random() < 0.9 else _unknown_name(rng)
        key = rng.choice(("class", "class", "id", "role") if semantic else ("class", "class", "id"))
        name = rng.choice((word, word, f"{word}-{rng.choice(('wrap', 'box', 'list', 'area', 'block', 'section', 'container'))}", f"{rng.choice(('site', 'main', 'page', 'top'))}-{word}"))
        attribute = "" if semantic and rng.random() < 0.6 else f' {key}="{name}"'
        return f"<{tag}{attribute}>{content}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{_prose(rng, 1, 3, False)}</a></li>' for _ in range(n)) + "</ul>"

    def other(kind: str) -> str:
        semantic = rng.random() < 0.6
        words = _OTHER_PARTS[kind]
        text = lambda a, b: _prose(rng, a, b)
        if kind in ("footer", "aside", "notice", "ad", "header") and rng.random() < 0.15:
            return named({"footer": "footer", "aside": "aside", "header": "header"}.get(kind, "div") if semantic else "div", words, _any_block(rng, ""), semantic)
        if kind == "nav":
            return named("nav" if semantic else "div", words, links(rng.randint(2, 8)) if rng.random() < 0.8 else " ".join(f'<a href="#">{_prose(rng, 1, 2, False)}</a>' for _ in range(4)), semantic)
        if kind == "header":
            return named("header" if semantic else "div", words, f"<h{rng.randint(1, 3)}>{text(1, 5)}</h1><p>{text(2, 9)}</p>" if rng.random() < 0.7 else text(2, 6), semantic)
        if kind == "footer":
            return named("footer" if semantic else "div", words, rng.choice((f"&copy; {text(2, 14)}", f"<p>&copy; 20{rng.randint(10, 30)} {text(1, 4)}</p>", f"<p>{text(2, 8)}</p>", f"<p>{text(3, 30)}</p>" + links(3), text(4, 30))), semantic)
        if kind == "aside":
            return named("aside" if semantic else "div", words, rng.choice((f"<h3>{text(1, 4)}</h3>" + links(4), f"<p>{text(5, 40)}</p>", f"<h4>{text(1, 3)}</h4><p>{text(8, 60)}</p>")), semantic)
        if kind == "form":
            body = f"<label>{text(1, 3)}</label><input name=q><button>{text(1, 2)}</button>" + (f"<p>{text(3, 15)}</p>" if rng.random() < 0.4 else "")
            return named("form" if semantic else "div", words, body, semantic)
        if kind == "comments":
            items = "".join(f'<{(t := rng.choice(("div", "li", "article", "p")))} class="{rng.choice(_COMMENT_BLOCKS)}">' + rng.choice((f"<p>{text(4, 50)}</p>", f"<b>{text(1, 2)}</b> {text(4, 50)}", f"<cite>{text(1, 2)}</cite><p>{text(6, 60)}</p><p>{text(4, 40)}</p>", f"<b>{text(1, 2)}</b>{_any_block(rng, '')}")) + f"</{t}>" for _ in range(rng.randint(1, 5)))
            if rng.random() < 0.25:
                # comments of one list or table, without items that tell what they are
                items = "".join(_any_block(rng, "") for _ in range(rng.randint(1, 3)))
            heading = f"<h3>{text(1, 3)}</h3>" if rng.random() < 0.7 else ""
            tag = rng.choice(("section", "div", "ol"))
            return f'<{tag} {rng.choice(("class", "class", "id"))}="{rng.choice(words.split())}{rng.choice(("", "", "-list", "-area", "-wrap"))}">{heading}{items}</{tag}>'
        if kind == "share":
            return named("div", words, rng.choice((links(3), text(1, 6), f'<a href="#">{text(1, 2)}</a> <span>{text(1, 4)}</span>')), False)
        return named(rng.choice(("div", "div", "section", "aside", "p")), words, rng.choice((text(3, 40), f"<p>{text(3, 50)}</p>", f'<a href="#">{text(2, 12)}</a>')), False)

    def article() -> str:
        parts = [f"<h1>{own(2, 12, False)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9, 14))):
            x = rng.random()
            if x < 0.55:
                p = own(1, 90) if rng.random() < 0.85 else own(1, 4)
                p = p if rng.random() < 0.8 else f'{p} <a href="#">{_prose(rng, 1, 4, False)}</a> {_prose(rng, 2, 20)}'
                parts.append(rng.choice((f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br><p>{own(1, 60)}</p>", f"<div>{p}</div>")))
            elif x < 0.64:
                parts.append(f"<h{(k := rng.randint(2, 4))}>{own(1, 8, False)}</h{k}>")
            elif x < 0.71:
                parts.append("<ul>" + "".join(f"<li>{own(1, 18)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif x < 0.76:
                parts.append(f"<blockquote><p>{own(5, 40)}</p></blockquote>")
            elif x < 0.79:
                parts.append("<table>" + "".join(f"<tr><td>{own(1, 4, False)}</td><td>{own(1, 4, False)}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.81:
                parts.append("<dl>" + "".join(f"<dt>{own(1, 4, False)}</dt><dd>{own(2, 30)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>")
            elif x < 0.83:
                parts.append(f"<figure><img src=x><figcaption>{own(3, 14)}</figcaption></figure>")
            elif x < 0.85:
                parts.append(f"<pre>{own(4, 20)}</pre>")
            else:
                parts.append(other(rng.choice(("ad", "ad", "share", "aside", "notice"))))
        if parts and rng.random() < 0.1:
            parts[0] = f"<header>{parts[0]}{other('share') if rng.random() < 0.5 else ''}</header>"
        for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
            parts.insert(rng.randint(0, len(parts)), other("comments"))
        if rng.random() < 0.08:
            parts.append(f"<footer>{_prose(rng, 2, 12)}</footer>")
        body = "".join(parts)
        style = rng.random()
        name = rng.choice(_MAIN_NAMES) if rng.random() < 0.9 else _unknown_name(rng)
        if style < 0.24:
            return f"<article>{body}</article>"
        if style < 0.36:
            beside = other(rng.choice(("aside", "comments", "share", "nav"))) if rng.random() < 0.3 else ""
            return f"<main>{body}{beside}</main>" if rng.random() < 0.5 else f"<main><article>{body}</article>{beside}</main>"
        if style < 0.43:
            return f'<article class="{name}">{body}</article>'
        if style < 0.7:
            return f'<div {rng.choice(("class", "id"))}="{rng.choice(("", "", "main-", "page-", "site-"))}{name}{rng.choice(("", "", "-content", "-body", "-text", "-wrap", "-area"))}">{body}</div>'
        if style < 0.75:
            return rng.choice((f'<div role="main">{body}</div>', f'<div itemprop="articleBody">{body}</div>', f"<section>{body}</section>"))
        if style < 0.86:
            return f'<div {rng.choice(("class", "id"))}="{rng.choice(_PLAIN_NAMES)}">{body}</div>'
        return body

    before = [other(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "aside", "share"], rng.randint(0, 4))]
    after = [other(k) for k in rng.sample(["footer", "aside", "comments", "ad", "notice", "form", "nav", "share"], rng.randint(0, 5))]
    middle = article()
    if rng.random() < 0.2:
        # the line of a page's end, in a part that has no name or an unknown one
        after.append(rng.choice((f'<div class="{_unknown_name(rng)}"><p>{_prose(rng, 1, 4, False)}</p></div>', f"<div>&copy; 20{rng.randint(10, 30)} {_prose(rng, 1, 4, False)}</div>", f"<p>&copy; {_prose(rng, 1, 6)}</p>", f"<small>&copy; {_prose(rng, 1, 6)}</small>")))
    if rng.random() < 0.2:
        middle = f'<div class="{rng.choice(_PLAIN_NAMES)}">{before.pop() if before and rng.random() < 0.5 else ""}{middle}{after.pop(0) if after else ""}</div>'
    return f"<html><head><title>x</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def main_text(page: str | None, model: ChainModel) -> str:
    """The article's blocks in page order, one on each line; empty for a null page or one without an article."""
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, label in zip(blocks, model.viterbi(features(blocks)), strict=True) if label)


@lru_cache(1)
def fitted() -> ChainModel:
    """The model of the composed pages, trained once in a process, as it depends on nothing that is given."""
    return train(labelled_pages())


def extracted(pages: DataFrame, model: ChainModel | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` of every page with text and n_chars (its code points).

    The model is that of the composed pages unless one is given. A null, empty or blank page gives an
    empty text; repeated rows give the same text; whole pages are read.
    """
    model = fitted() if model is None else model
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string, n_chars long"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    slim = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("_html"))
    return map_slices(slim, each, schema)
