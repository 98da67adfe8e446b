"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and pieces of text. The words of a piece score by where they stand and in what kind of
block: a positive prior, the weight of the elements around them, the share of links in their block, and for short blocks whether
they say what notices, adverts and the like say; each tag costs something. All weights are naive Bayes log odds, learned from
labelled pages. One linear scan finds the contiguous region with the highest sum; its blocks are the main
text, but for pieces with a negative score, such as an advert inside an article.

An element's weight comes from its name, role and property, and from its classes and id: a class counts as a whole if it is
known, else by its last word, else a little by the other words; one that begins with a modifier (has-, no-, is-) says
nothing. `html` and `body` say nothing about what stands in them. What an element says counts in full, what those around it say
the less the farther out they are, so an article inside a box with a misleading class is still an article.

Scripts, styles, comments of the markup, forms' controls and other unseen elements have no text; an unseen element that is closed in
its own tag (<svg/>) or, but for scripts and the like, never closed hides nothing. Character
references are decoded, white space inside a block becomes one space, blocks are joined by an empty line. Null or
empty html, and a page without any positive region, give the empty text. Pages are handled one by one and whole, so
ties, repeated rows and extra columns don't matter; only page_id, url and html are read. Ties between regions go to
the first one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .html_labelled import PAGES

UNSEEN = frozenset("script style noscript template textarea title svg math iframe select button object canvas audio video datalist".split())
#: Without an end tag, all that follows these is theirs.
RAW = frozenset("script style textarea title".split())
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>{_ATTRIBUTES})>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in UNSEEN}
SUBWORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words that make a class a statement about a state.
MODIFIERS = frozenset("has no is with without not js".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose name says what stands in them; the others count by class and id only.
TELLING = frozenset("article aside dialog footer form header main menu nav section".split())
ENDS_P = BLOCK - {"body", "html", "head"}
#: Elements that say nothing about what stands in them.
SILENT = frozenset(("html", "body"))
OUTER = 0.5  # what an element counts for what stands in a telling element inside it
PART, QUALIFIED = 0.5, 0.8  # what words of an unknown class count but for the last: if they speak for main text, against it
WORD_PRIOR, MOST, LEAST, RUN_LEAST, MOST_TAG, LEAST_TAG = 0.8, 1.5, -3.0, -2.5, 4.0, 0.05
SHORT = 40  # words of a block that is looked at for markers
#: What short blocks say that are no main text.
MARKERS = {
    "legal": r"©|\(c\) ?\d{4}|copyright|all rights reserved|terms of (?:use|service)|privacy policy|imprint|legal notice",
    "cookies": r"\b(?:use|accept|allow|reject|our)\b[^.]*\bcookies\b|\bcookies?\b[^.]*\b(?:consent|settings|preferences)\b",
    "subscribe": r"\bsubscribe|newsletter|sign(?:ing)? up\b|your inbox|free trial", "account": r"\blog ?in\b|\bsign in\b|\bpassword\b|create an account|your account",
    "share": r"\bshare (?:this|on|via)|\btweet\b|follow us|like us", "related": r"related (?:posts|articles|stories|reading)|most (?:read|popular|viewed)|you may also|you might|read (?:more|next)|recommended|trending",
    "advert": r"\badvert|\bsponsored|\bpromoted|buy now|shop now|order now|special offer|\d ?% off", "comment": r"leave a (?:comment|reply)|\bcomments?\b|\brepl(?:y|ies)\b|posted by|\bsays:|\bwrote:",
    "furniture": r"skip to|back to top|next page|previous page|filed under|\btags:|\bmenu\b|table of contents|on this page",
}
#: One of these stands in all that the markers match, so most blocks need no search.
HINTS = tuple(
    "©|(c)|copyright|all rights|terms of|privacy|imprint|legal|cookie|subscribe|newsletter|sign|inbox|trial|log|password|account|share|tweet|follow|like us|related|most |you m|read |recommended|trending|advert|sponsored|promoted| now|offer|% off|comment|repl|posted|says:|wrote:|leave|skip to|back to| page|filed|tags:|menu|contents".split("|")
)
SAYS = re.compile("|".join(f"(?P<{k}>{v})" for k, v in MARKERS.items()), re.I)


@dataclass
class Item:
    """A tag (text None) or a piece of text; what the elements around it say, with their weight; whether it is linked."""

    text: str | None
    tag: str
    features: frozenset
    weight: float = 0.0
    breaks: bool = False
    main: bool = False
    linked: bool = False


def own_features(name: str, rest: str, inner: bool) -> tuple[set[str], bool | None]:
    """What an element says about what stands in it, and whether it is labelled as kept or dropped. inner: it is part of a main text."""
    said, label = set(), None
    if name in TELLING:
        said.add(f"inner {name}" if inner and name in ("header", "footer", "article") else name)
    if not rest or rest.isspace():
        return said, label
    for a in ATTRIBUTE.finditer(rest):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in SUBWORDS.findall(token) if len(w) > 1]
                if words and words[0] not in MODIFIERS:
                    said.add(" ".join(["." + "-".join(words), "~" + words[-1], *("-" + w for w in words[:-1])]))
        elif key in ("role", "itemprop"):
            said.add(f"{key}={value.lower()}")
        elif key in ("hidden", "aria-hidden") and value.lower() != "false" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            said.add("hidden")
        elif key in ("keep", "drop"):
            label = key == "keep"
    return said, label


MAIN = frozenset(("article", "main", "role=main", "role=article", "itemprop=articlebody"))


def items(html: str, weigh: Callable[[frozenset], float] = lambda _: 0.0) -> Iterator[Item]:
    stack: list[tuple[str, frozenset, float, bool]] = []
    features, weight, main, at, pos, linked = frozenset(), 0.0, False, 0, 0, False
    never: set[str] = set()

    def text(upto: int) -> Iterator[Item]:
        if upto > at:
            yield Item(html[at:upto], "", features, weight, main=main, linked=linked)

    last = html.rfind(">") + 1  # no tag ends behind it
    while m := TOKEN.search(html, pos, last):
        yield from text(m.start())
        at = pos = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = pos = len(html)
            continue
        name = name.lower()
        breaks = name in BLOCK
        if m["end"]:
            if name == "a":
                linked = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    features, weight, main = stack[i][1:]
                    del stack[i:]
                    break
        else:
            rest = m["rest"]
            if name in UNSEEN:
                if rest.endswith("/") or name in never:
                    continue
                if end := CLOSING[name].search(html, pos):
                    at = pos = end.end()
                elif name in RAW:
                    at = pos = len(html)
                else:
                    never.add(name)
                continue
            if name in ENDS_P and stack:
                while stack and stack[-1][0] not in BLOCK:
                    features, weight, main = stack.pop()[1:]
                if stack and (stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li"):
                    features, weight, main = stack.pop()[1:]
                linked = False
            if name == "a":
                linked = True
            if name not in VOID:
                stack.append((name, features, weight, main))
                own, label = (set(), None) if name in SILENT and "keep" not in rest else own_features(name, rest, not features.isdisjoint(MAIN))
                main = main if label is None else label
                if own:
                    own = frozenset(own)
                    features = features | own
                    if told := weigh(own):
                        weight = told + OUTER * weight
        yield Item(None, name, features, weight, breaks or name in SPACED, main)
    yield from text(len(html))


def kinds(seq: list[Item]) -> list[tuple[str, ...]]:
    """For each item what kind its block is: how much of it is linked, and what it says if it is short."""
    out: list[tuple[str, ...]] = [()] * len(seq)
    start = 0
    for end in range(len(seq) + 1):
        if end < len(seq) and not (seq[end].text is None and seq[end].breaks and seq[end].tag not in SPACED):
            continue
        pieces = [it for it in seq[start:end] if it.text is not None]
        n = links = 0
        for it in pieces:
            words = len(it.text.split())
            n += words
            links += words * it.linked
        if n:
            kind = ["unlinked" if not links else "partly linked" if 2 * links <= n else "linked"]
            if n <= SHORT:
                said = entities.unescape(" ".join([it.text for it in pieces]))
                low = said.lower()
                if any(h in low for h in HINTS):
                    kind += sorted({f"says {k.lastgroup}" for k in SAYS.finditer(said)})
            out[start:end] = [tuple(kind)] * (end - start)
        start = end
    return out


@dataclass
class Weights:
    features: dict[str, float]
    kinds: dict[str, float]
    tags: dict[str, float]

    def element(self, own: frozenset) -> float:
        """What an element says about main text; classes by the most exact form that is known."""
        total = 0.0
        for f in own:
            if f[0] != ".":
                total += self.features.get(f, 0.0)
                continue
            whole, last, *others = f.split(" ")
            if whole in self.features:
                total += self.features[whole]
                continue
            end = self.features.get(last, 0.0)
            told = [self.features.get("~" + w[1:], 0.0) for w in others]
            worst = min(told, default=0.0)
            total += min(end, 0.0) + QUALIFIED * worst if worst < 0 else end or PART * sum(told)
        return max(LEAST, min(MOST, total))

    def word(self, weight: float, kind: tuple[str, ...]) -> float:
        return max(LEAST, min(MOST, WORD_PRIOR + weight + sum(self.kinds.get(k, 0.0) for k in kind)))


def _odds(counts: dict[bool, Counter]) -> dict[str, float]:
    """Smoothed log odds of main text for each feature; those that stand everywhere tell nothing."""
    total = {k: max(c[""], 1) for k, c in counts.items()}
    found = {*counts[True], *counts[False]} - {""}
    odds = {f: math.log((counts[True][f] + 1) / (total[True] + 2)) - math.log((counts[False][f] + 1) / (total[False] + 2)) for f in found}
    return {f: max(LEAST, min(MOST, w)) for f, w in odds.items() if min(counts[True][f] / total[True], counts[False][f] / total[False]) <= 0.9}


def learn(pages: list[str] = PAGES) -> Weights:
    words, blocks, tags = ({True: Counter(), False: Counter()} for _ in range(3))
    for page in pages:
        seq = list(items(page))
        for it, kind in zip(seq, kinds(seq), strict=True):
            if it.text is None:
                tags[it.main][it.tag] += 1
            elif n := len(it.text.split()):
                said = {part for f in it.features for part in (f.split(" ")[:2] if f[0] == "." else [f])}
                words[it.main].update(dict.fromkeys([*said, ""], n))
                blocks[it.main].update([*kind, ""])
    many = {k: sum(c.values()) for k, c in tags.items()}
    cost = {t: -max(LEAST_TAG, min(MOST_TAG, 0.5 + math.log((tags[False][t] + 1) / (many[False] + 2)) - math.log((tags[True][t] + 1) / (many[True] + 2)))) for t in {*tags[True], *tags[False]}}
    return Weights(_odds(words), _odds(blocks), cost)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Ends of the contiguous run with the highest positive sum; (0, 0) if there is none."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    known: dict[frozenset, float] = {}

    def weigh(own: frozenset) -> float:
        if own not in known:
            known[own] = weights.element(own)
        return known[own]

    seq = list(items(html, weigh))
    scores, each = [], []
    for it, kind in zip(seq, kinds(seq), strict=True):
        if it.text is None:
            each.append(0.0)
            scores.append(weights.tags.get(it.tag, -0.5))
            continue
        w = weights.word(it.weight, kind)
        each.append(w)
        scores.append(max(RUN_LEAST, w * len(it.text.split())))
    start, end = best_run(scores)
    blocks, block = [], []
    for it, w in zip(seq[start:end], each[start:end], strict=True):
        if it.text is None:
            if it.breaks:
                if it.tag in SPACED:
                    block.append(" ")
                else:
                    blocks.append(block)
                    block = []
        elif w > 0:
            block.append(it.text)
    blocks.append(block)
    said = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(s for s in said if s)


def extract(pages: DataFrame, labelled: list[str] = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = learn(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                texts = [main_text(h, weights) for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
