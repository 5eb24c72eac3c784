"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A page's leaf blocks (runs of text between block-level tags) form a sequence.  Each block
has features of its ancestors (tags, words of class and id, the two innermost sections) and
of its text (length, share of linked characters, punctuation).  The field is trained by
gradient steps on the exact log-likelihood of TRAIN_PAGES labelled pages (``labelled``),
which takes seconds on the driver whatever the input, and decoded by Viterbi in the tasks.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts
from .labelled import MAIN, labelled_pages

#: Labelled pages that the model is fitted on, and gradient steps.
TRAIN_PAGES, STEPS = 500, 120
RATE, DECAY = 0.15, 1e-4

#: Elements that are passed over with all they hold.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "svg", "math", "select", "iframe", "canvas")
#: Those that take the rest of a page if they do not end, and that a slash does not close.
CODE = ("script", "style")
#: Elements that stay inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label input button".split()) - {"label", "button"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the second list.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An element that none of ENDS reaches beyond.
SCOPE = frozenset("ul ol dl table div section article body".split())
SECTIONS = frozenset("nav header footer aside article main section form figure blockquote table ul ol body".split())
#: Start tags that a head may hold; any other ends it.
HEADED = frozenset("base basefont bgsound html link meta noframes".split())
#: No start tag ends an element that is open outside these.
BARRED = SCOPE | {"object"}
#: Elements whose own content is not read, and start tags that end them.
UNREAD = ("object", "audio", "video")
OUTER = frozenset("body article main section nav header footer aside h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
_NOT_INLINE_P = INLINE | {"label", "button"}

#: Elements below this depth are taken as parts of the one at it.
MAX_DEPTH = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r">|=\s*([\"'])")
_OPENS = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in RAW}
_CLOSES = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in (*RAW, *UNREAD)}
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Tokens:
    """Texts and tags of a page, each read once from front to end.

    What a search does not find from one place on it does not find later either, so it is not
    looked for again: time grows with the length of the page, however broken.  A quote opens
    a value only behind ``=`` and only if it ends; a tag that does not end before the page
    does ends at the next ``>``.
    """

    def __init__(self, page: str):
        self.page, self.loose, self.unclosed = page, False, False
        self.lost: set[str] = set()
        self.next_end: dict[str, int] = {}

    def _tag_end(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``; 0 if no tag ends any more."""
        place = at
        while not self.loose and (m := _MARK.search(self.page, place)):
            if m[1] is None:
                return m.end()
            place = m.end()
            close = -1 if m[1] in self.lost else self.page.find(m[1], place)
            if close < 0:
                self.lost.add(m[1])
            else:
                place = close + 1
        self.loose = True
        return self.page.find(">", at) + 1

    def _behind(self, tag: str, at: int, closed: bool) -> int:
        """The place behind a raw element whose start tag ends at ``at``."""
        page, end = self.page, len(self.page)
        if closed and tag not in CODE:
            return at
        if tag in self.lost:
            return end if tag in CODE else at
        until = _OPENS[tag].search(page, at) if closed else None
        m = _CLOSES[tag].search(page, at, until.start() if until else end)
        if m is None:
            if until is None:
                self.lost.add(tag)
            return end if tag in CODE and not closed else at
        return page.find(">", m.end()) + 1 or end

    def _ends(self, tag: str, at: int) -> bool:
        """Is there an end tag of an unread element behind ``at``?"""
        if self.next_end.get(tag, -1) < at and tag not in self.lost:
            m = _CLOSES[tag].search(self.page, at)
            if m is None:
                self.lost.add(tag)
            else:
                self.next_end[tag] = m.start()
        return tag not in self.lost

    def __iter__(self):
        """(text, "", "") or (None, tag, attributes); the tag of an end tag begins with a slash."""
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            here = page.find("<", at)
            if here < 0:
                yield page[at:], "", ""
                return
            if here > at:
                yield page[at:here], "", ""
            ahead = page[here + 1 : here + 2]
            if page.startswith("<!--", here):
                at = page.find("-->", here + 2) + 3
                at = at if at > 2 else end
                continue
            m = _NAME.match(page, here + 1 + (ahead == "/"))
            if m is None:
                if ahead and ahead in "!?/":
                    at = page.find(">", here) + 1 or end
                else:
                    yield "<", "", ""
                    at = here + 1
                continue
            at = self._tag_end(m.end())
            if not at:
                yield page[here:], "", ""
                return
            tag, attributes = m[0].lower(), page[m.end() : at - 1]
            if ahead == "/":
                yield None, "/" + tag, ""
            elif tag in _OPENS:
                at = self._behind(tag, at, attributes.endswith("/"))
            else:
                self.unclosed = tag in UNREAD and not self._ends(tag, at)
                yield None, tag, attributes


class Paths:
    """Interned paths of open elements: number of a path -> (tag, parent's number, its features).

    Of the features only those in ``known`` are kept, if it is given.
    """

    LIMIT = 200_000

    def __init__(self, known: frozenset | None = None):
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.rows: list[tuple[str, int, frozenset, tuple[str, ...]]] = [("", -1, frozenset(), ())]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes if len(attributes) < 200 else hash(attributes))
        found = self.numbers.get(key)
        if found is None:
            above = self.rows[parent]
            words = {w for m in _NAMED.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w}
            own = {f"word {w}" for w in words}
            if tag not in ("div", "span", "html", "body") and tag not in INLINE:
                own.add(f"tag {tag}")
            if self.known is not None:
                own &= self.known
            sections = (*above[3], tag)[-2:] if tag in SECTIONS else above[3]
            found = self.numbers[key] = len(self.rows)
            self.rows.append((tag, parent, above[2] | own if own - above[2] else above[2], sections))
        return found


def leaf_blocks(page: str, paths: Paths):
    """(text, linked characters, path) of every leaf block, in page order.

    Tags may be unclosed or misplaced: an end tag without an open element is ignored, a
    paragraph ends where another block starts.  A head ends at the first tag that it may not
    hold or at text; an unread element ends with its own end tag, with that of an element around
    it, or where a section or heading starts; one that has no end tag, where any block starts.
    """
    if len(paths.rows) > Paths.LIMIT:
        paths.clear()
    rows, at, depth, out, parts = paths.rows, 0, 0, [], []
    linked = anchors = unread = 0
    opened: Counter = Counter()
    deeper: Counter = Counter()
    head = unclosed = False
    tokens = Tokens(page)

    def settle():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                place = at
                while rows[place][0] in INLINE or rows[place][0] in UNREAD:
                    place = rows[place][1]
                out.append((text, min(linked, len(text)), place))
        linked = 0

    def enter(tag, attributes) -> bool:
        nonlocal at, depth
        if depth == MAX_DEPTH:
            deeper[tag] += 1
            return False
        at, depth = paths.child(at, tag, attributes), depth + 1
        opened[tag] += 1
        return True

    def leave(tags, scope):
        nonlocal at, depth, anchors, unread
        if not any(opened[t] for t in tags):
            return
        place = at
        while place > 0 and rows[place][0] not in scope:
            if rows[place][0] in tags:
                while True:
                    own = rows[at][0]
                    opened[own] -= 1
                    anchors -= own == "a"
                    unread -= own in UNREAD
                    last, at, depth = at, rows[at][1], depth - 1
                    if last == place:
                        return
            place = rows[place][1]

    def close(tag, scope):
        if deeper[tag]:
            deeper[tag] -= 1
        else:
            leave((tag,), scope)

    for text, tag, attributes in tokens:
        if text is not None:
            head = head and not text.strip()
            if not head and not unread:
                parts.append(text)
                if anchors > 0:
                    linked += len(text)
            continue
        ends = tag[0] == "/"
        tag = tag[1:] if ends else tag
        if head and (tag in ("head", "body", "html", "br") if ends else tag not in HEADED):
            head = False
        if tag in INLINE:
            if tag == "br" and not ends:
                parts.append(" ")
            elif tag == "a" and ends:
                close("a", SCOPE)
            elif tag == "a":
                anchors += enter("a", "")
            continue
        if tag == "head":
            head = not ends
            continue
        if tag in UNREAD:
            if ends:
                close(tag, ())
            elif not attributes.endswith("/"):
                unread += enter(tag, "")
                unclosed = tokens.unclosed
            continue
        while unread and not ends and (unclosed or tag in OUTER):
            leave(UNREAD, ())
        settle()
        if ends:
            close(tag, ())
            continue
        if tag in ENDS:
            leave(ENDS[tag], BARRED)
        if tag not in _NOT_INLINE_P:
            leave(("p",), BARRED)
        if tag not in VOID and not attributes.endswith("/"):
            enter(tag, attributes)
    settle()
    return out


def _bin(n: int) -> int:
    return min(7, n.bit_length())


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    last = text[-1]
    out = ["bias", f"words {_bin(words)}", f"linked {4 * linked // max(1, len(text))}", f"stops {min(3, text.count('. ') + text.count(', '))}"]
    out.append("ends " + ("stop" if last in ".!?…\"”" else "letter" if last.isalpha() else "other"))
    if "©" in text or text[:9].lower() == "copyright":
        out.append("copyright")
    if "|" in text or "·" in text:
        out.append("separator")
    return out


def features(blocks, paths: Paths) -> list[list[str]]:
    out = []
    for text, linked, path in blocks:
        tag, _, named, sections = paths.rows[path]
        out.append([*text_features(text, linked), *named, f"inner {tag}", "in " + " ".join(sections)])
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights: one pair a feature, a 2x2 table for neighbours, a pair for the first block."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, links: np.ndarray, first: np.ndarray):
        self.names, self.weights, self.links, self.first = names, weights, links, first

    def scores(self, blocks, paths: Paths, held: dict) -> np.ndarray:
        """Scores (blocks x 2); those of paths are kept in ``held``."""
        out = np.empty((len(blocks), 2))
        names, w = self.names, self.weights
        for i, (text, linked, path) in enumerate(blocks):
            total = held.get(path)
            if total is None:
                tag, _, named, sections = paths.rows[path]
                found = [names[f] for f in (*named, f"inner {tag}", "in " + " ".join(sections)) if f in names]
                total = held[path] = w[found].sum(0) if found else np.zeros(2)
            own = [names[f] for f in text_features(text, linked) if f in names]
            out[i] = total + w[own].sum(0)
        return out

    def decode(self, scores: np.ndarray) -> list[int]:
        """The likeliest labels (Viterbi); of equal ones REST."""
        if not len(scores):
            return []
        (a00, a01), (a10, a11) = self.links.tolist()
        s0, s1 = (scores[0] + self.first).tolist()
        back = []
        for e0, e1 in scores[1:].tolist():
            from0, from1 = s1 + a10 > s0 + a00, s1 + a11 > s0 + a01
            back.append((from0, from1))
            s0, s1 = (s1 + a10 if from0 else s0 + a00) + e0, (s1 + a11 if from1 else s0 + a01) + e1
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def log_likelihood(score: np.ndarray, mask: np.ndarray, gold: np.ndarray, links: np.ndarray, first: np.ndarray):
    """Of padded sequences (pages x blocks x 2): the sum, and its gradients for scores, links and first."""
    pages, n, _ = score.shape
    alpha = np.zeros_like(score)
    beta = np.zeros_like(score)
    alpha[:, 0] = score[:, 0] + first
    for t in range(1, n):
        step = log_sum(alpha[:, t - 1, :, None] + links[None], 1) + score[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    total = log_sum(alpha[:, -1], 1)
    for t in range(n - 2, -1, -1):
        step = log_sum(links[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
    node = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    pair = np.exp(alpha[:, :-1, :, None] + links + (score + beta)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
    truth = np.eye(2)[gold] * mask[:, :, None]
    pairs = (truth[:, :-1, :, None] * truth[:, 1:, None, :]) * mask[:, 1:, None, None]
    like = (score * truth).sum() + (pairs * links).sum() + (truth[:, 0] * first).sum() - total.sum()
    return like, truth - node, (pairs - pair).sum((0, 1)), (truth[:, 0] - node[:, 0]).sum(0)


@functools.lru_cache(maxsize=2)
def train(pages: int = TRAIN_PAGES, steps: int = STEPS, seed: int = 0) -> Field:
    """Fit a field on generated labelled pages; equal arguments give equal weights."""
    paths, rows = Paths(), []
    for page, labels in labelled_pages(pages, seed):
        found = leaf_blocks(page, paths)
        if len(found) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        rows.append((features(found, paths), labels))
    names: dict[str, int] = {}
    for blocks, _ in rows:
        for b in blocks:
            for f in b:
                names.setdefault(f, len(names))
    longest = max(len(labels) for _, labels in rows)
    mask, gold = np.zeros((pages, longest), bool), np.zeros((pages, longest), int)
    cell, feature = [], []
    for i, (blocks, labels) in enumerate(rows):
        mask[i, : len(labels)], gold[i, : len(labels)] = True, labels
        for t, b in enumerate(blocks):
            cell += [i * longest + t] * len(b)
            feature += [names[f] for f in b]
    cell, feature = np.array(cell), np.array(feature)
    order = np.argsort(cell, kind="stable")
    cell, feature = cell[order], feature[order]
    full, start = np.unique(cell, return_index=True)
    parts = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    moved, size = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        score = np.zeros((pages * longest, 2))
        score[full] = np.add.reduceat(parts[0][feature], start)
        _, g, g_links, g_first = log_likelihood(score.reshape(pages, longest, 2), mask, gold, parts[1], parts[2])
        flat = g.reshape(-1, 2)[cell]
        grads = [np.stack([np.bincount(feature, flat[:, k], len(names)) for k in (0, 1)], 1), g_links, g_first]
        for k, grad in enumerate(grads):
            grad = grad / pages - DECAY * parts[k]
            moved[k] = 0.9 * moved[k] + 0.1 * grad
            size[k] = 0.999 * size[k] + 0.001 * grad**2
            parts[k] = parts[k] + RATE * (moved[k] / (1 - 0.9**step)) / (np.sqrt(size[k] / (1 - 0.999**step)) + 1e-8)
    return Field(names, *parts)


def main_text(page: str, field: Field, paths: Paths, held: dict) -> str:
    found = leaf_blocks(page, paths)
    if len(paths.rows) < len(held):
        held.clear()
    return "\n".join(b[0] for b, label in zip(found, field.decode(field.scores(found, paths, held)), strict=True) if label == MAIN)


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), field: Field | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` for every row of ``pages``.

    A null or empty page, and one without main blocks, has an empty text.  Repeated rows are
    extracted alike, an empty table gives no rows, null keys pass by; a page of any length,
    well formed or not, is read whole, one at a time, in time that grows with its length.  Of
    equally likely labels a block is no main text.
    """
    # Names and weights of a few hundred features: bounded by the labelled pages.
    sent = pages.sparkSession.sparkContext.broadcast(field or train())

    def make():
        model = sent.value
        paths, held = Paths(frozenset(model.names)), {}

        def run(texts: list[str]) -> dict:
            found = [main_text(p, model, paths, held) if p else "" for p in texts]
            return {"text": found, "n_chars": [len(t) for t in found]}

        return run

    return map_texts(pages.select(*keep, F.col(page).cast("string").alias("_text")), make, {"text": "string", "n_chars": "long"})


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
