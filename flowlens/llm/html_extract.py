"""HTML extraction: the best contiguous region by a maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, or a tag with its name and attributes; the last form is cut off by the page's end.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp"}
#: Elements that do not part words.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold a part of the page.
PARTS = set("html head body div section article main nav header footer aside form ul ol dl table figure dialog fieldset menu select button td blockquote".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that never belong to the main text, and those that speak for it.
NEVER = RAW | set("head nav footer aside form dialog menu select button fieldset".split())
BAD_WORDS = re.compile(
    r"^(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|menus?|nav\w*|sidebars?|footers?|masthead"
    r"|breadcrumbs?|comments?|commentlist|disqus|repl(?:y|ies)|respond|related|recommend\w*|shar(?:e|ing)|social|subscri\w*|newsletters?"
    r"|pop-?ups?|modals?|widgets?|log-?in|sign-?up|search|pag(?:er|ination)|toolbars?|copyright|legal|banner|contentinfo|complementary|navigation)$"
)
WEAK_WORDS = re.compile(r"^(?:header|head|top|bottom|meta|tags?|links?)$")
GOOD_WORDS = re.compile(r"^(?:article\w*|main|content|post|entry|story|body|text|page)$")
#: Scores before any page is seen: of a word by where it stands, and of a tag.
WORD_PRIOR = {"good": 2.0, "open": 0.7, "bad": -3.0}
TAG_PRIOR = {"good": -0.05, "open": -0.4, "bad": -1.0}
#: Score of a bad part inside a good one, whatever it holds: it is left out of the text anyway.
BAD_INSIDE = -0.05


@dataclass
class Weights:
    """Scores of words by the name of the part that they stand in, and of tags by name and kind of part."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)


@dataclass
class Unit:
    """Text between two tags, or a tag (``text`` None)."""

    text: str | None
    name: str
    kind: str
    where: str
    inside: bool
    #: Whether it is the first tag of a bad part in a good one, and whether it lies in such a part.
    opens: bool = False
    within: bool = False


def _part(name: str, attributes: str, kind: str, article: bool) -> tuple[str, str]:
    """The name of a part for its weights, and whether it is good, open or bad for the main text."""
    words = [w for m in NAMED.finditer(attributes) for w in re.split(r"[\s_\"'-]+", m[1].lower()) if w]
    label = name + ("." + "-".join(words[:3]) if words else "")
    if kind == "bad" or name in NEVER or name == "header" and not article or any(BAD_WORDS.match(w) for w in words):
        return label, "bad"
    if name in ("article", "main") or any(GOOD_WORDS.match(w) for w in words):
        return label, "good"
    if any(WEAK_WORDS.match(w) for w in words) and not article:
        return label, "bad"
    return label, kind


def units(page: str) -> list[Unit]:
    """The texts and tags of a page in order, each with the part of the page that it stands in."""
    out: list[Unit] = []
    # element, label, kind, inside an article, in a bad part of a good one
    stack: list[tuple[str, str, str, bool, bool]] = [("", "", "open", False, False)]
    at, n = 0, len(page)

    def add(text: str) -> None:
        _, label, kind, article, within = stack[-1]
        if text and not text.isspace():
            out.append(Unit(text, "", kind, label, article, False, within))
        elif text:
            out.append(Unit(" ", "", kind, label, article, False, within))

    while at < n:
        found = MARKUP.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        out.append(Unit(None, name, stack[-1][2], stack[-1][1], stack[-1][3], False, stack[-1][4]))
        good, within = stack[-1][2] == "good", stack[-1][4]
        if closing:
            if name in PARTS and any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            continue
        if name in RAW:
            if attributes.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            out[-1].opens = good
            if stop > at:
                out.append(Unit(page[at:stop], "", "bad", name, False, False, good or within))
            at = stop
        elif name in PARTS and not (attributes.endswith("/") and name not in ("div",)):
            label, kind = _part(name, attributes, stack[-1][2], stack[-1][3])
            out[-1].opens = good and kind == "bad"
            article = (stack[-1][3] or name in ("article", "main")) and kind != "bad"
            stack.append((name, label, kind, article, within or out[-1].opens))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The stretch of largest sum, first and shortest among equals, as [begin, end); (0, 0) if none is positive."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def _score(unit: Unit, weights: Weights) -> float:
    if unit.opens:
        return BAD_INSIDE
    if unit.within:
        return 0.0
    if unit.text is None:
        return weights.tags.get(f"{unit.kind} {unit.name}", TAG_PRIOR[unit.kind])
    weight = weights.words.get(unit.where, WORD_PRIOR[unit.kind])
    return weight * len(unit.text.split())


def main_text(page: str, weights: Weights) -> str:
    """The text of the best region, without the parts in it that never belong to the main text."""
    if not page:
        return ""
    parts = units(page)
    begin, end = best_region([_score(u, weights) for u in parts])
    out: list[str] = []
    for unit in parts[begin:end]:
        if unit.text is None:
            if unit.name not in INLINE:
                out.append(" ")
        elif unit.kind != "bad":
            out.append(html.unescape(unit.text))
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages that mark their article: how many words and tags by place stand inside it and outside."""
    for batch in batches:
        seen: Counter = Counter()
        for page in batch.column("html").to_pylist():
            parts = units(page or "")
            if sum(u.text is None and u.name in ("article", "main") for u in parts) != 2:
                continue
            for u in parts:
                key = ("word", u.where) if u.text is not None else ("tag", f"{u.kind} {u.name}")
                seen[(*key, u.inside)] += len(u.text.split()) if u.text is not None else 1
        rows = [(*k, v) for k, v in seen.items()]
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["what", "name", "inside", "n"])


def fit_weights(pages: DataFrame, sample: int = 2000, names: int = 2000) -> Weights:
    """Learn weights from pages that mark their article themselves.

    The sample is bounded: the ``sample`` pages of smallest hash of their id; at most ``names``
    of the most frequent places and tags get a weight of their own, others keep the prior.
    """
    chosen = pages.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    seen = chosen.select("html").repartition(8).mapInArrow(_observe, "what string, name string, inside boolean, n long")
    counts = seen.groupBy("what", "name").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inner"),
        F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outer"),
    )
    weights = Weights()
    for row in counts.orderBy(F.desc(F.col("inner") + F.col("outer")), "what", "name").limit(names).collect():
        odds = math.log((row.inner + 1) / (row.outer + 1))
        if row.what == "word":  # words score for their place, tags always against it
            weights.words[row.name] = max(-4.0, min(4.0, odds))
        else:
            weights.tags[row.name] = -0.02 if odds > 0 else max(-2.0, odds / 2) - 0.02
    return weights


def _extract(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [main_text(page.as_py() or "", weights) for page in part.column("html")]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and its number of code points for every whole page.

    Words score positive and tags negative, by weights for where they stand; one linear scan
    finds the contiguous region of largest sum. Menus, forms, adverts, comments and the like
    inside the region are left out; inside an article or content part they cost the same whatever
    their length. Character references are decoded, white space becomes one
    blank, blocks are joined by one blank. A page that is cut off counts as it stands.

    A null or empty page, or one without a positive region, gives an empty text. Repeated rows
    are extracted each; an empty table gives an empty result; other columns are not looked at.
    """
    kinds = "page_id long, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_extract(weights), kinds)
