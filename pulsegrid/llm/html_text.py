"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags.  Every word scores by the open
elements around it (their names, and the words of their classes, ids and
roles), every tag costs something; the best contiguous run, found in one scan,
is the content region.  Words of it that stand in unlikely elements (an advert
in the middle) are left out.

The weights are log odds counted on labelled pages: those with exactly one
article element, whose words outside navigation and the like are content.
Names that such pages rarely show start from a fixed prior.

Null html is empty.  Pages without words give an empty text.  Character
references are decoded, white space inside a block becomes one blank, blocks
are joined by a line feed in page order.  Repeated rows are treated alike.
Of two equally good runs the first is taken.  Pages of any length, broken ones
too, are read in one pass.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pyspark.sql.types import StructType

LABELLED_PAGES = 5_000  # about so many labelled pages are learnt from, chosen by hash
FEATURES = 10_000  # the commonest names among them have weights
TAG_COST = 0.004
BIAS = 0.1

# fixed values: HTML element names by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe object".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
PLAIN = frozenset("html body div span".split())  # say nothing about content
CLOSED_BY = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
WALLS = frozenset("article aside body div footer form header main nav section table ul ol dl".split())
# fixed values: names that mark page furniture or content before anything is learnt
FURNITURE = frozenset(
    "head title nav menu header footer aside sidebar form button select textarea label dialog ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert "
    "popup modal newsletter subscribe share social related recommended breadcrumb breadcrumbs pagination comment comments reply replies disqus widget copyright navigation complementary contentinfo search hidden".split()
)
CONTENT = frozenset("article main content post entry story articlebody h1 h2 h3 p blockquote".split())
PRIOR = 200.0

# a quote opens a value only right after "="; an open value runs to the end of the page
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(>|\Z)")
BLIND = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(>)")
ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in SKIPPED}
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def tokens(page: str):
    """Texts as (text, None, None) and tags as (name, attributes, closes), in one pass.

    A tag ends at its first ``>`` outside attribute values.  A value that never
    closes makes quotes mean nothing from there on, so no part of a page is
    read twice more than once.  What no ``>`` follows is text, but for an open
    comment, which ends with the page.
    """
    at, n, last, pattern = 0, len(page), page.rfind(">"), TAG
    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            comment = page.find("<!--", at)
            yield page[at : n if comment < 0 else comment], None, None
            return
        if begin > at:
            yield page[at:begin], None, None
            at = begin
        if page.startswith("<!--", at) or page[at : at + 9].upper() == "<![CDATA[":
            close = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(close, at + 4)
            at = n if end < 0 else end + 3
            continue
        m = pattern.match(page, at)
        if m and not m[4]:
            pattern = BLIND
            m = pattern.match(page, at)
        if m:
            at = m.end()
            name = m[2].lower()
            if name in SKIPPED and not m[1] and not m[3].endswith("/"):
                end = ENDS[name].search(page, at)
                at = end.end() if end else n
            else:
                yield name, m[3], bool(m[1])
        elif page[at + 1] in "!?/":
            at = page.find(">", at) + 1
        else:
            yield "<", None, None
            at += 1


def events(page: str):
    """Tags as (name, None, opens), texts as (text, names of the open elements, None), in page order."""
    stack: list[tuple[str, frozenset]] = []
    around: frozenset = frozenset()
    for what, attributes, closing in tokens(page):
        if attributes is None:
            yield what, around, None
            continue
        name = what
        if closing:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            closes = CLOSED_BY.get(name)
            if closes:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
                    if stack[k][0] in WALLS:
                        break
            if name not in VOID and not attributes.endswith("/"):
                names = {name} - PLAIN
                if "=" in attributes:
                    for a in NAMES.finditer(attributes):
                        names.update(WORD.findall((a[1] or a[2] or a[3] or "").lower()))
                stack.append((name, (stack[-1][1] if stack else frozenset()) | names))
        around = stack[-1][1] if stack else frozenset()
        yield name, None, not closing


def best_run(scores) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, in one scan; the first of equal ones, empty if none is above 0."""
    total = low = top = 0.0
    start, run = 0, (0, 0)
    for k, score in enumerate(scores):
        total += score
        if total - low > top:
            top, run = total - low, (start, k + 1)
        if total < low:
            low, start = total, k + 1
    return run


def labelled_counts(page: str) -> dict[str, list[int]]:
    """Words inside and outside the content, by name of the elements around; nothing unless the page is labelled."""
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return {}
    counts: dict[str, list[int]] = {}
    furniture = FURNITURE - {"header", "label"}
    for text, around, _ in events(page):
        if around is not None:
            n = len(text.split())
            side = 0 if "article" in around and not around & furniture else 1
            for name in around if n else ():
                counts.setdefault(name, [0, 0])[side] += n
    return counts


def weights(pages: DataFrame, labelled_pages: int = LABELLED_PAGES) -> dict[str, float]:
    """Log odds of content by name, from labelled pages."""
    labelled = pages.filter(F.lower("html").contains("<article"))
    n = labelled.count()
    share = int(min(1.0, labelled_pages / max(1, n)) * (1 << 30)) + 1
    sample = labelled.filter(F.pmod(F.xxhash64("url", "html"), F.lit(1 << 30)) < share).select("html")

    def count(batches):
        import pyarrow as pa

        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for name, (a, b) in labelled_counts(page or "").items():
                    pair = total.setdefault(name, [0, 0])
                    pair[0] += a
                    pair[1] += b
        yield pa.RecordBatch.from_pydict({
            "name": pa.array(list(total), pa.string()), "inside": pa.array([v[0] for v in total.values()], pa.int64()), "outside": pa.array([v[1] for v in total.values()], pa.int64()),
        })

    rows = sample.mapInArrow(released(count), "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    learnt = {r["name"]: (r["inside"], r["outside"]) for r in rows.orderBy(F.desc(F.col("inside") + F.col("outside")), "name").limit(FEATURES).collect()}
    sides = [max(1, sum(v[k] for v in learnt.values())) for k in (0, 1)]
    # both sides count alike, so that long articles do not make every name likely
    rate = sides[0] / sides[1]
    out = {}
    for name in set(learnt) | FURNITURE | CONTENT:
        inside, outside = learnt.get(name, (0, 0))
        good = inside + PRIOR * (name in CONTENT) + 1
        bad = outside * max(1.0, rate) + PRIOR * (name in FURNITURE) + 1
        out[name] = max(-6.0, min(3.0, math.log(good / bad)))
    return out


class Extractor:
    def __init__(self, weight: dict[str, float]):
        self.weight = weight
        self.known: dict[frozenset, float] = {}

    def chance(self, around: frozenset) -> tuple[float, float]:
        """How likely words inside these elements are content, and the score of each."""
        found = self.known.get(around)
        if found is None:
            # names that speak for content go together, so the best counts; each one against it counts
            each = [self.weight.get(n, 0.0) for n in around]
            most = max([0.0, *each])
            p = 1 / (1 + math.exp(-BIAS - most - sum(w for w in each if w < 0)))
            # an advert in the middle of an article is left out of the text, it doesn't end the region
            found = self.known[around] = (p, 0.0 if p < 0.5 and most > 0 else p - 0.5)
            if len(self.known) > 100_000:
                self.known = {around: found}
        return found

    def score(self, what: str, around: frozenset | None) -> float:
        """Of a tag (``around`` is None) or a text."""
        if around is None:
            return -TAG_COST * (1.5 - 0.5 / (1 + math.exp(-self.weight.get(what, 0.0))))
        return 0.0 if what.isspace() else len(what.split()) * self.chance(around)[1]

    def text(self, page: str) -> str:
        sequence = [(what, around) for what, around, _ in events(page)]
        first, last = best_run(self.score(what, around) for what, around in sequence)
        blocks, now = [], []
        for what, around in sequence[first:last]:
            if around is None:
                if what in BLOCK:
                    blocks.append("".join(now))
                    now = []
            elif self.chance(around)[0] >= 0.5:
                now.append(what)
        blocks.append("".join(now))
        clean = (" ".join(entities.unescape(b).split()) for b in blocks)
        return "\n".join(b for b in clean if b)


def main_text(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """``pages`` with ``__text``, the main text of ``html``."""
    keep = pages.columns
    shared = pages.sparkSession.sparkContext.broadcast(weight)
    schema = StructType(pages.schema.fields + StructType.fromDDL("__text string").fields)

    def extract(batches):
        import pyarrow as pa

        extractor = Extractor(shared.value)
        for batch in batches:
            found = [extractor.text(page or "") for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*keep, "__text"])

    return pages.mapInArrow(released(extract), schema)
