"""Main text of web pages by two-pass block rules.

The markup is cut into blocks at block-level tags. Pass 1 classes each block by length, link density
and stop-word density as good, near-good, poor (long, with few stop words), short or bad. Blocks inside containers that
never hold the article (navigation, header, footer, sidebar, notice, advert, form, comments, ...) are bad, and so are
blocks of links. An article or main element is a feature only: inside one a short block is short though it has links, and
outside, where the page has one, good becomes near-good and the others become bad.
Pass 2 gives near-good, poor and short blocks the class of their nearest decided neighbours (good or bad): of two
unlike ones, that with the same parent element, else the closer one, else the one after for a heading, the good one
for near-good blocks and the bad one for the others. On a page without any good block the near-good ones are good,
without those the poor ones, without those the short ones inside an article.

Tags are found in linear time: once a quoted attribute is found to have no end, later tags end at their first ">".

Defined cases: null html is empty and gives an empty text; unclosed tags end with their parent or
page; pages without any good block give an empty text; repeated rows each give a row; pages of any length are
read whole; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

MAX_LINK_DENSITY = 0.5
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPWORDS_LOW, STOPWORDS_HIGH = 0.12, 0.25
#: Common function words of the languages handled.
STOPWORDS = frozenset(
    "the of and to in a is that it for on was with as be by this are or from at an which not but have has "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem "
    "le la les de des un une et est en que qui dans pour pas sur au il elle ce avec "
    "el los las del y es por con una para se no su al lo como más".split()
)
_START = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?/]")
_QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN = re.compile(r"([^>]*)>")
_WORD = re.compile(r"[^\W\d_]+")
#: Blocks whose text belongs to the element around them.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary address".split())
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "math", "object", "canvas", "select")}
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_TAGS = frozenset("aside button dialog footer form head header menu nav".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|disclaimer|footer|form|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|overlay|pager|pagination|popup|promo\w*|recommended|related|replies|reply|respond|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_SPACE = re.compile(r"\s+")


def _bad_element(name: str, attributes: str) -> bool:
    if name in _BAD_TAGS:
        return True
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _BAD_NAME.search(value):
            return True
        if key == "role" and value.strip().lower() in _BAD_ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


class Block:
    __slots__ = ("text", "links", "bad", "inside", "heading", "parent")

    def __init__(self, text: str, links: int, bad: bool, inside: bool, heading: bool, parent: int = 0) -> None:
        self.text, self.links, self.bad, self.inside, self.heading, self.parent = text, links, bad, inside, heading, parent


def markup(page: str):
    """The tags of a page in order: (start, end, "/" or "", lower-case name or None for comments and the like, attributes)."""
    at, n, last, quoted = 0, len(page), page.rfind(">"), True
    while True:
        m = _START.search(page, at)
        if m is None or (m[0] != "<!--" and m.end() > last):
            return
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            yield m.start(), at, "", None, ""
            continue
        found = _QUOTED.match(page, m.end()) if quoted and m[2] else None
        if found is None:
            quoted = quoted and not m[2]
            found = _PLAIN.match(page, m.end())
        at = found.end()
        new = yield m.start(), at, m[1] or "", m[2] and m[2].lower(), found[1] if m[2] else ""
        at = new or at


def blocks(page: str) -> list[Block]:
    """All text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, bad, article, container
    open_: dict[str, int] = {}
    parents = [0]
    bad = inside = link = made = 0
    heading = False
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(p for p, _ in parts))).strip()
            if text:
                links = sum(len(p) for p, linked in parts if linked)
                out.append(Block(text, min(links, len(text)), bad > 0, inside > 0, heading, parents[-1]))
            parts.clear()

    def close(k: int) -> None:
        nonlocal bad, inside
        for name, b, a, container in reversed(stack[k:]):
            bad -= b
            inside -= a
            open_[name] -= 1
            if container:
                parents.pop()
        del stack[k:]

    def ended(name: str, through: tuple[str, ...] | None = None) -> None:
        """Close the innermost open element of this name, unless others than ``through`` stand between."""
        if open_.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    return
                if through is not None and stack[k][0] not in through:
                    return

    at, tags = 0, markup(page)
    tag = next(tags, None)
    while tag is not None:
        start, end, slash, name, attributes = tag
        if start > at:
            parts.append((page[at:start], link > 0))
        at = end
        if name is None:
            pass
        elif slash:
            if name == "a":
                link = 0
            elif name in _BLOCKS:
                flush()
                heading = False
            ended(name)
        elif name in _RAW:
            if not attributes.endswith("/"):
                close_tag = _RAW[name].search(page, at)
                at = close_tag.end() if close_tag else len(page)
            if name not in ("title", "script", "style"):
                parts.append((" ", False))
        else:
            if name == "br":
                parts.append((" ", link > 0))
            elif name == "a":
                link = 1
            elif name in _BLOCKS:
                flush()
                heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
                if name in ("p", "li", "dt", "dd", "tr", "td", "th"):
                    # a new one ends an open one of its kind, if no other container stands between
                    ended(name, ("b", "i", "em", "strong", "span", "a", "u", "font", "p"))
            if name not in _VOID and not attributes.endswith("/"):
                b, a = _bad_element(name, attributes), name in ("article", "main")
                if b and bad == 0 and name not in _BLOCKS:
                    flush()
                container = name in _BLOCKS and name not in _LEAVES
                stack.append((name, b, a, container))
                open_[name] = open_.get(name, 0) + 1
                if container:
                    made += 1
                    parents.append(made)
                bad += b
                inside += a
        try:
            tag = tags.send(at)
        except StopIteration:
            tag = None
    if at < len(page):
        parts.append((page[at:], link > 0))
    flush()
    return out


def first_pass(b: Block, marked: bool) -> str:
    """good, near, poor, short or bad, by the block alone; marked: whether the page has an article element."""
    n = len(b.text)
    if b.bad or b.links / n > MAX_LINK_DENSITY:
        return "bad"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOPWORDS for w in words) / max(1, len(words))
    if n < LENGTH_LOW:
        label = "bad" if b.links and not b.inside else "short"
    elif stops >= STOPWORDS_HIGH and n > LENGTH_HIGH:
        label = "good"
    else:
        label = "near" if stops >= STOPWORDS_LOW else "poor"
    return ("near" if label == "good" else "bad") if marked and not b.inside else label


def classify(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    marked = any(b.inside for b in found)
    labels = [first_pass(b, marked) for b in found]
    for weaker in ("near", "poor", "short"):  # with no sure block
        if "good" not in labels:
            labels = ["good" if x == weaker and (weaker != "short" or b.inside) else x for x, b in zip(labels, found)]
    decided = [k for k, x in enumerate(labels) if x in ("good", "bad")]
    out, after = [], 0
    for k, (x, b) in enumerate(zip(labels, found)):
        if x in ("good", "bad"):
            out.append(x == "good")
            after += 1
            continue
        sides = [decided[j] for j in (after - 1, after) if 0 <= j < len(decided)]
        choices = {labels[j] for j in sides}
        if len(choices) < 2:
            out.append(choices == {"good"})
            continue
        kin = [j for j in sides if found[j].parent == b.parent]
        gaps = [abs(j - k) for j in sides]
        if len(kin) == 1:
            pick = labels[kin[0]]
        elif gaps[0] != gaps[1]:
            pick = labels[sides[gaps[1] < gaps[0]]]
        else:
            pick = labels[sides[1]] if b.heading else "good" if x == "near" else "bad"
        out.append(pick == "good")
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, classify(found)) if keep)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of each row, with text and n_chars."""
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            texts = [main_text(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html)).mapInArrow(run, schema)


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_main_text": op4_html_main_text}
ORACLE_SQL: dict[str, str] = {}
