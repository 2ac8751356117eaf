"""Main text of web pages by a maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words of the kinds that articles are
made of score positive, tags and words of boilerplate kinds negative; the
weights are log-odds counted on labelled pages, which are those that mark
their article themselves. One linear scan finds the contiguous run with the
largest sum; its text blocks, less boilerplate inside it, are the main text.
The mark of the article is never read when a page is scanned.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.common import chunks, keyed

# Elements and names with a known role.
RAW = ["script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "canvas"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCKS = ["address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
          "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"]
SPACED = ["br", "td", "th", "img"]
CLOSED_BY_BLOCK = ["p"]
BOILERPLATE = ["nav", "footer", "aside", "form", "menu", "head", "button", "dialog"]
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|header|login|masthead|menu|modal|nav\w*|newsletter|"
    r"notices?|pagination|popup|promo\w*|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|teaser|toolbar|widget)(?:$|[\s_-])"
    r"|(?:^|[\s_-])related(?:$|\s|[_-](?:articles?|box|content|items?|links?|news|pages?|posts?|reading|stories|topics?)(?:$|[\s_-]))", re.I)
#: Raw elements that may be closed in their own tag, and those that end at the next block when their end tag is missing.
SELF_CLOSED = ["svg", "canvas", "object", "iframe"]
OPEN_ENDED = ["script", "style"]
#: Elements whose further blocks belong to a run that ends inside them.
CONTAINERS = ["article", "main", "section", "div", "td", "blockquote"]
ARTICLE = ["article", "main"]
# Weights where no labelled page tells them.
WORD_WEIGHT, LINK_WEIGHT, BOILERPLATE_WEIGHT, TAG_WEIGHT = 1.0, -1.0, -1.0, -1.0
# Limits of learned weights, and words in a row of boilerplate that count, so that a long advert does not part an article.
WORD_LIMIT, TAG_LIMIT, BOILERPLATE_WORDS = 4.0, 1.0, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?P<rawattr>(?=[\s/>])[^>]*+)>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attr>(?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>", re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(BLOCKS)})(?=[\s/>])", re.I)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_GAP = re.compile(r"\s+")

Item = tuple[str, int, int, bool, int]


def raw_end(page: str, name: str, at: int, unclosed: dict[str, int]) -> int:
    """Where the content of a raw element that starts at ``at`` ends: behind its end tag, or before the next block if it has none.

    Scripts and styles without an end tag take the rest of the page. From
    ``unclosed[name]`` on, the page is known to have no such end tag.
    """
    if at < unclosed.get(name, len(page) + 1):
        found = _RAW_END[name].search(page, at)
        if found:
            return found.end()
        unclosed[name] = at
    if name in OPEN_ENDED:
        return len(page)
    following = _NEXT_BLOCK.search(page, at)
    return following.start() if following else len(page)


def items(page: str) -> tuple[list[Item], list[str]]:
    """Words and tags of a page in order, and its text blocks.

    An item is a kind (``tag name`` or a word kind), its block (-1 for a tag),
    its count, whether it stands in a marked article, and the number of the
    container element around it (0: none).
    """
    out: list[Item] = []
    blocks: list[list[str]] = [[]]
    stack: list[tuple[str, bool, str, int]] = []
    unclosed: dict[str, int] = {}
    link = marked = containers = 0
    at = 0

    def kind() -> str:
        name, boiler, label, _ = stack[-1] if stack else ("", False, "", 0)
        return f"word {'boilerplate' if boiler else name}{'.' + label if label else ''}{' link' if link else ''}"

    def text(part: str) -> None:
        plain = entities.unescape(part)
        blocks[-1].append(plain)
        n = len(plain.split())
        if n:
            out.append((kind(), len(blocks) - 1, n, marked > 0, stack[-1][3] if stack else 0))

    while found := _TOKEN.search(page, at):
        if found.start() > at:
            text(page[at:found.start()])
        at = found.end()
        name = (found["raw"] or found["name"] or "").lower()
        if not name:
            continue
        out.append((f"tag {name}", -1, 1, marked > 0, stack[-1][3] if stack else 0))
        if found["raw"]:
            if not (name in SELF_CLOSED and found["rawattr"].endswith("/")):
                at = raw_end(page, name, at, unclosed)
            continue
        if name in SPACED:
            blocks[-1].append(" ")
        if name == "a":
            link = 0 if found["close"] else 1
        if name not in BLOCKS:
            continue
        if blocks[-1]:
            blocks.append([])
        if found["close"]:
            if any(s[0] == name for s in stack):
                while True:
                    top = stack.pop()[0]
                    marked -= top in ARTICLE
                    if top == name:
                        break
            continue
        if name in VOID or found["attr"].endswith("/"):
            continue
        while stack and stack[-1][0] in CLOSED_BY_BLOCK:
            stack.pop()
        if name == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        attr = found["attr"]
        label = " ".join(next(filter(None, m.groups()[1:]), "") for m in _NAMED.finditer(attr)) if "=" in attr else ""
        # The header of a page stands in its body, that of an article in some element.
        of_page = name == "header" and all(s[0] in ("html", "body") for s in stack)
        boiler = bool(stack and stack[-1][1]) or name in BOILERPLATE or of_page \
            or (name not in (*ARTICLE, "body", "html") and bool(BOILERPLATE_NAMES.search(label))) or bool(_HIDDEN.search(attr))
        containers += name in CONTAINERS
        stack.append((name, boiler, label.split()[0].lower() if label and name not in ARTICLE else "", containers if name in CONTAINERS else stack[-1][3] if stack else 0))
        marked += name in ARTICLE
        link = 0
    if at < len(page):
        text(page[at:])
    return out, [_GAP.sub(" ", "".join(b)).strip() for b in blocks]


def default_weight(kind: str) -> float:
    if kind.startswith("tag "):
        return TAG_WEIGHT
    if kind.startswith("word boilerplate"):
        return BOILERPLATE_WEIGHT
    return LINK_WEIGHT if kind.endswith(" link") else WORD_WEIGHT


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from counts (inside, outside an article) by kind: log-odds, negative for tags and boilerplate words."""
    inside = sum(i for i, _ in counts.values())
    outside = sum(o for _, o in counts.values())
    out = {}
    for kind, (i, o) in counts.items():
        odds = math.log((i + 1) / (inside + len(counts))) - math.log((o + 1) / (outside + len(counts)))
        odds = min(max(odds, -WORD_LIMIT), WORD_LIMIT)
        if kind.startswith("tag "):
            odds = min(max(odds, -TAG_LIMIT), -0.1)
        elif kind.startswith("word boilerplate"):
            odds = min(odds, BOILERPLATE_WEIGHT)
        out[kind] = odds
    for name in ARTICLE:
        out[f"tag {name}"] = 0.0
    return out


def scored(sequence: list[Item], weights: dict[str, float]) -> list[tuple[float, float]]:
    """Weight of a unit, and the score of the whole, for each item of a page."""
    out = []
    for kind, _, n, *_ in sequence:
        weight = weights.get(kind)
        weight = default_weight(kind) if weight is None else weight
        out.append((weight, weight * (min(n, BOILERPLATE_WORDS) if kind.startswith("word boilerplate") else n)))
    return out


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the run with the largest sum, whole but for boilerplate, joined by blank lines; empty if no run has a positive sum."""
    if not page:
        return ""
    sequence, blocks = items(page)
    values = scored(sequence, weights)
    best = total = 0.0
    start = first = last = 0
    for i, (_, value) in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, first, last = total, start, i + 1
    return "\n\n".join(blocks[b] for b in run_blocks(sequence, first, last) if blocks[b])


def run_blocks(sequence: list[Item], first: int, last: int) -> list[int]:
    """Text blocks of a run, in order, but for boilerplate.

    Short blocks after the run that stand in the container of its last one, and
    before any boilerplate, belong to it: they cost more in tags than their
    words bring.
    """
    kept: dict[int, None] = {}
    container = 0
    for at, (kind, block, _, _, around) in enumerate(sequence[first:]):
        if block < 0:
            continue
        plain = not kind.startswith("word boilerplate")
        if first + at < last:
            if plain:
                kept[block] = None
                container = around
        elif plain and around == container and container:
            kept[block] = None
        else:
            break
    return list(kept)


def learn_weights(pages: DataFrame, html_col: str = "html", sample_rows: int = 4000) -> dict[str, float]:
    """Weights by kind from about ``sample_rows`` pages that mark their article, drawn by a hash of the page.

    Without such pages the table is empty and fixed weights hold.
    """
    marked = keyed(pages, html_col).where(F.lower(html_col).rlike(r"<(article|main)[\s>]"))
    n = marked.count()
    if not n:
        return {}
    drawn = marked.where(F.pmod(F.xxhash64(html_col), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, sample_rows / n))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, html_col):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for page in batch.column(0).to_pylist():
                for kind, _, n, inside, _ in items(page)[0]:
                    seen[inside][kind] += n
            kinds = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([seen[1][k] for k in kinds], pa.int64()),
                                              pa.array([seen[0][k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])

    # Kinds seen once or twice tell nothing; the others are few, as class names of a sample are.
    sums = drawn.mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    return weigh({r.kind: (r.i, r.o) for r in sums.where(F.col("i") + F.col("o") > 2).collect()})


def extract_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url and main ``text`` of every page.

    A null or empty page, and one without a run of positive sum, gives an empty
    text. Of equal runs the first is taken. Repeated rows and null ids or urls
    give a row each; other columns are ignored; an empty table gives no rows.
    """
    source = keyed(pages, id_col, url_col, html_col)
    schema = T.StructType([source.schema[id_col], source.schema[url_col], T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, html_col):
            texts = pa.array([main_text(p, weights) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=schema.names)

    return source.mapInArrow(run, schema)
