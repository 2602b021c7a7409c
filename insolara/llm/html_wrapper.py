"""Main text of web pages by wrappers inferred per host.

A page becomes a tree of its block elements and text runs; written as a token stream, that is a regular
expression without unions. The wrapper of a host starts as its first sample page and is aligned with one
page after the other: elements in both are merged, elements in one become optional, neighbouring or
tandem runs of like elements become repeated groups, and texts that differ become slots. The finished
wrapper is then split into the region that holds the article and the rest, once per host. Every page is
matched against its wrapper, and the texts that fall into the region's slots are its main text.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insolara.llm.common import prepare, stored

Batches = Iterator[pa.RecordBatch]

# Element kinds of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                     "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ITEMS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
         "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
LISTS = frozenset("ul ol menu dl table select".split())

# Elements and names that never hold the article.
WHOLE = frozenset("html body main article".split())
DEEPEST = 150  # levels of nesting that are kept; deeper blocks are blocks of this level
NEVER = frozenset("nav header footer aside form button select dialog menu head fieldset input".split())
NEVER_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments cookie cookies "
                        "consent disqus footer form header login masthead menu nav navbar navigation newsletter notice "
                        "pager pagination popup promo promotion related search share sharing sidebar signup skip social "
                        "sponsor sponsored subscribe tags toolbar widget".split())
REGIONS = frozenset(("article", "main"))
REGION_NAMES = frozenset("article articlebody content entry main maincontent post story".split())

PAGES_PER_HOST = 24
LINKED = 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|[^<]+|<""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Text:
    """A text run; ``value`` is None for a slot. ``seen`` and ``linked`` are characters met here in all samples."""

    value: str | None
    seen: int = 0
    linked: int = 0


@dataclass
class Node:
    """An element with its content; ``many`` marks repetition, ``maybe`` that some pages lack it."""

    key: str
    items: list = field(default_factory=list)
    many: bool = False
    maybe: bool = False
    main: bool = False


@dataclass
class Group:
    """Elements that repeat together."""

    items: list


def parse(source: str) -> Node:
    """The tree of block elements and text runs of a page, mended where tags are missing."""
    root = Node("#page")
    stack, parts, linked, in_link = [root], [], 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                stack[-1].items.append(Text(text, len(text), min(linked, len(text))))
            parts.clear()
        linked = 0

    def close_to(names: frozenset | tuple, stop: frozenset = frozenset()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].key.split(".", 1)[0]
            if tag in names:
                del stack[depth:]
                return
            if tag in stop:
                return

    at, size = 0, len(source)
    beyond: list[str] = []  # open elements below the deepest level, whose blocks belong to that level
    while at < size:
        token = _TOKEN.match(source, at)
        at = token.end()
        tag = token.group(2)
        if tag is None:
            if not token.group().startswith(("<!", "<?")):
                parts.append(token.group())
                linked += len(token.group()) if in_link else 0
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if token.group(1) else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if not token.group(1) and not (tag == "svg" and token.group(3).endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            continue
        flush()
        if token.group(1):
            in_link = 0
            if tag in beyond:
                while beyond.pop() != tag:
                    pass
                continue
            beyond.clear()
            close_to((tag,))
            continue
        if len(stack) > DEEPEST:
            beyond.append(tag)
            in_link = 0
            continue
        if tag in CLOSES_P:
            close_to(("p",), LISTS | {"div", "article", "section", "td", "li"})
        if tag in ITEMS:
            close_to(tuple(ITEMS[tag].split()), LISTS)
        node = Node(_key(tag, token.group(3)))
        stack[-1].items.append(node)
        if not token.group(3).endswith("/") or tag in CLOSES_P:
            stack.append(node)
        in_link = 0
    flush()
    return root


def _key(tag: str, attributes: str) -> str:
    names = {re.sub(r"\d+", "0", n.lower()) for _, *v in _NAMES.findall(attributes) for n in "".join(v).split()}
    return ".".join([tag, *sorted(names)])


def _shape(node: Node) -> frozenset:
    return frozenset(k for i in node.items for k in _keys(i))


def _keys(item) -> list[str]:
    if isinstance(item, Group):
        return [k for i in item.items for k in _keys(i)]
    return ["#text"] if isinstance(item, Text) else [item.key]


def _alike(a, b, neighbours: bool = False) -> bool:
    """Whether two items may be one element of the wrapper; of neighbours more than half must agree."""
    if isinstance(a, Text) or isinstance(b, Text):
        return isinstance(a, Text) and isinstance(b, Text)
    if isinstance(a, Group) or isinstance(b, Group):
        return isinstance(a, Group) and isinstance(b, Group) and [_keys(i) for i in a.items] == [_keys(i) for i in b.items]
    if a.key != b.key:
        return False
    one, two = _shape(a), _shape(b)
    return not (one and two) or "." in a.key or 2 * len(one & two) >= len(one | two) + neighbours


def _merge(a, b):
    if isinstance(a, Text):
        return Text(a.value if a.value == b.value else None, a.seen + b.seen, a.linked + b.linked)
    if isinstance(a, Group):
        return Group([_merge(x, y) for x, y in zip(a.items, b.items)])
    return Node(a.key, align(a.items, b.items), a.many or b.many, a.maybe or b.maybe)


def _optional(item):
    if isinstance(item, Node):
        item.maybe = True
    return item


def align(a: list, b: list) -> list:
    """One sequence for both: the longest common run of like items merged, all others optional, then folded."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    like = [[_alike(x, y) for y in b] for x in a]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if like[i][j] else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if like[i][j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return fold([*out, *map(_optional, a[i:]), *map(_optional, b[j:])])


def fold(items: list) -> list:
    """Like neighbours become one repeated item, tandem runs of two to four items a repeated group."""
    out: list = []
    for item in items:
        if isinstance(item, Node):
            item.items = fold(item.items)
        if out and _alike(out[-1], item, True):
            merged = _merge(out[-1], item)
            if isinstance(merged, Node):
                merged.many = True
            out[-1] = merged
        else:
            out.append(item)
        for width in (2, 3, 4):
            head, tail = out[-2 * width:-width], out[-width:]
            if len(head) == width and not any(isinstance(x, Group) for x in head + tail) and all(map(_alike, head, tail)):
                out[-2 * width:] = [Group([_merge(x, y) for x, y in zip(head, tail)])]
                break
            group, tail = out[-width - 1:-width], out[-width:]
            if group and isinstance(group[0], Group) and len(group[0].items) == width and all(
                    map(_alike, group[0].items, tail)):
                out[-width - 1:] = [Group([_merge(x, y) for x, y in zip(group[0].items, tail)])]
                break
    return out


def never_main(key: str) -> bool:
    """Whether an element never holds the article: by its tag or a word of its names, which say nothing about a whole page or article."""
    tag, *names = key.split(".")
    if tag in WHOLE:
        return False
    words = {w for n in names for w in re.split(r"[^a-z]+", n)}
    return tag in NEVER or bool(words & NEVER_NAMES)


def _texts(item) -> Iterator[Text]:
    if isinstance(item, Text):
        yield item
    else:
        for x in item.items:
            yield from _texts(x)


def _weight(item, varying: bool) -> int:
    """Characters of the article's kind below an item: not linked, not in an element that never holds it."""
    if isinstance(item, Text):
        return 0 if varying and item.value is not None else item.seen - item.linked
    if isinstance(item, Node) and never_main(item.key):
        return 0
    return sum(_weight(x, varying) for x in item.items)


def _nodes(item) -> Iterator[Node]:
    if isinstance(item, Node):
        if never_main(item.key):
            return
        yield item
    if not isinstance(item, Text):
        for x in item.items:
            yield from _nodes(x)


def mark_main(wrapper: Node) -> Node:
    """Marks the region of the article.

    An article or main element, or one named so, if it has text; else the smallest element with most of
    the text that differs between pages (of all text, where only one page is known).
    """
    everything = list(_nodes(wrapper))
    named = [n for n in everything if n.key.split(".")[0] in REGIONS and _weight(n, False)]
    if not named:
        named = [n for n in everything if set(n.key.split(".")[1:]) & REGION_NAMES and _weight(n, False)]
    if named:
        for node in named:
            node.main = True
        return wrapper
    varying = _weight(wrapper, True) > 0
    total, node = _weight(wrapper, varying), wrapper
    while total:
        inner = [x for i in node.items for x in (i.items if isinstance(i, Group) else [i]) if isinstance(x, Node)]
        inner = [x for x in inner if not never_main(x.key) and not x.many and 2 * _weight(x, varying) > total]
        if not inner:
            break
        node = inner[0]
    node.main = True
    return wrapper


def infer(pages: list[str]) -> Node:
    """The wrapper of pages of one host."""
    wrapper = None
    for page in pages:
        tree = parse(page)
        tree.items = fold(tree.items)
        wrapper = tree if wrapper is None else _merge(wrapper, tree)
    return mark_main(wrapper)


def dump(item) -> list:
    if isinstance(item, Text):
        return ["t", item.value, item.seen, item.linked]
    if isinstance(item, Group):
        return ["g", [dump(x) for x in item.items]]
    return ["n", item.key, [dump(x) for x in item.items], item.many, item.maybe, item.main]


def load(data: list):
    if data[0] == "t":
        return Text(*data[1:])
    if data[0] == "g":
        return Group([load(x) for x in data[1]])
    return Node(data[1], [load(x) for x in data[2]], *data[3:])


def _likeness(a, b) -> float:
    if not _alike(a, b):
        return 0.0
    if isinstance(a, Text):
        return 1.0
    one, two = _shape(a), _shape(b)
    return 1.0 + (len(one & two) / len(one | two) if one | two else 1.0)


def _match(items: list, wrapper: list) -> list:
    """The wrapper's item for each item of a page, in order, None where it has none; the match of most likeness."""
    flat, back = [], {}
    for item in wrapper:
        if isinstance(item, Group):
            back[len(flat) + len(item.items) - 1] = len(flat)
            flat.extend(item.items)
        else:
            flat.append(item)
    n, m = len(items), len(flat)
    after = [back.get(j, j if isinstance(x, Text) or x.many else j + 1) for j, x in enumerate(flat)]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    gain = [[_likeness(x, y) for y in flat] for x in items]
    for i in range(n - 1, -1, -1):
        row, below, own = best[i], best[i + 1], gain[i]
        for j in range(m, -1, -1):
            value = max(below[j], row[j + 1] if j < m else 0.0)
            if j < m and own[j]:
                value = max(value, own[j] + below[after[j]])
            row[j] = value
    out, i, j = [], 0, 0
    while i < n:
        if j < m and gain[i][j] and best[i][j] == gain[i][j] + best[i + 1][after[j]]:
            out.append(flat[j])
            i, j = i + 1, after[j]
        elif j < m and best[i][j] == best[i][j + 1]:
            j += 1
        else:
            out.append(None)
            i += 1
    return out


def extract(page: Node, wrapper: Node) -> list[str]:
    """The texts of a page, in order, that lie in the main region of its wrapper."""
    out: list[str] = []

    def walk(node: Node, like: Node | None, inside: bool) -> None:
        for item, known in zip(node.items, _match(node.items, like.items) if like else [None] * len(node.items)):
            if isinstance(item, Text):
                if inside and not (known is not None and known.linked > LINKED * max(1, known.seen)
                                   and item.linked > LINKED * item.seen):
                    out.append(item.value)
            elif not never_main(item.key):
                walk(item, known, inside or (known is not None and known.main))

    walk(page, wrapper, wrapper.main)
    return out


def main_text(source: str, wrapper: Node) -> str:
    page = parse(source)
    found = extract(page, wrapper)
    if not found:  # a page of another make than its host's samples: its own wrapper
        alone = parse(source)
        alone.items = fold(alone.items)
        found = extract(page, mark_main(alone))
    return "\n".join(found)


def wrappers(pages: DataFrame, per_host: int = PAGES_PER_HOST) -> DataFrame:
    """(host, wrapper) per host of ``pages(host, html)``, from at most ``per_host`` of its pages by a hash.

    That bound is the documented sample of the fit. Each task drops all but its first ``per_host`` pages
    of a host before the shuffle, so a host with a third of all pages is no heavy group.
    """
    order = Window.partitionBy("host").orderBy(F.xxhash64("html"), "html")
    sample = pages.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_host).select("host", "html")

    def one(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        made = infer(sorted(found["html"]))
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(dump(made), ensure_ascii=False)]})

    return sample.groupBy("host").applyInPandas(one, "host string, wrapper string")


def main_texts(pages: DataFrame, per_host: int = PAGES_PER_HOST) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages(page_id, url, html)``.

    A row without url, or with one that names no host, is of the host "". NULL and empty html give an
    empty text, as does a page without main text; n_chars counts code points. Repeated rows stay.
    """
    prepare(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1),
                              F.lit("")))
    rows = pages.select(F.col("page_id"), F.col("url"), host.alias("host"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    known = stored(wrappers(rows.select("host", "html"), per_host), "wrappers")

    def run(batches: Batches) -> Batches:
        seen: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch.column(2), batch.column(3)):
                spec = wrapper.as_py()
                if spec not in seen:
                    if len(seen) >= 500:
                        seen.clear()
                    seen[spec] = load(json.loads(spec))
                texts.append(main_text(source.as_py(), seen[spec]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    joined = rows.join(known, "host").select("page_id", "url", "html", "wrapper")
    schema = joined.select("page_id", "url").schema.add("text", "string")
    return joined.mapInArrow(run, schema).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
