"""Main text of web pages by composite text density.

The page becomes a tree (forgiving of missing end tags and cut-off pages). Parts
that are never article text - menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, hidden parts - are left out by
element, role, class and id. Over what remains, every node gets its composite text
density: characters per tag, weighed down by its share of link characters and
link tags. Every node's density sum adds its children's densities (a text of its
own counts as a child). The subtree with the greatest sum is the article; the
threshold is the least density on its path to body, and other subtrees at or
above it count as article too.

Null and empty pages give "". Pages without text outside the parts left out give
"". Every row gives one row; ties between sums go to the outermost, first node.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("nav header footer aside form button select datalist object embed audio video canvas head dialog menu fieldset map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs
    masthead header footer sidebar aside widget cookie cookies consent notice notices notification alert popup modal newsletter subscribe signup login
    share sharing related comment comments commentlist replies disqus respond form search pagination""".split()
)
NEVER = frozenset("has with without no show hide".split())
CLOSES_P = BLOCK - {"option", "optgroup", "col", "colgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "head", "html"}
ITEM = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>\"']|\Z)", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[-_:]+")


def _named(value: str) -> bool:
    for name in value.split():
        parts = [p for p in PARTS.split(CAMEL.sub("-", name).lower()) if p]
        if parts and parts[0] not in NEVER and (parts[0] in WORDS or parts[-1] in WORDS):
            return True
    return False


def _left_out(tag: str, attributes: str) -> bool:
    if tag in LEFT_OUT:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            if _named(value):
                return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden":
            if value.lower() != "until-found":
                return True
        elif name == "aria-hidden":
            if value.strip().lower() == "true":
                return True
        elif "display:none" in (v := value.replace(" ", "").lower()) or "visibility:hidden" in v:
            return True
    return False


class Tree:
    """Nodes in page order; a child's number is greater than its parent's."""

    def __init__(self, page: str):
        self.tag, self.parent = ["#root"], [-1]
        #: (node, block number, text); texts of one block stand together
        self.texts: list[tuple[int, int, str]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, names = [0], ["#root"]
        opened: dict[str, int] = {}
        skipped = 0  # depth of the stack at which a part left out began, or 0
        block = done = 0

        def close(depth: int) -> None:
            nonlocal skipped
            for name in names[depth:]:
                opened[name] -= 1
            del stack[depth:], names[depth:]
            if skipped and depth <= skipped:
                skipped = 0

        def text(end: int) -> None:
            if end > done and not skipped:
                self.texts.append((stack[-1], block, html.unescape(page[done:end])))

        at = 0
        while m := TOKEN.search(page, at):
            text(m.start())
            done = at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if m[1]:
                if tag in BLOCK:
                    block += 1
                if opened.get(tag):
                    for depth in range(len(names) - 1, 0, -1):
                        if names[depth] == tag:
                            close(depth)
                            break
                        if tag not in BLOCK and names[depth] in BLOCK:
                            break
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at) if not m[3].endswith("/") else m
                done = at = end.end() if end else len(page)
                continue
            if tag == "br":
                if not skipped:
                    self.texts.append((stack[-1], block, " "))
                continue
            if tag in BLOCK:
                block += 1
                if tag in CLOSES_P and opened.get("p"):
                    for depth in range(len(names) - 1, 0, -1):
                        if names[depth] == "p":
                            close(depth)
                            break
                        if names[depth] in BLOCK:
                            break
            if tag in VOID:
                continue
            if tag in ITEM and any(opened.get(x) for x in ITEM[tag][0]):
                ends, stops = ITEM[tag]
                for depth in range(len(names) - 1, 0, -1):
                    if names[depth] in stops:
                        break
                    if names[depth] in ends:
                        close(depth)
                        if tag != "tr":
                            break
            if tag in ("html", "body") and opened.get(tag):
                continue
            if tag == "body":  # head may lack its end
                for depth in range(len(names) - 1, 0, -1):
                    if names[depth] == "head":
                        close(depth)
            elif tag not in ("link", "meta", "base") and names[-1] == "head":
                close(len(names) - 1)
            stack.append(len(self.tag))
            names.append(tag)
            opened[tag] = opened.get(tag, 0) + 1
            self.tag.append(tag)
            self.parent.append(stack[-2])
            if not skipped and _left_out(tag, m[3]):
                skipped = len(stack) - 1
        text(len(page))


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    if not chars:
        return 0.0
    tags = max(tags, 1)
    weight = (chars / max(link_chars, 1)) * (tags / max(link_tags, 1))
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_share * chars + math.e)
    return chars / tags * (math.log(max(weight, 1.0)) / math.log(max(base, 1.0001)) if base > 1.0001 else math.log(max(weight, 1.0)))


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Composite text density and density sum of every node."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags, kept = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    own: list[list[int]] = [[] for _ in range(n)]
    for node, _, text in tree.texts:
        if size := len(text.strip()):
            own[node].append(size)
            chars[node] += size
            kept[node] = True
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if tree.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        if kept[i]:
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
            kept[p] = True
    share = link_chars[0] / max(chars[0], 1)
    density = [_density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(n)]
    sums = [0.0] * n
    for i in range(n - 1, -1, -1):
        linked = tree.tag[i] == "a"
        sums[i] += sum(_density(c, 1, c if linked else 0, 1 if linked else 0, share) for c in own[i])
        if i:
            sums[tree.parent[i]] += density[i]
    return density, sums


def _choose(tree: Tree) -> list[bool]:
    """For every node, whether it lies in the article."""
    n = len(tree.tag)
    density, sums = densities(tree)
    best = max(range(n), key=lambda i: (sums[i], -i))
    threshold, i = density[best], best
    while i >= 0:
        threshold = min(threshold, density[i])
        i = tree.parent[i]
    inside = [False] * n
    inside[best] = True
    # the greatest sum below every node at or above the threshold
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if (sums[top[i]], -top[i]) > (sums[top[p]], -top[p]):
            top[p] = top[i]
    open_ = [False] * n
    for i in range(n):
        if density[i] > 0 and density[i] >= threshold and (i == 0 or open_[tree.parent[i]]):
            open_[i] = True
            inside[top[i]] = True
    for i in range(1, n):
        if inside[tree.parent[i]]:
            inside[i] = True
    return inside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    if not any(t.strip() for _, _, t in tree.texts):
        return ""
    inside = _choose(tree)
    out: list[str] = []
    last = None
    for node, block, text in tree.texts:
        if inside[node]:
            if last is not None and block != last:
                out.append(" ")
            out.append(text)
            last = block
    return " ".join("".join(out).split())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text string, n_chars long) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    a, b = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {a}, `{url_col}` {b}, text string, n_chars long")
