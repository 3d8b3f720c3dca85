"""HTML extraction by minimum-cut labelling.

A page becomes a sequence of text blocks, cut at block-level tags. A linear classifier over the
block's innermost marked container, its tag, length and link share gives its log-odds of being
content; the positive part is the capacity from the source, the negative part that to the sink.
Neighbours in page order and blocks of one container are joined by smoothness edges whose capacity
shrinks with their distance in the element tree. The minimum cut separates content (source side)
from boilerplate. Blocks of one parent that follow each other and lean the same way are one node, their costs added.

Null and empty pages give empty text, as do pages without content. Repeated rows are extracted
each; extra columns are ignored. Broken markup never fails: unclosed elements end with their parent,
stray end tags are passed over, a lone ``<`` is text. The raw text of script, style and the like is left out up to
the end tag or, as in browsers, the page's end. svg, math, object and canvas are inline elements like others; a button or
select is boilerplate, but one without an end tag of its own loses its start tag only. ``/>`` closes these, and all inside svg and math. Work is linear in the page but for the flow,
whose graph has a node for each run of blocks.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
_RAW = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I) for tag in RAW}
FOREIGN = {"svg", "math"}
CONTROL = re.compile(r"<(/?)(button|select)(?![^\s/>])", re.I)
CONTROLS, CLOSABLE = {"button", "select"}, {"svg", "math", "object", "canvas", "button", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input embed object canvas"
    " math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose semantics annotation"
    " svg g path circle rect line polyline polygon ellipse text tspan textpath defs use symbol desc lineargradient radialgradient stop clippath mask pattern marker image filter".split()
)
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
AWAY_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "button", "select"}
HOME_TAGS = {"article", "main"}
AWAY_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget related recommended footer header masthead toolbar share sharing social comment comments discussion disqus"
    " reply replies respond form search login pagination pager tags copyright legal disclaimer skip".split()
)
HOME_WORDS = set("article content post entry story main body".split())
#: words of class names that say where a box is or how it looks, not what it holds
LAYOUT_WORDS = set(
    "area bar block bottom box btn button card cell col column container corner css default desktop first fixed full global group hidden hide icon inline inner item items js l large last layout left link links list"
    " lower m mobile module outer page panel posts primary region right row s secondary section section1 site slot small sticky text thread title top ui unit upper visible wide wrap wrapper zone web id x xl".split()
)
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Weights of the block classifier, in log-odds.
HOME, AWAY, NOWHERE, HINT, PROSE, HEADING, LENGTH, UNMARKED_LENGTH, LINKS = 4.0, -6.0, -1.5, -2.0, 0.7, 0.4, 0.35, 0.7, -3.0
#: marks of a content container in which, and of a place without container where, a name hints at boilerplate
HINTED, DOUBTED = 3, 4
HOMES = (1, HINTED)
NEXT, KIN = 0.8, 0.5  # smoothness of neighbours and of blocks of one container


def _named(name: str) -> int:
    """What a class name or id says: -1 boilerplate, 1 content, 0 neither, 2 perhaps boilerplate.

    A name tells of boilerplate if all its words do or are of layout; among others ("side-effects") the word is a hint only.
    """
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    away = [w for w in words if w in AWAY_WORDS]
    if away:
        return -1 if all(w in AWAY_WORDS or w in HOME_WORDS or w in LAYOUT_WORDS for w in words) else 2
    return 1 if words and any(w in HOME_WORDS for w in words) else 0


def _mark(tag: str, attrs: str, within_home: bool) -> int:
    """1 if the element holds content, -1 if it holds something else, 2 if it perhaps does, -2 if it isn't shown, 0 if it doesn't tell."""
    said: set[int] = set()
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id"):
                names = [x for x in value.split() if not (within_home and "header" in x.lower())]  # an article's header holds its title
                said.update(map(_named, names))
            elif name == "role" and value.lower() in AWAY_ROLES:
                return -1
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -2
    if tag in AWAY_TAGS or tag == "header" and not within_home:
        return -1
    if tag in ("body", "html"):
        return 0
    if -1 in said:
        return -1
    if tag in HOME_TAGS or 1 in said:
        return 1
    return 2 if 2 in said else 0


class Block:
    __slots__ = ("text", "links", "tag", "parent", "mark", "depth")

    def __init__(self, text: str, links: int, tag: str, parent: int, mark: int, depth: int):
        self.text, self.links, self.tag, self.parent, self.mark, self.depth = text, links, tag, parent, mark, depth


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, -1)]  # tag, element number, innermost mark, parent's number
    numbers, pos, end = 0, 0, len(html)
    buf: list[str] = []
    linked = anchors = foreign = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            if text:
                k = len(stack) - 1
                while k and stack[k][0] in INLINE:
                    k -= 1
                tag, number, mark, parent = stack[k]
                out.append(Block(text, linked, tag, parent if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "dt", "td", "th") else number, stack[-1][2], k))
            buf.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal anchors, foreign
        for tag, *_ in stack[k:]:
            anchors -= tag == "a"
            foreign -= tag in FOREIGN
        del stack[k:]

    while pos < end:
        at = html.find("<", pos)
        m = None
        if at >= 0:
            m = _TOKEN.match(html, at)
        stop = end if at < 0 else at if m else at + 1
        if stop > pos:
            buf.append(html[pos:stop])
            if anchors > 0:
                linked += stop - pos
        if at < 0:
            break
        if m is None:
            pos = stop
            continue
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                buf.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
            continue
        attrs = m[3] if m[2] else m[6]
        if (foreign or tag in CLOSABLE) and attrs and attrs.rstrip().endswith("/"):
            continue
        if tag in RAW:
            found = _RAW[tag].search(html, pos)
            pos = found.end() if found else end
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in CONTROLS:
            found = next((x for x in CONTROL.finditer(html, pos) if x[2].lower() == tag), None)
            if not found or not found[1]:
                continue
        if foreign and tag in CLOSES_P and not any(x[0] == "foreignobject" for x in stack):
            close(next(k for k, x in enumerate(stack) if x[0] in FOREIGN))
        if tag in CLOSES_P or tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" and tag in CLOSES_P or stack[k][0] == tag and tag in SAME or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd") or tag in ("td", "th") and stack[k][0] in ("td", "th"):
                    close(k)
                    break
                if tag in SAME and stack[k][0] in SAME[tag] or stack[k][0] not in INLINE and tag not in SAME:
                    break
        numbers += 1
        up = stack[-1]
        mark = up[2]
        if mark > -2 and not foreign and tag not in FOREIGN:
            own = _mark(tag, attrs or "", mark in HOMES)
            mark = {1: HINTED, 0: DOUBTED}.get(mark, mark) if own == 2 else own or mark
        stack.append((tag, numbers, mark, up[1]))
        anchors += tag == "a"
        foreign += tag in FOREIGN
    flush()
    return out


def odds(b: Block) -> float:
    """The classifier's log-odds that a block is content."""
    if b.mark <= -2:
        return 3 * AWAY
    home = b.mark in HOMES
    x = HOME if home else AWAY if b.mark < 0 else NOWHERE
    if b.mark in (HINTED, DOUBTED):
        x += HINT
    if b.tag in ("p", "blockquote", "pre"):
        x += PROSE
    elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        x += HEADING
    x += (LENGTH if b.mark in (1, -1, HINTED) else UNMARKED_LENGTH) * min(6, max(0, len(b.text).bit_length() - 4))
    return x + LINKS * min(1.0, b.links / len(b.text)) * (0.3 if home else 1.0)


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: capacity max(g, 0) from the source, max(-g, 0) to the sink, both ways on edges."""
    n = len(gain)
    if all(g >= 0 for g in gain) or all(g < 0 for g in gain):
        return [g >= 0 for g in gain]
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, c: float, back: float) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            add(s, i, g, 0.0)
        elif g < 0:
            add(i, t, -g, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:  # one blocking path after the other, without recursion
            path, u = [], s
            while u != t:
                while at[u] < len(adj[u]):
                    e = adj[u][at[u]]
                    if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(adj[u]):
                    path.append(adj[u][at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break
            if u != t:
                break
            f = min(cap[e] for e in path)
            for e in path:
                cap[e] -= f
                cap[e ^ 1] += f


def main_text(html: str | None) -> str:
    """The page's main text."""
    found = blocks(html or "")
    nodes: list[list[Block]] = []
    gain: list[float] = []
    for b in found:
        g = odds(b)
        if nodes and nodes[-1][-1].parent == b.parent and nodes[-1][-1].mark == b.mark and (g >= 0) == (gain[-1] >= 0):
            nodes[-1].append(b)
            gain[-1] += g
        else:
            nodes.append([b])
            gain.append(g)
    edges, last = [], {}
    for i, x in enumerate(nodes):
        if i:
            kin = nodes[i - 1][-1].parent == x[0].parent
            edges.append((i - 1, i, NEXT + KIN if kin else NEXT / (2 + abs(nodes[i - 1][-1].depth - x[0].depth))))
        if (j := last.get(x[0].parent)) is not None and j < i - 1:
            edges.append((j, i, KIN))
        last[x[0].parent] = i
    side = min_cut(gain, edges)
    return " ".join(b.text for x, keep in zip(nodes, side, strict=True) if keep for b in x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
