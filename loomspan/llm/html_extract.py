"""Main-text extraction: each page's blocks are labelled by a minimum cut.

A page becomes a list of text blocks. A classifier's log-odds (trained here on a bounded sample, from
the weak labels that semantic tags give) plus the cues of enclosing elements become terminal
capacities; neighbours in reading order get smoothness edges, stronger the more of the DOM path they
share. The minimum cut then separates content from boilerplate: exact, and linear in the blocks, since the arcs do
not cross. Pages are independent: no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|[^<]+|<", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# HTML element classes and the words in class, id and role that name a page region.
RAW = frozenset("svg select option button canvas audio video annotation annotation-xml head".split())
HEAD = frozenset("base basefont bgsound link meta".split())
OPAQUE = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr object optgroup q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose merror mmultiscripts mprescripts none semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAGS = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "menu": -7.0, "dialog": -7.0, "header": -5.0, "article": 4.0, "main": 3.0}
ROLES = {**dict.fromkeys("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split(), -7.0), "main": 3.0, "article": 4.0}
BAD = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsors sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead sidebar sidebars widget widgets related recommended recommendations recommend share sharing social comment comments respond replies disqus cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login search toolbar pagination pager copyright legal skip tags".split()
)
GOOD = frozenset("article content main post entry story body text".split())
# Words beside them that say nothing of their own, and words that turn them around.
PLAIN = frozenset("site page top bottom left right global primary secondary wrapper wrap container box block area section region inner outer list item items link links bar form row col column holder group panel posts articles stories the a".split())
NOT = frozenset("no not non without with has have is hide".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in OPAQUE}
_SAME = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in RAW}


class Block:
    __slots__ = ("element", "heading", "linked", "shared", "text")

    def __init__(self, text: str, linked: int, element: int, shared: int, heading: bool):
        self.text, self.linked, self.element, self.shared, self.heading = text, linked, element, shared, heading


def mark_value(kind: str, mark: str) -> float:
    """What a class, id or role says for (above 0) or against content. Class words count whole, and only if all their
    parts agree; marks that speak for both, or turn a word around (no-sidebar, has banner), leave it to the text."""
    if kind == "role":
        return min((ROLES.get(x, 0.0) for x in mark.lower().split()), default=0.0) or max((ROLES.get(x, 0.0) for x in mark.lower().split()), default=0.0)
    values = []
    for token in _CAMEL.sub("-", mark).lower().split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        if any(x in NOT for x in parts):
            return 0.0
        bad, good, known = any(x in BAD for x in parts), any(x in GOOD for x in parts), all(x in BAD or x in GOOD or x in PLAIN for x in parts)
        values.append(0.0 if bad and good else (-7.0 if known else -2.0) if bad else (3.0 if known else 1.5) if good else 0.0)
    low, high = min(values, default=0.0), max(values, default=0.0)
    return 0.0 if low < 0 < high else low or high


def element_value(name: str, attrs: str, inside: bool) -> float:
    """What an element adds to its descendants' log-odds of being content."""
    value = 0.0 if name == "header" and inside else TAGS.get(name, 0.0)
    if not attrs:
        return value
    if _HIDDEN.search(attrs):
        return HIDDEN
    if name in ("body", "html"):
        return 0.0
    marks = [mark_value(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _MARK.finditer(attrs)]
    low, high = min(marks, default=0.0), max(marks, default=0.0)
    if low < 0 < high:
        low = high = 0.0
    if low < 0:
        value = value + low if value > 0 and low > -7.0 else min(value, low)
    elif value >= 0:
        value = max(value, high)
    return value


HIDDEN = -20.0
MOST_INSIDE, MOST_OUTSIDE = 1.5, 5.0  # most that marks for content add up to in a boilerplate region, and elsewhere


class Page:
    """Text blocks in page order, and the elements around them (parents before children)."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.depth, self.value, self.title = [0], [1], [0.0], [False]
        self._read(page)
        self.cues = self._settle()

    def _open(self, parent: int, name: str, attrs: str, inside: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.value.append(element_value(name, attrs, inside))
        self.title.append(name == "h1")
        return len(self.parent) - 1

    def _settle(self) -> list[float]:
        """Each element's cue with those around it. A boilerplate element takes all cues for content back, and what is
        inside cannot outweigh it. One that holds most of the text and all marks of content (without any: all main
        headings) is a wrapper and says nothing itself."""
        n = len(self.parent)
        words = [0] * n
        marked = any(v > 0 for v in self.value)
        goods = [int(v > 0 if marked else h) for v, h in zip(self.value, self.title, strict=True)]
        for b in self.blocks:
            words[b.element] += b.text.count(" ") + 1
        for i in range(n - 1, 0, -1):
            words[self.parent[i]] += words[i]
            goods[self.parent[i]] += goods[i]
        bad, good = [0.0] * n, [0.0] * n
        for i in range(1, n):
            value, up = self.value[i], self.parent[i]
            if HIDDEN < value < 0 and 2 * words[i] >= words[0] and goods[i] == goods[0] > 0:
                value = 0.0
            bad[i] = bad[up] + min(value, 0.0)
            good[i] = 0.0 if value < 0 else min(good[up] + value, MOST_INSIDE if bad[i] < 0 else MOST_OUTSIDE)
        return [x + y for x, y in zip(bad, good, strict=True)]

    def _read(self, page: str) -> None:
        """Unclosed, misnested and truncated markup is read leniently."""
        out = self.blocks
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, element, whether inside content
        parts: list[str] = []
        linked = links = 0
        low = 1  # least depth of the stack since the last block
        raw: list[tuple[str, bool]] = []  # open elements whose text is left out, and whether an end tag comes before the next start
        inner: list[str] = []  # other elements open in those
        mute: list[str] = []  # open inline elements whose text is left out, from the first that says so

        def flush() -> None:
            nonlocal linked, low
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    out.append(Block(text, linked, stack[-1][1], low, stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")))
                    low = len(stack)
                parts.clear()
            linked = 0

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.match(page, at)
            if m is None:
                break
            at = m.end()
            name = m[2]
            if name is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    if raw and raw[-1][0] == "head" and not piece.isspace():
                        raw.clear()
                    if not raw and not mute:
                        parts.append(piece)
                        if links:
                            linked += len(piece)
                continue
            name, closing, attrs = name.lower(), bool(m[1]), m[3]
            if name in OPAQUE and not closing:
                if not attrs.endswith("/"):
                    end = _END[name].search(page, at)
                    at = end.end() if end else n
                continue
            if raw and raw[0][0] == "head" and name != "head" and name not in HEAD:
                raw.clear()  # whatever a head cannot hold ends it
            if name in INLINE:
                if name == "a":
                    links = 0 if closing else 1
                elif name == "br" and not raw:
                    parts.append(" ")
                if mute:
                    if closing and name in mute:
                        del mute[len(mute) - 1 - mute[::-1].index(name) :]
                    elif not closing and name not in VOID and not attrs.endswith("/"):
                        mute.append(name)
                elif attrs and not closing and name not in VOID and not attrs.endswith("/") and element_value(name, attrs, False) <= -7.0:
                    mute.append(name)
                continue
            if name in RAW:
                same = [i for i, x in enumerate(raw) if x[0] == name]
                if closing:
                    if same:
                        del raw[same[-1] :]
                elif not attrs.endswith("/"):
                    if same and name in ("select", "button") or name == "option" and raw and raw[-1][0] == name:
                        del raw[same[-1] :]
                    if not raw:
                        inner.clear()
                    other = _SAME[name].search(page, at)
                    raw.append((name, other is not None and other[1] == "/"))
                continue
            if raw:
                # The end tag of an element around them ends them all; a block's start ends those without an end tag.
                select = any(x[0] == "select" for x in raw)
                if closing and name in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(name) :]
                    continue
                if any(x[0] == name for x in stack) if closing else name == "body" or name in _CLOSE_P and not all(x[1] for x in raw if x[0] != "option" or not select):
                    raw.clear()
                else:
                    if not closing and name not in VOID:
                        inner.append(name)
                    continue
            inner.clear()
            mute.clear()
            flush()
            if closing:
                for i in range(len(stack) - 1, max(0, len(stack) - 1 - MOST_OPEN), -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in VOID:
                gone = _CLOSES.get(name, ())
                while len(stack) > 1 and (stack[-1][0] in gone or stack[-1][0] == "p" and name in _CLOSE_P):
                    stack.pop()
                _, up, inside = stack[-1]
                own = self._open(up, name, attrs, inside)
                low = min(low, len(stack))
                stack.append((name, own, inside or self.value[own] > 0))
            low = min(low, len(stack))
        flush()


MOST_OPEN = 2000  # open elements among which an end tag looks for its start


_STOP = re.compile(r"[.!?;:,]")


def features(blocks: list[Block]) -> np.ndarray:
    """Shallow text features that do not look at tags: length, links, sentence marks, neighbours, place."""
    n = len(blocks)
    words = np.array([b.text.count(" ") + 1 for b in blocks], float)
    chars = np.array([len(b.text) for b in blocks], float)
    out = np.empty((n, 8))
    out[:, 0] = 1
    out[:, 1] = np.log1p(words)
    out[:, 2] = np.minimum(1, np.array([b.linked for b in blocks]) / chars)
    out[:, 3] = np.minimum(1, np.array([len(_STOP.findall(b.text)) for b in blocks]) / words)
    out[:, 4] = chars / words / 10
    out[:, 5] = np.log1p(np.r_[0, words[:-1]])
    out[:, 6] = np.log1p(np.r_[words[1:], 0])
    out[:, 7] = np.abs(np.arange(n) + 0.5 - n / 2) / n
    return out


DEFAULT_WEIGHTS = (-1.5, 0.8, -4.0, 1.0, 0.0, 0.2, 0.2, -1.0)


def train(pages: list[str], rounds: int = 200) -> tuple[float, ...]:
    """Logistic weights from the blocks that enclosing elements label clearly; the defaults without both labels."""
    xs, ys = [], []
    for text in pages:
        page = Page(text)
        cues = [page.cues[b.element] for b in page.blocks]
        clear = [i for i, c in enumerate(cues) if abs(c) >= 3]
        if clear:
            xs.append(features(page.blocks)[clear])
            ys += [cues[i] > 0 for i in clear]
    y = np.array(ys, float)
    if not xs or y.min() == y.max():
        return DEFAULT_WEIGHTS
    x = np.concatenate(xs)
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps damped by a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + 0.01 * len(y) * w
        move = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + 0.01 * len(y) * np.eye(len(w)), grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return tuple(float(round(v, 6)) for v in w)


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost of nodes set against their sign plus that of the edges cut: a minimum cut between
    a source that holds what is kept and a sink, with |cost| as terminal capacities. A tie drops the node.

    A node with two neighbours at most is settled exactly: whatever they choose, the best of its two labels is a
    capacity for each of them and one between them. That alone solves a chain with arcs that do not cross, in linear
    time. What it leaves of other graphs goes to max-flow by shortest augmenting paths."""
    cost = list(costs)
    near: list[dict[int, float]] = [{} for _ in cost]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    settled: list[tuple[int, float, list[tuple[int, float]]]] = []
    gone = [False] * len(cost)
    queue = deque(i for i, x in enumerate(near) if len(x) <= 2)
    while queue:
        i = queue.popleft()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        others = list(near[i].items())
        settled.append((i, cost[i], others))
        (a, wa), (b, wb) = [*others, (-1, 0.0), (-1, 0.0)][:2]
        none, both = min(0.0, wa + wb - cost[i]), min(wa + wb, -cost[i])
        only_a, only_b = min(wa, wb - cost[i]), min(wb, wa - cost[i])
        link = max(0.0, (only_a + only_b - none - both) / 2)
        for x, value in ((a, only_a - none - link), (b, only_b - none - link)):
            if x >= 0:
                cost[x] -= value
                del near[x][i]
        if b >= 0 and link > 0:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + link
        queue.extend(x for x in (a, b) if x >= 0 and len(near[x]) <= 2)
    label = [False] * len(cost)
    left = [i for i in range(len(cost)) if not gone[i]]
    if left:
        for i in _source_side(left, cost, near):
            label[i] = True
    for i, own, others in reversed(settled):
        keep = -own + sum(w for x, w in others if not label[x])
        label[i] = keep < sum(w for x, w in others if label[x])
    return label


def _source_side(left: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that max-flow leaves on the source's side."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left} | {source: {}, sink: {}}
    for i in left:
        a, b = (source, i) if cost[i] > 0 else (i, sink)
        room[a][b] = abs(cost[i])
        room[b].setdefault(a, 0.0)
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return came.keys() - {source}
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours in reading order, the more of the DOM path they share the stronger; and the last
    block before in the same container, where that crosses no other such arc."""
    edges: list[tuple[int, int, float]] = []
    blocks = page.blocks
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1], blocks[i]
        deep = max(page.depth[a.element], page.depth[b.element])
        edges.append((i - 1, i, min(b.shared, deep) / deep + (0.5 if a.heading else 0.0)))
    last: dict[int, int] = {}
    open_: list[int] = []  # blocks that no arc spans
    at: dict[int, int] = {}  # their places in open_
    for i, b in enumerate(blocks):
        box = page.parent[b.element]
        j = last.get(box, -1)
        if 0 <= j < i - 1 and j in at:
            edges.append((j, i, 0.5))
            for x in open_[at[j] + 1 :]:
                del at[x]
            del open_[at[j] + 1 :]
        last[box] = i
        at[i] = len(open_)
        open_.append(i)
    return edges


MOST_ODDS = 3.0


def main_text(html: str, weights: tuple[float, ...]) -> str:
    page = Page(html)
    if not page.blocks:
        return ""
    odds = np.clip(features(page.blocks) @ np.array(weights), -MOST_ODDS, MOST_ODDS)
    costs = [float(o) + page.cues[b.element] for o, b in zip(odds, page.blocks, strict=True)]
    return "\n".join(b.text for b, keep in zip(page.blocks, min_cut(costs, smoothness(page)), strict=True) if keep)


SCHEMA = "page_id long, url string, text string, n_chars long"
SAMPLE_PAGES = 300
SAMPLE_CHARS = 100_000


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """page_id, url, text, n_chars for every input row.

    The classifier is fitted on `sample_pages` pages at most, those of the smallest hash of their id among
    pages of up to `sample_chars` code points. Null or empty html gives an empty text. Null ids or urls and repeated
    rows are kept as they come; pages of any length are read whole. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    ids = rows.where(F.length("html") <= sample_chars).select(F.xxhash64("page_id").alias("at"), "page_id").distinct().orderBy("at", "page_id").limit(sample_pages)
    chosen = rows.join(F.broadcast(ids.select("page_id")), "page_id").where(F.length("html") <= sample_chars)
    sample = chosen.select("page_id", "html").dropDuplicates(["page_id"]).orderBy("page_id").collect()
    weights = train([r.html for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)
