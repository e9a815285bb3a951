"""Main content of web pages among menus, notices, sidebars and footers.

Tag-path ratios: the text of a page hangs on root-to-leaf tag paths. For every
container path (with its place among its siblings, since many pages mark up all
blocks alike) the length of text outside links and the number of punctuation
marks are aggregated and divided by the number of leaf nodes; both ratios are
smoothed over neighbouring paths and fused with the share of text outside links.
Paths that reach NEAR_BEST of the page's best fused ratio are taken as content for
now, those under FAR of it as none; the others stay open. The thresholds are thus
the page's own, whatever the length of its texts.

These first choices of all pages say where wording is at home: hashed 4-grams and
line templates are counted inside and outside the chosen paths (a table of fixed
size over the whole input), and a line's *home* is its mean log ratio of the two.
The content ratio of a path is the home of its lines, weighted by length, summed
up the tree; the path with the largest sum over 0 holds the page's content, and so
does any other that the first choice did not rule out and that is at home inside by
SURE_HOME. Lines in them whose home is outside (promotions, share links) do not
count. The page's heading is no answer, only a feature: it raises the fused ratio
of its path by HEADING, and its line is kept on pages with content.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Shares of a page's best fused ratio from which a path is content, and under which it is none, in the first choice.
NEAR_BEST, FAR = 0.9, 0.8
#: Best fused ratio a page with a main body has at least, and punctuation marks of its path.
LEAST_RATIO, LEAST_MARKS = 20.0, 2
#: Mean home from which a path is content beside the one with the largest content ratio.
SURE_HOME = 0.3
#: Factor of the fused ratio of the path that holds the page's heading.
HEADING = 3.0
#: Weights of a path's neighbours and itself in smoothing.
KERNEL = [0.1, 0.8, 0.1]
#: 4-grams are hashed to the lower half, line templates to the upper one.
BUCKETS = 1 << 19
#: Times a 4-gram or template must be seen before it counts.
LEAST_SEEN = 5
# Elements that hold blocks, and those whose text is no content.
CONTAINERS = {"html", "body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "table", "tbody", "tr", "td", "ul", "ol", "dl", "form", "fieldset", "figure", "details"}
SILENT = {"script", "style", "head", "title", "template", "noscript", "svg"}
TOPS = {"body", "html", "#"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements within a line of text, those whose text is a link, and those that end an open paragraph.
INLINE = {"a", "span", "em", "strong", "i", "u", "small", "font", "label"}
LINKS = {"a", "button"}
BLOCKS = CONTAINERS | HEADINGS | {"p", "li", "dt", "dd", "th"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed"}

_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?([A-Za-z][A-Za-z0-9]*)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|\n", re.S)
_PUNCT = re.compile(r"[。、．，！？!?.,;:；：]")
_SLOT = re.compile(r"ア[ア]+|\b[A-Z][a-z]+\b|0[0:.,-]*")
_MASK = {c: "ア" for c in range(0x30A1, 0x30FB)} | {0x30FC: "ア"} | {ord(d): "0" for d in "0123456789０１２３４５６７８９"}


class Page:
    """Lines with text of a page, and its containers in document order."""

    def __init__(self) -> None:
        self.no: list[int] = []
        self.text: list[str] = []
        self.tag: list[str] = []
        self.link: list[int] = []
        self.node: list[int] = []
        self.heading: list[bool] = []
        self.up, self.kind = [-1], ["#"]


def lines_of(page: str) -> Page:
    """Missing end tags are supplied: an end tag closes what is still open inside it, one without a start tag is ignored."""
    out = Page()
    tags, nodes = ["#"], [0]  # open elements, and the container each is or stands in
    links = headings = silent = no = at = 0
    begun = False

    def text(s: str) -> None:
        nonlocal begun
        if silent or s.isspace():
            return
        if "&" in s:
            s = html.unescape(s)
            if s.isspace():
                return
        if not begun:
            begun = True
            out.no.append(no), out.text.append(s), out.link.append(0), out.node.append(nodes[-1]), out.heading.append(headings > 0)
            out.tag.append(next((t for t in reversed(tags) if t not in INLINE), tags[-1]))
        else:
            out.text[-1] += s
            if headings:
                out.heading[-1] = True
        if links:
            out.link[-1] += len(s.strip())

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tok = m[0]
        if tok == "\n":
            no, begun = no + 1, False
            continue
        tag = m[1]
        if tag:
            tag = tag.lower()
            if tok[1] == "/":
                if tag in SILENT:
                    silent = max(0, silent - 1)
                k = len(tags) - 1
                while k and tags[k] != tag:
                    k -= 1
                # An inline or text element never closes a container around it.
                if k and (tag in CONTAINERS or nodes[k] == nodes[-1] and not any(t in CONTAINERS for t in tags[k:])):
                    for t in tags[k:]:
                        links -= t in LINKS
                        headings -= t == "h1"
                    del tags[k:], nodes[k:]
            elif tag not in VOID and not tok.endswith("/>"):
                if tag in SILENT:
                    silent += 1
                if tag in BLOCKS:  # opening a block ends an open paragraph, item or heading
                    while len(tags) > 1 and tags[-1] not in CONTAINERS and tags[-1] not in SILENT:
                        t = tags.pop()
                        nodes.pop()
                        links -= t in LINKS
                        headings -= t == "h1"
                if tag in CONTAINERS:
                    out.up.append(nodes[-1]), out.kind.append(tag)
                    nodes.append(len(out.up) - 1)
                else:
                    nodes.append(nodes[-1])
                    links += tag in LINKS
                    headings += tag == "h1"
                tags.append(tag)
        if "\n" in tok:
            no, begun = no + tok.count("\n"), False
    if at < len(page):
        text(page[at:])
    out.text = [x.strip() for x in out.text]
    return out


def first_choice(p: Page) -> list[int]:
    """For each line 1 if its path is content by its fused ratio, 0 if it is none, -1 if open; paths without punctuation to speak of are none."""
    n, up, kind = len(p.up), p.up, p.kind
    if not p.no:
        return []
    under = [0] * n
    for k in p.node:
        under[k] += 1
    for k in range(n - 1, 0, -1):
        under[up[k]] += under[k]
    boxes: dict[int, int] = {}
    size, punct, leaf, link = ([0.0] * n for _ in range(4))
    for k, text, linked in zip(p.node, p.text, p.link):
        b = boxes.get(k)
        if b is None:
            b = k
            while up[b] > 0 and (under[b] <= 1 or kind[b] in ("tr", "tbody", "ul", "ol")):
                b = up[b]
            boxes[k] = b
        size[b] += len(text) - linked
        link[b] += linked
        leaf[b] += 1
        if linked < len(text):
            punct[b] += len(_PUNCT.findall(text))
    used = [k for k in range(n) if leaf[k]]
    a, b, c = KERNEL

    def smooth(v: list[float]) -> list[float]:
        v = [v[0], *v, v[-1]]
        return [a * v[k - 1] + b * v[k] + c * v[k + 1] for k in range(1, len(v) - 1)]

    ratio, marks = smooth([size[k] / leaf[k] for k in used]), smooth([punct[k] / leaf[k] for k in used])
    fused = [r * (1 + m) * size[k] / max(size[k] + link[k], 1) if punct[k] >= LEAST_MARKS else 0.0 for r, m, k in zip(ratio, marks, used)]
    head = next((boxes[k] for k, h in zip(p.node, p.heading) if h), None)
    fused = [v * HEADING if k == head else v for v, k in zip(fused, used)]
    best = max(fused)
    if best < LEAST_RATIO:
        return [0] * len(p.no)
    state = [0] * n
    for v, k in zip(fused, used):
        state[k] = 1 if v >= NEAR_BEST * best else -1 if v >= FAR * best else 0
    whole = [False] * n  # what stands under a chosen path belongs to it, but for the page's top
    for k in range(1, n):
        whole[k] = whole[up[k]] or state[k] == 1 and kind[k] not in TOPS
        if whole[k]:
            state[k] = 1
    return [1 if whole[k] else state[boxes[k]] for k in p.node]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 4-gram of the texts, and which text it is from."""
    s = "\n".join(f"^{t.translate(_MASK)}$" for t in texts)
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.uint64(0x9E3779B97F4A7C15)
    h = c[:-3]
    for k in (1, 2, 3):
        h = h * p + c[k : len(c) - 3 + k]
    h = (h * p) >> np.uint64(46)  # 18 bits
    cut = c == 10
    of = np.cumsum(cut)[:-3]
    whole = ~(cut[:-3] | cut[1:-2] | cut[2:-1] | cut[3:])
    return h[whole].astype(np.int64), of[whole]


def template(tag: str, text: str) -> int:
    """Bucket of the line's tag and wording, without numbers and invented words."""
    return BUCKETS // 2 + zlib.crc32(f"{tag}:{_SLOT.sub('_', text.translate(_MASK))}".encode()) % (BUCKETS // 2)


def scores(tags: list[str], texts: list[str], home: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Home of each line: over 0 where it is inside content, by its 4-grams or by its template if that is often seen."""
    h, of = grams(texts)
    mean = np.bincount(of, home[h], minlength=len(texts)) / np.maximum(np.bincount(of, minlength=len(texts)), 1)
    t = np.array([template(a, b) for a, b in zip(tags, texts)], np.int64)
    return np.where(seen[t], np.maximum(home[t], mean), mean)


def content_paths(node: np.ndarray, up: np.ndarray, length: np.ndarray, home: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Which lines stand in a content path: the one with the largest content ratio over 0, and others over 0 whose lines are not ruled out by their fused ratio."""
    share = (np.minimum(length, 80) + 10) * np.clip(home, -2, 2)
    total = np.bincount(node, share, minlength=len(up)).tolist()
    weight = np.bincount(node, np.minimum(length, 80) + 10, minlength=len(up)).tolist()
    above = up.tolist()
    open_ = [False] * len(above)
    for k, c in zip(node.tolist(), choice.tolist()):
        open_[k] |= c != 0
    for k in range(len(above) - 1, 0, -1):
        total[above[k]] += total[k]
        weight[above[k]] += weight[k]
    best = int(np.argmax(total))
    inside = [False] * len(above)
    if total[best] > 0:
        for k in range(1, len(above)):
            inside[k] = k == best or inside[above[k]] or open_[k] and total[k] > SURE_HOME * weight[k]
    return np.array(inside, bool)[node]


def homes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each bucket is at home inside, over 0, or outside; and which are seen often enough."""
    seen = counts.sum(axis=0) >= LEAST_SEEN
    return np.where(seen, np.clip(np.log((counts[0] + 0.5) / (counts[1] + 0.5)), -3, 3), 0).astype(np.float32), seen


#: One row a page: texts and tags joined, (line number, first choice, heading, container) of each line, parents of containers.
PARSED = "texts string, tags string, lines binary, up binary"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(id, PARSED) of each page of (id, content) that has markup and text; each page is parsed once."""
    kind = dict(pages.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, tags, lines, up = [], [], [], [], []
            for i, page in enumerate(b.column(1).to_pylist()):
                if "<" not in page:
                    continue
                p = lines_of(page)
                if p.no:
                    at.append(i), texts.append("\n".join(x.replace("\n", " ") for x in p.text)), tags.append(" ".join(p.tag))
                    lines.append(np.array([p.no, first_choice(p), p.heading, p.node], np.int32).tobytes()), up.append(np.array(p.up, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(texts, pa.string()), pa.array(tags, pa.string()), pa.array(lines, pa.binary()), pa.array(up, pa.binary())], names=["id", "texts", "tags", "lines", "up"])

    return pages.mapInArrow(run, f"id {kind}, {PARSED}")


def _unpack(lines: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32).reshape(4, -1) for x in lines]


def gram_counts(pages: DataFrame) -> np.ndarray:
    """Counts of 4-grams and templates (inside, outside) of the first choice over all pages, 2 x BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            texts = [x for t in b.column(0).to_pylist() for x in t.split("\n")]
            tags = [x for t in b.column(1).to_pylist() for x in t.split(" ")]
            chosen = np.concatenate([x[1] for x in _unpack(b.column(2).to_pylist())]) if b.num_rows else np.zeros(0, int)
            for side in (0, 1):
                own = np.flatnonzero(chosen == 1 - side).tolist()
                total[side] += np.bincount(grams([texts[k] for k in own])[0], minlength=BUCKETS)
                total[side] += np.bincount(np.array([template(tags[k], texts[k]) for k in own], np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "inside", "outside"])

    counts = np.zeros((2, BUCKETS), np.int64)
    rows = pages.select("texts", "tags", "lines").mapInArrow(run, "bucket int, inside bigint, outside bigint").groupBy("bucket").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    got = rows.toPandas()  # at most BUCKETS rows
    counts[0][got.bucket], counts[1][got.bucket] = got.inside, got.outside
    return counts


def main_lines(pages: DataFrame, id_col: str = "fetch_id", page_col: str = "content") -> DataFrame:
    """(id, line_no, text) of each line of main content; lines count from 0.

    Pages that are null, empty, no markup or without a main body give no rows.
    Repeated pages give their rows again; an empty table gives no rows. Pages of
    any length are read whole. On very few pages (no wording seen LEAST_SEEN
    times) nothing is known of what is at home where, and no line comes out.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(page_col).alias("content")).where("content is not null")
    kind = dict(rows.dtypes)["id"]
    parsed = cut(parsed_pages(rows))
    shared = spark.sparkContext.broadcast(homes(gram_counts(parsed)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = [x for t in b.column(1).to_pylist() for x in t.split("\n")]
            home = scores([x for t in b.column(2).to_pylist() for x in t.split(" ")], texts, *shared.value)
            length = np.array([len(x) for x in texts])
            at, no, line, first = [], [], [], 0
            for i, (x, up) in enumerate(zip(_unpack(b.column(3).to_pylist()), b.column(4).to_pylist())):
                part = slice(first, first + x.shape[1])
                first = part.stop
                inside = content_paths(x[3], np.frombuffer(up, np.int32), length[part], home[part], x[1])
                good = np.flatnonzero(inside & (home[part] >= 0) | (x[2] == 1) & inside.any())
                at += [i] * len(good)
                no.append(x[0][good])
                line += [texts[part.start + k] for k in good.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(np.concatenate(no), pa.int32()), pa.array(line, pa.string())], names=["id", "line_no", "text"])

    return parsed.mapInArrow(keep, f"id {kind}, line_no int, text string").withColumnRenamed("id", id_col)
