"""Main-text extraction by wrapper induction.

Learning: every page's DOM is aligned with the template tree of its host by simple tree matching
(Yang, 1991): two trees match if their roots carry the same tag and class (numbers in class names
count as equal, ids do not count), and a dynamic program over their children finds the largest
order-preserving match. Runs of equal siblings fold into one
repeated node. A template node counts its pages and keeps the least and largest hash of its text
and of all that is below it, and sketches of up to three articles that differ, so nodes and whole
boxes that never change over different articles are told from slots that vary, and copies of one
article count as one. Tasks learn partial templates from all
pages; the partial templates of a host merge by the same matching.
Extraction: the template names the host's content root, and constant nodes below it are template,
varying slots content. What tags or class names mark as menus, notices, adverts, forms, comments
and the like is left out in either case.
"""

from __future__ import annotations

import functools
import html
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import materialise

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|$)""", re.DOTALL)
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP_TAGS = frozenset("nav footer aside form script style noscript iframe template head button select option input textarea label svg canvas dialog menu object embed audio video title".split())
SKIP_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal overlay
sidebar side menu nav navbar navigation breadcrumb breadcrumbs toolbar header footer masthead comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe signup
login search pagination pager widget complementary contentinfo""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body div article section main table ul ol dl aside nav footer header form blockquote td th".split())
BROADCAST_BYTES = 8 << 20
LEAST_ARTICLES = 3  # different articles that show a node to be constant
SKETCH = 16  # one-permutation minhash: bytes of a sketch
DEPTH = 100  # what is nested deeper lies flat at this depth, in page order; browsers limit their trees alike
SCORES = 1 << 20  # counts of matched nodes that are remembered at a time (in rows of the dynamic program sixteen times as many); beyond that they are found anew
ROOT, CONSTANT = 1, 2  # marks of a plan
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "sig", "kids", "slot")

    def __init__(self, tag: str, sig: str):
        self.tag, self.sig, self.kids, self.slot = tag, sig, [], None


def signature(tag: str, attributes: str) -> str:
    """Tag, class and role, and of the id only what marks something other than the article."""
    words = []
    for name, *value in NAMED.findall(attributes) if "=" in attributes else ():
        value = "".join(value).lower()
        words += [w for w in re.split(r"[^a-z]+", value) if w in SKIP_NAMES] if name.lower() == "id" else [DIGITS.sub("0", value)] if value else []
    return f"{tag}.{' '.join(words)}" if words else tag


class _Open:
    """The open elements of a page, outermost first, and where the next node goes."""

    def __init__(self):
        self.root = Node("#root", "#root")
        self.stack, self.count, self.hidden = [self.root], Counter(), None

    def place(self) -> Node:
        """Below DEPTH all is put flat into the node at that depth, or into the skipped element that holds it."""
        if len(self.stack) <= DEPTH:
            return self.stack[-1]
        return self.hidden[1] if self.hidden else self.stack[DEPTH - 1]

    def push(self, node: Node) -> None:
        if len(self.stack) >= DEPTH and not self.hidden and skipped(node.sig):
            self.hidden = len(self.stack), node
        self.stack.append(node)
        self.count[node.tag] += 1

    def close(self, at: int) -> None:
        """End the elements from place `at` on; flat blocks leave a mark, so that their lines stay apart."""
        for i in range(len(self.stack) - 1, at - 1, -1):
            node = self.stack.pop()
            self.count[node.tag] -= 1
            if self.hidden and self.hidden[0] == i:
                self.hidden = None
            if i >= DEPTH and node.tag in BLOCK:
                self.place().kids.append(Node(node.tag, node.tag))

    def end(self, tags, fence, beyond=()) -> None:
        """Close the innermost open element of `tags`, unless one of `fence` (less those of `beyond`) is nearer."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                self.close(i)
                break
            if tag in fence and tag not in beyond:
                break


def parse(text: str) -> Node:
    """A tolerant DOM: unclosed and misnested tags are closed by what encloses them. Text is never lost, however deep it lies."""
    page, at, pos = _Open(), 0, 0
    while m := TOKEN.search(text, pos):
        if m.start() > at:
            page.place().kids.append(text[at : m.start()])
        at = pos = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            page.end((tag,), () if tag in SCOPES else SCOPES)
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            page.end(("p",), SCOPES)
        if tag in CLOSES:
            page.end(CLOSES[tag], SCOPES, ("td", "th"))
        node = Node(tag, signature(tag, m[3]))
        page.place().kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|$)", re.IGNORECASE).search(text, pos)
            at = pos = end.end() if end else len(text)
        elif tag not in VOID and not m[3].endswith("/"):
            page.push(node)
    if at < len(text):
        page.place().kids.append(text[at:])
    return page.root


@functools.lru_cache(8192)
def skipped(sig: str) -> bool:
    """Do the tag or the names of this element mark it as something other than the article?"""
    tag, _, names = sig.partition(".")
    if tag in SKIP_TAGS:
        return True
    if not names or tag in ("html", "body", "article", "main"):
        return False
    return any(w in SKIP_NAMES for w in re.split(r"[^a-z]+", names))


def sketch_of(page: Node) -> str:
    """Minhash of the word triples outside what is skipped, in hex; 00 stands for no triple."""
    parts: list[str] = []
    todo: list = [page]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        elif not skipped(node.sig):
            todo += reversed(node.kids)
    words = " ".join(parts).split()
    least = [0] * SKETCH
    for i in range(max(1, len(words) - 2) if words else 0):
        code = zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) + 1
        if not least[code % SKETCH] or code < least[code % SKETCH]:
            least[code % SKETCH] = code
    return bytes(code and code // SKETCH % 255 + 1 for code in least).hex()


def near(a: str, b: str) -> bool:
    """Are two sketches of copies or near copies, with three quarters of their places equal?"""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    used = [(p, q) for p, q in zip(x, y, strict=True) if p or q]
    return sum(p == q for p, q in used) * 4 >= len(used) * 3


def articles(a: list[str], b: list[str]) -> list[str]:
    """Sketches of different articles of both lists, as many as matter."""
    if a == b or len(a) >= LEAST_ARTICLES:
        return a
    out = list(a)
    for x in b:
        if len(out) < LEAST_ARTICLES and not any(near(x, y) for y in out):
            out.append(x)
    return out


def fold(node: Node, sketch: str | None = None) -> list:
    """Template node of one page: [sig, repeated, pages, least hash, largest hash, text length, children, least hash of the subtree (or run of equal siblings), largest, sketches of articles]."""
    if sketch is None:
        sketch = sketch_of(node)
    groups: list[list[Node]] = []
    own = []
    for kid in node.kids:
        if isinstance(kid, str):
            own.append(kid)
        elif groups and groups[-1][0].sig == kid.sig:
            groups[-1].append(kid)
        else:
            groups.append([kid])
    text = SPACE.sub(" ", "".join(own)).strip()
    kids = []
    for g in groups:
        one = fold(g[0], sketch)
        if len(g) > 1:
            below = [one[7]]
            for other in g[1:]:
                two = fold(other, sketch)
                below.append(two[7])
                one = merge(one, two, same_page=True)
                one[1] = True
            one[7] = one[8] = zlib.crc32(repr(below).encode())
        kids.append(one)
    code = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    below = zlib.crc32(repr([(k[0], k[7]) for k in kids if not skipped(k[0])]).encode("utf-8", "surrogatepass"), code)
    return [node.sig, False, 1, code, code, len(text), kids, below, below, [sketch]]


class Shapes:
    """Trees of names by number, equal trees having equal numbers, and how many nodes of two of them match. Holds for nodes that stay unchanged meanwhile."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.names: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.flat: list[bool] = []  # children without children only?
        self.places: dict[int, dict[str, int]] = {}  # by name of the children a number whose bits are their positions
        self.scores: dict[tuple[int, int], int] = {}

    def number(self, node: list) -> int:
        out = self.known.get(id(node))
        if out is None:
            key = (node[0], *map(self.number, node[6]))
            out = self.known[id(node)] = self.numbers.setdefault(key, len(self.numbers))
            if out == len(self.names):
                self.names.append(node[0])
                self.kids.append(key[1:])
                self.flat.append(not any(k[6] for k in node[6]))
        return out

    def score(self, x: int, y: int) -> int:
        """Matched nodes of two trees, roots included; none if the roots' names differ."""
        if self.names[x] != self.names[y]:
            return 0
        a, b = self.kids[x], self.kids[y]
        if not a or not b:
            return 1
        if self.flat[y]:
            return 1 + self.common(a, y)
        if self.flat[x]:
            return 1 + self.common(b, x)
        out = self.scores.get((x, y))
        if out is None:
            pairs = partners([self.names[k] for k in a], [self.names[k] for k in b], a.__getitem__, b.__getitem__, self.score)
            out = 1 + sum(self.score(a[i], b[j]) for i, j in pairs)
            if len(self.scores) >= SCORES:
                self.scores.clear()
            self.scores[x, y] = out
        return out

    def common(self, a: tuple[int, ...], y: int) -> int:
        """Length of the longest common subsequence of the names of `a` and of y's children, which have no children (Hyyro, 2004): bits that went are matches."""
        places = self.places.get(y)
        if places is None:
            places = self.places[y] = {}
            for i, k in enumerate(self.kids[y]):
                places[self.names[k]] = places.get(self.names[k], 0) | 1 << i
        free = whole = (1 << len(self.kids[y])) - 1
        for k in a:
            if own := places.get(self.names[k]):
                met = free & own
                free = ((free + met) | (free - met)) & whole
        return (free ^ whole).bit_count()


def align(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists of any length: (matched nodes, matched positions in order)."""
    shapes = Shapes()
    pairs = partners_of(a, b, shapes)
    return sum(shapes.score(shapes.number(a[i]), shapes.number(b[j])) for i, j in pairs), pairs


def partners_of(a: list, b: list, shapes: Shapes) -> list[tuple[int, int]]:
    """`partners` of two lists of template nodes."""
    return partners([x[0] for x in a], [y[0] for y in b], lambda i: shapes.number(a[i]), lambda j: shapes.number(b[j]), shapes.score)


def partners(a: list[str], b: list[str], x, y, score) -> list[tuple[int, int]]:
    """Positions of the largest order-preserving match of two lists of names; of equally large ones that with the earliest positions.

    x(i) and y(j) number the trees of these names, and score(x(i), y(j)) counts matched nodes. Names
    in one list only match nothing. From the front on, equal trees are partners, as are those that
    alone have their name: no other match of theirs is larger. The rest is a dynamic program.
    """
    if not a or not b or (a == b and len(set(a)) == len(a)):
        return [(i, i) for i in range(min(len(a), len(b)))]
    right = Counter(b)
    rows = [i for i, name in enumerate(a) if name in right]
    left = Counter([a[i] for i in rows])
    columns = [j for j, name in enumerate(b) if name in left]
    pairs = []
    for i, j in zip(rows, columns, strict=False):
        if a[i] != b[j] or not (left[a[i]] == right[a[i]] == 1 or x(i) == y(j)):
            break
        left[a[i]] -= 1
        right[a[i]] -= 1
        pairs.append((i, j))
    rows, columns = rows[len(pairs) :], columns[len(pairs) :]
    if rows and columns:
        pairs += [(rows[i], columns[j]) for i, j in largest([x(i) for i in rows], [y(j) for j in columns], score)]
    return pairs


def largest(xs: list, ys: list, score) -> list[tuple[int, int]]:
    """The dynamic program of `partners`, a row at a time. Rows at even distances are kept and those between made again on the way back, so memory grows with len(ys) * sqrt(len(xs))."""
    kinds = {y: k for k, y in enumerate(dict.fromkeys(ys))}
    spots = np.array([kinds[y] for y in ys])
    gains: dict = {}

    def below(above: np.ndarray, x) -> np.ndarray:
        if x not in gains:
            if len(gains) * len(ys) >= 16 * SCORES:
                gains.clear()
            gains[x] = np.array([score(x, y) for y in kinds], np.int32)[spots]
        out = np.zeros_like(above)
        np.add(above[:-1], gains[x][: len(above) - 1], out=out[1:])
        np.maximum(out, above, out=out)
        return np.maximum.accumulate(out, out=out)

    step = math.isqrt(len(xs)) + 1
    row, kept = np.zeros(len(ys) + 1, np.int32), []
    for i, x in enumerate(xs):
        if i % step == 0:
            kept.append(row)
        row = below(row, x)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        start = (i - 1) // step * step
        best = [kept[start // step][: j + 1]]
        for x in xs[start:i]:
            best.append(below(best[-1], x))
        while i > start and j:
            if best[i - start][j] == best[i - start - 1][j]:
                i -= 1
            elif best[i - start][j] == best[i - start][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return pairs[::-1]


def merge(t: list, p: list, same_page: bool = False, shapes: Shapes | None = None) -> list:
    """Template t with tree p aligned into it; nodes without a partner are inserted in order."""
    shapes = shapes or Shapes()
    pairs = partners_of(t[6], p[6], shapes)
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(t[6]), len(p[6]))]:
        kids += t[6][i:x] + p[6][j:y]
        if x < len(t[6]) and y < len(p[6]):
            kids.append(merge(t[6][x], p[6][y], same_page, shapes))
        i, j = x + 1, y + 1
    pages = max(t[2], p[2]) if same_page else t[2] + p[2]
    return [t[0], t[1] or p[1], pages, min(t[3], p[3]), max(t[4], p[4]), t[5] + p[5], kids, min(t[7], p[7]), max(t[8], p[8]), articles(t[9], p[9])]


def mass(t: list) -> int:
    """Varying text below a template node, without what is skipped."""
    if skipped(t[0]):
        return 0
    own = t[5] if t[1] or t[3] != t[4] or t[2] < 2 else 0
    return own + sum(map(mass, t[6]))


def content_root(t: list) -> list[int]:
    """Path (child positions) of the node that holds the host's articles."""
    found: list[tuple[int, list[int]]] = []

    def look(node, path):
        if skipped(node[0]):
            return
        if node[0].split(".")[0] in ("article", "main") and not node[1]:
            found.append((node[2], path))
            return
        for i, kid in enumerate(node[6]):
            look(kid, [*path, i])

    look(t, [])
    if found and (best := max(found, key=lambda x: x[0]))[0] * 2 >= t[2]:
        return best[1]
    path, node = [], t
    whole = mass(t)
    while node[6]:  # down to the deepest node with most of the varying text
        i = max(range(len(node[6])), key=lambda i: mass(node[6][i]))
        if node[6][i][1] or node[6][i][0].split(".")[0] in ("p", "h1", "h2", "h3", "ul", "ol", "pre", "blockquote") or mass(node[6][i]) * 10 < whole * 6:
            break
        path, node = [*path, i], node[6][i]
    return path


def chars(t: list) -> int:
    """Text in and below a template node."""
    return t[5] + sum(map(chars, t[6]))


def constants(t: list, path: list[int]) -> set[tuple[int, ...]]:
    """Paths below the content root of nodes and runs of equal siblings that are template, if other text there varies.

    Those are on most of the pages that have their parent, with the same text in and below them on
    all, and stand beside at least LEAST_ARTICLES different articles: copies of one article show nothing.
    """
    root = t
    for i in path:
        root = root[6][i]
    out: set[tuple[int, ...]] = set()

    def look(node, at):
        for i, kid in enumerate(node[6]):
            here = (*at, i)
            most = kid[2] >= 3 and kid[2] * 2 > node[2] and len(kid[9]) >= LEAST_ARTICLES
            if most and kid[7] == kid[8] and chars(kid) and kid[0][:2] not in ("h1", "h2", "h3"):
                out.add(here)
            elif not kid[1]:
                look(kid, here)

    if mass(root):
        look(root, tuple(path))
    return out


def plan_of(template: list, alone: bool = False) -> list:
    """What extraction needs of a template: [name, mark, children], the children only where a mark lies below. A page `alone` has no constants."""
    path = content_root(template)
    marks = {**dict.fromkeys(() if alone else constants(template, path), CONSTANT), tuple(path): ROOT}
    ways = {at[:i] for at in marks for i in range(len(at))}

    def cut(node, at):
        return [node[0], marks.get(at, 0), [cut(k, (*at, i)) for i, k in enumerate(node[6])] if at in ways else []]

    return cut(template, ())


def text_of(page: Node, template: list) -> str:
    """`planned_text` by a host's template."""
    return planned_text(page, plan_of(template))


def planned_text(page: Node, plan: list) -> str:
    """The page's main text: blocks joined by a line break, white space inside a block as one space."""
    roots = _map(page, plan) or _map(page, plan_of(fold(page), alone=True))  # a page that lacks the host's content root is judged by itself
    blocks, line = [], []

    def end():
        text = SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    def walk(node):
        for kid in node.kids:
            if isinstance(kid, str):
                line.append(kid)
            elif kid.slot == "constant" or skipped(kid.sig) or (kid.tag == "header" and node.tag not in ("article", "main", "section")):
                line.append(" ")
            elif kid.tag in BLOCK:
                end()
                walk(kid)
                end()
            elif kid.tag == "br":
                line.append(" ")
            else:
                walk(kid)

    for root in roots:
        walk(root)
        end()
    return "\n".join(blocks)


def _map(page: Node, plan: list) -> list[Node]:
    """DOM nodes at the content root, in page order; nodes at constant places are marked on the way."""
    starts = [page] if plan[1] == ROOT else []
    todo = [(page, plan)]
    while todo:
        node, t = todo.pop()
        groups: list[list[Node]] = []
        for kid in node.kids if t[2] else ():
            if not isinstance(kid, str):
                if groups and groups[-1][0].sig == kid.sig:
                    groups[-1].append(kid)
                else:
                    groups.append([kid])
        if not groups:
            continue
        names, sigs = [k[0] for k in t[2]], [g[0].sig for g in groups]
        below = []
        for x, y in partners(names, sigs, names.__getitem__, sigs.__getitem__, lambda a, b: int(a == b)):
            if t[2][x][1] == CONSTANT:
                for g in groups[y]:
                    g.slot = "constant"
            elif t[2][x][1] == ROOT:
                starts += groups[y]
            if t[2][x][2]:
                below += [(g, t[2][x]) for g in groups[y]]
        todo += reversed(below)
    return starts


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _learn(batches):
    templates: dict[str, list] = {}
    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if text:
                t = fold(parse(text))
                templates[host] = merge(templates[host], t) if host in templates else t
    if templates:
        yield pa.RecordBatch.from_pydict({"host": list(templates), "template": [json.dumps(t) for t in templates.values()]}, pa.schema([("host", pa.string()), ("template", pa.string())]))


def _combine(batches):
    """Rows sorted by host: the partial templates of each host become one."""
    host, t = None, None
    for batch in batches:
        for h, raw in zip(batch.column("host").to_pylist(), batch.column("template").to_pylist(), strict=True):
            if h == host:
                t = merge(t, json.loads(raw))
                continue
            if t is not None:
                yield pa.RecordBatch.from_pydict({"host": [host], "template": [json.dumps(t)]}, pa.schema([("host", pa.string()), ("template", pa.string())]))
            host, t = h, json.loads(raw)
    if t is not None:
        yield pa.RecordBatch.from_pydict({"host": [host], "template": [json.dumps(t)]}, pa.schema([("host", pa.string()), ("template", pa.string())]))


def _plan(batches):
    for batch in batches:
        plans = [json.dumps(plan_of(json.loads(raw))) for raw in batch.column("template").to_pylist()]
        yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "plan": pa.array(plans, pa.string())})


def _extract(batches):
    known: dict[str, list] = {}
    for batch in batches:
        out = []
        for text, raw in zip(batch.column("html").to_pylist(), batch.column("plan").to_pylist(), strict=True):
            if not text or not raw:
                out.append("")
                continue
            if raw not in known:
                if len(known) > 256:
                    known.clear()
                known[raw] = json.loads(raw)
            out.append(planned_text(parse(text), known[raw]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template as JSON) learnt from every page."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = "host string, template string"
    parts = rows.mapInArrow(_learn, schema)
    for deal in (["host", F.pmod(F.xxhash64("template"), F.lit(32))], ["host"]):  # a hot host's partial templates meet in 32 tasks first
        parts = parts.repartition(*deal).sortWithinPartitions("host", "template").mapInArrow(_combine, schema)
    return parts


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages; null or empty html has empty text.

    Pages without a host share one template. Pages of any depth and length pass (see DEPTH). Repeated rows give repeated results; other columns are
    ignored. Templates keep every node of their pages; what a page is joined with is only the plan, the
    names around content root and constants. Plans are broadcast only while all of them together stay under
    BROADCAST_BYTES; beyond that they are joined, with a hot host's partitions split by Spark.
    """
    plans, _ = materialise(induce(pages, url_col, html_col).mapInArrow(_plan, "host string, plan string"), "wrapper")
    size = plans.agg(F.sum(F.octet_length("plan"))).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(F.broadcast(plans) if size <= BROADCAST_BYTES else plans, "host", "left")
    out = joined.select("id", "url", "html", "plan").mapInArrow(_extract, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
