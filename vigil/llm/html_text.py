"""HTML extraction (11): minimum-cut labelling of a page's blocks.

1. A page is read into text blocks: pieces of text between the starts and ends
   of block elements, with the element that holds them.  References are
   decoded, white space inside a block becomes one space.
2. Every block has a cost, the log odds of being content.  What the mark-up
   says (elements, roles, words of class and id; the nearest ancestor counts)
   is worth up to 10; a logistic model of the block's shape adds up to 3.  The
   model is trained on blocks whose mark-up is clear, its features leave the
   mark-up out, and it decides where the mark-up says nothing.
3. Costs are terminal capacities: content from the source, boilerplate to the
   sink.  Neighbouring blocks, the closer in the element tree the more, and
   successive blocks below one container are joined by smoothness edges.  A
   maximum flow gives the minimum cut; blocks that cannot reach the sink any
   more are the main text, in page order, one line each.

Scripts, styles, comments, templates, the title and form fields are mark-up and
no blocks.  Null and empty pages give an empty text; a page without mark-up is
judged by shape alone.  Broken mark-up is read as it comes: an unfinished tag
ends with the page, an end tag without a start is passed over.  Every row is
judged alone, so repeated, null or tied ids give a row each, and very long pages
are read whole.  Extra columns are ignored whatever their names; an empty table
gives no rows.
"""
from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import blocks, texts

#: Elements that begin and end blocks of text.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript object ol optgroup option p pre
search section select summary svg table tbody td template tfoot th thead tr ul""".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag as it stands, and is no text of the page.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements whose content is not shown.
UNSHOWN = frozenset("noscript object svg template".split())
HEAD = frozenset("base head link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
#: start tag -> (elements that it ends, elements that it does not look beyond)
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}

#: Log odds that mark-up is worth.
TAG_EVIDENCE = {"article": 10.0, "main": 8.0, "nav": -10.0, "aside": -10.0, "footer": -10.0, "header": -10.0, "form": -10.0, "button": -10.0,
                "select": -10.0, "menu": -10.0, "dialog": -10.0, "label": -10.0, "fieldset": -10.0, "head": -10.0}
HINT_EVIDENCE = {True: 3.0, False: -8.0}
ROLES = {"article": "article", "main": "main", "navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside",
         "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog", "menu": "menu", "menubar": "menu"}
CONTENT_WORDS = frozenset("article content entry main post story".split())
BOILERPLATE_WORDS = frozenset("""banner breadcrumb breadcrumbs byline consent cookie cookies copyright footer gdpr header login masthead
menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup search share sharing sidebar signup
social subscribe subscription tags toolbar topbar widget""".split())
#: Words that hold for everything inside, articles included.
FIRM_WORDS = frozenset("""ad ads advert advertisement adverts advertising comment comments disqus promo promoted recommended related replies
reply respond sponsor sponsored teaser teasers""".split())
FIRM_TAGS = frozenset({"nav", "aside", "footer"})

#: Smoothness: neighbours, neighbours in the tree (divided by their distance), successive blocks of a container.
NEXT, NEAR, SIBLING = 0.5, 1.0, 0.75
#: Steps in the element tree beyond which two blocks are not near.
NEAR_STEPS = 8
UNIT = 1000  # capacities are whole numbers of 1/UNIT

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TELLING = re.compile(r"class|\bid|role|itemprop|hidden|style", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hints(attributes: str) -> tuple[str | None, bool | None, bool]:
    """What attributes say: (element that a role stands for, content or boilerplate, whether that holds for all inside)."""
    if not TELLING.search(attributes):
        return None, None, False
    role, words = None, set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "itemprop"):
            words.update(w.lower() for w in WORD.findall(value))
        elif name == "role":
            role = ROLES.get(value.strip().lower())
        elif (name == "style" and HIDDEN.search(value)) or (name == "aria-hidden" and value.lower() == "true"):
            return role, False, True
    bare = ATTRIBUTE.sub(" ", attributes).lower().split()
    if "hidden" in bare or words & FIRM_WORDS:
        return role, False, True
    if words & BOILERPLATE_WORDS:
        return role, False, False
    return role, True if words & CONTENT_WORDS else None, False


class Page:
    """Blocks of a page in order: text, element, characters in links, log odds of the mark-up."""

    def __init__(self, source: str):
        self.parent, self.depth, self.tag = [-1], [0], [""]
        self.evidence, self.firm, self.article, self.shown = [0.0], [False], [False], [True]
        self.texts, self.nodes, self.links = [], [], []
        self.stack, self.open = [0], Counter()
        self.pieces, self.linked, self.link_at = [], 0, -1
        self._read(source)

    def _read(self, source: str) -> None:
        at, token = 0, TOKEN.search(source)
        while token:
            if token.start() > at:
                self._text(source[at:token.start()])
            at = token.end()
            end, name, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
            if name:
                name = name.lower()
                if end:
                    self._end(name)
                else:
                    self._start(name, attributes)
                    if name in RAW:
                        close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                        at = close.end() if close else len(source)
            token = TOKEN.search(source, at)
        if at < len(source):
            self._text(source[at:])
        self._flush()

    def _text(self, piece: str) -> None:
        if "&" in piece:
            piece = html_lib.unescape(piece)
        self.pieces.append(piece)
        if self.link_at >= 0:
            self.linked += len(piece)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            node = self.stack[-1]
            if text and self.shown[node]:
                self.texts.append(text)
                self.nodes.append(node)
                self.links.append(min(self.linked, len(text)))
            self.pieces, self.linked = [], 0

    def _pop(self) -> str:
        node = self.stack.pop()
        self.open[self.tag[node]] -= 1
        if self.link_at == node:
            self.link_at = -1
        return self.tag[node]

    def _start(self, name: str, attributes: str) -> None:
        if name not in BLOCK:
            if name == "br":
                self.pieces.append(" ")
            elif name == "a":
                self.link_at = self.stack[-1] if "href" in attributes.lower() else -1
            return
        self._flush()
        if self.open["head"] and name not in HEAD:
            self._close(({"head"}, set()))
        if self.open["p"] and name in ENDS_P:
            self._close(({"p"}, {"table", "td", "th", "button"}))
        if name in ENDS:
            self._close(ENDS[name])
        if name in VOID or (name in ("html", "body") and self.open[name]):
            return
        self._push(name, attributes)

    def _close(self, rule: tuple) -> None:
        """Ends the innermost of the elements of rule[0], unless one of rule[1] lies inside of it."""
        ended, beyond = rule
        if not any(self.open[t] for t in ended):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag in ended:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in beyond:
                return

    def _end(self, name: str) -> None:
        if name == "a":
            self.link_at = -1
        elif name == "br":
            self.pieces.append(" ")
        elif name in BLOCK:
            self._flush()
            if self.open[name]:
                while self._pop() != name:
                    pass

    def _push(self, name: str, attributes: str) -> None:
        up = self.stack[-1]
        value, firm, article = self.evidence[up], self.firm[up], self.article[up]
        role, hint, hint_firm = hints(attributes) if name not in ("html", "body") else (None, None, False)
        kind = name if name in TAG_EVIDENCE else role or name
        told = TAG_EVIDENCE.get(kind, 0.0)
        if not firm:
            if hint is False and (hint_firm or kind not in ("article", "main")):
                value, firm = HINT_EVIDENCE[False], hint_firm
            elif told > 0:
                value, article = told, True
            elif told < 0:
                value, firm = told, kind in FIRM_TAGS
            elif name in HEADINGS and article and value < 0 and self._in_header(up):
                value = TAG_EVIDENCE["article"]  # the article's own title, set in its header
            elif hint and value >= 0:
                value = max(value, HINT_EVIDENCE[True])
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.tag.append(name)
        self.evidence.append(value)
        self.firm.append(firm)
        self.article.append(article)
        self.shown.append(self.shown[up] and name not in UNSHOWN)
        self.stack.append(len(self.tag) - 1)
        self.open[name] += 1

    def _in_header(self, node: int) -> bool:
        for _ in range(NEAR_STEPS):
            if self.tag[node] == "header":
                return True
            if node <= 0 or self.tag[node] == "article":
                return False
            node = self.parent[node]
        return False

    def steps(self, a: int, b: int) -> int:
        """Steps between two elements in the tree; more than NEAR_STEPS counts as NEAR_STEPS + 1."""
        n = 0
        while a != b and n <= NEAR_STEPS:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return n

    def edges(self) -> list[tuple[int, int, int]]:
        """Smoothness edges (block, later block, capacity)."""
        out, last = [], {}
        for k, node in enumerate(self.nodes):
            container = self.parent[node]
            if k:
                steps = self.steps(self.nodes[k - 1], node)
                near = NEAR / (1 + steps) if steps <= NEAR_STEPS else 0.0
                out.append((k - 1, k, round(UNIT * (NEXT + near))))
            before = last.get(container, k)
            if before < k - 1:
                out.append((before, k, round(UNIT * SIBLING)))
            last[container] = k
        return out

    def shapes(self) -> np.ndarray:
        """Features of every block that leave elements' meaning, classes and roles out."""
        n = len(self.texts)
        rows = np.empty((n, len(SHAPE)))
        for k, text in enumerate(self.texts):
            size, words = len(text), text.count(" ") + 1
            tag = self.tag[self.nodes[k]]
            rows[k] = (1.0, np.log1p(size) / 6, self.links[k] / size, min(words, 50) / 50, text[-1] in ".!?:;\"”»…",
                       (text.count(",") + text.count(". ")) / words, text[0].islower(), min(size / words, 20) / 10, tag == "p",
                       tag in HEADINGS, tag == "li", 2 * abs((k + .5) / n - .5))
        return rows


#: Features, and the weights that the trained ones are drawn to where there is little to learn from.
SHAPE = {"bias": -1.0, "length": 2.0, "links": -4.0, "words": 1.0, "sentence": 1.0, "commas": 2.0, "lower": -0.5, "word length": 0.0, "p": 1.0,
         "heading": 0.5, "li": -0.5, "edge of page": -1.0}
SHAPE_LIMIT = 3.0


def min_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For every node whether it lies on the source's side of a minimum cut (on the largest such side).

    excess > 0: capacity from the source, < 0: to the sink; edges have their
    capacity both ways.  Augmenting paths in layers (Dinic).
    """
    n, excess = len(excess), list(excess)
    arcs, to, room = [[] for _ in range(n)], [], []
    for a, b, capacity in edges:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        room += (capacity, capacity)
    while True:
        layer = [-1] * n
        front = [k for k in range(n) if excess[k] > 0]
        sources, reached, depth = front, False, 0
        for k in front:
            layer[k] = 0
        while front and not reached:
            depth, behind = depth + 1, front
            front = []
            for k in behind:
                for arc in arcs[k]:
                    other = to[arc]
                    if room[arc] and layer[other] < 0:
                        layer[other] = depth
                        front.append(other)
                        reached = reached or excess[other] < 0
        if not reached:
            break
        tried = [0] * n
        for source in sources:
            path, node = [], source
            while excess[source] > 0:
                if excess[node] < 0:
                    flow = min(excess[source], -excess[node], *(room[arc] for arc in path))
                    for arc in path:
                        room[arc] -= flow
                        room[arc ^ 1] += flow
                    excess[source] -= flow
                    excess[node] += flow
                    path, node = [], source
                    continue
                while tried[node] < len(arcs[node]):
                    arc = arcs[node][tried[node]]
                    if room[arc] and layer[to[arc]] == layer[node] + 1:
                        break
                    tried[node] += 1
                if tried[node] < len(arcs[node]):
                    path.append(arc)
                    node = to[arc]
                elif path:
                    node = to[path.pop() ^ 1]
                    tried[node] += 1
                else:
                    break
    sink = [k for k in range(n) if excess[k] < 0]
    out = [True] * n
    for k in sink:
        out[k] = False
    while sink:  # whatever can still reach the sink
        k = sink.pop()
        for arc in arcs[k]:
            other = to[arc]
            if out[other] and room[arc ^ 1]:
                out[other] = False
                sink.append(other)
    return out


def label(page: Page, weights: np.ndarray) -> list[bool]:
    """For every block whether it is content."""
    if not page.texts:
        return []
    shape = np.clip(page.shapes() @ weights, -SHAPE_LIMIT, SHAPE_LIMIT)
    costs = np.rint(UNIT * (shape + np.array([page.evidence[k] for k in page.nodes]))).astype(np.int64)
    return min_cut(costs.tolist(), page.edges())


def train(features: np.ndarray, content: np.ndarray, rounds: int = 25, pull: float = 2.0) -> np.ndarray:
    """Weights of a logistic model by Newton steps, both classes of equal weight, drawn to the given ones."""
    start = np.array(list(SHAPE.values()))
    weights = start.copy()
    if not len(features) or content.all() or not content.any():
        return weights
    share = np.where(content, 0.5 / content.mean(), 0.5 / (1 - content.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (share * (p - content)) + pull * (weights - start)
        bend = (features * (share * p * (1 - p) + 1e-9)[:, None]).T @ features + pull * np.eye(len(start))
        weights = weights - np.linalg.solve(bend, slope)
    return weights


def fit(pages: DataFrame, max_pages: int = 400, page_blocks: int = 64, key: str = "page_id", html: str = "html") -> np.ndarray:
    """Weights of the shape model from at most max_pages different pages (by a hash), page_blocks clearly marked blocks of each."""
    rows = texts(pages.filter(F.col(html).isNotNull()), F.xxhash64(F.col(key).cast("string"), F.col(html)).alias("hash"), text=html)
    chosen = rows.select("hash").distinct().orderBy("hash").limit(max_pages)
    sample = rows.join(F.broadcast(chosen), "hash").dropDuplicates(["hash"])  # the broadcast side has max_pages rows

    def features(batches):
        import pyarrow as pa
        for ids, data in blocks(batches):
            for (number,), source in zip(ids, data):
                page = Page(source.decode("utf-8", "replace"))
                clear = [k for k, node in enumerate(page.nodes) if abs(page.evidence[node]) >= 8]
                clear = clear[::-(-len(clear) // page_blocks) or 1]
                if clear:
                    shape = page.shapes()[clear]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(clear)), pa.array([page.evidence[page.nodes[k]] > 0 for k in clear]),
                                                      pa.array(shape.tolist(), pa.list_(pa.float64()))], ["hash", "content", "shape"])

    got = sample.mapInArrow(features, "hash long, content boolean, shape array<double>").toPandas()
    got = got.sort_values(["hash", "content"], kind="stable")
    shape = np.array(got["shape"].tolist()).reshape(len(got), len(SHAPE))
    order = np.lexsort((*shape.T[::-1], got["hash"].to_numpy()))  # the same order however Spark hands the rows over
    return train(shape[order], got["content"].to_numpy(dtype=bool)[order])


def extract(pages: DataFrame, weights: np.ndarray | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_blocks, n_kept) per page."""
    weights = fit(pages, key=key, html=html) if weights is None else weights
    kind = pages.schema[key].dataType

    def run(batches):
        import pyarrow as pa
        for ids, data in blocks(batches):
            out, n_blocks, n_kept = [], [], []
            for source in data:
                page = Page(source.decode("utf-8", "replace"))
                kept = [t for t, good in zip(page.texts, label(page, weights)) if good]
                out.append("\n".join(kept))
                n_blocks.append(len(page.texts))
                n_kept.append(len(kept))
            yield pa.RecordBatch.from_arrays([
                pa.array([i[0] for i in ids], pa.string()), pa.array([i[1] for i in ids], pa.string()), pa.array(out, pa.string()),
                pa.array([len(t) for t in out], pa.int64()), pa.array(n_blocks, pa.int64()), pa.array(n_kept, pa.int64())],
                ["id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = texts(pages, F.col(key).cast("string").alias("id"), F.col(url).alias("url"), text=html)
    rows = rows.mapInArrow(run, "id string, url string, text string, n_chars long, n_blocks long, n_kept long")
    return rows.select(F.col("id").cast(kind).alias(key), F.col("url").alias(url), "text", "n_chars", "n_blocks", "n_kept")
