"""Main text of pages by wrappers learned from pages of the same host.

Every page is read into a tree of its blocks.  Neighbours of equal shape become one repeated node, and each host's pages
are aligned by simple tree matching with the page of its commonest shape.  A text that stands in the same node on nearly
all different pages is template and is dropped; what varies is content.  Menus, adverts and footers whose words change from
page to page vary too, so regions that HTML or a class name marks as such never count as content; an ``article``, or else a
``main``, bounds it where there is one.

Trees travel as hashes, not as text: one row per different page and host, counted by slots, so a host with a third of all
pages is no group in one task, and the result doesn't depend on the order or the partitions of pages.

Defined results: a null or empty page has an empty text and 0 characters; a page without a host has no wrapper.  Repeated rows get
equal results and count once for the wrapper, as do pages of a host with the same content.  Hosts with fewer than
``LEAST_PAGES`` different pages have no wrapper.  Extra columns are not read.
"""

import hashlib
import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import stored

#: A host needs so many different pages, and a template text the given share of them.
LEAST_PAGES = 10
CONSTANT = 0.95
#: Wrappers up to so many bytes in all are sent to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Up to so many pairs of children the table is made by plain loops, beyond in numpy; both find the same pairs.
TABLE_PAIRS = 40_000
#: Deeper elements count as children of the one at this depth when trees are aligned; texts are read at any depth.
DEEPEST = 100

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"}
DROPPED = {"aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "map", "menu", "nav", "object", "select", "svg",
           "template", "video"} | RAW - {"xmp"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
         "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation",
         "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies",
         "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
OUTER_MARKS = {"header"}  # inside an article a header holds its title
MODIFIERS = {"has", "with", "no", "non", "without", "is", "hide"}
#: What an opening tag ends, up to the given ancestors.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tr"}, {"table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']++|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*>?""", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """The elements of a page as parallel lists, in page order, and its blocks as (element, text)."""

    def __init__(self, html: str):
        self.tag, self.attrs, self.parent, self.depth, self.blocks = ["#page"], [""], [-1], [0], []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, opened, buffer, at = [0], Counter(), [], 0
        skipped = {}  # open inline elements that don't count, and where their text starts in the buffer

        def flush():
            if buffer:
                node, start = next(iter(skipped.items()), (None, len(buffer)))
                text = " ".join("".join(buffer[:start]).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1] if node is None else self.parent[node], text))
                skipped.update(dict.fromkeys(skipped, 0))

        def pop_to(place: int):
            for k in stack[place:]:
                opened[self.tag[k]] -= 1
                if k in skipped:
                    del buffer[skipped.pop(k):]
            del stack[place:]

        def said(text: str):
            buffer.append(entities.unescape(text) if "&" in text else text)

        while True:
            token = _TOKEN.search(html, at)
            if token is None:
                if at < len(html):
                    said(html[at:])
                break
            if token.start() > at:
                said(html[at:token.start()])
            at = token.end()
            close, tag, attrs = token.groups()
            if not tag:
                continue
            tag = tag.lower()
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    buffer.append(" ")
                continue
            if close:
                if tag not in INLINE:
                    flush()
                if opened[tag]:
                    place = len(stack) - 1
                    while self.tag[stack[place]] != tag:
                        place -= 1
                    pop_to(place)
                continue
            if tag in RAW:
                end = _END[tag].search(html, at)
                inside = html[at:end.start() if end else len(html)]
                if tag == "xmp":
                    flush()
                    buffer.append(inside)
                    flush()
                shut = html.find(">", end.start()) if end else -1
                at = shut + 1 if shut >= 0 else len(html)
                continue
            if tag in INLINE:
                if not (attrs.strip() and _hidden_or_marked(tag, attrs)):
                    continue
                skipped[len(self.tag)] = len(buffer)
            else:
                flush()
                if self.tag[stack[-1]] == "p":
                    pop_to(len(stack) - 1)
            if tag in ENDS:
                ended, limits = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in limits:
                        break
                    if name in ended:
                        pop_to(k)
                        break
            if attrs.endswith("/") and tag in ("svg", "path", "g"):
                continue
            self.tag.append(tag)
            self.attrs.append(attrs)
            self.parent.append(stack[-1])
            self.depth.append(self.depth[stack[-1]] + 1)
            stack.append(len(self.tag) - 1)
            opened[tag] += 1
        flush()

    def content(self) -> list[bool]:
        """Whether each block is content as far as its regions tell."""
        n = len(self.tag)
        holds = [False] * n  # a main or the first article hangs below
        first = self.tag.index("article") if "article" in self.tag else None
        for k in range(n - 1, 0, -1):
            if holds[k] or k == first or self.tag[k] == "main":
                holds[self.parent[k]] = True
        inside, in_main, outer, marked = [False] * n, [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            p, tag, attrs = self.parent[k], self.tag[k], self.attrs[k]
            inside[k], in_main[k] = inside[p] or tag == "article", in_main[p] or tag == "main" or 'role="main"' in attrs
            within = inside[k] or in_main[k]
            outer[k] = outer[p] or tag in DROPPED or (tag == "header" and not within)
            marked[k] = marked[p]
            if attrs and not (outer[k] and marked[k]):
                roles, hidden, marks = _described(tag, attrs)
                outer[k] = outer[k] or hidden or bool(roles & ROLES)
                if not holds[k] and tag not in ("html", "body", "main"):
                    marked[k] = marked[k] or bool(marks & MARKS) or (not within and bool(marks & OUTER_MARKS))
        for bars in ((outer, marked), (outer,)):  # if the marks leave no text, only elements and roles count
            free = [not any(bar[k] for bar in bars) for k, _ in self.blocks]
            for region in (inside, in_main):
                if any(f and region[k] for f, (k, _) in zip(free, self.blocks)):
                    return [f and region[k] for f, (k, _) in zip(free, self.blocks)]
            if any(free):
                return free
        return [False] * len(self.blocks)


def _described(tag: str, attrs: str) -> tuple[set, bool, set]:
    """Roles, whether an element is hidden, and the words of its class and id."""
    roles, hidden, marks = set(), False, set()
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                marks.update(w for k, w in enumerate(words) if k == 0 or words[k - 1] not in MODIFIERS)
        elif name == "role":
            roles.update(value.lower().split())
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return roles, hidden, marks


def _hidden_or_marked(tag: str, attrs: str) -> bool:
    roles, hidden, marks = _described(tag, attrs)
    return hidden or bool(roles & ROLES) or bool(marks & MARKS)


class Tree:
    """A page's tree for matching: (label, children, texts) with neighbours of equal shape united."""

    def __init__(self, labels: list[int], parents: list[int], texts: list[list[int]]):
        self.labels, self.parents, self.texts = labels, parents, [set(t) for t in texts]
        self.children = [[] for _ in labels]
        for k, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(k)
        self.shapes = [0] * len(labels)
        for k in range(len(labels) - 1, -1, -1):
            self.shapes[k] = hash((labels[k], tuple(self.shapes[c] for c in self.children[k])))

    @classmethod
    def of(cls, page: Page) -> tuple["Tree", list[int], list[int]]:
        """The united tree, its node for every element, and the hash of every block."""
        n = len(page.tag)
        hashes = [_hash(t) for _, t in page.blocks]
        up = list(page.parent)
        for k in range(1, n):  # elements too deep hang on their ancestor at DEEPEST
            while up[k] > 0 and page.depth[up[k]] > DEEPEST:
                up[k] = up[up[k]]
        full = cls([_hash(page.tag[k] + " " + _class(page.attrs[k])) for k in range(n)], up, [[] for _ in range(n)])
        place, labels, parents, texts = [0] * n, [full.labels[0]], [-1], [set()]
        todo = [(0, [0])]
        while todo:  # a node stands for a run of elements; it is numbered before its children
            now, run = todo.pop()
            columns, groups = [full.children[k] for k in run], []
            if len(columns) == 1:
                for c in columns[0]:
                    if groups and full.shapes[groups[-1][-1]] == full.shapes[c]:
                        groups[-1].append(c)
                    else:
                        groups.append([c])
            else:  # equal shapes: the first child of each, the second of each, ...
                for group in zip(*columns):
                    if groups and full.shapes[groups[-1][-1]] == full.shapes[group[0]]:
                        groups[-1].extend(group)
                    else:
                        groups.append(list(group))
            for group in groups:
                for c in group:
                    place[c] = len(labels)
                todo.append((len(labels), group))
                labels.append(full.labels[group[0]])
                parents.append(now)
                texts.append(set())
        for (k, _), h in zip(page.blocks, hashes):
            texts[place[k]].add(h)
        return cls(labels, parents, texts), place, hashes

    def matched(self, other: "Tree") -> list[tuple[int, int]]:
        """Pairs of nodes by simple tree matching: the most nodes of equal label in equal order under matched parents."""
        known = {}

        def weight(a: int, b: int) -> int:
            """Nodes matched at and below a and b, with one more where they share a text."""
            if self.labels[a] != other.labels[b]:
                return 0
            if (a, b) not in known:
                pairs = self._aligned(self.children[a], other.children[b], other, weight)
                known[a, b] = (1 + (not self.texts[a].isdisjoint(other.texts[b])) + sum(w for w, _, _ in pairs), [p[1:] for p in pairs])
            return known[a, b][0]

        if not weight(0, 0):
            return []
        out, todo = [], [(0, 0)]
        while todo:
            pair = todo.pop()
            out.append(pair)
            todo.extend(known[pair][1])
        return out

    def _aligned(self, mine: list[int], theirs: list[int], other: "Tree", weight) -> list[tuple[int, int, int]]:
        if len(mine) * len(theirs) > TABLE_PAIRS:
            return self._in_rows(mine, theirs, other, weight)
        best = [[0] * (len(theirs) + 1) for _ in range(len(mine) + 1)]
        for i, a in enumerate(mine, 1):
            above, row = best[i - 1], best[i]
            for j, b in enumerate(theirs, 1):
                here = max(above[j], row[j - 1])
                w = weight(a, b)
                row[j] = max(here, above[j - 1] + w) if w else here
        out, i, j = [], len(mine), len(theirs)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((weight(mine[i], theirs[j]), mine[i], theirs[j]))
        return out

    def _in_rows(self, mine: list[int], theirs: list[int], other: "Tree", weight) -> list[tuple[int, int, int]]:
        """The same path through the same table, for many children.

        Rows of the table are numpy arrays, of which every so many-th is kept and the others are made again on the
        way back.  Nodes of equal shape whose texts below are equal too, as far as both sides have them, weigh the same.
        """
        weights, likes = {}, {}
        under_mine, under_theirs = [self._below(a) for a in mine], [other._below(b) for b in theirs]
        places, plain = defaultdict(list), {}
        kinds, shapes = np.unique([other.shapes[b] for b in theirs], return_inverse=True)
        for j, texts in enumerate(under_theirs):
            for text in texts:
                places[text].append(j)

        def like(tree: Tree, k: int, shared: frozenset) -> int:
            if not shared:
                return tree.shapes[k]
            key = (tree is self, k, shared)
            if key not in likes:
                likes[key] = hash((tree.labels[k], frozenset(tree.texts[k] & shared), tuple(like(tree, c, shared) for c in tree.children[k])))
            return likes[key]

        def weighed(i: int, j: int, shared: frozenset) -> int:
            key = (like(self, mine[i], shared), like(other, theirs[j], shared), bool(shared))
            if key not in weights:
                weights[key] = weight(mine[i], theirs[j])
            return weights[key]

        def row_of(i: int) -> np.ndarray:
            sharing = {j for text in under_mine[i] for j in places.get(text, ())}
            apart = plain.setdefault(self.shapes[mine[i]], np.full(len(kinds), -1))  # by shape, where no text is shared
            row = apart[shapes]
            for j in sharing:
                row[j] = weighed(i, j, frozenset(under_mine[i] & under_theirs[j]))
            while row.size and row.min() < 0:
                j = int(row.argmin())
                apart[shapes[j]] = weighed(i, j, frozenset())
                row[(row < 0) & (shapes == shapes[j])] = apart[shapes[j]]
            return row

        def following(above: np.ndarray, i: int) -> np.ndarray:
            here = above.copy()
            np.maximum(here[1:], above[:-1] + row_of(i), out=here[1:])
            return np.maximum.accumulate(here)

        step = math.isqrt(len(mine)) + 1
        best, kept = np.zeros(len(theirs) + 1, np.int64), []
        for i in range(len(mine)):
            if i % step == 0:
                kept.append(best)
            best = following(best, i)
        out, j = [], len(theirs)
        for block in range(len(kept) - 1, -1, -1):
            start = block * step
            rows = [kept[block]]
            for i in range(start, min(start + step, len(mine))):
                rows.append(following(rows[-1], i))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    a, b = mine[start + i], theirs[j]
                    out.append((weight(a, b), a, b))
        return out

    def _below(self, k: int) -> set[int]:
        """The texts of a node and of all below it."""
        texts, todo = set(), [k]
        while todo:
            now = todo.pop()
            texts |= self.texts[now]
            todo.extend(self.children[now])
        return texts


def _class(attrs: str) -> str:
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        if name.lower() == "class":
            return next((v for v in values if v), "")
    return ""


_TREE = "labels array<long>, parents array<int>, texts array<array<long>>"
_TREE_ARROW = pa.struct([("labels", pa.list_(pa.int64())), ("parents", pa.list_(pa.int32())), ("texts", pa.list_(pa.list_(pa.int64())))])


def _trees(pages: DataFrame) -> DataFrame:
    """(host, digest, shape, tree) of each different content of a host once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(html)
                tree, _, hashes = Tree.of(page)
                digest = _hash(" ".join(str(h) for h, kept in zip(hashes, page.content()) if kept))
                shape = _hash(",".join(map(str, (*tree.labels, *tree.parents))))
                rows.append((host, digest, shape, {"labels": tree.labels, "parents": tree.parents, "texts": [sorted(t) for t in tree.texts]}))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), _TREE_ARROW))],
                                                 ["host", "digest", "shape", "tree"])

    made = pages.where("host <> ''").select("host", "html").mapInArrow(run, f"host string, digest long, shape long, tree struct<{_TREE}>")
    return stored(made.groupBy("host", "digest").agg(F.min(F.struct("shape", "tree")).alias("s")).select("host", "digest", "s.*"), "trees")


def _sent(wrappers: DataFrame) -> DataFrame:
    size = wrappers.agg(F.sum(F.size("tree.labels") * 12 + F.size(F.flatten("tree.texts")) * 8).alias("bytes")).first().bytes or 0
    return F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree): each host's tree of its commonest shape, with only the texts that nearly all its pages have in that node.

    ``pages`` has host and html.
    """
    trees = _trees(pages)
    shapes = trees.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("tree").alias("tree"))
    model = stored(shapes.groupBy("host").agg(F.sum("n").alias("pages"), F.max_by("tree", F.struct("n", -F.size("tree.labels"), "shape")).alias("tree"))
                   .where(F.col("pages") >= LEAST_PAGES), "models")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, nodes, texts, models = [], [], [], {}
            for host, tree, model in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in models:
                    models[host] = Tree(**model)
                page = Tree(**tree)
                for a, b in models[host].matched(page):
                    for text in models[host].texts[a] & page.texts[b]:
                        hosts.append(host)
                        nodes.append(a)
                        texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(texts, pa.int64())], ["host", "node", "text"])

    same = (trees.select("host", "tree").join(_sent(model.select("host", F.col("tree").alias("model"), "tree")).drop("tree"), "host")
            .select("host", "tree", "model").mapInArrow(run, "host string, node int, text long").groupBy("host", "node", "text").agg(F.count("*").alias("n")))
    constant = (same.join(model.select("host", "pages"), "host").where(F.col("n") >= CONSTANT * F.col("pages"))
                .groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("constant")))  # at most the texts of one page
    texts = F.transform(F.sequence(F.lit(0), F.size("tree.labels") - 1), lambda k: F.transform(
        F.filter("constant", lambda c: c["node"] == k), lambda c: c["text"]))
    return stored(model.join(constant, "host").select("host", F.struct("tree.labels", "tree.parents", texts.alias("texts")).alias("tree")), "wrappers")


def main_text(html: str, wrapper: Tree | None = None) -> str:
    """The content blocks of a page, one a line."""
    page = Page(html)
    kept = page.content()
    template = set()
    if wrapper is not None and any(kept):
        tree, place, hashes = Tree.of(page)
        template = {(b, t) for a, b in wrapper.matched(tree) for t in wrapper.texts[a]}
        kept = [k and (place[node], h) not in template for k, (node, _), h in zip(kept, page.blocks, hashes)]
    return "\n".join(text for k, (_, text) in zip(kept, page.blocks) if k)


def html_extraction(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    learned = wrappers(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            known = {} if len(known) > 1000 else known
            texts = []
            for html, host, tree in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if tree is not None and host not in known:
                    known[host] = Tree(**tree)
                texts.append(main_text(html, known[host] if tree is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return (rows.join(_sent(learned), "host", "left").select("page_id", "url", "html", "host", "tree")
            .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long"))
