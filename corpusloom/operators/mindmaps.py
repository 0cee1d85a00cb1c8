"""Mind maps: trees of labels for each scope, from Markdown, from the modules of a course, and from a graph of concepts.

A scope's rows are read in their order as a stream, and only its tree is held, of which the node budget bounds the size. So a scope may have any
number of rows.

Defined results: labels are compared by their casefolded, single-spaced wording; ties go to the node that comes first in the tree, for parents to
the deeper one first; a scope of which less than three branches come out has no map; null labels and empty scopes give nothing.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship

#: Sizes of a map.
FAN_OUT, LEAVES, BRANCHES, FEWEST, LABEL, SUPPORTED = 7, 5, 10, 3, 80, 9
#: How lines of Markdown are read, and what is noise.
HEADING, BULLET = re.compile(r"^(#{1,4})\s+(.+?)\s*$"), re.compile(r"^\s*(?:[-*•▶]|\d+[.)])\s+(.+?)\s*$")
BOLD = re.compile(r"^\s*\*\*(.{4,80}?)\*\*\s*:?\s*$")
MARKUP = re.compile(r"!\[[^\]]*]\([^)]+\)|<[^>]+>|\${1,2}.*?\${1,2}|[*_`>#]")
NOISE = ("navigation", "footer", "toolbar", "logo", "seal", "presentation controls")
#: Order in which kinds of graph nodes are placed, and relations that show.
KINDS = ("section", "concept", "procedure", "skill", "formula", "objective", "example", "misconception", "assessment")
RELATIONS = ("requires", "prerequisite_of", "explains", "applies", "contrasts_with", "causes", "solves")
CONFIDENT, EACH = 0.65, 2

OUTPUT = "scope bigint, node int, parent int, depth int, pos int, text string"


def key(label: str) -> str:
    return " ".join(label.casefold().split())


def words(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w{3,}", text.casefold()))


def label(text: str | None) -> str:
    plain = " ".join(MARKUP.sub("", text or "").split()).strip(" -:;•▶")
    return plain if len(plain) <= LABEL else plain[: LABEL - 1].rstrip() + "…"


def noisy(text: str) -> bool:
    low = text.casefold()
    return len(low) < 4 or any(p in low for p in NOISE)


class Tree:
    """Nodes by number; 0 is the topic and its children are the branches."""

    def __init__(self, topic: str):
        self.text, self.up, self.kids = [topic], [-1], [[]]

    def add(self, parent: int, text: str) -> int:
        self.text.append(text)
        self.up.append(parent)
        self.kids.append([])
        self.kids[parent].append(len(self.text) - 1)
        return len(self.text) - 1

    def walk(self, at: int = 0, depth: int = 0) -> Iterator[tuple[int, int]]:
        """(node, depth) in the order of the tree."""
        yield at, depth
        for k in self.kids[at]:
            yield from self.walk(k, depth + 1)

    def size(self) -> int:
        return sum(1 for _ in self.walk())

    def keys(self, at: int) -> set[str]:
        return {key(self.text[k]) for k in self.kids[at]}

    def words(self, at: int) -> frozenset[str]:
        return frozenset().union(*(words(self.text[k]) for k, _ in self.walk(at)))

    def copy(self, other: Tree, at: int, parent: int) -> None:
        made = self.add(parent, other.text[at])
        for k in other.kids[at]:
            self.copy(other, k, made)

    def rows(self, scope: int) -> list[tuple]:
        order = list(self.walk())
        names = {node: k for k, (node, _) in enumerate(order)}
        return [
            (scope, names[node], names.get(self.up[node], -1), depth, self.kids[self.up[node]].index(node) if depth else 0, self.text[node])
            for node, depth in order
        ]


def outlined(lines: Iterator[str], topic: str | None, most: int) -> Tree | None:
    """A map of Markdown lines: headings by their level, bold lines below what is open, bullets as leaves of it, up to a budget of nodes."""
    tree, budget, seen = Tree(topic or ""), max(12, most), set()
    path: list[tuple[int, int]] = []  # (depth, node) of what is open

    def place(depth: int, text: str) -> None:
        name = label(text)
        if not topic and not tree.text[0] and name:
            tree.text[0] = name[:60]
        if not name or key(name) in seen or key(name) == key(tree.text[0]) or len(tree.text) >= budget:
            return
        seen.add(key(name))
        while path and (depth <= 1 or path[-1][0] >= depth):
            path.pop()
        path.append((depth if path else 1, tree.add(path[-1][1] if path else 0, name)))

    for line in map(str.strip, lines):
        if not line or any(p in line.casefold() for p in NOISE):
            continue
        if m := HEADING.match(line):
            place(max(1, len(m[1]) - 1), m[2])
        elif m := BOLD.match(line):
            place(2 if path else 1, m[1])
        elif (m := BULLET.match(line)) and path and len(tree.text) < budget:
            name, parent = label(m[1]), path[-1][1]
            mark = key(tree.text[parent]) + "::" + key(name)
            if not noisy(name) and not name.casefold().startswith(("http://", "https://")) and len(tree.kids[parent]) < LEAVES and mark not in seen:
                seen.add(mark)
                tree.add(parent, name)
    if any(tree.kids[b] for b in tree.kids[0]):
        tree.kids[0] = [b for b in tree.kids[0] if tree.kids[b]]
    tree.kids[0] = tree.kids[0][:BRANCHES]
    return tree if len(tree.kids[0]) >= FEWEST else None


def study_nodes(tree: Tree, branch: int, paths: list[list[str]], details: list[str], most: int) -> None:
    """Heading paths below a branch as a prefix tree of `most` children, then each detail at the node that shares most of its words."""
    for path in paths:
        at = branch
        for name in map(label, path):
            if noisy(name) or key(name) == key(tree.text[branch]):
                continue
            known = next((k for k in tree.kids[at] if key(tree.text[k]) == key(name)), None)
            if known is None:
                if len(tree.kids[at]) >= (most if at == branch else FAN_OUT):
                    break
                known = tree.add(at, name)
            at = known
    for text in filter(None, map(label, details)):
        fit = [(len(words(text) & words(tree.text[k])), k) for k, _ in tree.walk(branch) if len(tree.kids[k]) < FAN_OUT]
        score, at = max(fit, key=lambda x: x[0], default=(0, branch))
        if score and key(text) not in tree.keys(at) | {key(tree.text[at])}:
            tree.add(at, text)


def merge_supporting(tree: Tree, names: list[str]) -> None:
    """The headings of a supporting module, added to the branch whose subtree shares most words with them."""
    wanted = words(" ".join(names))
    target = max(tree.kids[0], key=lambda b: len(wanted & tree.words(b)))
    held = tree.keys(target)
    for name in map(label, names):
        if len(tree.kids[target]) >= SUPPORTED:
            break
        if not noisy(name) and key(name) not in held:
            held.add(key(name))
            tree.add(target, name)


def merge_map(tree: Tree, other: Tree) -> int:
    """Bare branches take the children of the other map's branch that fits best; one of its branches serves once. Children that came."""
    used: set[int] = set()
    came = 0
    for place, branch in enumerate(tree.kids[0]):
        if len(tree.kids[branch]) > 1 or any(tree.kids[k] for k in tree.kids[branch]):
            continue
        scores = []
        for b in other.kids[0]:
            if b in used or not other.kids[b]:
                continue
            same = key(tree.text[branch]) == key(other.text[b])
            likeness = 8 * len(words(tree.text[branch]) & words(other.text[b])) + len(tree.words(branch) & other.words(b))
            scores.append((100 + len(other.kids[b]) if same else likeness, b))
        _, best = max((s for s in scores if s[0] > 0), key=lambda s: s[0], default=(0, -1))
        if best < 0 and place < len(other.kids[0]) and other.kids[other.kids[0][place]]:
            best = other.kids[0][place]
        before = len(tree.kids[branch])
        held = tree.keys(branch)
        for k in other.kids[best] if best >= 0 else []:
            if len(tree.kids[branch]) < FAN_OUT and key(other.text[k]) not in held:
                held.add(key(other.text[k]))
                tree.copy(other, k, branch)
        if len(tree.kids[branch]) > before:
            used.add(best)
            came += len(tree.kids[branch]) - before
    return came


class Graph:
    """Places a stream of graph nodes, then of relations, in a tree."""

    def __init__(self, tree: Tree, most: int):
        self.tree, self.most = tree, most
        self.at: dict[str, int] = {}
        self.used: Counter[str] = Counter()

    def known(self, name: str) -> int | None:
        best, found = 0.8, None
        for k, depth in self.tree.walk():
            if not depth:
                continue
            if key(self.tree.text[k]) == key(name):
                return k
            a, b = words(name), words(self.tree.text[k])
            share = len(a & b) / max(1, len(a | b))
            if share > best or share == best and found is None:
                best, found = share, k
        return found

    def node(self, name: str, id_: str, strong: bool, evidence: str) -> None:
        name = label(name)
        if noisy(name):
            return
        if (k := self.known(name)) is not None:
            self.at[id_] = k
            return
        wanted, tree = words(evidence), self.tree
        if not strong or tree.size() >= self.most or not wanted:
            return
        fit = [
            (4 * len(wanted & words(tree.text[k])) + len(wanted & tree.words(k)), depth, k)
            for k, depth in tree.walk() if 1 <= depth <= 3 and len(tree.kids[k]) < FAN_OUT
        ]
        score, _, parent = max(fit, key=lambda x: x[:2], default=(0, 0, 0))
        if score:
            self.at[id_] = tree.add(parent, name)

    def relation(self, source: str, target: str, kind: str) -> None:
        a, b, tree = self.at.get(source), self.at.get(target), self.tree
        if a is None or b is None or a == b or self.used[source] >= EACH or tree.size() >= self.most:
            return
        name = f"{kind.replace('_', ' ').title()}: {tree.text[b]}"[:90]
        if key(name) not in tree.keys(a) and len(tree.kids[a]) < FAN_OUT:
            tree.add(a, name)
            self.used[source] += 1


def balanced(tree: Tree, most: int) -> Tree:
    """Chains of single children are shortened, children limited, and the deepest, then longest leaf goes until the size fits."""

    def shorten(at: int) -> None:
        for k in tree.kids[at]:
            shorten(k)
        if at and len(tree.kids[at]) == 1 and tree.kids[tree.kids[at][0]]:
            tree.kids[at] = tree.kids[tree.kids[at][0]]
            for k in tree.kids[at]:
                tree.up[k] = at

    shorten(0)
    for at, _ in list(tree.walk()):
        tree.kids[at] = tree.kids[at][:FAN_OUT]
    order = {node: (place, depth) for place, (node, depth) in enumerate(tree.walk())}
    leaves = [(-depth, -len(tree.text[n]), place, n) for n, (place, depth) in order.items() if depth > 1 and not tree.kids[n]]
    heapq.heapify(leaves)
    total = len(order)
    while total > most and leaves:
        node = heapq.heappop(leaves)[-1]
        parent = tree.up[node]
        tree.kids[parent].remove(node)
        total -= 1
        place, depth = order[parent]
        if depth > 1 and not tree.kids[parent]:
            heapq.heappush(leaves, (-depth, -len(tree.text[parent]), place, parent))
    return tree


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.int32()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in OUTPUT.split(", ")])


def outline_maps(docs: DataFrame, most: int = 60) -> DataFrame:
    """(scope, node, parent, depth, pos, text) of Markdown documents (doc_id, text, topic), a map for each. Without a topic the first heading is it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, topic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "topic"))):
                if (tree := outlined((text or "").splitlines(), topic, most)) is not None:
                    yield _batch(balanced(tree, most).rows(doc))

    ship(docs.sparkSession)
    topic = F.col("topic") if "topic" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", topic.alias("topic")).mapInArrow(run, OUTPUT)


#: Rows of a scope in the order in which they are taken: main modules, supporting ones, graph nodes, relations.
MAIN, SUPPORTING, NODE, RELATION = range(4)
_STEPS = "scope bigint, step int, rank double, name string, id string, other string, strong boolean, paths array<array<string>>, details array<string>"


def _steps(rows: DataFrame, **given) -> DataFrame:
    names = [x.split(" ", 1) for x in re.split(r", (?=\w+ )", _STEPS)]
    return rows.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def module_maps(modules: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, most: int = 60, extra: DataFrame | None = None) -> DataFrame:
    """(scope, node, parent, depth, pos, text): a map of each scope's course.

    modules (scope, rank, role, title, paths, details): the first seven main ones are branches, supporting ones are merged. extra (doc_id, text): Markdown
    whose map fills bare branches. nodes (scope, id, kind, name, description, evidence, n_sources) and edges (scope, source, target, relation, confidence) of
    a concept graph are placed last: nodes by kind and name where they match or fit best, then two relations of each node, by confidence.
    """
    c = F.col
    supporting = F.coalesce(F.lower("role") == "supporting", F.lit(False))
    steps = _steps(modules, scope=c("scope"), step=F.when(supporting, SUPPORTING).otherwise(MAIN), rank=c("rank"), name=c("title"), paths=c("paths"), details=c("details"))
    if extra is not None:
        steps = steps.unionByName(_steps(extra, scope=c("doc_id"), step=F.lit(SUPPORTING), rank=F.lit(1e18), other=c("text")))
    if nodes is not None:
        places = F.array(*map(F.lit, KINDS))
        name = F.regexp_replace("name", r"\s+", " ")
        strong = (c("kind") != "concept") | (F.size(F.split(F.trim(name), " ")) >= 2) | (F.length("description") >= 20) | (c("n_sources") >= 3)
        strong = strong | (F.length(F.regexp_replace("name", r"[^\p{Lu}]", "")) >= 2)
        known = nodes.where(c("kind").isin(*KINDS) & c("name").isNotNull())
        text = F.concat_ws(" ", "name", "description", "evidence")
        steps = steps.unionByName(_steps(known, scope=c("scope"), step=F.lit(NODE), rank=F.array_position(places, c("kind")), name=c("name"), id=c("id"), strong=F.coalesce(strong, F.lit(False)), details=F.array(text)))
    if edges is not None:
        shown = edges.where(c("relation").isin(*RELATIONS) & (c("confidence") >= CONFIDENT))
        steps = steps.unionByName(_steps(shown, scope=c("scope"), step=F.lit(RELATION), rank=-c("confidence"), name=c("relation"), id=c("source"), other=c("target")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, tree, graph, mains = None, None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if tree is not None and len(tree.kids[0]) >= FEWEST:
                yield _batch(balanced(tree, most).rows(scope))

        for batch in batches:
            for r in batch.to_pylist():
                if tree is None or r["scope"] != scope:
                    yield from done()
                    scope, tree, graph, mains = r["scope"], Tree(""), None, 0
                if r["step"] == MAIN:
                    name = label(r["name"])
                    if mains < FAN_OUT and name:
                        mains += 1
                        tree.text[0] = tree.text[0] or name
                        study_nodes(tree, tree.add(0, name), r["paths"] or [], r["details"] or [], max(2, (most - 8) // FAN_OUT))
                elif not tree.kids[0]:
                    continue
                elif r["step"] == SUPPORTING and r["other"] is not None:
                    if (other := outlined(r["other"].splitlines(), tree.text[0], most)) is not None:
                        merge_map(tree, other)
                elif r["step"] == SUPPORTING:
                    merge_supporting(tree, [r["name"] or "", *(x for p in r["paths"] or [] for x in p)])
                else:
                    graph = graph or Graph(tree, most)
                    if r["step"] == NODE:
                        graph.node(r["name"], r["id"], r["strong"], r["details"][0])
                    else:
                        graph.relation(r["id"], r["other"], r["name"])
        yield from done()

    ship(modules.sparkSession)
    ordered = steps.where("scope IS NOT NULL").repartition("scope").sortWithinPartitions("scope", "step", "rank", F.lower("name"), "name", "id", "other")
    return ordered.mapInArrow(run, OUTPUT)
