"""Exact self-join of texts by the Jaccard similarity of their word n-gram sets, as a metric-space join.

The Jaccard distance d is a metric; a link is d <= r, with r = 1 - similarity. Documents with the same set are one class
from the start. The join is a recursion over regions around pivots:

1.  Root regions. Unrelated texts all lie at a distance of about 1 from each other, so that around whole documents as
    pivots every window would take in every region. The root pivots are therefore taken in sub-universes: the hash range
    is cut into m parts, and a set restricted to one part is its own pivot, with the cell of all sets that are equal to
    it there. d(x, y) <= r bounds the number of differing n-grams by K; with m = K + 1 + S parts a linked pair lies in the
    same cell in S + 1 parts at least. Each set leaves out its S smallest cells, by (n-grams inside, part): the largest
    cell that the pair shares is left out by neither, as it would go only after the S others. So no link is lost, and
    cells of one or no n-gram, which unrelated texts share by chance, go first. S is SLACK per cent of K, 2 at least.
2.  Windows. m depends on the size, by bands; d >= 1 - |x|/|y| is the triangle inequality with the empty set, so a set
    belongs to its own band and, as a boundary document, to the band below if a linked set can lie there.
3.  Rings. Every member is compared exactly with one pivot, the member of its regions that shares most cells, then with
    the pivot of another region. Those within r are one component, and regions inside one component are settled.
4.  Voronoi regions. A region of several components that is too large for a task gets PIVOTS pivots, farthest first. Its
    distance is the L1 distance of SKETCH counts of n-grams by hash: a metric, and never more than the number of
    differing n-grams, so that linked sets lie within rho(x) = |x| (100 - p) / p. A member within rho of its nearest pivot
    belongs to that pivot's region; whoever is within 2 rho of a pivot is in the window and replicated there. A linked
    pair of which one belongs to a pivot meets in that pivot's region, by the triangle inequality; the others stay together as the
    rest, which recurs with other pivots. Where members are equally far from all pivots, so that hardly any leaves the rest,
    the rest is cut by a second sub-universe instead: linked sets share S more cells, each smaller than the last.
5.  Leaves. A region that fits a task, by its members and their n-grams, is joined there in two steps: the bounds of size and L1
    distance leave candidates between two components, of which each region emits a spanning forest. Clusters of
    candidates get their sets, once each, are compared exactly, and emit a spanning forest of their links. Neither has
    more rows than members. A large region with few members outside its largest component meets them block by
    block. What can't be cut any more (all near one pivot and still of many components) is compared in blocks, exactly.

Links are between classes; components come from operators/components.py. Only n-gram hashes of 64 bits are compared.

Defined results: a null text and one without words have no n-grams, link with nothing and are their own component; a text
with fewer words than n is one n-gram; repeated rows are a class; a null doc_id is carried along with the component of its
class, and links as others do; one doc_id on several texts is a node for each text, and component_id is the smallest doc_id of a component;
ties between pivots go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, small_batches, stage, table, without
from corpusloom.operators.components import connected_components
from corpusloom.session import Scratch, ship
from corpusloom.session import broadcast_if_few as _broadcast_if_few

SLACK = 25
#: A sketch counts a set's n-grams in so many hash ranges at least, one for each four n-grams, and at most.
SKETCH, SKETCH_MOST = 128, 1 << 16
#: A leaf has so many members at most, and so many n-grams unless LEAST members have more.
LEAF, LEAF_GRAMS, LEAST = 2048, 1 << 22, 16
PIVOTS, SAMPLE = 16, 256
#: Tables of up to so many rows, by their count, are sent to every task: regions; classes; pivots of
#: a region. Sketches are sent by their bytes.
BROADCAST_REGIONS, BROADCAST_CLASSES, BROADCAST_SKETCHES = 250_000, 500_000, 64 << 20
BLOCK_BYTES = 1 << 18
SENT_CLASSES = 100_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes, fold: bool = True, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes other than gaps, by default white space; A-Z are taken as a-z."""
    data = np.frombuffer(raw, np.uint8)
    solid = ~gaps[data]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    if fold:
        data = _FOLD[data]
    # prefix sums of byte * g^position give every word's polynomial; g is odd, so a shift back divides exactly
    n = len(data)
    up = _powers(n, _M[0])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    poly = (total[stops] - total[starts]) * _powers(n, _INVERSE)[starts]
    return mix(poly + (stops - starts).astype(np.uint64) * _M[2]), starts


_INVERSE = np.uint64(pow(int(_M[0]), -1, 1 << 64))
_TABLES: dict[int, np.ndarray] = {}


def _powers(n: int, g: np.uint64) -> np.ndarray:
    """g^0 to g^(n-1), modulo 2^64."""
    held = _TABLES.get(int(g))
    if held is None or len(held) < n:
        p = np.full(max(n, BLOCK_BYTES), g, np.uint64)
        p[0] = 1
        held = np.cumprod(p)
        if n <= 4 * BLOCK_BYTES:
            _TABLES[int(g)] = held
    return held[:n]


def _segments(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of about BLOCK_BYTES, cut at a blank or line end."""
    at = 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        if end < len(raw):
            cuts = [c for c in (raw.find(b" ", end), raw.find(b"\n", end)) if c >= 0]
            end = min(cuts) if cuts else len(raw)
        yield raw[at:end]
        at = end


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a sequence of word hashes."""
    if not len(words):
        return words
    if len(words) < n:
        h = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            h = mix(h * _M[0] + words[k : k + 1])
        return h
    count = len(words) - n + 1
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = h * _M[0] + words[k : k + count]
    return np.unique(mix(h))


def gram_sets(texts: list[str | None], n: int, fold: bool = True) -> Iterator[np.ndarray]:
    """The set of each text; texts are hashed in blocks of about BLOCK_BYTES."""
    block: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = word_hashes(b"\n".join(block), fold)
        ends = np.cumsum([len(b) + 1 for b in block])
        for words in np.split(hashes, np.searchsorted(starts, ends)[:-1]):
            yield _grams(words, n)

    for text in texts:
        raw = (text or "").encode()
        if block and size + len(raw) > BLOCK_BYTES:
            yield from flush()
            block, size = [], 0
        if len(raw) > BLOCK_BYTES:
            yield _grams(np.concatenate([word_hashes(part, fold)[0] for part in _segments(raw)]), n)
        else:
            block.append(raw)
            size += len(raw) + 1
    if block:
        yield from flush()


class Bands:
    """Size bands and the number of parts in each. Sets of one band or its window are cut alike."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent, self.ratio = percent, ratio
        #: Sizes up to here link only if the sets are equal.
        self.equal_up_to = next(s for s in range(1, 1000) if self.differ(s) > 0) - 1
        self.tops = [self.equal_up_to]

    def differ(self, size: int) -> int:
        """The most n-grams in which a set of this size can differ from a linked one that is no smaller."""
        return size * (100 - self.percent) // self.percent

    def of(self, size: int) -> list[int]:
        """Its band, and the band below if a linked smaller set can lie there."""
        while self.tops[-1] < size:
            self.tops.append(max(int(self.tops[-1] * self.ratio), self.tops[-1] + 1))
        k = next(i for i, t in enumerate(self.tops) if t >= size)
        below = k - 1
        return [k, below] if below >= 0 and size * self.percent <= 100 * self.tops[below] else [k]

    def _parts(self, grams: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """The cells of a set of sorted hashes in band k, largest first, and how many of them are root regions."""
        kept = self.differ(self.tops[k]) + 1
        m = kept + max(2, kept * SLACK // 100)
        cuts = np.searchsorted(grams, (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64))
        bounds = np.concatenate([[0], cuts, [len(grams)]])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + _M[1]))])
        inside = np.diff(bounds)
        own = (total[bounds[1:]] - total[bounds[:-1]]) + np.arange(1, m + 1, dtype=np.uint64) * _M[0]
        cell = mix(own + np.array([k], np.uint64) * _M[2])
        return cell[np.argsort(inside, kind="stable")[::-1]], kept

    def cells(self, grams: np.ndarray) -> np.ndarray:
        """The root regions of a set."""
        found = []
        for k in self.of(len(grams)):
            if k:  # in band 0 only equal sets link, and they are one class already
                cell, kept = self._parts(grams, k)
                found.append(cell[:kept])
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def after(self, grams: np.ndarray, cell: int, depth: int) -> np.ndarray | None:
        """The cells that may follow this one at a depth: linked sets share a path of S + 1 cells, each smaller than the
        last, of which those at this depth are among the first K + 1 + depth. None beyond S."""
        for k in self.of(len(grams)):
            if k:
                cells, kept = self._parts(grams, k)
                at = np.flatnonzero(cells.view(np.int64) == cell)
                if len(at):
                    return cells[at[0] + 1 : kept + depth].view(np.int64) if kept + depth <= len(cells) else None
        return None


def sketch_width(size: int) -> int:
    """A power of two."""
    return min(max(SKETCH, 1 << (max(size, 4) // 4 - 1).bit_length()), SKETCH_MOST)


def _counts(grams: np.ndarray) -> np.ndarray:
    """N-grams by hash ranges, up to 255: what is cut off can only make sets look nearer."""
    width = sketch_width(len(grams))
    return np.minimum(np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8)


def _matrix(sketches: list[bytes], width: int = 0) -> np.ndarray:
    """Sketches as rows of one width, the least of theirs if none is given; wider ones are folded."""
    width = width or min(map(len, sketches), default=SKETCH)
    out = np.empty((len(sketches), width), np.int16)
    for i, x in enumerate(sketches):
        v = np.frombuffer(x, np.uint8)
        out[i] = v if len(v) == width else v.reshape(-1, width).sum(0, dtype=np.int64).clip(0, 32_000)
    return out


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profiles(docs: DataFrame, n: int, percent: int, fold: bool) -> DataFrame:
    """(doc_id, key, size, class, sketch, cells) of every document; class is null for an empty set.

    A task gives a class its cells once, so that a class of many copies isn't sent as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        sent: set[int] = set()
        for batch in slices(batches):
            size, group, sketch, cells = [], [], [], []
            for grams in gram_sets(batch.column("text").to_pylist(), n, fold):
                size.append(len(grams))
                if len(grams):
                    group.append(class_of(grams))
                    sketch.append(_counts(grams).tobytes())
                    cells.append(None if group[-1] in sent else bands.cells(grams).view(np.int64))
                    if len(sent) >= SENT_CLASSES:
                        sent.clear()
                    sent.add(group[-1])
                else:
                    group.append(None)
                    sketch.append(None)
                    cells.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(size, pa.int64()),
                    pa.array(group, pa.int64()),
                    pa.array(sketch, pa.binary()),
                    pa.array(cells, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "size", "class", "sketch", "cells"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("key")).mapInArrow(
        run, "doc_id bigint, key bigint, size bigint, class bigint, sketch binary, cells array<bigint>"
    )


def _sets(docs: DataFrame, n: int, fold: bool) -> DataFrame:
    """(class, grams) of every document that has n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [g for g in gram_sets(batch.column("text").to_pylist(), n, fold) if len(g)]
            grams = pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(map(class_of, found), pa.int64()), grams], ["class", "grams"])

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "class bigint, grams array<bigint>")


def _rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        found = np.zeros(t.num_rows, bool)
        found[:1] = True
        for k in keys:
            v = t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(k).to_numpy()
            found[1:] |= v[1:] != v[:-1]
        return found

    for batch in batches:
        if not batch.num_rows:
            continue
        first = np.flatnonzero(starts(batch))
        if held and all(held[-1].column(k)[held[-1].num_rows - 1] == batch.column(k)[0] for k in keys):
            if len(first) == 1:  # one group, which goes on
                held.append(batch)
                continue
            cut = int(first[1])
        else:
            cut = 0
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        last = int(first[-1])
        if last > cut:
            yield pa.Table.from_batches([batch.slice(cut, last - cut)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


#: Bits of a bit map, at least and at most; it has 32 for each mark as long as that is less.
BITS = 20, 29


def _bit_map(ids: DataFrame) -> tuple[Broadcast, int]:
    """A bit map of the low bits of `region`, sent to every task, and the mask of these bits. It has 64 MB at most; beyond that it is denser, so
    that more pass by chance."""
    n = ids.count()
    width = min(max((32 * n).bit_length(), BITS[0]), BITS[1])
    mask, part = (1 << width) - 1, 1 << BITS[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _rows(batches, ["part"]):
            own, at = t.column("part").to_numpy(), t.column("at").to_numpy()
            for a, b in _groups(t, ["part"]):
                bits = np.zeros(part, bool)
                bits[at[a:b]] = True
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 1]), pa.array([np.packbits(bits).tobytes()])], ["part", "bits"])

    at = F.col("region").bitwiseAND(F.lit(mask))
    places = ids.select(F.shiftright(at, BITS[0]).cast("int").alias("part"), at.bitwiseAND(F.lit(part - 1)).cast("int").alias("at"))
    ship(ids.sparkSession)
    packed = places.repartition("part").sortWithinPartitions("part").mapInArrow(pack, "part int, bits binary")
    found = {r.part: r.bits for r in packed.collect()}  # 512 rows at most
    empty = bytes(part >> 3)
    return ids.sparkSession.sparkContext.broadcast(b"".join(bytes(found.get(i, empty)) for i in range(1 << (width - BITS[0])))), mask


def _groups(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        v = table.column(k).to_numpy()
        change |= v[1:] != v[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
    return list(zip(cuts, cuts[1:]))


class Bounds:
    """What two linked sets keep: sizes within the similarity, sketches within the differing n-grams that it allows."""

    matrix = staticmethod(_matrix)

    def __init__(self, percent: int):
        self.p = percent

    def near(self, n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(n_a, n_b) >= self.p * np.maximum(n_a, n_b)
        at = np.flatnonzero(ok)
        apart = np.abs((s_a[at] if s_a.ndim > 1 else s_a) - s_b[at]).sum(1, dtype=np.int64)
        ok[at] = (100 + self.p) * apart <= (100 - self.p) * ((n_a[at] if np.ndim(n_a) else n_a) + n_b[at])
        return ok

    def near_pairs(self, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        """The same for pairs of rows, each at the lesser width of its two sketches."""
        ok = np.zeros(len(i), bool)
        width = np.array([len(x) for x in sketches])
        least = np.minimum(width[i], width[j]) if len(i) else width[:0]
        for w in np.unique(least):
            at = np.flatnonzero(least == w)
            rows = np.unique(np.concatenate([i[at], j[at]]))
            m = _matrix([sketches[r] for r in rows], int(w))
            for part in np.array_split(at, max(1, len(at) * int(w) >> 24)):
                a, b = np.searchsorted(rows, i[part]), np.searchsorted(rows, j[part])
                ok[part] = self.near(sizes[i[part]], m[a], sizes[j[part]], m[b])
        return ok

    def may_link(self, labels: np.ndarray, sizes: np.ndarray, sketches: list[bytes], asks: np.ndarray, held: np.ndarray) -> list[tuple[int, int]]:
        """A spanning forest of the pairs of two components within the bounds of which one asks."""
        found, part, m = [], np.arange(len(labels)), self.matrix(sketches)
        at = np.flatnonzero(held)
        for i in np.flatnonzero(asks):
            j = at[(labels[at] != labels[i]) & (part[at] != part[i])]
            for k in j[self.near(sizes[i], m[i], sizes[j], m[j])]:
                if part[k] != part[i]:
                    found.append((int(i), int(k)))
                    part[part == part[k]] = part[i]
        return found

    def may_link_in_small(self, groups: list[tuple[int, int]], labels: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
        """The same for many small groups at once, by their pairs."""
        found: list[tuple[int, int]] = []
        first, second, root = [], [], {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        def flush() -> None:
            i, j = np.concatenate(first), np.concatenate(second)
            other = labels[i] != labels[j]
            i, j = i[other], j[other]
            low = min(map(int, i), default=0)
            high = max(map(int, j), default=-1) + 1
            ok = self.near_pairs(i - low, j - low, sizes[low:high], sketches[low:high])
            for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((a, b))
            first.clear()
            second.clear()
            root.clear()

        pairs = 0
        for a, b in groups:
            i, j = _PAIRS[b - a - 1]
            first.append(i + a)
            second.append(j + a)
            pairs += len(i)
            if pairs > 20_000:
                flush()
                pairs = 0
        if first:
            flush()
        return found

    def forest(self, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links (i, j) that join components, by exact comparison; pairs of one component aren't compared."""
        n = len(sets)
        sizes = np.array([len(x) for x in sets])
        _, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        hashed = _matrix([_counts(x.view(np.uint64)).tobytes() for x in sets])
        names, label = np.unique(labels, return_inverse=True)
        mark = np.zeros(int(ranks.max()) + 1, np.int64)
        found = []
        for i in range(n - 1):
            j = np.arange(i + 1, n)
            j = j[label[i + 1 :] != label[i]]
            j = j[self.near(sizes[i], hashed[i], sizes[j], hashed[j])]
            if not len(j):
                continue
            own = ranks[starts[i] : ends[i]]
            mark[own] = 1
            for part in np.array_split(j, max(1, int(sizes[j].sum()) >> 22)):
                lengths = sizes[part]
                offsets = np.cumsum(lengths) - lengths
                take = np.arange(int(lengths.sum())) - np.repeat(offsets - starts[part], lengths)
                common = np.add.reduceat(mark[ranks[take]], offsets)
                for k in part[100 * common >= self.p * (lengths + sizes[i] - common)]:
                    if label[k] != label[i]:
                        found.append((i, int(k)))
                        label[label == label[k]] = label[i]
            mark[own] = 0
        return found


_PAIRS = [np.triu_indices(k, 1) for k in range(1, 33)]


class Join:
    """State of one join: regions still open, links found. Another choice of regions gives its own profiled() and tests()."""

    #: Whether large regions are compared in blocks instead of being cut.
    in_blocks = False

    def __init__(self, docs: DataFrame, n: int, percent: int, fold: bool):
        self.docs, self.n, self.percent, self.fold = docs, n, percent, fold
        self.scratch = Scratch()
        self.bounds = self.tests()
        with small_batches(docs.sparkSession):
            self.profiles = self._stage(self.profiled(), "profiles")

    def profiled(self) -> DataFrame:
        """(doc_id, key, size, class, sketch, cells) of every document."""
        return _profiles(self.docs, self.n, self.percent, self.fold)

    def tests(self) -> Bounds:
        return Bounds(self.percent)

    def _stage(self, rows: DataFrame, name: str) -> DataFrame:
        return self.scratch.stage(rows, name)

    def regions(self) -> DataFrame:
        """(region, class, w) for the cells that hold more than one class, w classes each.

        Cells are counted first, a frequent one being combined before it travels. Those that stand twice mark their places in a bit map of
        bounded size, and only cells at marked places travel again; what is alone there by chance, or a class that several tasks have sent,
        goes when classes are counted."""
        cells = self.profiles.where("cells IS NOT NULL").select(F.explode("cells").alias("region"))
        several = self._stage(cells.groupBy("region").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("region"), "several")
        marks, mask = _bit_map(several)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(marks.value, np.uint8)
            for batch in batches:
                lists = batch.column("cells")
                flat = lists.flatten().to_numpy()
                at = flat & mask
                kept = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                ids = np.repeat(batch.column("class").to_numpy(), lists.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(flat[kept]), pa.array(ids[kept])], ["region", "class"])

        marked = self.profiles.where("cells IS NOT NULL").select("class", "cells").mapInArrow(run, "region bigint, class bigint")
        found = self._stage(marked.distinct(), "found")
        shared = self._stage(found.groupBy("region").agg(F.count(F.lit(1)).alias("w")).where("w > 1"), "shared")
        return self._stage(found.join(_broadcast_if_few(shared, BROADCAST_REGIONS), "region"), "members")

    def prepare(self, members: DataFrame) -> None:
        """Size, sketch and set of each class in a region."""
        inside = members.select("class").distinct()
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "size", "sketch"))
        found = self.profiles.where("sketch IS NOT NULL").join(inside, "class", "left_semi").groupBy("class").agg(first.alias("f"))
        self.facts = self._stage(found.select("class", "f.doc_id", "f.size", "f.sketch"), "facts")
        n, held = self.facts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("sketch")), F.lit(0))).first()
        self.few, self.few_sketches = n <= BROADCAST_CLASSES, held <= BROADCAST_SKETCHES
        ids = _broadcast_if_few(self.facts.where("doc_id IS NOT NULL").select("doc_id"))
        docs = self.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        wanted = docs.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
        # an id may stand on several texts, so sets are chosen by class; bucketed: sets are sent once, not in every round
        chosen = self._sent(self.facts.select("class"))
        with small_batches(docs.sparkSession):
            self.sets = self.scratch.bucketed(_sets(wanted, self.n, self.fold).join(chosen, "class", "left_semi"), "sets", "class")

    def _sent(self, classes: DataFrame) -> DataFrame:
        """A table with a row for each class in a region, or fewer; sent to every task if there are few classes."""
        return F.broadcast(classes) if self.few else classes

    def _sketched(self, rows: DataFrame) -> DataFrame:
        """rows with a class, and its sketch."""
        s = self.facts.select("class", "sketch")
        return rows.join(F.broadcast(s) if self.few_sketches else s, "class")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes, one for each class at most, those that link. Sets travel only within the bounds."""
        p, bounds = self.percent, self.bounds
        sent = lambda d: F.broadcast(d) if self.few_sketches else d
        side = lambda x: sent(self.facts.select(F.col("class").alias(x), F.col("size").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")))
        one = lambda x: self.sets.select(F.col("class").alias(x), F.col("grams").alias(f"g_{x}"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = np.arange(batch.num_rows)
                sizes = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
                ok = bounds.near_pairs(k, k + len(k), sizes, batch.column("s_a").to_pylist() + batch.column("s_b").to_pylist())
                yield batch.select(["a", "b"]).filter(pa.array(ok))

        near = self._stage(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint"), "near-pairs")
        common = F.size(F.array_intersect("g_a", "g_b"))
        return (
            near.join(one("a"), "a").join(one("b"), "b")
            .where(100 * common >= p * (F.size("g_a") + F.size("g_b") - common))
            .select("a", "b")
        )

    def labelled(self, members: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return members.withColumn("label", F.col("class"))
        return members.join(self._sent(labels), "class", "left").withColumn("label", F.coalesce("label", "class"))

    def components(self, links: DataFrame) -> DataFrame:
        found = connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("label"))
        return self._stage(found, "labels")

    def ring(self, members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
        """Links of every class in an open region with one pivot: the best of its regions, then one of a region drawn by hash."""
        m = self.labelled(members, labels)
        best = F.max(F.struct(F.col("score"), (-F.col("class")).alias("pivot")))
        regions = (
            m.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), best.alias("best")).where("lo < hi")
            .select("region", F.col("best.score").alias("pivot_score"), (-F.col("best.pivot")).alias("pivot"))
        )
        regions = _broadcast_if_few(self._stage(regions, "regions"), BROADCAST_REGIONS)
        rank = F.col("pivot_score") if turn == 0 else F.xxhash64("region", "class")
        drawn = (
            members.join(regions, "region").where("class != pivot")
            .groupBy("class").agg(F.max(F.struct(rank, -F.col("pivot")))["col2"].alias("neg"))
        )
        x, y = F.col("class"), -F.col("neg")
        pairs = drawn.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
        return self._stage(self.verified(pairs), "ring")

    def sized(self, members: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(members with label, open regions with their kind). Regions of one component are left out.

        kind "leaf": the region is cut into `blocks` and those outside its largest component meet each of them; this never
        makes more than twice its rows, unless it can't be cut any more (force). kind "split": too large for that.
        """
        m = self._stage(self.labelled(members, labels).join(self._sent(self.facts.select("class", "size")), "class"), "labelled")
        regions = (
            m.groupBy("region", "label")
            .agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("print"),
                 F.max("size").alias("top"), F.min("size").alias("low"), F.max("force").alias("force"))
            .groupBy("region")
            .agg(F.sum("k").alias("n"), F.sum("print").alias("print"), F.max("top").alias("top"), F.min("low").alias("low"), F.max("force").alias("force"),
                 F.max(F.struct("k", "label")).alias("l"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1")
        )
        cap = F.greatest(F.lit(LEAST), F.least(F.lit(LEAF), F.floor(F.lit(LEAF_GRAMS) / F.col("top"))))
        blocks = F.ceil(F.col("n") / cap)
        fits = (blocks == 1) | F.col("force") | ((F.col("n") - F.col("l.k")) * blocks <= F.col("n"))
        regions = regions.select("region", "n", "low", "print", F.col("l.label").alias("largest"), blocks.alias("blocks"), fits.alias("fits"))
        # regions with the same members are one; those to be split stay, as each is cut by another cell
        same = F.when(F.col("fits"), F.lit(0)).otherwise(F.col("region"))
        first = F.min(F.struct("region", "largest", "blocks", "fits", "low")).alias("r")
        return m, self._stage(regions.groupBy("n", "print", same.alias("same")).agg(first).select("r.*", "n"), "sized")

    def candidates(self, m: DataFrame, regions: DataFrame) -> DataFrame:
        """(region, block, a, b): for each leaf a spanning forest of its pairs of two components within the bounds."""
        bounds = self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _rows(batches, ["region", "block"]):
                labels, sizes = t.column("label").to_numpy(), t.column("size").to_numpy()
                sketches, asks, held = t.column("sketch").to_pylist(), t.column("asks").to_numpy(), t.column("held").to_numpy()
                groups = _groups(t, ["region", "block"])
                small = [(a, b) for a, b in groups if b - a <= len(_PAIRS) and held[a:b].all()]
                pairs = bounds.may_link_in_small(small, labels, sizes, sketches)
                done = set(small)
                for a, b in groups:
                    if (a, b) not in done:
                        found = bounds.may_link(labels[a:b], sizes[a:b], sketches[a:b], asks[a:b], held[a:b])
                        pairs += [(a + i, a + j) for i, j in found]
                at = np.array(pairs, np.int64).reshape(-1, 2)
                ids = t.column("class").to_numpy()
                lo, hi = np.minimum(ids[at[:, 0]], ids[at[:, 1]]), np.maximum(ids[at[:, 0]], ids[at[:, 1]])
                own = [t.column(c).to_numpy()[at[:, 0]] for c in ("region", "block")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*own, lo, hi)], ["region", "block", "a", "b"])

        rows = m.join(_broadcast_if_few(regions.where("fits").drop("n", "fits", "low"), BROADCAST_REGIONS), "region")
        rows = self._sketched(rows)
        columns = ["region", "class", "label", "size", "sketch"]
        outside = F.col("label") != F.col("largest")
        inside = rows.select(
            *columns, F.pmod(F.xxhash64("class"), F.col("blocks")).alias("block"),
            ((F.col("blocks") == 1) & outside).alias("asks"), F.lit(True).alias("held"),
        )
        asking = rows.where(outside & (F.col("blocks") > 1)).select(
            *columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
            F.lit(True).alias("asks"), F.lit(False).alias("held"),
        )
        key = ["region", "block"]
        ship(m.sparkSession)
        found = (
            inside.unionByName(asking).repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(run, "region bigint, block bigint, a bigint, b bigint")
        )
        return self._stage(found.where("a != b"), "candidates")

    def leaf_links(self, m: DataFrame, regions: DataFrame, labels: DataFrame) -> DataFrame:
        """Spanning links (a, b) of the leaves.

        One pair may be a candidate in many regions. So candidates are first joined to clusters, in which all of a
        cluster's pairs lie, and every set goes to its cluster once; only clusters too large for a task are
        compared region by region.
        """
        near = self.candidates(m, regions)
        clusters = connected_components(near.select("a", "b").distinct()).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
        clusters = self._stage(self.labelled(clusters, labels).join(self._sent(self.facts.select("class", "size")), "class"), "clusters")
        totals = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
        small = ((F.col("n") <= LEAF) & (F.col("grams") <= LEAF_GRAMS)) | (F.col("n") <= LEAST)
        sized = self._stage(totals.select("cluster", small.alias("small")), "cluster-sizes")
        clusters = clusters.join(_broadcast_if_few(sized, BROADCAST_REGIONS), "cluster")
        key = ["region", "block"]
        leaves = clusters.where("small").select(F.col("cluster").alias("region"), F.lit(-1).cast("bigint").alias("block"), "class", "label")
        if not sized.where("not small").isEmpty():
            ends = near.select(*key, F.col("a").alias("class")).unionByName(near.select(*key, F.col("b").alias("class"))).distinct()
            wide = self._stage(ends.join(clusters.where("not small").select("class", "label"), "class"), "wide")
            prints = wide.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("print"))
            one = prints.groupBy("n", "print").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
            wide = wide.join(_broadcast_if_few(self._stage(one, "leaves"), BROADCAST_REGIONS), key)
            leaves = leaves.unionByName(wide.select(leaves.columns))
        bounds = self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _rows(batches, key):
                ids, labels, grams = t.column("class").to_numpy(), t.column("label").to_numpy(), t.column("grams").combine_chunks()
                flat, ends = grams.flatten().to_numpy(), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
                found = []
                for a, b in _groups(t, key):
                    sets = [flat[ends[k] : ends[k + 1]] for k in range(a, b)]
                    found += [(ids[a + i], ids[a + j]) for i, j in bounds.forest(labels[a:b], sets)]
                lo, hi = [min(x) for x in found], [max(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

        rows = leaves.join(self.sets, "class").select(*key, "class", "label", "grams")
        return self._stage(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint"), "leaf-links")

    def split(self, m: DataFrame, regions: DataFrame, turn: int) -> DataFrame:
        """(region, class, cell, depth, force) of the regions into which large ones are cut."""
        p, seed = self.percent, turn
        wide = regions.where("not fits").select("region", "n", "low")
        rows = self._sketched(m.join(_broadcast_if_few(wide, BROADCAST_REGIONS), "region"))
        schema = "region bigint, pivots array<binary>, reach array<bigint>"

        def choose(frame):
            import pandas as pd  # here, as few tasks need it

            frame = frame.sort_values(["draw", "class"]).head(SAMPLE)
            held = _matrix(list(frame["sketch"]), sketch_width(int(frame["low"].iloc[0])))
            chosen = [0]
            apart = np.abs(held - held[0]).sum(1, dtype=np.int64)
            while len(chosen) < PIVOTS and apart.max() > 0:
                chosen.append(int(apart.argmax()))
                apart = np.minimum(apart, np.abs(held - held[chosen[-1]]).sum(1, dtype=np.int64))
            reach = [int(frame["size"].iloc[k]) * (100 - p) // p for k in chosen]
            return pd.DataFrame({"region": frame["region"].iloc[:1], "pivots": [[held[k].astype("<i2").tobytes() for k in chosen]], "reach": [reach]})

        # a sample of about SAMPLE members by hash; which members are pivots decides speed only, not the result
        draw = F.pmod(F.xxhash64("region", "class", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = rows.withColumn("draw", draw).where(F.col("draw") * F.col("n") < SAMPLE)
        ship(m.sparkSession)
        pivots = self._stage(sample.select("region", "class", "size", "low", "sketch", "draw").groupBy("region").applyInPandas(choose, schema), "pivots")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list[np.ndarray]] = [[], []]  # row, pivot (-1: rest)
                t = pa.Table.from_batches([batch])
                sketches, region, low = t.column("sketch").to_pylist(), t.column("region").to_numpy(), t.column("low").to_numpy()
                rho = t.column("size").to_numpy() * (100 - p) // p
                for r in np.unique(region):
                    at = np.flatnonzero(region == r)
                    centres = batch.column("pivots")[int(at[0])].as_py()
                    if centres is None:  # no member was drawn
                        out[0].append(at)
                        out[1].append(np.full(len(at), -1))
                        continue
                    reach = np.array(batch.column("reach")[int(at[0])].as_py())
                    held = _matrix([sketches[k] for k in at], sketch_width(int(low[at[0]])))  # one width in all of a region
                    apart = np.stack([np.abs(held - np.frombuffer(c, "<i2")).sum(1, dtype=np.int64) for c in centres], 1)
                    nearest = apart.argmin(1)
                    owned = apart[np.arange(len(at)), nearest] <= reach[nearest]
                    i, k = np.nonzero(apart <= reach[None, :] + rho[at][:, None])
                    out[0] += [at[i], at[~owned]]
                    out[1] += [k, np.full(int((~owned).sum()), -1)]
                rows_, which = np.concatenate(out[0]), np.concatenate(out[1])
                taken = batch.select(["region", "class", "cell", "depth", "force", "n"]).take(pa.array(rows_))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(which, pa.int64())], [*taken.schema.names, "pivot"])

        columns = "region bigint, class bigint, cell bigint, depth int, force boolean, n bigint, pivot bigint"
        held = pivots.agg(F.coalesce(F.sum(F.aggregate("pivots", F.lit(0), lambda t, x: t + F.length(x))), F.lit(0))).first()[0]
        sent = F.broadcast(pivots) if held <= BROADCAST_SKETCHES else pivots
        cut = self._stage(
            rows.join(sent, "region", "left")
            .select("region", "class", "cell", "depth", "force", "n", "low", "size", "sketch", "pivots", "reach").mapInArrow(assign, columns),
            "cut",
        )
        counts = cut.groupBy("region", "pivot").agg(F.count(F.lit(1)).alias("k"))
        cut = cut.join(_broadcast_if_few(self._stage(counts, "counts"), BROADCAST_REGIONS), ["region", "pivot"])
        same = F.col("k") * 4 > F.col("n") * 3  # hardly smaller than before
        named = F.xxhash64("region", "pivot", F.lit(seed)).alias("region")
        rest = F.col("pivot") < 0
        kept = cut.where(~(rest & same)).select(named, "class", "cell", "depth", (F.col("force") | same).alias("force"))
        percent = self.percent

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands = Bands(percent)
            for batch in batches:
                row, cell, end = [], [], []
                cells, depths = batch.column("cell").to_pylist(), batch.column("depth").to_pylist()
                for i, grams in enumerate(batch.column("grams")):
                    after = bands.after(grams.values.to_numpy().view(np.uint64), cells[i], depths[i] + 1)
                    found = [cells[i]] if after is None else after.tolist()
                    row += [i] * len(found)
                    cell += found
                    end += [after is None] * len(found)
                taken = batch.select(["region", "class", "depth"]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell, pa.int64()), pa.array(end, pa.bool_())], ["region", "class", "depth", "cell", "force"]
                )

        finer = (
            cut.where(rest & same).select("region", "class", "cell", "depth").join(self.sets, "class")
            .select("region", "class", "cell", "depth", "grams")
            .mapInArrow(refine, "region bigint, class bigint, depth int, cell bigint, force boolean")
            .select(F.xxhash64("region", "cell").alias("region"), "class", "cell", (F.col("depth") + 1).alias("depth"), "force")
        )
        return self._stage(kept.unionByName(finer), "split")

    def labels(self) -> DataFrame | None:
        """(class, label) of the classes that link with others; None if there are none."""
        members = self.regions()
        if members.isEmpty():
            return None
        self.prepare(members)
        score = self._stage(members.groupBy("class").agg(F.sum("w").alias("score")), "scores")
        scored = self._stage(members.drop("w").join(self._sent(score), "class"), "scored")
        links = self.ring(scored, None, 0)
        links = self._stage(links.unionByName(self.ring(scored, self.components(links), 1)), "links")
        open_ = members.select("region", "class", F.col("region").alias("cell"), F.lit(0).alias("depth"), F.lit(self.in_blocks).alias("force"))
        turn = 0
        while True:
            self.links = links
            labels = self.components(links)
            m, regions = self.sized(open_, labels)  # of ids and sizes; sketches and sets join what is left
            if regions.isEmpty():
                return labels
            if not regions.where("fits").isEmpty():
                links = self._stage(links.unionByName(self.leaf_links(m, regions, labels)), "links")
            if regions.where("not fits").isEmpty():
                self.links = links
                return self.components(links)
            open_ = self.split(m, regions, turn)
            turn += 1


def _nodes(join: Join) -> DataFrame:
    """(doc_id, key, size, class, label), written: label is one for each component, null for documents without n-grams."""
    labels = join.labels()
    nodes = join.profiles.select("doc_id", "key", "size", "class")
    if labels is None:
        found = nodes.withColumn("label", F.col("class"))
    else:
        found = nodes.join(_broadcast_if_few(labels), "class", "left").withColumn("label", F.coalesce("label", "class"))
    found = stage(found.select("doc_id", "key", "size", "class", "label"), "nodes")
    join.scratch.clear()
    return found


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents link when 100 * intersection >= percent * union."""
    return components_of(Join(docs, n, percent, fold))


def components_of(join: Join) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of a join's documents."""
    nodes = _nodes(join)
    # only components of several rows are looked up: every other document is its own
    shared = (
        nodes.where("label IS NOT NULL").groupBy("label")
        .agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    )
    shared = stage(shared, "components")
    return nodes.join(_broadcast_if_few(shared), "label", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The input rows without those that have a smaller one, by doc_id, in their component. A row is known by doc_id and text; of
    rows that repeat both one stays, and a null doc_id stays only where its component has no other."""
    nodes = _nodes(Join(docs, n, percent, True)).where("label IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    groups = nodes.groupBy("label").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = stage(groups.select("label", "first"), "groups")
    found = nodes.join(_broadcast_if_few(groups), "label").withColumn("keep", row == F.col("first"))
    verdicts = found.groupBy("doc_id", "key", "keep").agg(F.count(F.lit(1)).alias("rows")).where("not keep or rows > 1")
    return without(docs, F.xxhash64("text"), stage(verdicts.select("doc_id", "key", "keep"), "dropped"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


def near_sql(n: int, percent: int, kept: str = "") -> str:
    """DuckDB SQL for the components of documents: every pair with a common n-gram is counted, so it is for small tables."""
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams
  FROM split),
sized AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sized a JOIN sized b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id{kept}
FROM sets s LEFT JOIN least l ON l.a = s.doc_id
"""


SQL = {"op6_ngram_jaccard_join": near_sql(3, 90)}
