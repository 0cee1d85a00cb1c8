"""Byte-level BPE over the distinct words of blocks of texts.

A block of texts is cut into words (the matches of the GPT-2 pattern) with array operations over its code points; each
distinct word is folded once by ranked merges over its bytes, and the words' ids are laid out again in text order. Words
stay positions in arrays throughout, also in the cache, where they are found by a hash and compared by all characters.
Only the vocabulary, a cache of words of bounded size and one block are in memory, whatever the size of the corpus.

Defined results: a null or empty text has no ids; texts of any length are cut into blocks before white space that
follows other characters, which is always a border between words; every input row is encoded on its own, so ties and
repeated rows give equal results.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex

BLOCK_CHARS = 1 << 20
CACHE_WORDS, CACHE_CHARS = 200_000, 1 << 22
#: Words of up to so many bytes are folded side by side; longer ones alone.
MATRIX_BYTES = (4, 8, 12, 16, 24, 32, 64)
NO_RANK = (1 << 31) - 1
LETTER, NUMBER, SPACE = 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed value: the pattern that word_starts cuts by, with array operations; other patterns are matched text by text.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BORDER = re.compile(r"(?<=\S)[ \n]")


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    found[WHITE_SPACE] = SPACE
    return found


def word_starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets at which words start; `first` marks the first code point of each text."""
    n = len(cps)
    kind = _classes()[cps]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last character of white space before other text starts a word; a blank takes the following characters along
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    start[last] = True
    start[last[cps[last] == 32] + 1] = False
    quote = np.flatnonzero((cps == 39) & start)
    if len(quote):
        padded = np.concatenate([cps, np.zeros(3, cps.dtype)])
        edge = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~edge[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~edge[quote + 1] & ~edge[quote + 2] & (
            ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        )
        for hit, length in ((quote[one], 2), (quote[two & ~one], 3)):
            for k in range(1, length):
                start[hit + k] = False
            after = hit + length
            start[after[after < n]] = True
    return np.flatnonzero(start)


_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64))
    return _POWERS


def distinct_words(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the number of its distinct word, and for each of these a word that shows it and its hash, ascending."""
    n = len(cps)
    lengths = np.diff(np.append(starts, n))
    # in place and in 32 bits: these arrays, of an entry a code point, are most of a block's memory
    at = np.arange(n, dtype=np.int32)
    at -= np.repeat(starts.astype(np.int32), lengths)
    h = cps.astype(np.uint64)
    h += np.uint64(1)
    h *= _powers(int(lengths.max()))[at]
    h = np.add.reduceat(h, starts)
    order = np.argsort(h)
    new = np.append(True, np.diff(h[order]) != 0)
    shown = order[new]
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    if np.array_equal(lengths, lengths[shown[of]]):
        at += np.repeat(starts[shown[of]].astype(np.int32), lengths)
        if np.array_equal(cps[at], cps):
            return of, shown, h[shown]
    seen: dict[bytes, int] = {}  # two words share a hash: number them by their characters
    of = np.array([seen.setdefault(cps[s : s + k].tobytes(), len(seen)) for s, k in zip(starts, lengths)])
    _, shown = np.unique(of, return_index=True)
    order = np.argsort(h[shown])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[of], shown[order], h[shown[order]]


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(begins - (ends - lengths), lengths)
    return at


class PairTable:
    """Rank and product of pairs of ids, looked up for whole arrays: open addressing, sparsely filled."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        if not pairs:
            return
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # of the pairs that want an empty slot one gets it, the others try the next
            empty = self.keys[slot[todo]] < 0
            self.keys[slot[todo[empty]]] = keys[todo[empty]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.ranks[slot], self.made[slot] = values[:, 0], values[:, 1]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a pair without a rank gets one that has NO_RANK."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return slot


class Bpe:
    """Ids by ranked merges. `ranks` holds the id of each piece; `merges`, if given, the rank of each pair of pieces,
    else a pair's rank is the id of what it makes. Texts are cut into the matches of `pattern`."""

    def __init__(self, ranks: dict[bytes, int], merges: dict[tuple[bytes, bytes], int] | None = None, pattern: str = GPT2_PATTERN):
        self.ranks, self.merges = ranks, merges
        self.split = None if pattern == GPT2_PATTERN else regex.compile(pattern)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        if merges is None:
            splits = ((p[:k], p[k:], i) for p, i in ranks.items() for k in range(1, len(p)))
            pairs = {(ranks[a], ranks[b]): (i, i) for a, b, i in splits if a in ranks and b in ranks}
        else:
            pairs = {(ranks[a], ranks[b]): (r, ranks[a + b]) for (a, b), r in merges.items()}
        self.pairs = PairTable(pairs)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        top = max((r for r, _ in pairs.values()), default=0) + 1
        kind = np.int32 if top < 1 << 24 else np.int64
        self.none = np.iinfo(kind).max
        self.made = np.zeros(top, np.int32)
        for r, made in pairs.values():
            self.made[r] = made
        # rank of each slot of pairs and of each pair of bytes, shifted so that a row fits below it
        self.slots = np.where(self.pairs.ranks < NO_RANK, self.pairs.ranks.astype(kind) << 7, self.none)
        self.of_bytes = self.slots[self.pairs.find(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))]
        self._forget()

    def _forget(self) -> None:
        """The cache: for each word its characters and ids, by the number that it got; the hashes in order and whose they are."""
        self.hashes, self.whose = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chars, self.char_at, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.id_at, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, a: bytes, b: bytes) -> int:
        return self.ranks.get(a + b, NO_RANK) if self.merges is None else self.merges.get((a, b), NO_RANK)

    def _fold_matrix(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """fold() of many short words at once, a column each: every step merges one pair in each. Their ids, one after the other, and numbers of ids.

        A key holds a pair's rank and, below it, its row, so that the least key is the leftmost pair of the lowest rank. Rows of
        padding on both sides have no rank with any neighbour.
        """
        width, n = int(sizes.max()), len(sizes)
        row = np.arange(width, dtype=np.int64)[:, None]
        inside = row < sizes
        held = raw[np.where(inside, begins + row, 0)]
        pad = len(self.pieces)
        ids = np.full((width + 2, n), pad, np.int32)
        ids[1:-1] = np.where(inside, self.of_byte[held], pad)
        key = np.full((width + 1, n), self.none, self.slots.dtype)  # of the pair of a row and the next
        ranks = self.of_bytes[held[:-1].astype(np.int32) << 8 | held[1:]]
        key[1:-1] = np.where(inside[1:] & (ranks < self.none), ranks | row[1:].astype(key.dtype), self.none)
        out, left = np.empty((n, width), np.int32), sizes.copy()
        cols, most = np.arange(n), self.none - 128  # steps lower every key by their number at most
        while True:
            best = key.min(0)
            open_ = best < most
            if not open_.all():
                shut = np.flatnonzero(~open_)
                out[cols[shut], : len(ids) - 2] = ids[1:-1, shut].T
                keep = np.flatnonzero(open_)
                if not len(keep):
                    inside = np.arange(width) < left[:, None]
                    return out[inside].astype(np.uint32), left
                ids, key, best, cols = ids.take(keep, 1), key.take(keep, 1), best[keep], cols[keep]
            left[cols] -= 1
            at, made = best & 127, self.made[best >> 7]
            row = np.arange(len(key), dtype=key.dtype)[:, None]
            here = np.arange(len(cols))
            ids = np.where(row <= at, ids[:-1], ids[1:])
            ids[at, here] = made
            key = np.where(row[:-1] < at, key[:-1], key[1:] - 1)
            slot = self.pairs.find(np.concatenate([ids[at - 1, here], made]), np.concatenate([made, ids[at + 1, here]]))
            ranks = self.slots[slot].reshape(2, -1)
            for r, k in ((ranks[0], at - 1), (ranks[1], at)):
                key[k, here] = np.where(r < self.none, r | k, self.none)

    def _fold_flat(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """fold() of words that stand in an array of bytes: an order of the words, and in it their ids and numbers of ids."""
        orders, found, counts = [], [], []
        low = 0
        for high in MATRIX_BYTES:
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(rows), 16_384):
                part = rows[k : k + 16_384]
                ids, n = self._fold_matrix(raw, begins[part], sizes[part])
                orders.append(part)
                found.append(ids)
                counts.append(n)
            low = high
        for i in np.flatnonzero(sizes > low).tolist():
            ids = self.fold(raw[begins[i] : begins[i] + sizes[i]].tobytes())
            orders.append(np.array([i]))
            found.append(np.array(ids, np.uint32))
            counts.append(np.array([len(ids)]))
        if not orders:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(orders), np.concatenate(found), np.concatenate(counts)

    def fold_many(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array(list(map(len, words)), np.int64)
        order, ids, counts = self._fold_flat(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
        done: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        for i, part in zip(order.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
            done[i] = part
        return done

    def fold(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until no pair has a rank."""
        if len(word) > 512:
            return self._fold_long(word)
        rank = self._rank
        parts = [word[i : i + 1] for i in range(len(word))]
        found = [rank(a, b) for a, b in zip(parts, parts[1:])]
        while found and (least := min(found)) != NO_RANK:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank(parts[i - 1], parts[i])
            if i < len(found):
                found[i] = rank(parts[i], parts[i + 1])
        return [self.ranks[p] for p in parts]

    def _fold_long(self, word: bytes) -> list[int]:
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self._rank(parts[i], parts[i + 1])) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self._rank(parts[x], parts[y])) < NO_RANK:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ranks[p] for p in parts if p is not None]

    def _numbers(self, cps: np.ndarray, begins: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where each of the distinct words, by ascending hashes, stands in the cache; unknown ones are folded and added first."""
        if len(self.sizes) + len(begins) > CACHE_WORDS or len(self.chars) > CACHE_CHARS:
            self._forget()
        slot = np.searchsorted(self.hashes, hashes)
        taken = slot < len(self.hashes)
        taken[taken] = self.hashes[slot[taken]] == hashes[taken]
        found = np.full(len(begins), -1)
        found[taken] = self.whose[slot[taken]]
        at = np.flatnonzero(taken)
        same = lengths[at] == self.lengths[found[at]]
        found[at[~same]] = -1
        at = at[same]
        if len(at):  # equal hashes are not enough: all characters must be
            equal = cps[_spans(begins[at], lengths[at])] == self.chars[_spans(self.char_at[found[at]], lengths[at])]
            found[at[~np.logical_and.reduceat(equal, np.cumsum(lengths[at]) - lengths[at])]] = -1
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        chars = cps[_spans(begins[missing], lengths[missing])]
        wide = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        first = np.cumsum(lengths[missing]) - lengths[missing]
        sizes = np.add.reduceat(wide, first)
        raw = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        order, ids, counts = self._fold_flat(raw, np.cumsum(sizes) - sizes, sizes)
        base = len(self.sizes)
        found[missing[order]] = base + np.arange(len(order))
        self.char_at = np.concatenate([self.char_at, len(self.chars) + first[order]])
        self.lengths = np.concatenate([self.lengths, lengths[missing[order]]])
        self.chars = np.concatenate([self.chars, chars])
        self.id_at = np.concatenate([self.id_at, len(self.ids) + np.cumsum(counts) - counts])
        self.sizes = np.concatenate([self.sizes, counts])
        self.ids = np.concatenate([self.ids, ids])
        # of several words of a hash the first keeps it; the others are folded wherever they are met
        new = missing[~taken[missing] & np.append(True, hashes[1:] != hashes[:-1])[missing]]
        self.whose = np.insert(self.whose, slot[new], found[new])
        self.hashes = np.insert(self.hashes, slot[new], hashes[new])
        return found

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        first = np.zeros(len(cps), bool)
        begins = np.concatenate([[0], ends[:-1]])
        first[begins[begins < len(cps)]] = True
        starts = word_starts(cps, first)
        of, shown, hashes = distinct_words(cps, starts)
        lengths = np.append(starts, len(cps))[shown + 1] - starts[shown]
        numbers = self._numbers(cps, starts[shown], lengths, hashes)[of]
        each = self.sizes[numbers]
        done = np.concatenate([[0], np.cumsum(each)])
        ids = self.ids[_spans(self.id_at[numbers], each)]
        cuts = done[np.searchsorted(starts, ends)]
        return np.split(ids, cuts[:-1])

    def _matched(self, text: str) -> np.ndarray:
        words = [m[0] for m in self.split.finditer(text)]
        if not words:
            return np.zeros(0, np.uint32)
        once = list(dict.fromkeys(words))
        folded = dict(zip(once, self.fold_many([w.encode() for w in once])))
        return np.concatenate([folded[w] for w in words]).astype(np.uint32)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if self.split:
            yield from (self._matched(t or "") for t in texts)
            return
        block: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if size and size + len(text) > BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
            if len(text) > BLOCK_CHARS:
                yield np.concatenate([self._block([part])[0] for part in _parts(text)])
            else:
                block.append(text)
                size += len(text)
        if block:
            yield from self._block(block)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _parts(text: str) -> Iterator[str]:
    """Parts of about BLOCK_CHARS, cut before white space that follows another character."""
    at = 0
    while at < len(text):
        m = _BORDER.search(text, at + BLOCK_CHARS)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Piece to id from the lines of a .tiktoken file."""
    return {base64.b64decode(piece): int(i) for piece, i in map(bytes.split, raw.splitlines()) if piece}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the JSON vocabulary: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def parse_json(raw: bytes) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], dict[str, int]]:
    """Piece to id, pair to rank, and special strings to ids from a tokenizers JSON file of kind ByteLevel BPE."""
    spec = json.loads(raw)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    to_bytes = lambda s: bytes(letters[c] for c in s)
    ranks = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return ranks, {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(pairs)}, special


class SpecialBpe:
    """Bpe of a JSON file whose special strings, where they stand in a text, are one id each."""

    def __init__(self, raw: bytes):
        ranks, merges, self.special = parse_json(raw)
        self.bpe = Bpe(ranks, merges)
        names = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        texts = [t or "" for t in texts]
        marked = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        for i, ids in enumerate(self.bpe.encode("" if i in marked else t for i, t in enumerate(texts))):
            if i in marked:
                parts = self.split.split(texts[i])
                plain = list(self.bpe.encode("" if p in self.special else p for p in parts))
                ids = np.concatenate(
                    [np.array([self.special[p]], np.uint32) if p in self.special else x for p, x in zip(parts, plain)]
                )
            yield ids


@functools.lru_cache(maxsize=4)
def rank_encoder(raw: bytes, pattern: str = GPT2_PATTERN) -> Bpe:
    """One encoder for each vocabulary and Python worker."""
    return Bpe(parse_ranks(raw), pattern=pattern)


@functools.lru_cache(maxsize=4)
def json_encoder(raw: bytes) -> SpecialBpe:
    return SpecialBpe(raw)
