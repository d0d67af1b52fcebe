"""Evaluation texts in training text: SimHash windows, multi-index Hamming blocks, exact verification.

Every window of ``WINDOW`` words of an item, and of a document, has a 64-bit SimHash of its words, weighted by how few items use
them. The item side is indexed by four blocks of 16 bits: two fingerprints at most ``RADIUS`` bits apart agree within 2 bits on some block, so with all values
within 2 bits of either side's looked up no pair within the radius is missed. Candidates are verified exactly: by the weighted
shingles (words and word pairs) that the windows share and, where enough are shared, by aligning item and document around the window.

Items are written to the shared folder, in blocks, with the counts of their words over all items; workers load them from there. Documents are read and cut into words
once, however many blocks there are. Weights and spellings come from the counts over all items, so results don't depend on the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.text import words
from tabulith.session import materialize, new_dir, spread
from tabulith.sources.filesystem import filesystem

WINDOW = 12
RADIUS = 11
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 2
LEAST_SHARED = 0.5
LEAST_MATCHED = 10  # a passage of twelve words of which two were altered
LEAST_WORDS_WEIGHT = 11.0  # in words of mean weight; for alignments beyond ALTERED edits, or that lack the passage's telling words
ALTERED = 2  # edits of a slightly altered passage, its end words included
LEAST_WEIGHT_SHARE = 0.75  # of a slightly altered passage's own weight
FAR = 40
BAND = 8
CHUNK = 4_096
SLAB = 1 << 14  # windows looked up at a time
RUNS = 1_024  # windows fingerprinted at a time
LOOKUPS = 1 << 16  # pairs of fingerprints compared at a time
SEED = 4  # of WINDOW words of which ALTERED were altered, so many always stand unbroken
ITEM_BLOCK = 20_000
TABLE_BYTES = 24 << 20  # of the windows in the index's buckets, whose fingerprints take twice that beside them; what does not fit is looked up from the other side


class _Codes(dict):
    """Numbers of the words met so far, 0 for those of no item. Letters in another order are a common slip: such words are looked up by first letter and sorted
    letters."""

    def __init__(self, ids: dict[str, int], slips: dict[str, int]) -> None:
        super().__init__(ids)
        self.slips, self.room = slips, len(ids) + 500_000

    def __missing__(self, w: str) -> int:
        code = self.slips.get(_letters(w), 0) if 3 < len(w) < 30 else 0
        if len(self) < self.room:
            self[w] = code
        return code


class Vocabulary:
    """The words of all items, with what all items say of them."""

    def __init__(self, names: list[str], df: list[int], slips: list[str], n_items: int, least: float) -> None:
        self.ids = {w: i + 1 for i, w in enumerate(names)}  # 0: not a word of any item
        self.codes = _Codes(self.ids, {_letters(w): self.ids[w] for w in slips})
        self.weight = np.array([0.0] + [math.log(1 + n_items / k) for k in df])
        self.least = least
        seeds = np.array([0] + [xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64)
        bits = (seeds[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        self.signs = ((bits.astype(np.int16) * 2 - 1) * np.rint(self.weight * 16).astype(np.int16)[:, None]).astype(np.int16)

    @staticmethod
    def of(texts: list[list[str]]) -> Vocabulary:
        df: dict[str, int] = {}
        for t in texts:
            for w in set(t):
                df[w] = df.get(w, 0) + 1
        names = sorted(df)
        first: dict[str, str] = {}
        for w in names:
            if len(w) > 3:
                first.setdefault(_letters(w), w)
        used = [math.log(1 + len(texts) / df[w]) for t in texts for w in t]
        return Vocabulary(names, [df[w] for w in names], list(first.values()), len(texts), LEAST_WORDS_WEIGHT * sum(used) / len(used) if used else 0.0)


def _letters(w: str) -> str:
    return w[:1] + "".join(sorted(w))


class Items:
    """The index over a block of items."""

    def __init__(self, ids: list[int], texts: list[list[str]], vocabulary: Vocabulary | None = None) -> None:
        self.ids = ids
        v = self.vocabulary = vocabulary or Vocabulary.of(texts)
        self.vocab, self.weight, self.signs, self.least = v.ids, v.weight, v.signs, v.least
        self.tokens = [np.array([self.vocab[w] for w in t], dtype=np.int32) for t in texts]
        sizes = np.array([max(0, len(t) - WINDOW + 1) for t in self.tokens], dtype=np.int64)
        long = [np.lib.stride_tricks.sliding_window_view(t, WINDOW) for t in self.tokens if len(t) >= WINDOW]
        seeds = [_codes(t, SEED) for t in self.tokens]
        code = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        order = np.argsort(code, kind="stable")
        self.seeds = code[order]
        bits = min(22, len(code).bit_length() + 4)
        # which first bits of a code the items' codes have: most others need no search
        self.seed_shift, self.seed_marks = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seed_marks[code >> self.seed_shift] = True
        self.seed_item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])[order]
        self.seed_at = np.concatenate([np.arange(len(x)) for x in seeds] or [np.zeros(0, np.int64)])[order]
        pad = np.full(WINDOW, -1, np.int32)
        self.padded = np.concatenate([x for t in self.tokens for x in (pad, t, pad)] or [pad])
        self.origin = np.cumsum([0] + [len(t) + 2 * WINDOW for t in self.tokens])[:-1] + WINDOW
        self.windows = np.concatenate(long).astype(np.int32) if long else np.zeros((0, WINDOW), np.int32)
        self.item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.start = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.hashes = self._hash_rows(self.windows)
        self.total = np.concatenate([self._shingle_weight(self.windows[a : a + CHUNK]).sum(axis=1) for a in range(0, len(self.windows), CHUNK)] or [np.zeros(0)])
        # two blocks within BLOCK_RADIUS bits have a value between them that is within ``spread`` of the item's and the rest of the document's
        self.spread = next(r for r in range(BLOCK_RADIUS, -1, -1) if r == 0 or len(_masks(r)) * len(self.windows) * 4 * BLOCKS <= TABLE_BYTES)
        self.tables = [self._table(b) for b in range(BLOCKS)]

    def _hash_rows(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        for a in range(0, len(rows), CHUNK):
            out[a : a + CHUNK] = _pack(self.signs[rows[a : a + CHUNK]].sum(axis=1, dtype=np.int32))
        return out

    def _hash_runs(self, toks: np.ndarray) -> np.ndarray:
        """The fingerprints of all windows of ``toks``, one after another."""
        n = len(toks) - WINDOW + 1
        out = np.zeros(n, dtype=np.uint64)
        for a in range(0, n, RUNS):
            one = self.signs.take(toks[a : a + RUNS + WINDOW - 1], axis=0, mode="clip")
            two = one[:-1] + one[1:]
            four = two[:-2] + two[2:]
            out[a : a + RUNS] = _pack(four[:-8] + four[4:-4] + four[8:])
        return out

    def _table(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each bucket, windows by bucket, their fingerprints)."""
        key = (self.hashes >> np.uint64(block * BLOCK_BITS)).astype(np.uint32) & np.uint32(0xFFFF)
        keys = (key[None, :] ^ _masks(self.spread)[:, None]).ravel().astype(np.uint16)  # sorted by radix
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
        entries = (order % max(1, len(key))).astype(np.int32)
        return at, entries, self.hashes[entries]

    def _shingle_weight(self, rows: np.ndarray) -> np.ndarray:
        w = self.weight[rows]
        return np.concatenate([w, w[:, 1:] + w[:, :-1]], axis=1)

    def encode(self, text: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.codes.__getitem__, text), dtype=np.int32, count=len(text))

    def candidates(self, toks: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, window, share) of all verified candidates in ``toks``, whose documents are numbered in ``doc``."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        n = len(toks) - WINDOW + 1
        if n <= 0 or not len(self.windows):
            return none
        known = np.concatenate([[0], np.cumsum(toks > 0)])
        many = known[WINDOW:] - known[:n]
        ok = (doc[:n] == doc[WINDOW - 1 :]) & (many > 0)  # a window without any word of an item shares nothing
        # a passage that is accepted has at least so many words of an item within twelve: texts without such a place hold none
        dense = np.zeros(int(doc[-1]) + 1, bool)
        dense[doc[:n][ok & (many >= WINDOW // 2)]] = True
        ok &= dense[doc[:n]]
        found = []
        for a in range(0, n, SLAB):
            at = np.flatnonzero(ok[a : a + SLAB])
            if not len(at):
                continue
            h = self._hash_runs(toks[a : min(n, a + SLAB) + WINDOW - 1])[at]
            at += a
            pos, win = [], []
            for b, (first, entries, prints) in enumerate(self.tables):
                own = (h >> np.uint64(b * BLOCK_BITS)).astype(np.uint16)
                order = np.argsort(own, kind="stable")  # neighbours in the table follow one another
                own, sorted_ = own[order].astype(np.uint32), h[order]
                for mask in _masks(BLOCK_RADIUS - self.spread):
                    key = own ^ mask
                    begin = first[key]
                    size = first[key + 1] - begin
                    ends = np.cumsum(size)
                    cuts = np.searchsorted(ends, np.arange(LOOKUPS, ends[-1], LOOKUPS)) + 1  # as many as the processor's cache holds
                    for x, y in zip([0, *cuts], [*cuts, len(key)], strict=True):
                        if x < y:
                            n_ = size[x:y]
                            to = ends[x:y] - (ends[x - 1] if x else 0)
                            at_ = np.repeat(begin[x:y] - to + n_, n_)
                            at_ += np.arange(to[-1])
                            differ = prints.take(at_, mode="clip")  # all are in range; this mode is the fast one
                            differ ^= np.repeat(sorted_[x:y], n_)
                            near = np.flatnonzero(np.bitwise_count(differ) <= RADIUS)
                            pos.append(order[x + np.searchsorted(to, near, side="right")])
                            win.append(entries[at_[near]])
            code = np.unique(np.concatenate(pos).astype(np.int64) * len(self.windows) + np.concatenate(win))
            if len(code):
                p, w = at[code // len(self.windows)], code % len(self.windows)
                share = self._share(toks, p, w)
                good = share >= LEAST_SHARED
                found.append((p[good], w[good], share[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    def _share(self, toks: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted part of the item window's shingles that the document's window has."""
        out = np.zeros(len(p))
        big = np.int64(len(self.weight) + 1)
        for a in range(0, len(p), 4096):
            d = toks[p[a : a + 4096, None] + np.arange(WINDOW)].astype(np.int64)
            i = self.windows[w[a : a + 4096]].astype(np.int64)
            one = (i[:, :, None] == d[:, None, :]).any(axis=2)
            pair = ((i[:, :-1] * big + i[:, 1:])[:, :, None] == (d[:, :-1] * big + d[:, 1:])[:, None, :]).any(axis=2)
            out[a : a + 4096] = (self._shingle_weight(i) * np.concatenate([one, pair], axis=1)).sum(axis=1) / self.total[w[a : a + 4096]]
        return out

    def passage(self, toks: np.ndarray, item: int, diagonal: int) -> tuple[int, int, float]:
        """(words matched, words of the item spanned, their weight) of the best local alignment within ``BAND`` of a diagonal."""
        it = self.tokens[item]
        best = (0, 0, 0.0)
        top = -1.0
        weight = self.weight
        prev: dict[int, tuple[float, int, int, float]] = {}
        n = len(toks)
        for q, x in enumerate(it.tolist()):
            row: dict[int, tuple[float, int, int, float]] = {}
            lo, hi = max(0, q + diagonal - BAND), min(n, q + diagonal + BAND + 1)
            for p in range(lo, hi):
                y = int(toks[p])
                s = prev.get(p - 1)
                if y == x:
                    c = (s[0] + 1, s[1] + 1, s[2], s[3] + weight[x]) if s else (1.0, 1, q, weight[x])
                else:
                    c = (s[0] - 1, *s[1:]) if s else None
                    for o in (prev.get(p), row.get(p - 1)):
                        if o and (c is None or o[0] - 1 > c[0]):
                            c = (o[0] - 1, *o[1:])
                    if c is None or c[0] <= 0:
                        continue
                row[p] = c
                if c[0] > top:
                    top, best = c[0], (c[1], q - c[2] + 1, c[3])
            prev = row
        return best

    def seeded(self, toks: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, item position) of all runs of ``SEED`` words in common about which ``LEAST_MATCHED`` words stand at their place, give or take
        ``ALTERED`` words: every passage with at most so many edits has one, whatever its fingerprint."""
        n = len(toks) - SEED + 1
        if n <= 0 or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.concatenate([[0], np.cumsum(toks > 0)])
        code = _codes(toks, SEED)
        at = np.flatnonzero((doc[:n] == doc[SEED - 1 :]) & (known[SEED:] - known[:n] == SEED) & self.seed_marks[code >> self.seed_shift])
        code = code[at]
        lo = np.searchsorted(self.seeds, code)
        size = np.searchsorted(self.seeds, code, side="right") - lo
        p = np.repeat(at, size)
        e = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        item, q = self.seed_item[e], self.seed_at[e]
        reach = WINDOW - SEED
        side = np.zeros(reach + ALTERED, np.int32)
        text = np.concatenate([side, toks, side])
        span = np.arange(2 * reach + SEED)
        good = np.zeros(len(p), bool)
        for a in range(0, len(p), 4096):
            b = slice(a, a + 4096)
            want = self.padded[(self.origin[item[b]] + q[b] - reach)[:, None] + span]
            there = np.zeros(want.shape, bool)
            for shift in range(2 * ALTERED + 1):
                there |= want == text[(p[b] + shift)[:, None] + span]
            good[b] = there.sum(axis=1) >= LEAST_MATCHED
        return p[good], item[good], q[good]

    def leaks(self, texts: list[list[str]]) -> list[tuple[int, int, int, list[int]]]:
        """(text, item, words matched, positions of the windows) of each item that a text holds a passage of."""
        coded = [self.encode(t) for t in texts]
        lens = np.array([len(c) for c in coded], dtype=np.int64)
        ends = np.cumsum(lens)
        toks = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        texts_of = np.repeat(np.arange(len(coded)), lens)
        p, w, share = self.candidates(toks, texts_of)
        doc = np.searchsorted(ends, p, side="right")
        at = p - (ends - lens)[doc]
        order = np.lexsort((-share, self.item[w], doc))
        out = []
        key = doc[order] * len(self.ids) + self.item[w[order]]
        for part in np.split(order, np.flatnonzero(np.diff(key)) + 1) if len(p) else ():
            k, i = int(doc[part[0]]), int(self.item[w[part[0]]])
            tried: list[int] = []
            for diagonal in dict.fromkeys((at[part] - self.start[w[part]]).tolist()):
                if any(abs(diagonal - x) <= BAND // 2 for x in tried):
                    continue
                tried.append(diagonal)
                if matched := self._holds(coded[k], i, diagonal):
                    out.append((k, i, matched, at[part].tolist()))
                    break
        held = {(k, i) for k, i, *_ in out}
        more: dict[tuple[int, int], tuple[int, list[int]]] = {}
        p, item, q = self.seeded(toks, texts_of)
        doc = texts_of[p]
        for k, i, x, y in zip(doc.tolist(), item.tolist(), (p - (ends - lens)[doc]).tolist(), q.tolist(), strict=True):
            if (k, i) not in held and (matched := self._slightly(coded[k], i, x, y)):
                most, places = more.setdefault((k, i), (0, []))
                more[k, i] = (max(most, matched), places + [max(0, x - WINDOW + SEED), x])
        return out + [(k, i, matched, places) for (k, i), (matched, places) in more.items()]

    def _slightly(self, toks: np.ndarray, item: int, p: int, q: int) -> int:
        """Words matched if a passage with at most ``ALTERED`` edits goes through text position ``p`` and item position ``q``, else 0. It has no least
        weight of its own: words of the item that were altered must just not be the ones that tell it from stock phrases."""
        it, weight = self.tokens[item], self.weight
        if len(it) < WINDOW:
            return 0
        i, t = it[max(0, q - FAR) : q + FAR].tolist(), toks[max(0, p - FAR) : p + FAR].tolist()
        q0, p0 = min(q, FAR), min(p, FAR)
        right, left = _extend(i[q0:], t[p0:], ALTERED), _extend(i[:q0][::-1], t[:p0][::-1], ALTERED)
        for er, (mr, qr) in enumerate(right):
            for ml, ql in left[: ALTERED + 1 - er]:
                matched = len(mr) + len(ml)
                if matched < LEAST_MATCHED:
                    continue
                a, b = q - ql, q + qr
                kept = float(sum(weight[i[q0 + k]] for k in mr) + sum(weight[i[q0 - 1 - k]] for k in ml))
                spans = [(x, x + max(WINDOW, b - a)) for x in range(max(0, min(a, b - WINDOW)), a + 1)]  # altered end words
                whole = min((float(weight[it[x:y]].sum()) for x, y in spans if b <= y <= len(it)), default=math.inf)
                if kept >= LEAST_WEIGHT_SHARE * whole:
                    return matched
        return 0

    def _holds(self, toks: np.ndarray, item: int, diagonal: int) -> int:
        """Words matched if the text holds a passage of the item about this diagonal, else 0."""
        it = self.tokens[item]
        a, b = max(0, -diagonal), min(len(it), len(toks) - diagonal)
        equal = toks[a + diagonal : b + diagonal] == it[a:b]
        breaks = np.flatnonzero(np.diff(np.concatenate([[0], equal, [0]])))
        for s, e in zip(breaks[::2], breaks[1::2], strict=True):
            if e - s >= WINDOW:
                return int(e - s)
        for s, e in zip(breaks[::2], breaks[1::2], strict=True):
            if e - s >= SEED and (matched := self._slightly(toks, item, a + diagonal + int(s), a + int(s))):
                return matched
        matched, span, weight = self.passage(toks, item, diagonal)
        return matched if matched >= LEAST_MATCHED and weight >= self.least and matched >= 0.7 * span else 0


def _codes(toks: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = max(0, len(toks) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + toks[k : k + n].astype(np.uint64) + np.uint64(1)
    return out


def _extend(item: list[int], text: list[int], edits: int) -> list[tuple[list[int], int]]:
    """(places of the item's words matched, words of the item spanned) from the start of both on, with at most 0, 1, ... ``edits`` edits."""
    k, n = 0, min(len(item), len(text))
    while k < n and item[k] == text[k]:
        k += 1
    run = list(range(k))
    out = [(run, k)]
    ways = [(di, _extend(item[k + di :], text[k + dt :], edits - 1)) for di, dt in ((1, 1), (1, 0), (0, 1))] if edits and k < n else []
    for e in range(edits):
        best = out[-1]
        for di, way in ways:
            m, span = way[e]
            if m and k + len(m) > len(best[0]):
                best = (run + [k + di + x for x in m], k + di + span)
        out.append(best)
    return out


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _masks(radius: int) -> np.ndarray:
    """All values of a block with at most ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BLOCK_BITS), r)], dtype=np.uint32)


def _items(packed: tuple[tuple[int, str], ...]) -> Items:
    return Items([i for i, _ in packed], [words(t) for _, t in packed])


@dataclass(frozen=True)
class ItemStore:
    """Items in the shared folder: their words by block, and the words of all of them with their counts."""

    folder: str
    blocks: int
    n_items: int
    least: float

    def indexes(self) -> Iterator[Items]:
        """The indexes of all blocks, one in memory at a time."""
        for b in range(self.blocks):
            yield _block(self, b)


def _load(folder: str, *columns: str):
    fs, path = filesystem(folder)
    return pq.read_table(path, filesystem=fs, columns=list(columns), partitioning=None)


@lru_cache(maxsize=1)
def _vocabulary(store: ItemStore) -> Vocabulary:
    t = _load(f"{store.folder}/words", "w", "df", "slip").sort_by("w")
    return Vocabulary(t["w"].to_pylist(), t["df"].to_pylist(), t.filter(t["slip"])["w"].to_pylist(), store.n_items, store.least)


@lru_cache(maxsize=1)
def _block(store: ItemStore, b: int) -> Items:
    fs, path = filesystem(f"{store.folder}/items/b={b}")
    if not _exists(fs, path):  # it got no item
        return Items([], [], _vocabulary(store))
    t = _load(f"{store.folder}/items/b={b}", "id", "ws").sort_by("id")
    return Items(t["id"].to_pylist(), t["ws"].to_pylist(), _vocabulary(store))


def _exists(fs, path: str) -> bool:
    return fs.get_file_info(path).type.name != "NotFound"


def item_blocks(items: DataFrame, id: str, text: str, block: int = ITEM_BLOCK) -> ItemStore | None:  # noqa: A002
    """Write the items to the shared folder in blocks of about ``block``. Of an item given twice the greatest text counts. None if there are none.

    Nothing of their number comes to the driver. A worker holds one block, and some 300 bytes for each different word of all items.
    """
    one = items.where(F.col(id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(text).alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "ws": [words(t) for t in f["text"]]})

    one = materialize(one.mapInPandas(cut, "id bigint, ws array<string>"), "items")
    n = one.count()
    if not n:
        return None
    folder, k = new_dir(items.sparkSession, "store"), -(-n // block)
    one.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(k))).repartition(min(k, 2000), "b").write.partitionBy("b").parquet(f"{folder}/items")
    # a few numbers for each word; both counts combine before the shuffle
    each = one.select("id", F.explode("ws").alias("w")).groupBy("id", "w").agg(F.count("*").alias("c"))
    counts = materialize(each.groupBy("w").agg(F.count("*").alias("df"), F.sum("c").alias("tf")), "counts")
    key = F.concat(F.substring("w", 1, 1), F.array_join(F.array_sort(F.split("w", "")), ""))
    slips = counts.where(F.length("w") > 3).groupBy(key).agg(F.min("w").alias("_s")).select("_s")
    marked = counts.join(slips, F.col("w") == F.col("_s"), "left").select("w", "df", F.col("_s").isNotNull().alias("slip"))
    marked.write.parquet(f"{folder}/words")
    used = counts.agg(F.sum(F.log(1 + n / F.col("df")) * F.col("tf")), F.sum("tf")).first()
    return ItemStore(folder, k, n, LEAST_WORDS_WEIGHT * used[0] / used[1] if used[1] else 0.0)


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **blocks: int) -> DataFrame:
    """``doc_id, item_id, n_words``: each document that holds a passage of an item, itself or in a quote.

    A passage is a run of at least ``WINDOW`` words of the item, even if slightly altered. An unaltered run counts whatever its words are. Of an altered one
    at least ``LEAST_MATCHED`` words match in order, either with at most ``ALTERED`` edits and ``LEAST_WEIGHT_SHARE`` of the passage's own weight, or with the
    weight of ``LEAST_WORDS_WEIGHT`` average words and few others between them, so stock phrases and turns of the language are none. Items of fewer than ``WINDOW`` words have no such passage. Whole texts are read. NULL and empty texts hold nothing; repeated documents give one row; a NULL
    ``doc_id`` is left out. No items, or no documents: no rows. ``block`` (items in memory at a time) changes no row.
    """
    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    kind = src.schema["d"].dataType.simpleString()
    store = item_blocks(items, item_id, item_text, **blocks)
    if store is None:
        return src.select(F.col("d").alias(doc_id), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_words")).limit(0)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # with several blocks an index serves a whole batch of documents before the next one takes its place
            step = 500 if store.blocks == 1 else max(1, len(f))
            for a in range(0, len(f), step):
                ids = f["d"].iloc[a : a + step].tolist()
                texts = [words(t) for t in f["t"].iloc[a : a + step]]
                for index in store.indexes():
                    for b in range(0, len(texts), 500):
                        hits = index.leaks(texts[b : b + 500])
                        yield pd.DataFrame({"d": [ids[b + k] for k, *_ in hits], "item_id": [index.ids[i] for _, i, *_ in hits], "n_words": [m for _, _, m, _ in hits]})

    found = spread(src).mapInPandas(find, f"d {kind}, item_id bigint, n_words int")
    return found.groupBy(F.col("d").alias(doc_id), "item_id").agg(F.max("n_words").alias("n_words"))
