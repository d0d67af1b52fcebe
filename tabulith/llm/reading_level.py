"""Reading level of each document: a linear pairwise ranker, calibrated by isotonic regression.

The author's own prose is taken out of a post (no quotes, signatures, code, logs, pasted test items), described by features of syntax and
vocabulary, and scored by a linear model that was fitted to order pairs of graded documents. Isotonic regression over scores from
folds that the model had not seen turns scores into levels. Beside lengths and marks, syntax shows in the order of word shapes: which patterns of them are demanding
is learned by the ranker. Whether prose is English is told by a model of letter sequences, trained on posts that name their language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.contamination import WINDOW, Items, ItemStore, _items, item_blocks  # noqa: F401
from tabulith.llm.text import CONFUSABLE, TAG, WORD, plain_words, unescaped
from tabulith.session import spread

MAX_LABELLED = 5_000
PAIRS_PER_DOC = 200
FOLDS = 5
LEAST_WORDS = 30
BASE = 16  # features beside the counts
VOCABULARY = 512
PATTERNS = 512
MAX_LANGUAGE = 5_000
LETTER_BITS = 14
LETTERS = 1 << LETTER_BITS
BATCH = 500

PRE = re.compile(r"(?is)<(pre|code)\b[^>]*>.*?(?:</\1\s*>|\Z)|```.*?(?:```|\Z)|\[code\].*?(?:\[/code\]|\Z)")
BB_QUOTE = re.compile(r"(?is)\[quote(?:=[^\]]*)?\](?:(?!\[quote\b).)*?\[/quote\]")
HTML_QUOTE = re.compile(r"(?is)<blockquote\b[^>]*>(?:(?!<blockquote\b).)*?</blockquote\s*>")
OPEN_QUOTE = re.compile(r"(?is)(?:\[quote(?:=[^\]]*)?\]|<blockquote\b[^>]*>).*?(?:\n[ \t]*\n|\Z)")
LINE_QUOTE = re.compile(r"(?m)^[ \t]*(?:[A-Za-z]{0,3}>).*$")
ORIGINAL = re.compile(r"(?m)^-{3,}\s*Original Message\s*-{3,}[^\n]*\n(?:[^\n]+\n?)*")
SAID = re.compile(r"(?mi)^.{0,80}\b(?:wrote|said|says):[ \t]*$")
BREAK = re.compile(r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h\d|tr|table)\b[^>]*>")
BB = re.compile(r"\[/?[A-Za-z*]+(?:=[^\]\n]{0,200})?\]")
SIGNATURE = re.compile(r"\n[ \t]*(?:-{2,3}|_{3,}|={3,})[ \t]*\n(?=((?:[^\n]*\n?){1,6})\Z)")
URL = re.compile(r"(?i)\b(?:https?://|www\.)\S+|\b[\w-]+\.(?:com|org|net|info|invalid|example|test)\b\S*")
# One of these is in every ASCII text that URL matches.
URL_MARKS = ("://", "www.", ".com", ".org", ".net", ".info", ".invalid", ".example", ".test")
DIGIT = re.compile(r"\d")
PLAIN_DIGIT = re.compile(r"[0-9]")  # the same of ASCII texts, faster
NUMBERED = re.compile(r"(?<!\S)[^\s\d]*\d")
LONG = re.compile(r"\S{41}")
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n\s*\n")
ENDED = re.compile(r"[.!?]([\"')\]]*\s+)")  # the first kind of SENTENCE, found by the mark
VOWELS = re.compile(r"[aeiouy]+")
WRAP = re.compile(r"(?<=\w)-\n(?=\w)")

# English words that only join or point.
COMMON = frozenset("a an the this that these those my our your his her its their i you we they he she it me him us them and or but so not no do does did is are was were be been has have had will would can could may might should must of in on at by for from with to as if when while because since after before until although though than then there here who which what why how".split())
SUBORDINATE = frozenset("after albeit although as because before if inasmuch insofar lest notwithstanding once provided since that though unless until when whenever where whereas whereby wherein whereupon wherever which while whilst who whom whose".split())
PERSONAL = frozenset("i you we they he she it me us them".split())


def own_prose(text: str | None) -> list[str]:
    """The author's own sentences that have words. Quotes (also nested or cut off), attributions, code, logs, encoded data, links, markup and
    signatures are left out; a last paragraph of one short sentence counts as a signature if there are others before it."""
    return [s for s in _sentences(text) if WORD.search(s)]


def _sentences(text: str | None) -> list[str]:
    if not text:
        return []
    t = text.replace("\r\n", "\n") if "\r" in text else text
    # the patterns run only where what they look for is there: posts are many
    code = "<" in t or "```" in t or "[" in t
    t = unescaped(PRE.sub("\n\n", t) if code else t)
    tagged, bracketed = "<" in t, "[" in t
    if tagged or bracketed or "```" in t:
        t = PRE.sub("\n\n", t)
        for quote, there in ((BB_QUOTE, bracketed), (HTML_QUOTE, tagged)):
            n = there
            while n:
                t, n = quote.subn(" ", t)  # an outer quote that was cut off still ends at the next empty line
        t = OPEN_QUOTE.sub("\n\n", t)
    if "Original Message" in t:
        t = ORIGINAL.sub("\n\n", t)
    m = SIGNATURE.search(t)
    if m and len(m[1].split()) <= 30:
        t = t[: m.start()]
    if ">" in t:
        t = LINE_QUOTE.sub("\n", t)
    if ":\n" in t or t.endswith(":"):
        t = SAID.sub("", t)
    if tagged:
        t = TAG.sub("", BREAK.sub("\n\n", t))
    if bracketed:
        t = BB.sub("", t)
    if "-\n" in t:
        t = WRAP.sub("", t)
    if "." in t:
        t = _unlinked(t)
    if (PLAIN_DIGIT if t.isascii() else DIGIT).search(t) or max(map(len, t.split()), default=0) > 40:
        t = "\n".join("" if (len(x) > 40 and LONG.search(x)) or (DIGIT.search(x) and len(NUMBERED.findall(x)) * 3 > len(x.split())) else x for x in t.split("\n"))
    t = t.replace("_", "").replace("*", "")
    paragraphs = [p for p in re.split(r"\n\s*\n", t) if p.strip()]
    if len(paragraphs) > 1 and len(paragraphs[-1].split()) < 12 and len(SENTENCE.split(paragraphs[-1].strip())) == 1 and "\n" not in paragraphs[-1].strip():
        paragraphs.pop()
    return [s.strip() for p in paragraphs for s in _cut(p) if s]


def _unlinked(t: str) -> str:
    """``URL.sub(" ", t)``; the pattern runs only where a mark of it is there."""
    if t.isascii():
        low = t.lower()
        if not any(m in low for m in URL_MARKS):
            return t
    return URL.sub(" ", t)


def _cut(paragraph: str) -> list[str]:
    """``SENTENCE.split(paragraph)`` of a text without empty lines."""
    out, a = [], 0
    for m in ENDED.finditer(paragraph):
        out.append(paragraph[a : m.start(1)])
        a = m.end()
    out.append(paragraph[a:])
    return out


class _Words(dict):
    """Places of the words met so far in a table of their attributes: (length, syllables, subordinates, personal, common, is "of", place of its count, shape). The shape of
    a word of up to three letters, as most of those that join others are, is the word itself, that of a longer one its last three."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.table = np.zeros((8, 0))

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.rows.append((len(w), max(1, len(VOWELS.findall(w))), w in SUBORDINATE, w in PERSONAL, w in COMMON, w == "of", xxhash.xxh32_intdigest(w) % VOCABULARY, xxhash.xxh32_intdigest(w[-3:] if len(w) < 4 else "-" + w[-3:])))
        return n

    def of(self, words_: list[str]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words_), dtype=np.int64, count=len(words_))
        if len(self.rows) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.array(self.rows[self.table.shape[1] :], dtype=float).T], axis=1)
        return self.table[:, at]


_words = _Words()


Post = tuple[list[str], list[list[str]]]  # sentences and their words


def post_of(text: str | None) -> Post:
    both = [(s, w) for s in _sentences(text) if (w := tokens(s))]
    return [s for s, _ in both], [w for _, w in both]


def tokens(sentence: str) -> list[str]:
    if sentence.isascii():
        return plain_words(sentence)
    s = sentence.lower()
    return WORD.findall(s if s.isascii() else s.translate(CONFUSABLE))


@dataclass
class Features:
    """Of each post: ``base``, features of syntax (lengths, clauses, commas) and of vocabulary (lengths, syllables, kinds of words), and relative counts, held as places:
    hashed words, and three word shapes in a row within a sentence. ``n`` counts words. Without a language model a text is ``english`` if a fifth of its words are
    ones that only join or point there."""

    base: np.ndarray
    n: np.ndarray
    english: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    pattern_doc: np.ndarray
    pattern: np.ndarray

    def dense(self) -> np.ndarray:
        """All features as columns, ``BASE + VOCABULARY + PATTERNS``."""
        k, per = len(self.n), (10 / np.maximum(self.n, 1))[:, None]
        counts = [np.bincount(d * size + x, minlength=k * size).reshape(k, size) * per for d, x, size in ((self.doc, self.word, VOCABULARY), (self.pattern_doc, self.pattern, PATTERNS))]
        return np.concatenate([self.base, *counts], axis=1)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """``dense() @ w`` from the places alone."""
        k, per = len(self.n), 10 / np.maximum(self.n, 1)
        words_, patterns = w[BASE : BASE + VOCABULARY], w[BASE + VOCABULARY :]
        return self.base @ w[:BASE] + per * (np.bincount(self.doc, words_[self.word], k) + np.bincount(self.pattern_doc, patterns[self.pattern], k))


def features(posts: list[Post]) -> Features:
    k = len(posts)
    toks_ = [t for _, toks in posts for t in toks]
    per_post = np.fromiter((len(toks) for _, toks in posts), dtype=np.int64, count=k)
    lens = np.fromiter(map(len, toks_), dtype=np.int64, count=len(toks_))
    flat = list(chain.from_iterable(toks_))
    of = np.repeat(np.arange(k), per_post)
    n = np.bincount(of, lens, k)
    none = np.zeros(0, np.int64)
    if not flat:
        return Features(np.zeros((k, BASE)), n.astype(int), np.zeros(k, bool), none, none, none, none)
    longest = np.zeros(k)
    np.maximum.at(longest, of, lens)
    marks = np.array([sum(s.count(",") + s.count(";") + s.count(":") for s in sentences) for sentences, _ in posts], dtype=float)
    w = _words.of(flat)
    doc = np.repeat(of, lens)
    total = lambda v: np.bincount(doc, v, k)
    some, m = np.maximum(n, 1), np.maximum(per_post, 1)
    size = w[0]
    common = total(w[4])
    content = np.maximum(n - common, 1)
    mean = total(size) / some
    sub = total(w[2])
    base = np.stack(
        [
            np.log(some / m),
            n / m / 10,
            np.log(np.maximum(longest, 1)),
            marks / m,
            sub / m,
            sub / some * 10,
            mean,
            np.sqrt(np.maximum(total(size**2) / some - mean**2, 0)),
            total(size >= 8) / some * 5,
            total(size >= 11) / some * 5,
            total(size >= 13) / some * 5,
            total(w[1]) / some,
            total(w[3]) / some * 10,
            total(w[5]) / some * 10,
            (n - common) / some * 5,
            total(size * (1 - w[4])) / content,
        ],
        axis=1,
    )
    base[n == 0] = 0
    shape = w[7].astype(np.uint64)
    sentence = np.repeat(np.arange(len(lens)), lens)
    within = sentence[:-2] == sentence[2:]
    code = (shape[:-2] * np.uint64(0x9E3779B1) + shape[1:-1] * np.uint64(0x85EBCA77) + shape[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(17)
    return Features(base, n.astype(int), (n > 0) & (common >= 0.2 * n), doc, w[6].astype(np.int64), doc[:-2][within], (code[within] % np.uint64(PATTERNS)).astype(np.int64))


def letter_codes(posts: list[Post]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of all runs of three letters of the posts' words one after another, where each post's begin, which runs lie across two posts)."""
    texts = [f" {' '.join(chain.from_iterable(toks))} " for _, toks in posts]
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    x = np.frombuffer(("".join(texts) + "  ").encode("utf-32-le"), dtype=np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return h >> np.uint32(32 - LETTER_BITS), np.concatenate([[0], ends[:-1]]), np.concatenate([ends - 2, ends - 1])


@dataclass
class Language:
    """Naive Bayes over runs of three letters: what each says for English."""

    odds: np.ndarray

    @staticmethod
    def of(counts: dict[bool, np.ndarray]) -> Language:
        """From the counts of runs in English posts and in others."""
        yes, no = ((counts[k] + 0.5) / (counts[k] + 0.5).sum() for k in (True, False))
        return Language(np.log(yes) - np.log(no))

    def english(self, posts: list[Post]) -> np.ndarray:
        if not posts:
            return np.zeros(0, bool)
        code, starts, across = letter_codes(posts)
        said = self.odds[code]
        said[across] = 0
        return np.add.reduceat(said, starts) > 0


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray  # scores
    levels: np.ndarray  # non-decreasing levels at the scores

    def score(self, x: np.ndarray | Features) -> np.ndarray:
        w = self.weights / self.scale
        return (x.dot(w) if isinstance(x, Features) else x @ w) - self.mean @ w

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.cuts, self.levels)


def _pairs(y: np.ndarray, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (harder, easier): up to ``most`` easier partners of each document."""
    rng = np.random.default_rng(seed)
    a, b = [], []
    for i in range(len(y)):
        easier = np.flatnonzero(y < y[i] - 0.25)
        if len(easier) > most:
            easier = rng.choice(easier, most, replace=False)
        a.append(np.full(len(easier), i))
        b.append(easier)
    return np.concatenate(a).astype(int), np.concatenate(b).astype(int)


def _rank(x: np.ndarray, y: np.ndarray, pairs_per_doc: int = PAIRS_PER_DOC, ridge: float = 3e-3, steps: int = 60, keep: int = 10) -> np.ndarray:
    """Weights of a logistic model of which document of a pair is harder, by the limited-memory BFGS method."""
    a, b = _pairs(y, 7, pairs_per_doc)
    w = np.zeros(x.shape[1])
    if not len(a):
        return w
    gap = np.minimum(y[a] - y[b], 2.0)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        s = x @ v
        d = s[a] - s[b]
        e = np.exp(-np.abs(d))
        g = -gap * np.where(d > 0, e, 1.0) / (1 + e)
        per = np.bincount(a, g, len(x)) - np.bincount(b, g, len(x))
        return float((gap * (np.log1p(e) + np.maximum(-d, 0))).mean() + 0.5 * ridge * v @ v), x.T @ per / len(a) + ridge * v

    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    f, g = loss(w)
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * t
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, float(np.linalg.norm(g)))
        for (s, t, r), alpha in zip(past, reversed(alphas), strict=True):
            q += (alpha - r * (t @ q)) * s
        step, slope = 1.0, float(g @ q)
        while True:
            new = w - step * q
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, t = new - w, g2 - g
        if s @ t > 1e-12:
            past = [*past[-(keep - 1) :], (s, t, 1.0 / float(s @ t))]
        done = f - f2 < 1e-6 * max(1.0, abs(f))
        w, f, g = new, f2, g2
        if done:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean scores and non-decreasing levels of the pools."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            s2, v2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + v2, pools[-1][2] + n2]
    return np.array([s / n for s, _, n in pools]), np.array([v / n for _, v, n in pools])


def fit(x: np.ndarray, y: np.ndarray, pairs_per_doc: int = PAIRS_PER_DOC) -> Ranker:
    """Fit ranker and calibration. The calibration uses scores from folds, put on the scale of the final model."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    scale[16:] *= 8.0  # single words weigh little beside the summary features
    z = (x - mean) / scale
    weights = _rank(z, y, pairs_per_doc)
    fold = np.arange(len(y)) % FOLDS
    held = z @ weights
    if len(y) >= 10 * FOLDS:
        final = held.copy()
        for f in range(FOLDS):
            w = _rank(z[fold != f], y[fold != f], pairs_per_doc)
            s = z @ w
            k, c = np.polyfit(s[fold != f], final[fold != f], 1) if np.ptp(s[fold != f]) > 0 else (1.0, 0.0)
            held[fold == f] = s[fold == f] * k + c
    cuts, levels = isotonic(held, y)
    return Ranker(mean, scale, weights, cuts, levels)


def _own(frame: pd.DataFrame, items: Items | ItemStore | None) -> list[Post]:
    """Own sentences of each post and their words, without those that belong to a pasted item."""
    posts = [post_of(t) for t in frame["t"]]
    if items is None:
        return posts
    flat = [list(chain.from_iterable(toks)) for _, toks in posts]
    pasted: dict[int, np.ndarray] = {}
    for index in [items] if isinstance(items, Items) else items.indexes():
        for a in range(0, len(flat), BATCH):
            for k, item, _, at in index.leaks(flat[a : a + BATCH]):
                mark = pasted.setdefault(a + k, np.zeros(len(flat[a + k]), bool))
                # the windows reach beyond the passage: of their words those are the item's that stand beside the same neighbour there
                window = np.zeros(len(mark), bool)
                for p in at:
                    window[p : p + WINDOW] = True
                code, it = index.encode(flat[a + k]).astype(np.int64), index.tokens[item].astype(np.int64)
                pair = np.isin(code[:-1] << 32 | code[1:], it[:-1] << 32 | it[1:]) & (code[:-1] > 0) & (code[1:] > 0)
                mark |= window & (np.concatenate([pair, [False]]) | np.concatenate([[False], pair]))
    for k, mark in pasted.items():
        ends = np.cumsum([len(t) for t in posts[k][1]])
        kept = [(s, t) for s, t, e in zip(*posts[k], ends, strict=True) if not t or mark[e - len(t) : e].sum() < 0.5 * len(t)]
        posts[k] = ([s for s, _ in kept], [t for _, t in kept])
    return posts


def _posts(frame: pd.DataFrame, items: ItemStore | None) -> Iterator[tuple[pd.DataFrame, list[Post]]]:
    """Parts of a batch of documents and their posts. With several blocks of items an index serves the whole batch before the next one takes its place."""
    step = BATCH if items is None or items.blocks == 1 else max(1, len(frame))
    for a in range(0, len(frame), step):
        part = frame.iloc[a : a + step]
        posts = _own(part, items)
        for b in range(0, len(part), BATCH):
            yield part.iloc[b : b + BATCH], posts[b : b + BATCH]


def _featured(docs: DataFrame, items: ItemStore | None, keep: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, posts in _posts(f, items):
                yield pd.DataFrame({"d": part["d"].to_numpy(), **{c: part[c].to_numpy() for c in keep}, "x": list(features(posts).dense())})

    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("d", *keep))
    return docs.mapInPandas(run, f"{ddl}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, items: DataFrame | ItemStore | None = None, max_labelled: int = MAX_LABELLED, pairs_per_doc: int = PAIRS_PER_DOC) -> Ranker | None:
    """Fit on the labelled documents: at most ``max_labelled`` of them (chosen by hash), the mean of a document's labels counts; of each, at most ``pairs_per_doc``
    easier ones are its partners in pairs. None if fewer than two have own prose."""
    y = labels.where("doc_id IS NOT NULL AND reading_level IS NOT NULL").groupBy(F.col("doc_id").alias("d")).agg(F.avg("reading_level").alias("y"))
    y = y.orderBy(F.xxhash64("d"), "d").limit(max_labelled)
    graded = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("d"), F.col("text").alias("t")).join(F.broadcast(y), "d").dropDuplicates(["d"])
    t = _featured(graded, _stored(items), ["y"]).toArrow().sort_by("d")  # max_labelled rows of numbers, 4 kB each
    if not t.num_rows:
        return None
    x, y = t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), t["y"].to_numpy()
    full = x[:, 6] > 0
    if full.sum() < 2:
        return None
    return fit(x[full], y[full], pairs_per_doc)


def language(docs: DataFrame, max_language: int = MAX_LANGUAGE) -> Language | None:
    """Fit on at most ``max_language`` posts (chosen by hash) that name their language in ``lang``; None without any of English and any of another."""
    if "lang" not in docs.columns:
        return None
    # the sample is chosen without the texts, which then come to it where they are
    named = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text <> ''")
    some = named.select(F.col("doc_id").alias("_d")).distinct().orderBy(F.xxhash64("_d"), "_d").limit(max_language)
    t = named.select(F.col("doc_id").alias("_i"), "lang", F.col("text").alias("t")).join(F.broadcast(some), F.col("_i") == F.col("_d")).select("lang", "t")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bool, np.ndarray] = {}
        for f in frames:
            english = f["lang"].str.lower().str.startswith("en").to_numpy(bool)
            for e in (True, False):
                texts = f["t"][english == e]
                if len(texts):
                    code, _, across = letter_codes([post_of(x) for x in texts])
                    total[e] = total.get(e, 0) + np.bincount(np.delete(code, across), minlength=LETTERS)
        for e, n in total.items():
            k = np.flatnonzero(n)
            yield pd.DataFrame({"e": np.full(len(k), e), "k": k, "n": n[k]})

    rows = t.mapInPandas(run, "e boolean, k int, n bigint").groupBy("e", "k").agg(F.sum("n").alias("n")).toArrow()  # at most two for each place
    counts = {True: np.zeros(LETTERS), False: np.zeros(LETTERS)}
    for e in (True, False):
        part = rows.filter(pc.equal(rows["e"], e))
        counts[e][part["k"].to_numpy()] = part["n"].to_numpy()
    return Language.of(counts) if all(v.any() for v in counts.values()) else None


def _stored(items: DataFrame | ItemStore | None) -> ItemStore | None:
    return items if items is None or isinstance(items, ItemStore) else item_blocks(items, "item_id", "text")


def reading_levels(docs: DataFrame, labels: DataFrame, items: DataFrame | None = None, max_labelled: int = MAX_LABELLED, pairs_per_doc: int = PAIRS_PER_DOC, max_language: int = MAX_LANGUAGE) -> DataFrame:
    """``doc_id, own_words, english, score, level`` of each document.

    ``level`` is continuous on the labels' scale, NULL where there is no own prose or it isn't English, and everywhere if too few documents are labelled. English is
    told by the prose, not by what ``lang`` says of the post: by a model fitted on at most ``max_language`` posts that name a language, or, where none do, by
    common words. Whole texts are read. NULL and empty texts have no own prose; repeated documents give equal rows, of which one is kept;
    a NULL ``doc_id`` is left out.
    """
    store = _stored(items)
    model = train(docs, labels, store, max_labelled, pairs_per_doc)
    speech = language(docs, max_language)
    src = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, posts in _posts(f, store):
                x = features(posts)
                n, english = x.n, speech.english(posts) & (x.n > 0) if speech else x.english
                score = model.score(x) if model else np.full(len(n), np.nan)
                yield pd.DataFrame({"doc_id": part["d"].to_numpy(), "own_words": n, "english": english, "score": np.where(english, score, np.nan), "level": np.where(english, model.level(score) if model else np.nan, np.nan)})

    kind = src.schema["d"].dataType.simpleString()
    out = spread(src).mapInPandas(run, f"doc_id {kind}, own_words int, english boolean, score double, level double")
    return out.select("doc_id", "own_words", "english", F.nanvl("score", F.lit(None).cast("double")).alias("score"), F.nanvl("level", F.lit(None).cast("double")).alias("level")).dropDuplicates(["doc_id"])
