from __future__ import annotations

import random

import numpy as np
import pytest

from tabulith.llm import contamination as c
from tabulith.llm.text import words

VOCABULARY = [a + b + d for a in "bdfgklmprstvz" for b in "aeiou" for d in ("nt", "rk", "sh", "l", "mber")]


def text(r, n):
    return " ".join(r.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def items():
    r = random.Random(7)
    return [(i + 1, text(r, r.randint(20, 60))) for i in range(40)]


def index(items):
    return c.Items([i for i, _ in items], [words(t) for _, t in items])


def test_words():
    assert words("It&amp;#39;s <b>bold</b>.<br/>New") == ["it", "s", "bold", "new"]
    assert words("> GA> quo-\n> ted line\n> > again") == ["quoted", "line", "again"]
    assert words("ｆｕｌｌ wi­dth z​ero ѕаме") == ["full", "width", "zero", "same"]
    assert words("[quote=x]UPPER[/quote] a_b") == ["upper", "a", "b"] and words(None) == words("") == []


def test_no_pair_within_the_radius_is_missed(items):
    """The multi-index against all pairs."""
    ix = index(items)
    r = random.Random(3)
    toks = []
    for _ in range(60):
        t = words(r.choice(items)[1])
        k = r.randrange(len(t))
        toks += [w if r.random() > 0.1 else r.choice(VOCABULARY) for w in t[k : k + 25]] + words(text(r, 10))
    coded = ix.encode(toks)
    p, w, share = ix.candidates(coded, np.zeros(len(coded), int))
    got = set(zip(p.tolist(), w.tolist(), strict=True))
    rows = np.lib.stride_tricks.sliding_window_view(coded, c.WINDOW)
    h = ix._hash_rows(rows)
    near = np.bitwise_count(h[:, None] ^ ix.hashes[None, :]) <= c.RADIUS
    known = (rows > 0).sum(axis=1) >= c.WINDOW // 2
    a, b = np.nonzero(near & known[:, None])
    keep = ix._share(coded, a, b) >= c.LEAST_SHARED
    assert got == set(zip(a[keep].tolist(), b[keep].tolist(), strict=True)) and len(got) > 200


def brute(doc: list[str], item: list[str]) -> int:
    """Longest run of equal words."""
    best, prev = 0, [0] * (len(item) + 1)
    for x in doc:
        row = [0] * (len(item) + 1)
        for j, y in enumerate(item):
            if x == y:
                row[j + 1] = prev[j] + 1
                best = max(best, row[j + 1])
        prev = row
    return best


def test_against_brute_force(spark, items):
    r = random.Random(5)
    docs, want = [], set()
    for k in range(300):
        i, t = r.choice(items)
        t = t.split()
        n = r.choice([5, 7, 14, 18, len(t)])
        a = r.randrange(max(1, len(t) - n + 1))
        cut = t[a : a + n]
        docs.append((k, " ".join([text(r, r.randint(0, 30)), *cut, text(r, r.randint(0, 30))])))
    for k, d in docs:
        for i, t in items:
            run = brute(words(d), words(t))
            if run >= 12:
                want.add((k, i))
            assert run >= 12 or run < 9
    df = spark.createDataFrame([(*d, "x", 1) for d in docs] + [(0, docs[0][1], "x", 1), (None, items[0][1], "", 1), (900, None, "", 1), (901, "", "", 1)], "doc_id long, text string, item_id string, t int")
    its = spark.createDataFrame([*items, items[0], (99, None), (98, ""), (97, "too short to matter"), (None, "x")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in c.leaked(df, its).collect()}
    assert got == want and len(want) > 100
    assert c.leaked(df.limit(0), its).count() == 0 and c.leaked(df, its.limit(0)).count() == 0


def test_blocks_of_items(spark, items, monkeypatch):
    monkeypatch.setattr(c.item_blocks, "__defaults__", (7,))
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in c.leaked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(i, i) for i, _ in items}


def test_altered_passages(items):
    """Passages with swapped letters, replaced, added and lost words."""
    ix, r = index(items), random.Random(9)
    found = total = 0
    for i, t in items:
        for _ in range(5):
            out = []
            for w in words(t)[:30]:
                x = r.random()
                if x < 0.03:
                    out.append(w[:1] + w[2] + w[1] + w[3:])
                elif x < 0.06:
                    out.append(r.choice(VOCABULARY))
                elif x < 0.08:
                    out += [w, "really"]
                elif x > 0.02 + 0.08:
                    out.append(w)
            total += 1
            found += any(ix.ids[k] == i for _, k, _, _ in ix.leaks([words(text(r, 20)) + out + words(text(r, 20))]))
    assert found >= 0.98 * total


def test_long_text(items):
    ix, r = index(items), random.Random(2)
    toks = words(text(r, 60_000)) + words(items[3][1]) + words(text(r, 1000))
    assert [ix.ids[k] for _, k, _, _ in ix.leaks([[], toks, ["one"]])] == [items[3][0]]


def test_runs_of_common_words():
    """An unaltered run of 12 or 13 words counts though every item uses its words; the same words in another order don't."""
    r = random.Random(4)
    common = r.sample(VOCABULARY, 16)
    its = [(k, " ".join(r.sample(common, 16)) + " " + text(r, 25)) for k in range(40)]
    ix = index(its)
    for n in (12, 13):
        for k, t in its[:10]:
            run = words(t)[1 : 1 + n]
            got = {ix.ids[i] for _, i, _, _ in ix.leaks([["zz"] * 15 + run + ["zz"] * 15])}
            assert k in got
    assert ix.leaks([["zz"] * 5 + common[::2] + ["zz"] + common[1::2]]) == []


@pytest.mark.parametrize(("n", "replaced", "inserted"), [(12, 1, 0), (12, 0, 1), (12, 2, 0), (14, 2, 0), (16, 2, 0)])
def test_short_altered_passages(items, n, replaced, inserted):
    """The shortest passages with words replaced by others of the items, or put in."""
    ix, r = index(items), random.Random(n)
    found = 0
    for i, t in items * 5:
        t = words(t)
        a = r.randrange(len(t) - n + 1)
        cut = t[a : a + n]
        for x in r.sample(range(n), replaced):
            cut[x] = r.choice(VOCABULARY)
        for _ in range(inserted):
            cut.insert(r.randrange(1, n), r.choice(VOCABULARY))
        found += any(ix.ids[k] == i for _, k, _, _ in ix.leaks([words(text(r, 20)) + cut + words(text(r, 20))]))
    assert found >= 0.95 * 200


def altered(r, t):
    out = []
    for w in words(t):
        x = r.random()
        out += [w[:1] + w[2] + w[1] + w[3:]] if x < 0.04 else [r.choice(VOCABULARY)] if x < 0.08 else [w, "really"] if x < 0.1 else [] if x < 0.12 else [w]
    return out


def test_blocks_change_nothing(spark, items):
    """The same rows for any size of block: weights, spellings and the least weight come from all items."""
    r = random.Random(21)
    docs = [(k, " ".join([text(r, 15), *altered(r, r.choice(items)[1])[: r.randint(8, 40)], text(r, 15)])) for k in range(250)]
    df, its = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(tuple, c.leaked(df, its, block=n).collect())) for n in (3, 11, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 150
    ix = index(items)
    assert got[0] == sorted({(docs[k][0], ix.ids[i], m) for k, i, m, _ in ix.leaks([words(t) for _, t in docs])})


@pytest.mark.parametrize("size", [0, 1 << 19, 1 << 30])
def test_any_side_of_the_index(items, monkeypatch, size):
    """Where the index is too large for all values near an item's, those near the document's are looked up: the same candidates."""
    whole = index(items)
    monkeypatch.setattr(c, "TABLE_BYTES", size)
    ix, r = index(items), random.Random(8)
    toks = [w for _ in range(40) for w in altered(r, r.choice(items)[1])]
    coded = whole.encode(toks)
    got, want = (sorted(zip(*(x.tolist() for x in i.candidates(coded, np.zeros(len(coded), int))), strict=True)) for i in (ix, whole))
    assert got == want and len(got) > 100 and ix.spread == {0: 0, 1 << 19: 1, 1 << 30: 2}[size]


def test_recall_against_brute_force(items):
    """Every altered passage that the exact test accepts at some diagonal is found: candidates lose next to none."""
    ix, r = index(items), random.Random(31)
    found = total = 0
    for k in range(200):
        i, t = r.choice(items)
        n = r.randint(12, 30)
        cut = altered(r, " ".join(words(t)[:n]))
        toks = ix.encode(words(text(r, 12)) + cut + words(text(r, 12)))
        it = ix.ids.index(i)
        held = any(ix._holds(toks, it, d) for d in range(-len(ix.tokens[it]), len(toks)))
        total += held
        found += held and any(x == it for _, x, _, _ in ix.leaks([words(text(random.Random(31 + k), 12)) + cut + words(text(r, 12))]))
    assert total > 120 and found >= 0.98 * total


def test_crowded_buckets(items, monkeypatch):
    """Many items with one passage in common: fewer windows are compared at a time, with the same result."""
    r = random.Random(3)
    stock = text(r, 14)
    ix = index([(k, f"{text(r, 8)} {stock} {text(r, 8)}") for k in range(200)])
    docs = [words(f"{text(r, 10)} {stock} {text(r, 10)}") for _ in range(5)]
    want = sorted((k, i, m) for k, i, m, _ in ix.leaks(docs))
    monkeypatch.setattr(c, "LOOKUPS", 50)
    assert sorted((k, i, m) for k, i, m, _ in ix.leaks(docs)) == want and len(want) == 1000


def test_windows_are_looked_up_in_the_order_of_the_table(items, monkeypatch):
    """Neighbours in the table follow one another, however windows are cut; what is found is the same."""
    ix, r = index(items), random.Random(19)
    texts = [words(" ".join([text(r, r.randint(0, 30)), " ".join(words(r.choice(items)[1])[3:20]), text(r, 15)])) for _ in range(40)]
    coded = [ix.encode(t) for t in texts]
    toks, doc = np.concatenate(coded), np.repeat(np.arange(len(coded)), [len(x) for x in coded])
    assert ix._hash_runs(toks).tolist() == ix._hash_rows(np.lib.stride_tricks.sliding_window_view(toks, c.WINDOW)).tolist()

    class Table(np.ndarray):
        def __getitem__(self, k):
            if getattr(k, "ndim", 0):
                asked.append(np.asarray(k))
            return np.asarray(self)[k]

    asked, tables = [], ix.tables
    want = [x.tolist() for x in ix.candidates(toks, doc)], ix.leaks(texts)
    ix.tables = [(first.view(Table), *rest) for first, *rest in tables]
    ix.candidates(toks, doc)
    assert ix.spread == c.BLOCK_RADIUS and asked and all((np.diff(k.astype(int)) >= 0).all() for k in asked)
    ix.tables = tables
    for slab, runs, lookups in ((7, 3, 5), (64, 1, 1 << 20), (13, 50, 40)):
        for name, n in (("SLAB", slab), ("RUNS", runs), ("LOOKUPS", lookups)):
            monkeypatch.setattr(c, name, n)
        assert ([x.tolist() for x in ix.candidates(toks, doc)], ix.leaks(texts)) == want and want[1]


def test_seeds_without_a_code_of_an_item_are_not_searched(items):
    ix = index(items)
    assert ix.seed_marks[ix.seeds >> ix.seed_shift].all() and ix.seed_marks.mean() < 0.1
    assert c.Items([], []).leaks([words(items[0][1])]) == []
