from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from tabulith.llm import packing as p


def optimum(items: list[int], capacity: int) -> int:
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(400))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 37, 100])
    items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
    fixed, rest = p.reduce_instance(Counter(items), capacity)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (optimum(left, capacity) if left else 0) == optimum(items, capacity)
    packed: Counter = Counter()
    for pattern, n in p.pack_histogram(Counter(items), capacity):
        assert sum(s * k for s, k in pattern) <= capacity
        for s, k in pattern:
            packed[s] += k * n
    assert packed == Counter(items)


def test_millions_of_items_and_full_containers():
    r = random.Random(1)
    count = {s: int(3e6 / s) + r.randint(0, 99) for s in range(1, 2049)}
    patterns = p.pack_histogram(count)
    total = sum(s * n for s, n in count.items())
    assert len(patterns) < 20_000 and sum(n for _, n in patterns) <= total / 2048 * 1.001 + 1
    runs, containers = p.place_runs(patterns)
    assert containers == sum(n for _, n in patterns) and len(runs) < 200_000


def check(rows, sizes, capacity):
    """Every item whole, in pieces only if larger than a container, without overlap."""
    spans = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.id].append((r.piece, r.n_tokens))
        if r.n_tokens:
            spans[r.container].append((r.place, r.place + r.n_tokens))
    for c in spans.values():
        c.sort()
        assert c[0][0] == 0 and all(a[1] == b[0] for a, b in zip(c, c[1:], strict=False)) and c[-1][1] <= capacity
    want = defaultdict(list)
    for i, n in sizes:
        n = max(n or 0, 0)
        want[i] += [(k, min(capacity, n - k * capacity)) for k in range(max(1, -(-n // capacity)))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(spans)


@pytest.mark.parametrize("shard", [5, 200_000])
def test_pack(spark, monkeypatch, shard):
    monkeypatch.setattr(p, "SHARD_ROWS", shard)
    r = random.Random(4)
    sizes = [(i, r.choice([2, 2, 2, r.randint(1, 60), r.randint(0, 260)])) for i in range(400)] + [(1000, None), (1001, 0), (1002, -5), (1003, 100), (1003, 100), (1004, 1000), (None, 7)]
    df = spark.createDataFrame([(*x, 1, "s") for x in sizes], "id long, n int, place int, container string")
    used = check(p.pack(df, "id", "n", 100).collect(), sizes, 100)
    assert used <= sum(max(n or 0, 0) for _, n in sizes) / 100 * 1.02 + 1
    assert p.pack(df.limit(0), "id", "n", 100).count() == 0
    assert p.pack(df.where("n = 0"), "id", "n", 100).count() == df.where("n = 0").count()


def test_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = ["Hello world", "", None, "<|endoftext|> as text", "x" * 50_000, "naïve 日本語 🙂", "a b " * 100_000]
    assert p.counter("/opt/tokenizers/piece_bpe_32k.model")(["", "Hello world"]) == [0, 2]
    assert p.counter("/opt/tokenizers/word_bpe_49k.json")(["", "Hello world"]) == [0, 2]
    got = {r.id: r.n_tokens for r in p.token_counts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()}
    t.encode_special_tokens = True
    assert got == {i: 0 if not x else len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_ids_stay_whole_beside_nulls(spark):
    big = 8_182_715_666_859_000_001
    docs = spark.createDataFrame([(big, "some words"), (None, "other words here"), (big + 1, "")], "doc_id bigint, text string").coalesce(1)
    from tabulith.llm import packing

    got = packing.pack(packing.token_counts(docs, "doc_id", "text"), "doc_id", "n_tokens").collect()
    assert {r.doc_id for r in got} == {big, None, big + 1}
