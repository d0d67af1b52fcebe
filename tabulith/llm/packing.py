"""Filling fixed-capacity containers with documents: dominance reduction, then best fit.

Sizes are whole tokens, so a packing depends on nothing but how many items there are of each size: a histogram of at most
``capacity`` rows. It is packed whole, over all data, as patterns with multiplicities: Martello and Toth's dominance reduction fixes sets of items
that no other use of the container can beat, best fit (largest items first) packs what remains. Items then find their place by their rank
among those of their size. Work on the driver depends on the capacity alone, not on the number of documents.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.session import materialize, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]  # (size, copies), in the order they lie in the container


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """(fixed patterns with their multiplicities, what remains).

    For the largest size s with r = capacity - s left beside it, a set is fixed if it provably dominates all others with s: s alone
    if nothing fits; s and the largest k <= r if k fills the rest, if no two others fit, or if at most two fit and k is no less than
    the best pair; s, k and the largest m that fits beside them if at most two fit and no pair has both parts above m.
    """
    left = {s: n for s, n in count.items() if n > 0 and s > 0}
    present = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def have(x: int, used: list[int]) -> int:
        return left.get(x, 0) - used.count(x)

    def largest(limit: int, used: list[int]) -> int | None:
        i = bisect_right(present, limit) - 1
        while i >= 0 and have(present[i], used) <= 0:
            i -= 1
        return present[i] if i >= 0 else None

    def smallest(n: int, used: list[int]) -> list[int]:
        out: list[int] = []
        for x in present:
            while have(x, [*used, *out]) > 0 and len(out) < n:
                out.append(x)
            if len(out) == n:
                break
        return out

    def best_pair(r: int, used: list[int]) -> int:
        best, i, j = 0, 0, bisect_right(present, r) - 1
        while i <= j:
            if have(present[i], used) <= 0:
                i += 1
            elif have(present[j], used) <= 0 or present[i] + present[j] > r:
                j -= 1
            elif i == j and have(present[i], used) < 2:
                break
            else:
                best = max(best, present[i] + present[j])
                i += 1
        return best

    def fix(parts: list[int]) -> None:
        n = min(left[x] // parts.count(x) for x in set(parts))
        fixed.append((tuple((x, parts.count(x)) for x in dict.fromkeys(parts)), n))
        for x in set(parts):
            left[x] -= n * parts.count(x)
            if not left[x]:
                del left[x]
                present.pop(bisect_left(present, x))

    for s in sorted(count, reverse=True):
        while left.get(s, 0) > 0:
            r, used = capacity - s, [s]
            few = smallest(3, used)
            k = largest(r, used)
            if k is None:
                fix([s])
            elif k == r or sum(few[:2]) > r or len(few) < 2:
                fix([s, k])
            elif len(few) < 3 or sum(few) > r:
                if k >= best_pair(r, used):
                    fix([s, k])
                    continue
                m = largest(r - k, [s, k])
                if m is None:
                    break
                above = [x for x in present[bisect_right(present, m) : bisect_right(present, r)] if have(x, used) > 0][:2]
                two = 2 * above[0] if above and have(above[0], used) > 1 else sum(above) if len(above) > 1 else capacity + 1
                if two > r:
                    fix([s, k, m])
                else:
                    break
            else:
                break
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, largest first, for all items of a size at once: the fullest containers that still take the size come first."""
    open_: dict[int, list[list]] = {}  # room -> groups [pattern, number of containers]
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([pattern, n])

    for s in sorted(count, reverse=True):
        n = count[s]
        while n > 0:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, pattern, m = capacity, (), -(-n // (capacity // s))
            k = room // s
            full = min(m, n // k)
            put(room - k * s, (*pattern, (s, k)), full)
            n -= full * k
            m -= full
            if m and n:
                put(room - n * s, (*pattern, (s, n)), 1)
                m, n = m - 1, 0
            if pattern:
                put(room, pattern, m)
    return [(p, n) for groups in open_.values() for p, n in groups]


def pack_histogram(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and multiplicities that hold exactly the counted items. Sizes are 1 .. capacity."""
    if any(s < 1 or s > capacity for s in count):
        raise ValueError("sizes must lie between 1 and the capacity")
    fixed, rest = reduce_instance(count, capacity)
    return fixed + best_fit(rest, capacity)


def place_runs(patterns: list[tuple[Pattern, int]]) -> tuple[np.ndarray, int]:
    """(runs, number of containers); a run is (size, first rank, first container, copies, place): the items of that size from that rank on."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for pattern, n in patterns:
        at = 0
        for s, k in pattern:
            out.append((s, taken.get(s, 0), base, k, at))
            taken[s] = taken.get(s, 0) + n * k
            at += s * k
        base += n
    runs = np.array(out, dtype=np.int64).reshape(-1, 5)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))], base


@lru_cache(maxsize=2)
def counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, by the file's kind: ``.tiktoken`` ranks of a byte-level vocabulary, ``.json`` of the
    tokenizers library, ``.model`` of sentencepiece. Strings of special tokens count as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(x)) for x in texts]
    if tokenizer.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:  # noqa: A002
    """``id, n_tokens`` of each row; NULL and empty texts have none. ``tokenizer`` is the path of a public vocabulary file on the driver or on all executors."""

    if os.path.exists(tokenizer):
        docs.sparkSession.sparkContext.addFile(tokenizer)  # executors that don't have the path get the file with the job

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(os.path.basename(tokenizer)))
        for b in batches:  # ids stay in Arrow's form: pandas would turn longs with a NULL among them into doubles
            texts = b.column(1).to_pylist()
            n = np.zeros(len(texts), dtype=np.int64)
            batch: list[int] = []
            size = 0
            for i, x in enumerate(texts):
                batch.append(i)
                size += len(x)
                if size > 1_000_000 or i == len(texts) - 1:
                    n[batch] = tokens([texts[j] for j in batch])
                    batch, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["d", "n_tokens"])

    src = docs.select(F.col(id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return spread(src).mapInArrow(count, f"d {src.schema['d'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("d", id)


def pack(sized: DataFrame, id: str, size: str, capacity: int = CAPACITY) -> DataFrame:  # noqa: A002
    """``id, piece, n_tokens, container, place`` of all rows of ``sized``.

    A row of at most ``capacity`` is one piece; a longer one is cut into full pieces, which fill a container each, and a last piece. Pieces
    ``[place, place + n_tokens)`` of a container never overlap nor pass the capacity. A row without tokens (NULL or negative size too) takes no
    room: it lies at place 0 of some container. Repeated rows are items of their own, a NULL id is an id. No rows: no result.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    pieces = sized.select(F.col(id).alias("d"), n.alias("n")).select("d", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("d", F.col("piece").cast("int").alias("piece"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("s"))
    pieces = materialize(pieces, "pieces")
    total = pieces.count()
    shards = max(1, -(-total // SHARD_ROWS))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("d", "piece"), F.lit(shards)).cast("int"))
    by = materialize(pieces.where("s > 0").groupBy("s", "shard").agg(F.count("*").alias("c")), "sizes")
    hist = {r.s: r.c for r in by.groupBy("s").agg(F.sum("c").alias("c")).collect()}  # at most capacity rows
    runs, containers = place_runs(pack_histogram(hist, capacity))
    first = by.withColumn("before", F.sum("c").over(Window.partitionBy("s").orderBy("shard")) - F.col("c")).select("s", "shard", "before")
    ranked = pieces.where("s > 0").withColumn("r", F.row_number().over(Window.partitionBy("s", "shard").orderBy("d", "piece"))).join(first, ["s", "shard"])
    ranked = ranked.select("d", "piece", "s", (F.col("before") + F.col("r") - 1).alias("rank"))
    key = runs[:, 0] << 44 | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, rank = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            run = runs[np.searchsorted(key, s << 44 | rank, side="right") - 1]
            t = rank - run[:, 1]
            cols = [pa.array(s.astype(np.int32)), pa.array(run[:, 2] + t // run[:, 3]), pa.array((run[:, 4] + t % run[:, 3] * s).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["d", "piece", "n_tokens", "container", "place"])

    kind = pieces.schema["d"].dataType.simpleString()
    out = ranked.mapInArrow(place, f"d {kind}, piece int, n_tokens int, container bigint, place int")
    none = pieces.where("s = 0").select("d", "piece", F.col("s").alias("n_tokens"), F.pmod(F.xxhash64("d"), F.lit(max(1, containers))).alias("container"), F.lit(0).alias("place"))
    return out.unionByName(none).withColumnRenamed("d", id)
