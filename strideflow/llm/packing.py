"""Best-fit packing by exact complements.

The plan works on counts of piece lengths, a table of at most ``capacity``
entries whatever the corpus: combinations of one, two or three other lengths
that exactly fill a gap are consumed as often as their counts allow, and what
is left is packed best-fit, longest first.  Pieces then take their places by
their rank among the pieces of their length, so no rows meet in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, task
from .tokens import encode_column

CAPACITY = 2048
END = np.uint32(0).tobytes()  # the id after each document
_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, bucket int, place bigint"


def _documents(texts, path: str):
    for i, j, ids, offs in encode_column(texts, path, added=True):
        raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * offs).tolist()
        for r in range(j - i):
            yield i + r, raw[at[r] : at[r + 1]] + END


def _cut(doc_id: str, text: str, path: str, capacity: int):
    """Tokens of each text and the id 0, cut; ``place`` counts the pieces of
    a length within the task."""

    @task
    def run(batches):
        bucket, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index(doc_id)), batch.column(batch.schema.get_field_index(text))
            rows, piece, start, length, crc, place = [], [], [], [], [], []
            for i, tokens in _documents(texts, path):
                n, at = len(tokens) // 4, 0
                for k in range(-(-n // capacity)):
                    size = n - capacity * ((n - 1) // capacity) if k == 0 else capacity
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(tokens[4 * at : 4 * (at + size)]))
                    place.append(seen[size])
                    seen[size] += 1
                    at += size
            cols = [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([bucket] * len(rows), pa.int32()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[doc_id, "piece", "start", "length", "ids_crc32", "bucket", "place"])

    return run


def fill(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every piece once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = np.bincount(pattern, minlength=capacity + 1)
        used = np.flatnonzero(need)
        if (times := int((left[used] // need[used]).min())) > 0:
            left[used] -= times * need[used]
            plan.append((pattern, times))

    if left[capacity]:
        take((capacity,))
    for size in range(capacity - 1, 0, -1):
        gap = capacity - size
        if left[size] and gap <= size and left[gap]:
            take((size, gap))
        if left[size]:
            for pair in _pairs(left, gap, size):
                if not left[size]:
                    break
                take((size, *pair))
        if left[size]:
            for a in range(min(size, gap - 2), 0, -1):
                if not left[size] or 3 * a < gap:
                    break
                if left[a]:
                    for pair in _pairs(left, gap - a, a):
                        if not left[size] or not left[a]:
                            break
                        take((size, a, *pair))
    return plan + _best_fit(left, capacity)


def _pairs(left: np.ndarray, total: int, most: int) -> list[tuple[int, int]]:
    """(a, b), a >= b, both available, a <= most, that sum to total."""
    b = np.arange(max(1, total - most), total // 2 + 1)
    if not len(b):
        return []
    b = b[(left[b] > 0) & (left[total - b] > 0)]
    return [(total - int(x), int(x)) for x in b]


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    room: dict[int, list] = {}  # gap -> [pattern, bins]
    out = []

    def put(pattern, gap, bins):
        if gap:
            room.setdefault(gap, []).append([pattern, bins])
        else:
            out.append((pattern, bins))

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            gap = min((g for g in room if g >= size), default=None)
            if gap is None:
                each = capacity // size
                if n >= each:
                    put((size,) * each, capacity - each * size, n // each)
                if n % each:
                    put((size,) * (n % each), capacity - (n % each) * size, 1)
                break
            pattern, bins = room[gap][-1]
            m = min(n, bins)
            if m == bins:
                room[gap].pop()
                if not room[gap]:
                    del room[gap]
            else:
                room[gap][-1][1] -= m
            put((*pattern, size), gap - size, m)
            n -= m
    return out + [(p, b) for xs in room.values() for p, b in xs]


def _slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, consecutive ranges of ranks with their first sequence
    and offset, as arrays sorted by (length, rank)."""
    rows, seen, base = [], [0] * (capacity + 1), 0
    for pattern, times in plan:
        at = 0
        for size in pattern:
            rows.append((size, seen[size], base, at))
            seen[size] += times
            at += size
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3], "first": np.searchsorted(a[:, 0], np.arange(capacity + 2))}


def _placed(slots: dict[str, np.ndarray], shift: int):
    key = slots["length"] * shift + slots["rank"]

    @task
    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            rank = get("place").to_numpy() + get("before").to_numpy()
            at = np.searchsorted(key, get("length").to_numpy() * shift + rank, side="right") - 1
            keep = [c for c in batch.schema.names if c not in ("place", "before", "bucket")]
            cols = [*(get(c) for c in keep), pa.array(slots["sequence"][at] + rank - slots["rank"][at]), pa.array(slots["offset"][at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A document is its ids and the id 0 (null or empty text: that id alone).
    A document over ``capacity`` is cut into full pieces after a first one
    that may be shorter.  Repeated rows and null ids are packed like any
    other row; no rows give no pieces.  Other columns are ignored.
    """
    base = docs.select(doc_id, text) if doc_id != text else docs.select(doc_id)
    kind = base.schema[doc_id].dataType.simpleString()
    pieces = stage(base.mapInArrow(_cut(doc_id, text, tokenizer, capacity), f"`{doc_id}` {kind}, {_PIECES}"), "pieces")
    tally = stage(pieces.groupBy("bucket", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(fill(total, capacity), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tally.select("bucket", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["bucket", "length"]).select(doc_id, "piece", "start", "length", "ids_crc32", "place", "before")
    shift = 1 << 50
    return ranked.mapInArrow(_placed(slots, shift), f"`{doc_id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
