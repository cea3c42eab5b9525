"""Removal of repeated byte strings by refining buckets of sampled suffixes.

Every window of ``length`` bytes is filed under the smallest q-gram hash it
holds, so equal windows share a bucket whatever stands around them;
neighbouring windows with the same q-gram are one run.  Three refinements
follow, each over what the one before left open:

1. runs of a bucket with equal whole bytes are one class, and all windows of
   the class but those of its smallest document are settled;
2. buckets with one class, or of one document only, are done;
3. the first runs of the other buckets are cut into their windows, which are
   refined to classes of equal ``length`` bytes.

A q-gram of very many runs (that of a passage which stands in a large share of
the texts) is in no bucket: its runs, and the windows of its open runs, are
rows, one per chunk and different content, whose smallest documents Spark
finds by content.

Texts are shuffled once, in chunks; only packed hashes and the open runs move
between buckets and chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_KEYS, mix64, powers, task, text_slices

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20  # text whose hashes make up one bucket
HOT_RUNS = 100_000  # runs from which a q-gram is in no bucket: its open runs would take half a GB in a task
HOT_GRAMS = 1 << 20  # such q-grams at most: beyond, more runs are needed
_LAST = np.iinfo(np.int64).max  # a null id comes after all others
_SETTLED, _OPEN = 1, 2
_WINDOWS, _ALONE, _SPREAD, _HOT_WINDOWS = -1, -2, -3, -4  # replies that are no bucket's


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_KEYS[data] * p[: len(data)], out=total[1:])
    return total, q


def _runs(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Runs of windows with the same smallest q-gram: (q-gram hash, hash of
    the run's bytes, row, first window, end window) in slice positions."""
    w = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    total, q = _prefix(data)
    g = mix64((total[gram:] - total[:-gram]) * q[: len(data) - gram + 1])
    low, have = g, 1
    while 2 * have <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[w - have : w - have + n])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = row[:n] == row[length - 1 :]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (low[1:] != low[:-1]) | (row[1:n] != row[: n - 1])
    start = np.flatnonzero(first)
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (low[1:] != low[:-1]) | (row[1:n] != row[: n - 1])
    end = np.flatnonzero(last) + 1
    whole_run = mix64((total[end + length - 1] - total[start]) * q[start] + (end - start).astype(np.uint64))
    return mix64(low[start] ^ np.uint64(0x9E3779B97F4A7C15)), whole_run, row[start], start, end


class _Chunk:
    """The documents of a chunk, in an order that depends on them alone."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.order = sorted(range(len(raw)), key=lambda i: (_LAST if ids[i] is None else ids[i], raw[i]))
        self.ids = [ids[i] for i in self.order]
        self.raw = [raw[i] for i in self.order]
        self.rank = np.array([_LAST if i is None else i for i in self.ids], dtype=np.int64)
        self.offs = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in self.raw], out=self.offs[1:])
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)

    def dealt(self, length: int, gram: int, buckets: int, hot: np.ndarray):
        """Runs ordered by bucket, and the bounds of each bucket; the runs of
        hot q-grams come after the last bucket."""
        k, whole, row, start, end = _runs(self.data, self.offs, length, gram)
        bucket = ((k >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        if len(hot):
            bucket[np.isin(k, hot)] = buckets
        order = np.argsort(bucket, kind="stable")
        return (k[order], whole[order], row[order], start[order], end[order]), np.searchsorted(bucket[order], np.arange(buckets + 2))


def _count_runs(length: int, gram: int):
    """Q-grams that have several runs in a slice of text, and how many."""

    @task
    def run(batches):
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0), CHUNK_BYTES):
                k, n = np.unique(_runs(data, offs, length, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k[n > 1].astype(np.uint64).view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["k", "n"])

    return run


def hot_grams(texts: DataFrame, size: int, length: int, gram: int, hot_runs: int) -> np.ndarray:
    """Hashes of the q-grams of at least ``hot_runs`` runs, at most about
    ``HOT_GRAMS``.  Slices of 1 MB that hold a single run of a q-gram do not
    count for it, so one that is rarer than that is not found."""
    least = max(hot_runs, 2 * size // (length - gram + 2) // HOT_GRAMS)
    counts = texts.mapInArrow(_count_runs(length, gram), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    return np.sort(counts.filter(F.col("n") >= least).select("k").toArrow().column("k").to_numpy()).view(np.uint64)


def _packed(*columns: tuple[np.ndarray, int]) -> bytes:
    """Little-endian columns cut to the given numbers of bytes."""
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1)[:, :n] for c, n in columns], axis=1).tobytes()


def _unpacked(raw: bytes, *sizes: int) -> list[np.ndarray]:
    grid, out, at = np.frombuffer(raw, np.uint8).reshape(-1, sum(sizes)), [], 0
    for n in sizes:
        wide = np.zeros((len(grid), 8), np.uint8)
        wide[:, :n] = grid[:, at : at + n]
        out.append(wide.view(np.uint64).ravel())
        at += n
    return out


_RUN = (5, 6, 4)  # bytes of a bucket's q-gram hash, of the run's hash, of the row


def _send_runs(length: int, gram: int, buckets: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        chunk, no = _Chunk(table), table.column("chunk")[0].as_py()
        (k, whole, row, _, _), cut = chunk.dealt(length, gram, buckets, hot)
        out = []
        for b in np.flatnonzero(np.diff(cut)[:buckets]):
            own = slice(cut[b], cut[b + 1])
            used, local = np.unique(row[own], return_inverse=True)
            out.append((int(b), no, chunk.rank[used].tobytes(), _packed((k[own], _RUN[0]), (whole[own], _RUN[1]), (local, _RUN[2]))))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "ids": pa.array(cols[2], pa.binary()), "runs": pa.array(cols[3], pa.binary())})

    return run


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a new group begins in sorted columns."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _refine(table: pa.Table) -> pa.Table:
    """First refinement of a bucket: the state of each run, per chunk."""
    chunks, raws, ids = table.column("chunk").to_pylist(), table.column("runs").to_pylist(), table.column("ids").to_pylist()
    parts = [_unpacked(r, *_RUN) for r in raws]
    k, whole = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    doc = np.concatenate([np.frombuffer(i, np.int64)[p[2].astype(np.int64)] for i, p in zip(ids, parts, strict=True)])
    order = np.lexsort((doc, whole, k))
    k, whole, doc = k[order], whole[order], doc[order]
    new_class, new_bucket = _groups(k, whole), _groups(k)
    least = doc[new_class][np.cumsum(new_class) - 1]
    bounds = np.flatnonzero(new_bucket)
    of = np.cumsum(new_bucket) - 1
    spread = (np.maximum.reduceat(least, bounds) > np.minimum.reduceat(least, bounds))[of]
    state = np.zeros(len(k), np.uint8)
    state[order] = np.where(doc > least, _SETTLED, np.where(spread, _OPEN, 0))
    out, at = [], 0
    for p in parts:
        n = len(p[0])
        out.append(state[at : at + n].tobytes())
        at += n
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "state": pa.array(out, pa.binary())})


def _least(k: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One smallest document's row of each (k, h), and each row's group."""
    order = np.lexsort((doc, h, k))
    new = _groups(k[order], h[order])
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


_HOT_ROW = "chunk int, place int, k bigint, h bigint, least bigint"


def _hot_rows(no, k: np.ndarray, h: np.ndarray, doc: np.ndarray) -> pa.Table:
    first, _ = _least(k, h, doc)
    places = np.arange(len(first), dtype=np.int32)
    cols = [pa.array(np.full(len(first), no, np.int32)), pa.array(places), *(pa.array(c[first].view(np.int64)) for c in (k, h, doc))]
    return pa.Table.from_arrays(cols, names=["chunk", "place", "k", "h", "least"])


def _hot_runs(length: int, gram: int, buckets: int, hot: np.ndarray):
    """Runs of hot q-grams: one row for each content, with its smallest document."""

    def run(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        (k, whole, row, _, _), cut = chunk.dealt(length, gram, buckets, hot)
        own = slice(cut[buckets], cut[buckets + 1])
        return _hot_rows(table.column("chunk")[0].as_py(), k[own], whole[own], chunk.rank[row[own]])

    return run


def _replied(replies: pa.Table, *kinds: int) -> pa.Table:
    if not replies.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "state": pa.array([], pa.binary()), "place": pa.array([], pa.int32()), "least": pa.array([], pa.int64())})
    return replies.filter(pa.array(np.isin(replies.column("bucket").to_numpy(), kinds)))


def _states(chunk: _Chunk, replies: pa.Table, length: int, gram: int, buckets: int, hot: np.ndarray):
    runs, cut = chunk.dealt(length, gram, buckets, hot)
    state = np.zeros(len(runs[0]), np.uint8)
    own = _replied(replies, *range(buckets))
    for b, s in zip(own.column("bucket").to_pylist(), own.column("state").to_pylist(), strict=True):
        state[cut[b] : cut[b + 1]] = np.frombuffer(s, np.uint8)
    if cut[buckets] < cut[buckets + 1]:
        own = slice(cut[buckets], cut[buckets + 1])
        doc = chunk.rank[runs[2][own]]
        first, group = _least(runs[0][own], runs[1][own], doc)
        least, spread = doc[first], np.zeros(len(first), dtype=bool)
        reply = _replied(replies, _ALONE, _SPREAD)
        at = reply.column("place").to_numpy()
        least[at] = reply.column("least").to_numpy()
        spread[at] = reply.column("bucket").to_numpy() == _SPREAD
        state[own] = np.where(doc > least[group], _SETTLED, np.where(spread[group], _OPEN, 0))
    return runs, cut, state


def _hot_windows(chunk: _Chunk, runs: tuple, cut: np.ndarray, state: np.ndarray, length: int, buckets: int):
    """Windows of the open runs of hot q-grams: (place, q-gram hash, hash of
    the window's bytes, document)."""
    k, _, row, start, end = runs
    own = np.flatnonzero(state[cut[buckets] : cut[buckets + 1]] == _OPEN) + cut[buckets]
    n = end[own] - start[own]
    of = np.repeat(own, n)
    where = start[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    total, q = _prefix(chunk.data)
    return where, k[of], mix64((total[where + length] - total[where]) * q[where]), chunk.rank[row[of]]


def _hot_open(length: int, gram: int, buckets: int, hot: np.ndarray):
    """Windows of the open runs of hot q-grams: one row for each content."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _hot_rows(0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        chunk = _Chunk(left)
        _, k, h, doc = _hot_windows(chunk, *_states(chunk, right, length, gram, buckets, hot), length, buckets)
        return _hot_rows(left.column("chunk")[0].as_py(), k, h, doc)

    return run


def _send_open(length: int, gram: int, buckets: int, hot: np.ndarray):
    """Bytes of the open runs, to the bucket of their q-gram."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            chunk, no = _Chunk(left), left.column("chunk")[0].as_py()
            (_, _, row, start, end), cut, state = _states(chunk, right, length, gram, buckets, hot)
            whole = chunk.data.tobytes()
            for b in range(buckets):
                own = np.flatnonzero(state[cut[b] : cut[b + 1]] == _OPEN) + cut[b]
                if len(own):
                    at, size = start[own], end[own] - start[own] + length - 1
                    raw = b"".join([whole[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)])
                    out.append((b, no, _packed((chunk.rank[row[own]], 8), (at, 6), (size, 6)), raw))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "heads": pa.array(cols[2], pa.binary()), "bytes": pa.array(cols[3], pa.binary())})

    return run


def equal_strings(data: np.ndarray, until: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
    """Bucket of equal ``length`` bytes for each place of ``where``: bucket
    pointers of the first 8 bytes, refined by sorting on the pointers of later
    offsets.  Each round's pointers serve the next one at twice the depth, the
    last at whatever offset makes up ``length``, so no hash decides.  ``until``
    is the end of the text of each byte."""
    depth = min(8, length)
    value = np.zeros(len(data), np.uint64)
    for j in range(depth):
        value[: len(data) - j] = value[: len(data) - j] << np.uint64(8) | data[j:]
    places = np.flatnonzero(np.arange(len(data)) + depth <= until)
    pointer = np.zeros(len(data), np.int64)
    pointer[places] = np.unique(value[places], return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        places = where if depth + step == length else np.flatnonzero(np.arange(len(data)) + depth + step <= until)
        # fewer than 2**31 buckets a group: two pointers make one number
        pair = pointer[places] << 32 | pointer[places + step]
        finer = np.zeros(len(data), np.int64)
        finer[places] = np.unique(pair, return_inverse=True)[1]
        pointer, depth = finer, depth + step
    return pointer[where]


def _refine_windows(length: int):
    """Last refinement: windows of the open runs with equal bytes."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        heads = [_unpacked(h, 8, 6, 6) for h in table.column("heads").to_pylist()]
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        doc, at, size = (np.concatenate([h[i] for h in heads]).astype(np.int64) for i in range(3))
        source = np.repeat(np.arange(len(heads)), [len(h[0]) for h in heads])
        begin = np.cumsum(size) - size
        n = size - length + 1
        run_of = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = begin[run_of] + inside
        h = equal_strings(data, np.repeat(begin + size, size), where, length)
        who = doc[run_of]
        order = np.lexsort((who, h))
        new = _groups(h[order])
        gone = np.zeros(len(h), dtype=bool)
        gone[order] = who[order] > who[order][new][np.cumsum(new) - 1]
        begins = gone & np.concatenate([[True], ~gone[:-1] | (run_of[1:] != run_of[:-1])])
        ends = gone & np.concatenate([~gone[1:] | (run_of[1:] != run_of[:-1]), [True]])
        a, e = np.flatnonzero(begins), np.flatnonzero(ends)
        first, last = at[run_of[a]] + inside[a], at[run_of[e]] + inside[e] + 1
        src = source[run_of[a]]
        bounds = np.searchsorted(src, np.arange(len(heads) + 1))
        out = [np.stack([first[x:y], last[x:y]]).astype(np.int64).tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
        return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([_WINDOWS] * len(chunks), pa.int32()), "state": pa.array(out, pa.binary())})

    return run


def _finish(length: int, gram: int, buckets: int, hot: np.ndarray):
    """Remove the settled windows' bytes of each document of a chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left)
        depth = np.zeros(len(chunk.data) + 1, np.int32)
        if (right.num_rows or len(hot)) and len(chunk.data):
            runs, cut, state = _states(chunk, right, length, gram, buckets, hot)
            _, _, _, start, end = runs
            np.add.at(depth, start[state == _SETTLED], 1)
            np.add.at(depth, end[state == _SETTLED] + length - 1, -1)
            for s in _replied(right, _WINDOWS).column("state").to_pylist():
                first, last = np.frombuffer(s, np.int64).reshape(2, -1)
                np.add.at(depth, first, 1)
                np.add.at(depth, last + length - 1, -1)
            if len(hot):
                where, k, h, doc = _hot_windows(chunk, runs, cut, state, length, buckets)
                first, group = _least(k, h, doc)
                least, reply = doc[first], _replied(right, _HOT_WINDOWS)
                least[reply.column("place").to_numpy()] = reply.column("least").to_numpy()
                where = where[doc > least[group]]
                np.add.at(depth, where, 1)
                np.add.at(depth, where + length, -1)
        gone = np.cumsum(depth[:-1]) > 0
        rows = []
        for i, raw in enumerate(chunk.raw):
            own = gone[chunk.offs[i] : chunk.offs[i + 1]]
            n = int(own.sum())
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
            kept = np.frombuffer(raw, np.uint8)[~own].tobytes() if n else raw
            rows.append((chunk.ids[i], len(raw), n, spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})

    return run


def _reply(rows: DataFrame, kind: F.Column) -> DataFrame:
    return rows.select("chunk", kind.cast("int").alias("bucket"), F.lit(None).cast("binary").alias("state"), "place", F.col("first").alias("least"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept (the remaining bytes).

    A byte goes if a string of ``length`` bytes over it, within its own text,
    also starts in a text with a smaller doc_id.  Null text counts as empty;
    a null id comes after all others; rows with the same id are not smaller
    than each other.  Strings are judged on the input.  ``doc_id`` is an
    integer; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = int(max(size // CHUNK_BYTES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    buckets = int(max(size // BUCKET_BYTES, 16))
    hot = hot_grams(base.select("text"), size, length, gram, hot_runs)
    given = (length, gram, buckets, hot)
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    grouped = base.groupBy("chunk")
    none = {"place": F.lit(None).cast("int"), "least": F.lit(None).cast("long")}
    runs = grouped.applyInArrow(_send_runs(*given), "bucket int, chunk int, ids binary, runs binary")
    states = runs.groupBy("bucket").applyInArrow(_refine, "chunk int, bucket int, state binary").withColumns(none)
    if len(hot):
        of_content = Window.partitionBy("k", "h")  # a row a chunk
        rows = grouped.applyInArrow(_hot_runs(*given), _HOT_ROW).withColumn("first", F.min("least").over(of_content))
        spread = rows.groupBy("k").agg((F.min("first") < F.max("first")).alias("spread"))  # a row a hot q-gram
        rows = rows.join(F.broadcast(spread), "k").filter("first < least or spread")
        states = states.unionByName(_reply(rows, F.when(F.col("spread"), _SPREAD).otherwise(_ALONE)))
    opened = grouped.cogroup(states.groupBy("chunk")).applyInArrow(_send_open(*given), "bucket int, chunk int, heads binary, bytes binary")
    windows = opened.groupBy("bucket").applyInArrow(_refine_windows(length), "chunk int, bucket int, state binary").withColumns(none)
    replies = states.unionByName(windows)
    if len(hot):
        rows = grouped.cogroup(states.groupBy("chunk")).applyInArrow(_hot_open(*given), _HOT_ROW).withColumn("first", F.min("least").over(of_content))
        replies = replies.unionByName(_reply(rows.filter("first < least"), F.lit(_HOT_WINDOWS)))
    out = grouped.cogroup(replies.groupBy("chunk")).applyInArrow(_finish(*given), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.withColumnRenamed("doc_id", doc_id)
