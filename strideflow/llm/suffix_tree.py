"""Removal of repeated word sequences by prefix-partitioned suffix trees.

The suffixes of all texts, read as words and cut at ``length`` words, are
split by variable-length prefixes into groups that fit in memory: a prefix of
4 words, of 8 where those 4 are frequent, the whole path where the 8 are too.
A group builds its subtree from the sorted paths of its suffixes; its internal
nodes at depth ``length`` are the repeats.  The first leaf of such a node
stays, the others go, and neighbouring ones unite to maximal repeats.

Before, suffixes that branch off early are dropped: the smallest 8-word gram
of a path has to stand at another place too, or the path has one leaf.  Every
chunk of texts settles its own repeats, so a path reaches its group once a
chunk, however often it stands there.

Words are compared by 64-bit hashes, paths by 80 bits within a group.  Texts
are shuffled once; only packed paths and bit maps move between chunks and
groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import gram_hashes, mix64, task, text_slices

LENGTH = 20
PREFIXES = (4, 8)  # words of a prefix; beyond, the whole path
CHUNK_BYTES = 2 << 20
GROUP_BYTES = 16 << 20  # text whose suffixes make up one group
FREQUENT_SHARE = 16  # a prefix of more than this part of a group is lengthened
FREQUENT = 1 << 16  # lengthened prefixes at most
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LAST = np.iinfo(np.int64).max  # a null id comes after all others
_PATH = (6, 4, 4)  # bytes of a path's two hashes, of its document's place
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _first_words(data: np.ndarray, offs: np.ndarray, length: int):
    """(starts, ends, row, hash) of words, and the words where a path begins."""
    starts, ends, row = spans.runs(~_SPACE[data], offs)
    h = spans.hashes(data, starts, ends)
    n = max(len(h) - length + 1, 0)
    return starts, ends, row, h, np.flatnonzero(row[:n] == row[len(row) - n :])


def _least_grams(g: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the rightmost minimum of each ``wide`` entries."""
    value, place, have = g, np.arange(len(g)), 1

    def lower(a, b):
        right = value[b] <= value[a]
        return np.where(right, value[b], value[a]), np.where(right, place[b], place[a])

    while 2 * have <= wide:
        value, place = lower(slice(0, len(value) - have), slice(have, None))
        have *= 2
    n = len(g) - wide + 1
    return lower(slice(0, n), slice(wide - have, wide - have + n))


def _count_prefixes(length: int, prefixes: tuple[int, ...]):
    """Prefixes that begin several paths of a slice of text, and how many."""

    @task
    def run(batches):
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                _, _, _, h, begin = _first_words(data, offs, length)
                for k in prefixes if len(begin) else ():
                    value, n = np.unique(gram_hashes(h, k)[begin], return_counts=True)
                    kept = n > 1
                    cols = [pa.array(np.full(kept.sum(), k, np.int32)), pa.array(value[kept].view(np.int64)), pa.array(n[kept].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["words", "prefix", "n"])

    return run


def frequent_prefixes(texts: DataFrame, least: int, length: int = LENGTH, prefixes: tuple[int, ...] = PREFIXES) -> dict[int, np.ndarray]:
    """Hashes of the prefixes that begin ``least`` paths or more (places that
    are alone in their slice of 1 MB are not counted), at most ``FREQUENT`` of
    each length: ``least`` follows the size of the input."""
    counts = texts.mapInArrow(_count_prefixes(length, prefixes), "words int, prefix bigint, n bigint").groupBy("words", "prefix").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= least).select("words", "prefix").toArrow()
    words, value = found.column("words").to_numpy(), found.column("prefix").to_numpy().view(np.uint64)
    return {k: np.sort(value[words == k]) for k in prefixes}


class _Chunk:
    """The texts of a chunk in an order that depends on them alone, and the
    paths that begin in them."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        order = sorted(range(len(raw)), key=lambda i: (_LAST if ids[i] is None else ids[i], raw[i]))
        self.no, self.ids = table.column("chunk")[0].as_py(), [ids[i] for i in order]
        self.rank = np.array([_LAST if i is None else i for i in self.ids], dtype=np.int64)
        self.data = np.frombuffer(b"".join([raw[i] for i in order]), np.uint8)
        offs = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(raw[i]) for i in order], out=offs[1:])
        self.starts, self.ends, self.row, self.h, self.begin = _first_words(self.data, offs, length)
        # paths with the same smallest gram at the same place are one anchor
        value, place = _least_grams(gram_hashes(self.h, gram), length - gram + 1) if len(self.begin) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        value, place = value[self.begin], place[self.begin]
        new = np.ones(len(place), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        self.anchor = np.cumsum(new) - 1  # of each path
        self.grams = mix64(value[new] ^ _SALT)

    def anchors(self, groups: int):
        """Different anchors by (group, 32 bits), their bounds, the anchor of
        each place, and how many places they have."""
        key = (self.grams >> np.uint64(40)) % np.uint64(groups) << np.uint64(32) | self.grams & np.uint64(0xFFFFFFFF)
        key, of, n = np.unique(key, return_inverse=True, return_counts=True)
        return key, np.searchsorted(key, np.arange(groups + 1, dtype=np.uint64) << np.uint64(32)), of, n

    def paths(self, open_anchors: np.ndarray, groups: int, length: int, frequent: dict[int, np.ndarray]):
        """Paths of open anchors, sorted by (group, path, place): their places
        and hashes, where a new path begins, and each path's group."""
        at = np.flatnonzero(open_anchors[self.anchor])
        begin = self.begin[at]
        whole = gram_hashes(self.h, length)[begin] if len(at) else np.zeros(0, np.uint64)
        again = gram_hashes(mix64(self.h ^ _SALT), length)[begin] if len(at) else np.zeros(0, np.uint64)
        prefix, left = whole.copy(), np.arange(len(at))
        for k in sorted(frequent):
            if len(left):
                own = gram_hashes(self.h, k)[begin[left]]
                prefix[left] = own
                left = left[np.isin(own, frequent[k])]
        prefix[left] = whole[left]
        group = ((mix64(prefix ^ _SALT) >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
        first, second = whole >> np.uint64(16), again >> np.uint64(32)
        order = np.lexsort((second, first, group))  # stable: places stay in order
        group, first, second = group[order], first[order], second[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return begin[order], first, second, new, group


def _packed(*columns: tuple[np.ndarray, int]) -> bytes:
    """Little-endian columns cut to the given numbers of bytes, one after another."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1)[:, :n]).tobytes() for c, n in columns)


def _unpacked(raw: bytes, *sizes: int) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.uint8), [], 0
    rows = len(flat) // sum(sizes)
    for n in sizes:
        wide = np.zeros((rows, 8), np.uint8)
        wide[:, :n] = flat[at : at + rows * n].reshape(rows, n)
        out.append(wide.view(np.uint64).ravel())
        at += rows * n
    return out


def _table(rows: list[tuple], **kinds) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table({name: pa.array(c, t) for (name, t), c in zip(kinds.items(), cols, strict=True)})


_ANCHORS, _ANCHOR_TABLE = {"group": pa.int32(), "chunk": pa.int32(), "grams": pa.binary()}, "`group` int, chunk int, grams binary"
_PATHS, _PATH_TABLE = {"group": pa.int32(), "chunk": pa.int32(), "ids": pa.binary(), "paths": pa.binary()}, "`group` int, chunk int, ids binary, paths binary"
_BITS, _BIT_TABLE = {"chunk": pa.int32(), "group": pa.int32(), "kind": pa.string(), "bits": pa.binary()}, "chunk int, `group` int, kind string, bits binary"


def _send_anchors(length: int, gram: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, length, gram)
        key, cut, _, _ = chunk.anchors(groups)
        return _table([(int(g), chunk.no, key[cut[g] : cut[g + 1]].astype("<u4").tobytes()) for g in np.flatnonzero(np.diff(cut))], **_ANCHORS)

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Which anchors stand in several chunks."""
    parts = [np.frombuffer(r, "<u4") for r in table.column("grams").to_pylist()]
    _, of, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = np.split(n[of] > 1, np.cumsum([len(p) for p in parts])[:-1])
    group = table.column("group")[0].as_py()
    return _table([(c, group, "anchors", np.packbits(s).tobytes()) for c, s in zip(table.column("chunk").to_pylist(), shared, strict=True)], **_BITS)


def _replies(table: pa.Table, kind: str):
    for g, k, bits in zip(*(table.column(c).to_pylist() for c in ("group", "kind", "bits")), strict=True):
        if k == kind:
            yield g, np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def _open_anchors(chunk: _Chunk, replies: pa.Table, groups: int) -> np.ndarray:
    _, cut, of, n = chunk.anchors(groups)
    shared = n > 1
    for g, bits in _replies(replies, "anchors"):
        shared[cut[g] : cut[g + 1]] |= bits[: cut[g + 1] - cut[g]]
    return shared[of]


def _send_paths(length: int, gram: int, groups: int, frequent: dict[int, np.ndarray]):
    """A chunk's different paths, each with its first document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], **_PATHS)
        chunk = _Chunk(left, length, gram)
        begin, first, second, new, group = chunk.paths(_open_anchors(chunk, right, groups), groups, length, frequent)
        doc, first, second, group = chunk.row[begin[new]], first[new], second[new], group[new]
        cut = np.searchsorted(group, np.arange(groups + 1))
        out = []
        for g in np.flatnonzero(np.diff(cut)):
            own = slice(cut[g], cut[g + 1])
            used, place = np.unique(doc[own], return_inverse=True)
            out.append((int(g), chunk.no, chunk.rank[used].tobytes(), _packed((first[own], _PATH[0]), (second[own], _PATH[1]), (place, _PATH[2]))))
        return _table(out, **_PATHS)

    return run


def _subtree(table: pa.Table) -> pa.Table:
    """The leaves of a group's subtree in the order of their paths.  Leaves
    with the same path hang under one node of full depth; told are those with
    a leaf of a smaller document beside them."""
    parts = [_unpacked(r, *_PATH) for r in table.column("paths").to_pylist()]
    first, second = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    doc = np.concatenate([np.frombuffer(ids, np.int64)[p[2].astype(np.int64)] for ids, p in zip(table.column("ids").to_pylist(), parts, strict=True)])
    order = np.lexsort((doc, second, first))
    a, b, d = first[order], second[order], doc[order]
    node = np.ones(len(order), dtype=bool)
    node[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    later = np.zeros(len(order), dtype=bool)
    later[order] = d > d[node][np.cumsum(node) - 1]
    told = np.split(later, np.cumsum([len(p[0]) for p in parts])[:-1])
    group = table.column("group")[0].as_py()
    return _table([(c, group, "paths", np.packbits(t).tobytes()) for c, t in zip(table.column("chunk").to_pylist(), told, strict=True)], **_BITS)


def _finish(length: int, gram: int, groups: int, frequent: dict[int, np.ndarray]):
    """The words of each text outside its repeats."""
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], **kinds)
        chunk = _Chunk(left, length, gram)
        begin, _, _, new, group = chunk.paths(_open_anchors(chunk, right, groups), groups, length, frequent)
        depth = np.zeros(len(chunk.h) + 1, np.int32)
        if len(begin):
            of = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            cut = np.searchsorted(group[heads], np.arange(groups + 1))
            elsewhere = np.zeros(len(heads), dtype=bool)
            for g, bits in _replies(right, "paths"):
                elsewhere[cut[g] : cut[g + 1]] = bits[: cut[g + 1] - cut[g]]
            row = chunk.row[begin]
            same_row = np.zeros(len(begin), dtype=bool)
            same_row[1:] = ~new[1:] & (row[1:] == row[:-1])
            gone = elsewhere[of] | (chunk.rank[row] > chunk.rank[row[heads]][of]) | same_row
            np.add.at(depth, begin[gone], 1)
            np.add.at(depth, begin[gone] + length, -1)
        gone = np.cumsum(depth[:-1]) > 0
        rows = len(chunk.ids)
        bounds = np.searchsorted(chunk.row, np.arange(rows + 1))
        enter = gone.copy()
        enter[1:] &= ~gone[:-1] | (chunk.row[1:] != chunk.row[:-1])
        count = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (gone, enter)]
        kept = np.flatnonzero(~gone)
        raw, offs = spans.gather(chunk.data, chunk.starts[kept], chunk.ends[kept], b" ")
        ends = offs[np.searchsorted(kept, bounds)]
        text = [raw[a : max(a, b - 1)].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        cols = [chunk.ids, np.diff(bounds), np.diff(count[0]), np.diff(count[1]), text]
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(kinds.items(), cols, strict=True)})

    return run


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, prefixes: tuple[int, ...] = PREFIXES, chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES, frequent: int | None = None
) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, n_spans (maximal repeats)
    and kept (the remaining words, one space between them).

    Words are what white space separates.  A word goes if a sequence of
    ``length`` words over it, within its own text, also starts earlier: in a
    text with a smaller doc_id, or earlier in the same text.  Sequences are
    judged on the input.  Null text has no words, nor have empty texts; a null
    id comes after all others; rows with the same id are not earlier than each
    other.  ``doc_id`` is an integer; other columns are ignored.  An empty
    table gives an empty one.

    ``frequent`` is the number of paths from which a prefix is lengthened.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = int(max(size // chunk_bytes, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    groups = int(max(size // group_bytes, 16))
    if frequent is None:
        frequent = max(group_bytes // 5 // FREQUENT_SHARE, size // 5 // FREQUENT)
    long = frequent_prefixes(base.select("text"), frequent, length, prefixes)
    gram = max(prefixes)
    grouped = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).groupBy("chunk")
    anchors = grouped.applyInArrow(_send_anchors(length, gram, groups), _ANCHOR_TABLE).groupBy("group").applyInArrow(_shared_anchors, _BIT_TABLE)
    paths = grouped.cogroup(anchors.groupBy("chunk")).applyInArrow(_send_paths(length, gram, groups, long), _PATH_TABLE)
    replies = anchors.unionByName(paths.groupBy("group").applyInArrow(_subtree, _BIT_TABLE))
    out = grouped.cogroup(replies.groupBy("chunk")).applyInArrow(_finish(length, gram, groups, long), "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept string")
    return out.withColumnRenamed("doc_id", doc_id)
