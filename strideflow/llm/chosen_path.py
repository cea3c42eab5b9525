"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles; equal sets are one node with a weight.
A set is embedded in a signature of ``COORDINATES`` minimum hashes, of which
two sets share as many as they are similar.  Buckets start at a few
coordinates (the runs) and large buckets are split again and again on further
sampled coordinates, so a path of shared coordinates leads similar sets into
one leaf.  Runs and depth are chosen for the target recall.  Leaves are
compared by signature; connected candidates are then compared exactly, with
all sets of their candidate component that can reach the threshold.  Of a large
component, sets with too few shingles that another one has go first, as no
pair of theirs can; the others are compared in blocks of like size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix64, stage, stream64, task, text_slices, word_hashes
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 64
CHILDREN = 3  # coordinates on which a large bucket is split
DEPTH = 3  # splits after the first
DENSE = 0.5  # share of a large bucket that a further coordinate may keep together
LEAF = 128  # sets of a leaf that are compared with each other
MARGIN = 0.25  # what a signature may fall short of the threshold (five standard deviations)
BLOCK = 1024  # sets of a block of the exact comparison
BLOCK_GRAMS = 1 << 20  # shingles of a block: 8 MB
PART_GRAMS = 1 << 19  # shingles of a large component that are counted in one group
SENT_BYTES = 8 << 20  # shingles of a batch that a task sends on
TILE = 1 << 20  # pairs, or places of a dense table, that a comparison holds at once
BROADCAST_ROWS = 500_000

_A = (stream64(COORDINATES, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (stream64(COORDINATES, 102) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def runs_for(threshold: float, recall: float, children: int = CHILDREN, depth: int = DEPTH) -> int:
    """First coordinates needed so that a pair at the threshold reaches a
    common leaf with this probability, even where every bucket is split."""
    lost = 0.0
    for _ in range(depth):
        lost = (1 - threshold + threshold * lost) ** children
    each = 1 - threshold + threshold * lost
    return int(np.ceil(np.log(1 - recall) / np.log(each)))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle."""
    return np.unique(gram_hashes(h, min(size, len(h)))) if len(h) else np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    lo, hi = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(grams), 4096):
        np.minimum(out, (_A[:, None] * lo[i : i + 4096] + _B[:, None] * hi[i : i + 4096]).min(axis=1), out=out)
    return out


def _key(grams: np.ndarray) -> bytes:
    """128 bits of a set, and its size."""
    return np.array([len(grams), mix64(grams).sum(dtype=np.uint64), mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=">u8").tobytes()[4:]


def _sets_of(column, size: int):
    for i, j, data, offs in text_slices(column):
        h, row = word_hashes(data, offs)
        at = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, shingles(h[at[r] : at[r + 1]], size)


def _features(doc_id: str, text: str, size: int):
    @task
    def run(batches):
        for batch in batches:
            n, key, sig = [], [], []
            for _, grams in _sets_of(batch.column(batch.schema.get_field_index(text)), size):
                n.append(len(grams))
                key.append(_key(grams))
                sig.append(signature(grams).tobytes())
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([get(doc_id), get("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n", "set_key", "sig"])

    return run


def _runs_of(batches, key: str):
    """Yield (batch, group bounds) with every group whole, from batches
    sorted by ``key``."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key))
        k = np.array(k.to_pylist(), dtype=object) if not pa.types.is_integer(k.type) else k.to_numpy()
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        if len(cut) > 1:
            yield batch.slice(0, cut[-1]), cut
        held = batch.slice(cut[-1])
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) of the connected parts of a symmetric relation."""
    left, out = np.ones(len(near), dtype=bool), []
    for i in range(len(near)):
        if left[i]:
            part = np.zeros(len(near), dtype=bool)
            part[i] = True
            todo = part.copy()
            while todo.any():
                todo = near[todo].any(axis=0) & ~part
                part |= todo
            left &= ~part
            out += [(int(j), i) for j in np.flatnonzero(part) if j != i]
    return out


def _similar(threshold: float):
    """Leaves -> links of sets whose signatures and sizes allow the threshold."""

    @task
    def run(batches):
        for batch, cut in _runs_of(batches, "node"):
            keys = batch.column(batch.schema.get_field_index("set_key"))
            sig = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            n = batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.float64)
            a, b = [], []
            for i, j in zip(cut, cut[1:], strict=False):
                if j - i > 1:
                    s, m = sig[i:j], n[i:j]
                    near = (s[:, None, :] == s[None]).mean(axis=2) >= threshold - MARGIN
                    near &= np.minimum(m[:, None], m) >= threshold * np.maximum(m[:, None], m) - 1e-9
                    for x, y in _forest(near):
                        a.append(i + x)
                        b.append(i + y)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a, pa.int64())), keys.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return run


class _Sent:
    """Rows with shingles on their way out, as batches of limited bytes."""

    def __init__(self, **kinds: pa.DataType):
        self.kinds, self.rows, self.bytes = kinds, [], 0

    def add(self, *row) -> bool:
        """Whether a batch is full."""
        self.rows.append(row)
        self.bytes += len(row[-1])
        return self.bytes >= SENT_BYTES or len(self.rows) >= 4096

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.kinds)
        out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, self.kinds.values(), strict=True)], names=list(self.kinds))
        self.rows, self.bytes = [], 0
        return out


def _grams(text: str, size: int):
    """Members with their text -> members with their shingles."""

    @task
    def run(batches):
        done = set()  # of this task: rows may repeat
        out = _Sent(set_key=pa.binary(), root=pa.binary(), weight=pa.int64(), n=pa.int64(), grams=pa.binary())
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            key, root, weight = (get(c).to_pylist() for c in ("set_key", "root", "weight"))
            for r, grams in _sets_of(get(text), size):
                if key[r] not in done:
                    done.add(key[r])
                    if out.add(key[r], root[r], weight[r], len(grams), grams.tobytes()):
                        yield out.batch()
        yield out.batch()

    return run


@task
def _parts(batches):
    """Members of large components -> their shingles, dealt by hash to the
    groups of the component."""
    out = _Sent(grp=pa.binary(), set_key=pa.binary(), grams=pa.binary())
    for batch in batches:
        key, root, total, raw = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("set_key", "root", "total", "grams"))
        for r in range(batch.num_rows):
            grams, many = np.frombuffer(raw[r], np.uint64), -(-total[r] // PART_GRAMS)
            part = mix64(grams) % np.uint64(many)
            order = np.argsort(part, kind="stable")
            for own in np.split(grams[order], np.flatnonzero(np.diff(part[order])) + 1):
                if out.add(root[r] + int(mix64(own[:1])[0] % np.uint64(many)).to_bytes(4, "big"), key[r], own.tobytes()):
                    yield out.batch()
    yield out.batch()


def _once(key: list, i: int, j: int) -> list[int]:
    """A row of each set of a group, as rows may repeat."""
    return list({key[x]: x for x in range(i, j)}.values())


@task
def _common(batches):
    """Groups of shingles -> number of each set's that another set has too."""
    for batch, cut in _runs_of(batches, "grp"):
        key, raw = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("set_key", "grams"))
        keys, common = [], []
        for i, j in zip(cut, cut[1:], strict=False):
            at = _once(key, i, j)
            grams = [np.frombuffer(raw[x], np.uint64) for x in at]
            row = np.repeat(np.arange(len(at)), [len(g) for g in grams])
            _, token, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            keys += [key[x] for x in at]
            common += np.bincount(row[n[token] > 1], minlength=len(at)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(common, pa.int64())], names=["set_key", "common"])


@task
def _blocks(batches):
    """Members of large components -> once for each pair of blocks that theirs
    takes part in.  ``others`` has the levels of size that a member's can be
    similar to, its own among them, and their numbers of blocks."""
    out = _Sent(grp=pa.binary(), second=pa.bool_(), set_key=pa.binary(), weight=pa.int64(), grams=pa.binary())
    for batch in batches:
        key, root, weight, level, others, raw = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("set_key", "root", "weight", "level", "others", "grams"))
        for r in range(batch.num_rows):
            many = {x["level"]: x["many"] for x in others[r]}
            own = (level[r], int.from_bytes(key[r][-4:], "big") % many[level[r]])
            for other in ((at, i) for at in many for i in range(many[at])):
                grp = root[r] + b"".join(x.to_bytes(4, "big") for x in (*min(own, other), *max(own, other)))
                if out.add(grp, own > other, key[r], weight[r], raw[r]):
                    yield out.batch()
    yield out.batch()


def _postings(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, where the sets of each begin, and these sets."""
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    token = np.concatenate(grams)
    order = np.argsort(token, kind="stable")
    token = token[order]
    at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return token[at], np.append(at, len(token)), row[order]


def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all spans, and the span of each."""
    span = np.repeat(np.arange(len(size)), size)
    return np.arange(len(span)) - np.repeat(np.cumsum(size) - size - first, size), span


def _shared(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``,
    without it of ``a``.  Shingles of many sets are multiplied as dense
    tables, the pairs of the others are counted."""
    token, at, row = _postings(a)
    if b is None:
        left = right = np.flatnonzero(np.diff(at) > 1)
        to, at_to, row_to = len(a), at, row
    else:
        other, at_to, row_to = _postings(b)
        _, left, right = np.intersect1d(token, other, assume_unique=True, return_indices=True)
        to = len(b)
    n, m = np.diff(at)[left], np.diff(at_to)[right]
    out = np.zeros((len(a), to), np.float32)
    dense = n * m * 256 >= out.size
    width = max(256, TILE // max(out.shape))
    x, y = left[dense], right[dense]
    for i in range(0, len(x), width):
        tables = []
        for starts, rows, own, sets in ((at, row, x, len(a)), (at_to, row_to, y, to))[: 1 + (b is not None)]:
            own = own[i : i + width]
            place, column = _spans(starts[own], starts[own + 1] - starts[own])
            table = np.zeros((sets, len(own)), np.float32)
            table[rows[place], column] = 1
            tables.append(table)
        out += tables[0] @ tables[-1].T
    x, y, n, m = left[~dense], right[~dense], n[~dense], m[~dense]
    until = np.cumsum(n * m)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + TILE, side="right")))
        pair, span = _spans(np.zeros(j - i, np.int64), (n * m)[i:j])
        one, two = np.divmod(pair, m[i:j][span])
        flat = row[at[x[i:j]][span] + one] * to + row_to[at_to[y[i:j]][span] + two]
        out += np.bincount(flat, minlength=out.size).reshape(out.shape)
        i = j
    return out


def _near(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` reach the threshold; without ``b``, which
    different ones of ``a``."""
    both = _shared(a, b)
    n, m = (np.array([len(g) for g in x], np.float64) for x in (a, a if b is None else b))
    out = np.empty(both.shape, dtype=bool)
    step = max(1, TILE // len(m))
    for i in range(0, len(n), step):
        shared = both[i : i + step]
        out[i : i + step] = shared >= threshold * (n[i : i + step, None] + m - shared) - 1e-6
    if b is None:
        np.fill_diagonal(out, False)
    return out


def _exact(threshold: float):
    """Pairs of blocks -> each set's weight of links, and links that connect
    the linked sets."""

    @task
    def run(batches):
        for batch, cut in _runs_of(batches, "grp"):
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            key, second, raw = get("set_key").to_pylist(), get("second").to_pylist(), get("grams").to_pylist()
            weight = get("weight").to_numpy()
            a, b, links = [], [], []
            for i, j in zip(cut, cut[1:], strict=False):
                at = sorted(_once(key, i, j), key=lambda x: second[x])
                two = sum(second[x] for x in at)
                one = len(at) - two
                if len(at) < 2 or not one:
                    continue
                grams = [np.frombuffer(raw[x], np.uint64) for x in at]
                if two:
                    near = np.zeros((len(at), len(at)), dtype=bool)
                    near[:one, one:] = _near(grams[:one], grams[one:], threshold)
                    near[one:, :one] = near[:one, one:].T
                else:
                    near = _near(grams, None, threshold)
                linked = np.flatnonzero(near.any(axis=0))
                if not len(linked):
                    continue
                near, at = near[np.ix_(linked, linked)], [at[x] for x in linked]
                a += [key[x] for x in at]
                b += [None] * len(at)
                links += (near @ weight[at]).tolist()
                for x, y in _forest(near):
                    a.append(key[at[x]])
                    b.append(key[at[y]])
                    links.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return run


def _leaves(sets: DataFrame, threshold: float, runs: int) -> tuple[DataFrame, DataFrame]:
    """(node, set_key) of all leaves that are compared, and links of the
    large buckets that are not split: those of which a further coordinate
    keeps ``DENSE`` together, or that are ``DEPTH`` splits deep.  Their sets
    are alike on the whole, so each is linked to the first."""
    roots = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {4 * i + 1}, 4)")) for i in range(runs)])
    children = F.array(*[F.expr(f"xxhash64(node, {c}, substring(sig, 4 * ({runs} + pmod(xxhash64(node, {c}), {COORDINATES - runs})) + 1, 4))") for c in range(CHILDREN)])
    nodes = sets.select("set_key", F.explode(roots).alias("node"))
    leaves, links = None, None
    for level in range(DEPTH + 1):
        sizes = stage(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("set_key").alias("least")).filter("size > 1"), "sizes")
        now = stage(nodes.join(sizes, "node").select("node", "set_key", "size", "least"), "nodes")
        small, large = now.filter(F.col("size") <= LEAF).select("node", "set_key"), now.filter(F.col("size") > LEAF)
        leaves = small if leaves is None else leaves.unionByName(small)
        whole = large
        if level < DEPTH and not large.isEmpty():
            kids = stage(large.join(sets.select("set_key", "sig"), "set_key").select("node", "size", "set_key", F.explode(children).alias("child")), "children")
            kept = kids.groupBy("node", "size", "child").agg(F.count("*").alias("n")).groupBy("node", "size").agg(F.max("n").alias("n"))
            dense = stage(kept.filter(F.col("n") >= DENSE * F.col("size")).select("node"), "dense")
            whole = large.join(dense, "node", "left_semi")
            nodes = kids.join(dense, "node", "left_anti").select("set_key", F.col("child").alias("node"))
        stars = whole.filter("set_key <> least").select(F.col("set_key").alias("a"), F.col("least").alias("b"))
        links = stars if links is None else links.unionByName(stars)
        if level == DEPTH or large.isEmpty():
            break
    return leaves, links


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _compared(grams: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Members with their shingles -> ``grp``, ``second``, ``set_key``,
    ``weight``, ``grams``: groups in which all pairs of one component meet that
    can reach the threshold.

    A component within a block is one group.  Of a larger one, a set can only
    be similar to another if the component's other sets have ``threshold`` of
    its shingles; the sets that remain meet those of like size, in pairs of
    blocks.
    """
    large = members.groupBy("root").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
    large = _small(stage(large.filter((F.col("count") > BLOCK) | (F.col("total") > BLOCK_GRAMS)).select("root", "total"), "large"))
    whole = grams.join(large, "root", "left_anti").select(F.col("root").alias("grp"), F.lit(False).alias("second"), "set_key", "weight", "grams")

    split = grams.join(large, "root")
    parts = split.select("set_key", "root", "total", "grams").mapInArrow(_parts, "grp binary, set_key binary, grams binary")
    common = parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_common, "set_key binary, common bigint").groupBy("set_key").agg(F.sum("common").alias("common"))
    # sets of similar size are on the same level or on neighbouring ones; the steps are a little wider, as logarithms are rounded
    step = max(-np.log(threshold), 1e-3) * 1.0001
    open_ = members.join(common, "set_key").filter(F.col("common") >= threshold * F.col("n") - 1e-6)
    open_ = stage(open_.select("set_key", "root", "n", F.floor(F.log("n") / F.lit(float(step))).cast("int").alias("level")), "open")
    many = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_GRAMS))).cast("int").alias("many")
    levels = open_.groupBy("root", "level").agg(many)
    others = levels.select("root", F.explode(F.array(*[F.col("level") + i for i in (-1, 0, 1)])).alias("at"), F.struct("level", "many").alias("other"))
    others = stage(others.groupBy("root", "at").agg(F.collect_list("other").alias("others")).withColumnRenamed("at", "level"), "levels")
    left = split.join(_small(open_.select("set_key", "level")), "set_key").join(_small(others), ["root", "level"])
    blocks = left.select("set_key", "root", "weight", "level", "others", "grams").mapInArrow(_blocks, "grp binary, second boolean, set_key binary, weight bigint, grams binary")
    return whole.unionByName(blocks)


def similar_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row: doc_id, text_hash, class_id (smallest id of its
    connected class of similar texts), class_size and n_links (other rows at
    or above the threshold, rows with an equal set of shingles included).

    A text of fewer than ``size`` words is one shingle.  Null, empty and
    wordless texts have no links: class_id is their own id.  Null ids take
    part and get their class's smallest id, null if it has none.  Repeated
    rows link to each other.  Other columns are ignored.
    """
    runs = runs_for(threshold, recall)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = stage(base.mapInArrow(_features("doc_id", "text", size), f"doc_id {kind}, text_hash bigint, n bigint, set_key binary, sig binary"), "features")
    # the row whose text stands for the set: by id and text, as ids may be null or repeat
    where = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("at")
    sets = stage(rows.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), where, F.count("*").alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")

    leaves, links = _leaves(sets, threshold, runs)
    held = leaves.join(sets.select("set_key", "n", "sig"), "set_key")
    sorted_leaves = held.repartition("node").sortWithinPartitions("node")
    found = sorted_leaves.mapInArrow(_similar(threshold), "a binary, b binary").unionByName(links)
    root = stage(components(found, "a", "b"), "candidates")

    members = stage(root.join(sets, F.col("node") == sets["set_key"]).select("root", "set_key", "at", "weight", "n"), "members")
    texts = base.join(_small(members.drop("n")), F.col("doc_id").eqNullSafe(F.col("at.id")) & (F.col("text_hash") == F.col("at.hash"))).select("set_key", "root", "weight", "text")
    grams = stage(texts.mapInArrow(_grams("text", size), "set_key binary, root binary, weight bigint, n bigint, grams binary"), "grams")
    pairs = _compared(grams, members, threshold).repartition("grp").sortWithinPartitions("grp").mapInArrow(_exact(threshold), "a binary, b binary, links bigint")
    pairs = stage(pairs, "links")

    classes = components(pairs.filter("b is not null"), "a", "b")
    degree = pairs.groupBy("a").agg(F.sum("links").alias("links"))
    labelled = sets.select("set_key", "rep", "weight").join(classes, F.col("set_key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_key"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("weight").alias("class_size"))
    info = labelled.join(least, "root").join(degree, F.col("set_key") == F.col("a"), "left").select("set_key", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = rows.filter("n > 0").select("doc_id", "text_hash", "set_key").join(info, "set_key").select("doc_id", "text_hash", "class_id", "class_size", "n_links")
    alone = rows.filter("n = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone).withColumnRenamed("doc_id", doc_id)


def drop_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is its class's smallest id; a class
    without any id stays."""
    gone = similar_classes(docs, doc_id=doc_id, text=text, **options).filter(F.col("class_id").isNotNull() & ~F.col(doc_id).eqNullSafe(F.col("class_id")))
    gone = stage(gone.select(F.col(doc_id).alias("__id"), "text_hash").distinct(), "dropped")
    return docs.join(_small(gone), docs[doc_id].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text]) == gone["text_hash"]), "left_anti")
