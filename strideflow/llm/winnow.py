"""Benchmark decontamination by winnowing.

Each text is reduced to the minimum k-gram hash of every sliding window of
``w`` word positions; ``k + w - 1`` equals the window length in words, so any
shared span that long has a fingerprint in common.  Fingerprints of training
and test texts are joined, and each hit is extended word by word to the full
shared span, which verifies it exactly.

A test set of at most ``broadcast_bytes`` is indexed once and joined inside
the scan.  A larger one goes through a shuffle join on fingerprints.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, task, text_slices, word_hashes

WINDOW = 10  # words of a window
K = 5  # words of a fingerprinted gram
BROADCAST_BYTES = 32 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def winnowed(h: np.ndarray, row: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the (rightmost) minimum k-gram hashes of all windows inside a row, and
    the hashes of all positions."""
    w = window - k + 1
    g = gram_hashes(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), g
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):  # the rightmost minimum of each window
        right = g[j : j + n] <= low
        low, at = np.where(right, g[j : j + n], low), np.where(right, np.arange(j, j + n), at)
    whole = row[:n] == row[window - 1 : window - 1 + n]
    chosen = np.zeros(len(g), dtype=bool)
    chosen[at[whole]] = True
    return np.flatnonzero(chosen), g


def fingerprints(h: np.ndarray, row: np.ndarray, window: int, k: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(position, fingerprint): winnowed grams, and every gram of the short
    lengths, for items that have fewer words than a window."""
    at, g = winnowed(h, row, window, k)
    where, prints = [at], [g[at]]
    for n in short:
        g = gram_hashes(h, n)
        if len(g):
            at = np.flatnonzero(row[: len(g)] == row[n - 1 :])
            where.append(at)
            prints.append(g[at] ^ np.uint64(n))
    return np.concatenate(where), np.concatenate(prints)


class Index:
    """Fingerprints of a bounded set of items, sorted, with their places."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, k: int):
        self.window, self.k = window, k
        kept = {}
        for name, text in items:
            if name is not None and (w := words_of(text)):
                kept.setdefault((str(name), b" ".join(w)), w)
        self.names = [name for name, _ in kept]
        self.words = list(kept.values())
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for own in self.words for w in own}))}
        self.ids = [np.array([self.vocabulary[w] for w in own], dtype=np.int64) for own in self.words]
        self.short = sorted({len(w) for w in self.words if len(w) < window})
        h, row = word_hashes(*_joined([b" ".join(w) for w in self.words]))
        first = np.searchsorted(row, np.arange(len(self.words)))
        at, fp = fingerprints(h, row, window, k, [])
        item = row[at] if len(at) else np.zeros(0, np.int64)
        parts = [(fp, item, at - first[item])]
        for n in self.short:
            g = gram_hashes(h, n)
            own = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            parts.append((g[first[own]] ^ np.uint64(n), own, np.zeros(len(own), np.int64)))
        fp, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(fp, kind="stable")
        self.fp, self.item, self.place = fp[order], item[order], place[order]

    def spans(self, words: list[bytes], seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
        """Extend hits ``(word position, first and last index row)`` to the
        shared spans of a window or more, once for each diagonal of an item,
        and unite them: (first word, end, item name)."""
        marks: dict[int, np.ndarray] = {}
        for p, lo, hi in seeds:
            items, places = self.item[lo:hi], self.place[lo:hi]
            for item in np.unique(items):
                own = self.ids[item]
                diagonals = marks.setdefault(int(item), np.zeros(len(words) + len(own), dtype=bool))
                diagonals[p + len(own) - places[items == item]] = True
        out, ids = [], np.array([self.vocabulary.get(w, -1) for w in words], dtype=np.int64)
        for item, diagonals in marks.items():
            own = self.ids[item]
            n, cover = min(self.window, len(own)), np.zeros(len(ids) + 1, dtype=np.int64)
            for shift in np.flatnonzero(diagonals) - len(own):
                a, e = max(0, shift), min(len(ids), shift + len(own))
                same = np.zeros(e - a + 2, dtype=bool)
                same[1:-1] = ids[a:e] == own[a - shift : e - shift]
                edge = np.flatnonzero(same[1:] != same[:-1]) + a
                long = edge[1::2] - edge[::2] >= n
                np.add.at(cover, edge[::2][long], 1)
                np.add.at(cover, edge[1::2][long], -1)
            inside = np.concatenate([[False], np.cumsum(cover) > 0])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            out += [(int(a), int(e), self.names[item]) for a, e in zip(edge[::2], edge[1::2], strict=True)]
        return out


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offs[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offs


def _digest(n_words: int, spans: list[tuple[int, int, str]]) -> tuple[int, int, str, list]:
    hit, end = 0, 0
    for a, e, _ in sorted(spans):
        hit += max(0, e - max(a, end))
        end = max(end, e)
    names = sorted({name for _, _, name in spans})
    return hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sorted(spans)


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("item_id", pa.string())]))
_OUT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans array<struct<first:bigint,end:bigint,item_id:string>>"


def _result(batch: pa.RecordBatch, drop: list[str], n_words, found: dict) -> pa.RecordBatch:
    none = _digest(0, [])
    rows = [_digest(0, found[i]) if i in found else none for i in range(batch.num_rows)]
    keep = [x for x in batch.schema.names if x not in drop]
    cols = [batch.column(batch.schema.get_field_index(x)) for x in keep]
    cols.append(pa.array(n_words, pa.int64()))
    cols += [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
    cols.append(pa.array([[{"first": a, "end": e, "item_id": x} for a, e, x in r[3]] for r in rows], _SPAN))
    return pa.RecordBatch.from_arrays(cols, names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "spans"])


def _scan(index: Index, text: str, drop: list[str]):
    @task
    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            n_words, found = np.zeros(batch.num_rows, np.int64), {}
            for i, j, data, offs in text_slices(col):
                h, row = word_hashes(data, offs)
                n_words[i:j] = np.bincount(row, minlength=j - i)
                at, fp = fingerprints(h, row, index.window, index.k, index.short)
                lo = np.searchsorted(index.fp, fp, side="left")
                hit = np.flatnonzero((lo < len(index.fp)) & (index.fp[np.minimum(lo, len(index.fp) - 1)] == fp)) if len(index.fp) else []
                seeds: dict[int, list] = {}
                first = np.searchsorted(row, np.arange(j - i))
                for x in hit:
                    r = int(row[at[x]])
                    seeds.setdefault(r, []).append((int(at[x] - first[r]), int(lo[x]), int(np.searchsorted(index.fp, fp[x], side="right"))))
                for r, own in seeds.items():
                    if spans := index.spans(words_of(col[i + r].as_py()), own):
                        found[i + r] = spans
            yield _result(batch, drop, n_words, found)

    return run


def _prints(text: str, key: str, window: int, k: int, short: list[int]):
    @task
    def run(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for i, _, data, offs in text_slices(batch.column(batch.schema.get_field_index(text))):
                h, row = word_hashes(data, offs)
                at, fp = fingerprints(h, row, window, k, short)
                both = np.unique(np.stack([row[at].astype(np.uint64), fp]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(both[0].astype(np.int64) + i)), pa.array(both[1].view(np.int64))], names=[key, "fp"])

    return run


def _verify(window: int, k: int):
    @task
    def run(batches):
        for batch in batches:
            texts, cands = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("cand"))
            n_words, found = np.zeros(batch.num_rows, np.int64), {}
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                n_words[i] = len(words)
                if not (own := cands[i].as_py()):
                    continue
                index = Index([(x["item_id"], x["text"]) for x in own], window, k)
                h, row = word_hashes(*_joined([b" ".join(words)]))
                at, fp = fingerprints(h, row, window, k, index.short)
                lo, hi = np.searchsorted(index.fp, fp), np.searchsorted(index.fp, fp, side="right")
                if spans := index.spans(words, [(int(at[x]), int(lo[x]), int(hi[x])) for x in np.flatnonzero(hi > lo)]):
                    found[i] = spans
            yield _result(batch, ["text", "cand"], n_words, found)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256, spans (word ranges and items), contaminated; with
    ``keep_text`` all columns of ``docs`` come first.

    Null or empty text: no words, not contaminated.  Items with a null id or
    without words have no windows; repeated items count once; an empty test
    set finds nothing.  Repeated rows each get their row.  Columns of ``docs``
    named like a result are replaced by it.
    """
    k = min(k, window)
    own = {"n_words", "n_hit", "n_items", "items_sha256", "spans", "contaminated"}
    names = [c for c in docs.columns if c not in own] if keep_text else [doc_id]
    base = docs.select(*dict.fromkeys([*names, text]))
    drop = [] if keep_text else [x for x in [text] if x != doc_id]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name not in drop)
    test = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    size = test.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + F.lit(64))).head()[0] or 0
    if size <= broadcast_bytes:
        index = Index([tuple(r) for r in test.collect()], window, k)  # bounded by the check above
        out = base.mapInArrow(_scan(index, text, drop), f"{fields}, {_OUT}")
    else:
        out = _shuffled(base, test, text, fields, drop, window, k)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _shuffled(base: DataFrame, test: DataFrame, text: str, fields: str, drop: list[str], window: int, k: int) -> DataFrame:
    """The join for test sets over the broadcast bound.  Copies of a text
    share a key, so a common text is joined once."""
    test = test.filter("item_id is not null").withColumn("item", F.sha2(F.concat_ws("\x01", "item_id", "text"), 256))
    lengths = test.select(F.size(F.expr("filter(split(lower(text), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), x -> x != '')")).alias("n")).filter(f"n < {window} and n > 0").distinct()
    short = sorted(r[0] for r in lengths.collect())  # fewer than a window's words
    keyed = base.withColumn("__key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    texts = keyed.select("__key", F.col(text).alias("text")).dropDuplicates(["__key"])
    d = texts.mapInArrow(_prints("text", "__key", window, k, short), "__key string, fp bigint")
    t = test.mapInArrow(_prints("text", "item", window, k, short), "item string, fp bigint")
    cand = d.join(t, "fp").select("__key", "item").distinct()
    lists = cand.join(test, "item").groupBy("__key").agg(F.collect_list(F.struct("item_id", "text")).alias("cand"))
    found = texts.join(lists, "__key").mapInArrow(_verify(window, k), f"__key string, {_OUT}").drop("n_words")
    counted = keyed.mapInArrow(_scan(Index([], window, k), text, [*drop]), f"{fields}, __key string, {_OUT}")
    names = [c for c in base.columns if c not in drop]
    f, none = found.alias("f"), counted.alias("d")
    pick = [F.coalesce(f"f.{c}", f"d.{c}").alias(c) for c in ("n_hit", "n_items", "items_sha256", "spans")]
    return none.join(f, F.col("d.__key") == F.col("f.__key"), "left").select(*[F.col(f"d.`{c}`") for c in names], "d.n_words", *pick)
