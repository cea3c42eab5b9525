"""Phrase mining by dynamic itemset counting.

The documents are dealt over shards that are read in a cycle.  Single words are
counted from the first shard on.  A longer phrase becomes active with the
shard after the one at which both its subphrases (all words but the last, all
but the first) have been seen ``least`` times, and is counted until it has seen
every shard once.  So lengths are interleaved, and every phrase of ``least``
occurrences gets its exact count.

Which subphrases have reached the threshold, and after which shard, is a table
of fixed size over hashes, sent to all tasks.  Two phrases on one place of it
only make some phrases active that need not be; these are counted exactly as
well.

Phrases are counted by 64-bit hashes of (language, words), packed and bucketed
by ranges of the hash, so the counts of a step are shuffled once and summed
with those of other steps where they lie.  At the end the shards are read once
more until every frequent phrase has its words; the query fails if two frequent
phrases should share a hash.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import LOWER, gram_hashes, mix64, shared_dir, stage, task, text_slices

LEAST = 30
LONGEST = 4
SHARDS = 4
BITS = 24  # places of the table of reached phrases, as a power of 2
TOP = 2000
SLICE = 1 << 20
TASK_KEYS = 1 << 21  # counts that a task holds before it sends them
BUCKET_BYTES = 16 << 20  # text whose counts make up one bucket
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_WORD = "[^.,;:!?\\x0A-\\x0D\\x20\\x09]+"
_COUNTS = "bucket int, counts binary"


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hashes, in their order."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _place(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


class _Words:
    """The words of a slice, A-Z in lower case, and its phrases."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: list[str], keys: dict[str, int]):
        self.low = LOWER[data]
        self.starts, self.ends, self.row = spans.runs(~_GAP[self.low], offs)
        if len(self.starts):
            seed = np.array([keys.setdefault(x, _lang_key(x)) for x in langs], dtype=np.uint64)
            self.h = mix64(spans.hashes(self.low, self.starts, self.ends) ^ seed[self.row])
            piece = np.cumsum(_BREAK[self.low])[self.starts]
            self.together = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])

    def phrases(self, longest: int):
        """(words, hash at each word, whether the phrase lies in one piece)."""
        whole = np.ones(len(self.starts), dtype=bool)
        for k in range(1, min(longest, len(self.starts)) + 1):
            if k > 1:
                whole = whole[:-1] & self.together[k - 2 :]
            yield k, gram_hashes(self.h, k), whole


def _summed(key: np.ndarray, k: np.ndarray, n: np.ndarray):
    """One entry for each hash, in their order."""
    order = np.argsort(key, kind="stable")
    key, k, n = key[order], k[order], n[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], k[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n


def _cut(values: np.ndarray, wide: int) -> bytes:
    raw = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :wide]).tobytes()


def _widen(raw: np.ndarray, wide: int) -> np.ndarray:
    out = np.zeros((len(raw) // wide, 8), np.uint8)
    out[:, :wide] = raw.reshape(-1, wide)
    return out.view(np.uint64).ravel()


def _packed(key: np.ndarray, k: np.ndarray, n: np.ndarray) -> bytes:
    """Counts in the order of their hashes, which are stored as steps: the
    widths, the first hash, then steps, numbers of words, counts."""
    steps = np.diff(key)
    wide = 6 if not len(steps) or steps.max() < 1 << 48 else 8
    some = 1 if n.max() < 256 else 8
    return bytes([wide, some]) + key[:1].tobytes() + _cut(steps, wide) + k.tobytes() + _cut(n, some)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, (wide, some) = np.frombuffer(raw, np.uint8), raw[:2]
    rows = (len(flat) - 10 + wide) // (wide + 1 + some)
    key = np.zeros(rows, np.uint64)
    key[:1] = flat[2:10].copy().view(np.uint64)
    at = 10 + (rows - 1) * wide
    key[1:] = _widen(flat[10:at], wide)
    return np.cumsum(key, dtype=np.uint64), flat[at : at + rows], _widen(flat[at + rows :], some).astype(np.int64)


def _count(sent, step: int, shards: int, longest: int, bits: int, buckets: int):
    def flush(held: list[tuple]):
        key, k, n = _summed(*(np.concatenate([h[c] for h in held]) for c in range(3)))
        cut = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
        own = np.flatnonzero(np.diff(cut))
        packed = [_packed(key[cut[b] : cut[b + 1]], k[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]]) for b in own]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "counts"])

    @task
    def run(batches):
        reached = np.frombuffer(sent.value, np.uint8)
        keys, held = {}, []
        for batch in batches:
            for i, j, data, offs in text_slices(batch.column(0), SLICE):
                last = None
                for k, key, whole in _Words(data, offs, batch.column(1).slice(i, j - i).to_pylist(), keys).phrases(longest):
                    if k == 1:
                        active = whole if step < shards else np.zeros(len(key), dtype=bool)
                    else:
                        after = np.maximum(last[:-1], last[1:]).astype(np.int64)  # both are reached
                        active = whole & (np.minimum(last[:-1], last[1:]) > 0) & (after <= step) & (step < after + shards)
                    if active.any():
                        value, n = np.unique(key[active], return_counts=True)
                        held.append((value, np.full(len(value), k, np.uint8), n.astype(np.int64)))
                    last = reached[_place(key, bits)] if k < longest else None
                if sum(len(h[0]) for h in held) > TASK_KEYS:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The counts of a bucket in one step."""
    parts = [_unpacked(c) for c in table.column("counts").to_pylist()]
    counts = _packed(*_summed(*(np.concatenate([p[c] for p in parts]) for c in range(3))))
    return pa.table({"bucket": table.column("bucket")[:1], "counts": pa.array([counts], pa.binary())})


def _frequent(least: int, shards: int):
    """Phrases of a bucket with ``least`` occurrences in all steps.  Such a
    phrase has its share of them in some step, so only those are looked up."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(c) for c in table.column("counts").to_pylist()]  # a step each
        some = [n >= -(-least // shards) for _, _, n in parts]
        share, first = np.unique(np.concatenate([p[0][x] for p, x in zip(parts, some, strict=True)]), return_index=True)
        words = np.concatenate([p[1][x] for p, x in zip(parts, some, strict=True)])[first]
        f = np.zeros(len(share), np.int64)
        for key, _, n in parts:
            at = np.minimum(np.searchsorted(key, share), len(key) - 1)
            f += np.where(key[at] == share, n[at], 0)
        kept = f >= least
        return pa.table({"key": share[kept].view(np.int64), "words": words[kept].astype(np.int32), "f": f[kept]})

    return run


def _places(found: DataFrame, bits: int) -> np.ndarray:
    """The places of phrases, as a bit map: 2**bits bits at most."""
    at = F.shiftrightunsigned("key", 64 - bits) + 1
    maps = found.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    out = np.zeros(1 << bits, dtype=bool)
    for bucket, raw in zip(maps.column("bucket").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        own = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
        start = (bucket - 1) * len(own)
        out[start : start + len(own)] = own[: len(out) - start]
    return out


_NAMED = "lang string, key bigint, phrase string, parts array<bigint>, held array<bigint>"


def _lists(columns: list[np.ndarray], rows: int) -> pa.Array:
    """A list of the columns' values in each row."""
    flat = np.stack(columns, axis=1).ravel().view(np.int64) if columns else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(columns)), pa.array(flat))


def _name(sent, longest: int, bits: int):
    """Phrases of two words or more at given places, each once a slice: their
    words, the hashes of their two parts at each cut, and of the phrases of two
    words or more in them."""

    @task
    def run(batches):
        given = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        keys = {}
        for batch in batches:
            lang = batch.column(1)
            for i, j, data, offs in text_slices(batch.column(0), SLICE):
                own = lang.slice(i, j - i)
                words = _Words(data, offs, own.to_pylist(), keys)
                if not len(words.starts):
                    continue
                text, at = spans.gather(words.low, words.starts, words.ends, b" ")
                grams = {}
                for k, key, whole in words.phrases(longest):
                    grams[k] = key
                    where = np.flatnonzero(whole & given[_place(key, bits)]) if k > 1 else []
                    if not len(where):
                        continue
                    value, first = np.unique(key[where], return_index=True)
                    one = where[first]
                    parts = [x for c in range(1, k) for x in (grams[c][one], grams[k - c][one + c])]
                    held = [grams[size][one + o] for size in range(2, k) for o in range(k - size + 1)]
                    cols = [own.take(pa.array(words.row[one])), pa.array(value.view(np.int64)), spans.strings(text, at[one], at[one + k] - 1), _lists(parts, len(one)), _lists(held, len(one))]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "key", "phrase", "parts", "held"])

    return run


def _named(dealt: DataFrame, found: DataFrame, shards: int, longest: int, bits: int) -> DataFrame:
    """The frequent phrases with their words: a shard after the other is read
    for those that no shard before has."""
    context, out, left = dealt.sparkSession.sparkContext, None, found.filter("words > 1")
    one = F.struct("lang", "phrase", "parts", "held")
    for shard in range(shards):
        sent = context.broadcast(np.packbits(_places(left, bits)).tobytes())
        rows = dealt.filter(F.col("shard") == shard).select("text", "lang").mapInArrow(_name(sent, longest, bits), _NAMED)
        rows = rows.join(left, "key").groupBy("key", "words", "f").agg(F.min(one).alias("own"), F.max(one).alias("other"))
        same = F.when(F.col("own") != F.col("other"), F.raise_error(F.lit("two frequent phrases share a hash"))).otherwise(F.col("own"))
        rows = stage(rows.withColumn("own", same).select("key", "words", "f", "own.*"), "named")
        out = rows if out is None else out.unionByName(rows)
        left = stage(left.join(rows, "key", "left_anti"), "left")
        sent.destroy()
        if left.isEmpty():
            break
    return out


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, words, f) of all phrases of 1 to ``longest`` words with ``least``
    occurrences or more; those of two words or more with lang, phrase, parts
    and held (see ``_name``); and (lang, n) with all word occurrences."""
    spark = docs.sparkSession
    base = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    size = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = int(min(max(size // BUCKET_BYTES, 16), 50_000))
    folder, name = f"{shared_dir(spark)}/llm-stages/{uuid.uuid4().hex}", f"phrase_counts_{uuid.uuid4().hex}"
    dealt = base.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    dealt.write.partitionBy("shard").parquet(f"{folder}/shards")  # from here on every row has its shard
    dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/shards")
    reached, last, step = np.zeros(1 << bits, np.uint8), 0, 0
    while step < last + shards:  # the last phrases that became active have not seen every shard
        sent = spark.sparkContext.broadcast(reached.tobytes())
        rows = dealt.filter(F.col("shard") == step % shards).select("text", "lang").mapInArrow(_count(sent, step, shards, longest, bits, buckets), _COUNTS)
        seen = rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merge, _COUNTS)
        seen.write.bucketBy(buckets, "bucket").option("path", f"{folder}/counts").mode("append").format("parquet").saveAsTable(name)
        sent.destroy()
        # all steps so far, no shuffle: a bucket's counts lie together
        found = spark.table(name).groupBy("bucket").applyInArrow(_frequent(least, shards), "key bigint, words int, f bigint")
        new = _places(found.filter(F.col("words") < longest), bits) & (reached == 0)
        step += 1
        if new.any():
            reached[new], last = step, step
    found = stage(found, "frequent")
    spark.sql(f"DROP TABLE {name}")  # its files are the folder's
    total = dealt.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(_WORD))).cast("long").alias("n"))
    return found, _named(dealt, found, shards, longest, bits), stage(total, "words")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l,
    r, n, score.

    Texts are cut at ``.,;:!?`` and line ends into pieces and these at spaces
    and tabs into words, A-Z in lower case; null text has none, a null
    language is ``und``.  a counts the phrase's occurrences (overlaps too), l
    and r those of its two parts at the cut of the lowest score, which is
    floor(2000000 * a / (l + r)), ties to the first cut; n is the language's
    number of words.  A phrase goes if a longer one that holds it has at least
    80 % of its occurrences.  Order: score and a descending, phrase ascending
    by bytes.  Repeated rows count each; other columns are ignored; an empty
    table gives an empty one.
    """
    found, named, total = frequent_phrases(docs, text=text, lang=lang, least=least, longest=longest, shards=shards, bits=bits)
    exact = "decimal(38,0)"
    some = named.withColumnRenamed("f", "a")
    cuts = some.select("key", "lang", "phrase", "a", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": F.col("parts")[2 * F.col("cut") - 2], "rest": F.col("parts")[2 * F.col("cut") - 1]}).drop("parts")
    cuts = cuts.join(found.select(F.col("key").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(found.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"(cast(2000000 as {exact}) * cast(a as {exact})) div (cast(l as {exact}) + r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    scored = cuts.groupBy("key", "lang", "phrase", "a").agg(lowest).select("key", "lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = some.select("a", F.explode("held").alias("key")).groupBy("key").agg(F.max("a").alias("longer"))
    held = F.expr(f"cast(100 as {exact}) * cast(longer as {exact}) >= cast(80 as {exact}) * cast(a as {exact})")
    kept = scored.join(inner, "key", "left").filter(F.col("longer").isNull() | ~held)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
