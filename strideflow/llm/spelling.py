"""Spelling variants: words one edit apart, found with a bit-sliced position
index.

For each (position, letter) the index holds a bit set over the words.  A query
word walks its letters once: ANDs of these bit sets carry, for all words at
the same time, the set that agrees so far (no error) and the sets with one
replaced, one more and one less letter, whose positions are shifted by 0, 1
and -1.

Two words one edit apart share their first or their last half, counted on the
shorter one, so the vocabulary is indexed in parts: by length, half and a hash
of the half.  A pair counts in the part of the first half if these agree, in
that of the last half otherwise: once in all.  Where very many words share a
half, its queries are spread over several tasks, each with the whole index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LEAST_LETTERS = 6
LEAST_OCCURRENCES = 5
RATIO = 5  # a form has at least this many times the occurrences
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
PART_WORDS = 4096  # words of an index, and queries of a task
BLOCK_BYTES = 1 << 22  # a bit set of a block of queries


def runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(doc_id, word) of every maximal run of letters that is long enough,
    only A-Z in lower case.  Null text has none."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("word"))
    return rows.withColumn("word", F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def vocabulary(rows: DataFrame, *, word: str = "word", least_letters: int = LEAST_LETTERS, least_occurrences: int = LEAST_OCCURRENCES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    long = rows.select(F.col(word).alias("word")).filter(F.length("word") >= least_letters)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_occurrences)


class Index:
    """Bit sets over words of ``length`` and ``length + 1`` letters, in the
    order of the words given."""

    def __init__(self, words: list[str], length: int):
        self.length = length
        # a letter more than the longest: position length + 1 has no letter
        codes = np.array(words, dtype=f"<U{length + 2}").view(np.uint32).reshape(len(words), length + 2)
        self.letters = np.unique(codes)
        self.codes = np.searchsorted(self.letters, codes)
        self.longer = codes[:, length] > 0
        self.sets = np.stack([np.packbits(self.codes[:, j][None, :] == np.arange(len(self.letters))[:, None], axis=1) for j in range(length + 1)])
        self.is_longer = np.packbits(self.longer)
        self.is_short = np.packbits(~self.longer)

    def near(self, queries: np.ndarray, first_half: bool) -> np.ndarray:
        """For words (by number, all of one length) the bit set of the words
        one edit away whose first half agrees, or does not."""
        m, half = self.length + int(self.longer[queries[0]]), self.length // 2
        width = self.sets.shape[2]
        same = np.full((len(queries), width), 255, np.uint8)
        replaced, more, less = (np.zeros_like(same) for _ in range(3))
        agree = same
        for i in range(m):
            letter = self.codes[queries, i]
            here = self.sets[i][letter]
            if m > self.length:
                before = self.sets[i - 1][letter] if i else np.zeros_like(same)
                less = (less & before) | same
            else:
                after = self.sets[i + 1][letter]
                more = (more | same) & after
                replaced = (replaced & here) | (same & ~here)
            same = same & here
            if i + 1 == half:
                agree = same
        found = less & self.is_short if m > self.length else (replaced & self.is_short) | ((more | same) & self.is_longer)
        return found & (agree if first_half else ~agree)


_TOP_BIT = np.array([0] + [8 - int(i).bit_length() for i in range(1, 256)], dtype=np.int64)


def _search(table: pa.Table) -> pa.Table:
    """The near words of each query of a part: how many, and the first by
    (most occurrences, code points)."""
    words, n, asks = (table.column(c).to_pylist() for c in ("word", "n", "asks"))
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], np.array([n[i] for i in order], np.int64)
    asked = np.array([asks[i] for i in order], dtype=bool)
    index = Index(words, table.column("short")[0].as_py())
    first_half = table.column("first_half")[0].as_py()
    block = max(1, BLOCK_BYTES // index.sets.shape[2])
    out = []
    for longer in (False, True):
        queries = np.flatnonzero(asked & (index.longer == longer))
        for i in range(0, len(queries), block):
            own = queries[i : i + block]
            near = index.near(own, first_half)
            count = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
            byte = (near != 0).argmax(axis=1)
            best = byte * 8 + _TOP_BIT[near[np.arange(len(own)), byte]]
            hit = count > 0
            out += [(words[q], c, int(n[b]), words[b]) for q, c, b in zip(own[hit].tolist(), count[hit].tolist(), best[hit].tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({"word": pa.array(cols[0], pa.string()), "n_near": pa.array(cols[1], pa.int64()), "best_n": pa.array(cols[2], pa.int64()), "best": pa.array(cols[3], pa.string())})


def near_words(vocabulary: DataFrame, *, part_words: int = PART_WORDS, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocabulary`` (word, n)
    that have words one edit away."""
    size = F.length("word")
    short = F.explode(F.array(size, size - 1))
    cells = vocabulary.withColumn("short", short).filter(F.col("short") >= least_letters)
    half = F.floor(F.col("short") / 2).cast("int")
    first = F.struct(F.lit(True).alias("first_half"), F.substring(F.col("word"), F.lit(1), half).alias("half"))
    last = F.struct(F.lit(False).alias("first_half"), F.right(F.col("word"), F.col("short") - half).alias("half"))
    cells = cells.withColumn("cell", F.explode(F.array(first, last))).select("word", "n", "short", F.xxhash64("cell.half").alias("half"), "cell.first_half")
    # one part for about part_words words; more tasks for a half that has more
    parts = cells.groupBy("short", "first_half").agg(F.ceil(F.count(F.lit(1)) / part_words).alias("parts"))
    hot = cells.groupBy("short", "first_half", "half").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > part_words)
    hot = hot.select("short", "first_half", "half", F.ceil(F.col("c") / part_words).alias("tasks"))
    keyed = cells.join(parts, ["short", "first_half"]).join(hot, ["short", "first_half", "half"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("tasks"))
    part = F.when(F.col("tasks").isNull(), F.pmod(F.col("half"), F.col("parts"))).otherwise(F.col("half"))
    keyed = keyed.withColumn("part", part).withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tasks") - 1, F.lit(0)))))
    keyed = keyed.withColumn("asks", F.coalesce(own == F.col("task"), F.lit(True))).withColumn("is_hot", F.col("tasks").isNotNull())
    found = keyed.groupBy("short", "first_half", "part", "is_hot", "task").applyInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.m")).alias("best_n"), F.col("first.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): every form chain followed to its end by pointer jumping.
    A step multiplies the occurrences, so chains are short."""
    now, open_ = forms.select("word", F.col("form").alias("root")), True
    while open_:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        open_ = not now.filter("moved").isEmpty()
        now = now.select("word", "root")
    return now


def variants(vocabulary: DataFrame, *, ratio: int = RATIO, part_words: int = PART_WORDS, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """One row for each word of ``vocabulary`` (word, n; words unique): word,
    form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point.
    The form is the near word of largest n, ties to the smallest in code-point
    order, if it has at least ``ratio`` times the word's occurrences, else
    null; the root is the end of the chain of forms, the word itself without
    one.  Null words are left out, as are words shorter than
    ``least_letters``.  An empty vocabulary gives an empty table; other columns
    are ignored.
    """
    words = stage(vocabulary.select("word", F.col("n").cast("long").alias("n")).filter(F.length("word") >= least_letters), "vocabulary")
    near = near_words(words, part_words=part_words, least_letters=least_letters)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.when(is_form, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    found = stage(found, "near")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
