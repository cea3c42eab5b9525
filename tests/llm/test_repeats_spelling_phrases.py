"""Suffix trees, spelling variants and phrase mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import empty, frame, messy, words

pytest.importorskip("strideflow.llm")

from pyspark.sql import functions as F  # noqa: E402

from strideflow.llm import phrases, queries, spelling, suffix_tree  # noqa: E402

LAST = 1 << 62

# --- suffix trees ---------------------------------------------------------------


def brute_repeats(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    places = defaultdict(list)
    for r, w in enumerate(split):
        for p in range(len(w) - length + 1):
            places[tuple(w[p : p + length])].append((LAST if rows[r][0] is None else rows[r][0], r, p))
    out = []
    for r, w in enumerate(split):
        own, gone = LAST if rows[r][0] is None else rows[r][0], set()
        for p in range(len(w) - length + 1):
            if any(d < own or (s == r and q < p) for d, s, q in places[tuple(w[p : p + length])]):
                gone.update(range(p, p + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((rows[r][0], len(w), len(gone), spans, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(map(str, out))


def tree(df, **options):
    return sorted(str(tuple(r)) for r in suffix_tree.remove_repeats(df, **options).select("doc_id", "n_words", "n_removed", "n_spans", "kept").collect())


def repeat_rows():
    rng = random.Random(3)
    passage, common = words(rng, 45), words(rng, 12)
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randrange(0, 60), 5000)]
        if i % 3 == 0:  # a passage in a third of all texts, with different words around it
            parts += [passage, words(rng, 30, 5000)]
        if i % 4 == 0:  # a frequent beginning with different ends
            parts += [common + " " + words(rng, 25, 5000)]
        if i % 10 == 0:
            parts += [words(rng, 24, 3)] * 2
        rows.append((rng.randrange(80), rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(7, "a " * 100), (8, "a " * 70 + "b"), (9, None), (9, ""), (None, passage), (None, passage), (3, rows[0][1]), (3, rows[0][1])]
    return rows


@pytest.mark.parametrize(
    "options",
    [{}, {"frequent": 3}, {"frequent": 2, "chunk_bytes": 2000, "group_bytes": 400}, {"length": 9, "prefixes": (2, 5), "frequent": 4}],
    ids=["one chunk size", "longer prefixes", "many chunks and groups", "shorter"],
)
def test_suffix_trees_equal_brute_force(spark, options):
    rows = repeat_rows()
    df = frame(spark, rows)
    assert tree(df, **options) == brute_repeats(rows, options.get("length", 20))


def test_suffix_trees_take_messy_rows(spark):
    rows = [tuple(r) for r in messy(spark).select("doc_id", "text").collect()]
    assert tree(messy(spark)) == brute_repeats(rows, 20)
    assert tree(empty(spark)) == []


def test_prefixes_are_lengthened_only_where_they_are_frequent(spark):
    rng = random.Random(1)
    common, long_common = words(rng, 4), words(rng, 8)
    texts = [(i, f"{common} {words(rng, 30, 9000)}") for i in range(30)] + [(99 + i, f"{long_common} {words(rng, 30, 9000)}") for i in range(30)]
    found = suffix_tree.frequent_prefixes(frame(spark, texts).coalesce(1).select("text"), 20)
    assert {k: len(v) for k, v in found.items()} == {4: 6, 8: 1}  # the 8 words hold 5 prefixes of 4


def test_a_path_reaches_its_group_once_a_chunk(spark):
    """A passage of all texts of a chunk is sent as one path, not one a text."""
    import pyarrow as pa

    rng = random.Random(2)
    passage = words(rng, 20)
    table = pa.table({"doc_id": list(range(50)), "text": [f"{words(rng, 3, 9999)} {passage} {words(rng, 3, 9999)}" for _ in range(50)], "chunk": pa.array([0] * 50, pa.int32())})
    none = pa.table({"chunk": pa.array([], pa.int32()), "group": pa.array([], pa.int32()), "kind": pa.array([], pa.string()), "bits": pa.array([], pa.binary())})
    sent = suffix_tree._send_paths(20, 8, 4, {4: [], 8: []})(table, none)
    paths = sum(len(p) // sum(suffix_tree._PATH) for p in sent.column("paths").to_pylist())
    anchors = suffix_tree._Chunk(table, 20, 8)
    assert paths < len(anchors.begin) and paths <= 50 * 6 + 1  # the passage itself once; windows over its edges differ


# --- spelling -------------------------------------------------------------------


def edits(w, v):
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v, strict=True)) == 1
    if len(w) > len(v):
        w, v = v, w
    return len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))


def brute_variants(n):
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(map(str, out))


def variant_rows(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def some_words():
    rng = random.Random(9)
    n = {}
    for base in ("variant", "aaaaaa", "señorial", "abcdefabcdef", "élévation", "x" * 300):
        pool = [base]
        for _ in range(40):
            w = list(rng.choice(pool))
            i = rng.randrange(len(w))
            rng.choice([lambda: w.insert(i, rng.choice("abéx")), lambda: w.pop(i), lambda: w.__setitem__(i, rng.choice("abéx"))])()  # noqa: B023
            if len(w) >= 6:
                pool.append("".join(w))
        n.update({w: rng.choice([5, 6, 25, 30, 125, 150, 800]) for w in pool})
    return n


@pytest.mark.parametrize("part_words", [4096, 8], ids=["one part a length", "hot halves over several tasks"])
def test_spelling_variants_equal_brute_force(spark, part_words):
    n = some_words()
    df = spark.createDataFrame(list(n.items()), "word string, n long").withColumns({"short": F.lit("x"), "form": F.lit("y"), "root": F.lit("z")})
    assert variant_rows(spelling.variants(df, part_words=part_words)) == brute_variants(n)


def test_spelling_chain_ties_and_empty(spark):
    chain = {"abcdefghij": 5, "abcdefghijk": 25, "abcdefghijkl": 125, "abcdefghijkm": 125, "abcdefghijklm": 625}
    assert variant_rows(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))) == brute_variants(chain)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_spelling_query_on_messy_rows(spark, tmp_path):
    rng = random.Random(4)
    base = ["Straße", "voilàtout", "Beispielwort", "GROSSBUCHSTABEN", "naïveté", "kurz", "coöperation", "×÷×÷×÷×"]
    texts = [(i if i % 7 else None, " ".join(rng.choice(base) + rng.choice(["", "", "s", "1"]) for _ in range(rng.randrange(300)))) for i in range(80)] + [(3, None), (4, ""), (5, "x" * 100000)]
    rows = frame(spark, texts, "doc_id long, text string").withColumn("word", F.lit("clash"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            if len(w) < 6:
                continue
            h = zlib.crc32(f"{i}:{w}".encode() if i is not None else w.encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if c >= 5 and len(w) >= 6}
    assert variant_rows(queries.op12_spelling_variants(spark, str(tmp_path))) == brute_variants(n)


def test_index_is_walked_letter_by_letter(spark):
    """One walk over a query's letters gives all its near words at once."""
    import numpy as np

    index = spelling.Index(["abcdef", "abcdeg", "abcdefg", "abxdef", "zbcdef", "abcdff"], 6)
    hits = [np.flatnonzero(np.unpackbits(index.near(np.array([0]), half))).tolist() for half in (True, False)]
    assert hits == [[1, 2, 5], [3, 4]]


# --- phrases --------------------------------------------------------------------


def brute_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        inside = [v for (x, q), v in f.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * v >= 80 * a for v in inside):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(str((lang, r + 1, p.decode(), -a, x, y, n[lang], -s)) for lang, own in out.items() for r, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


def phrase_rows():
    rng = random.Random(8)
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "fr", None, "und", ""])
        t = " ".join(rng.choice(["New York", "the", "City", "of light", "a a", "état", "x"]) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(1, 60)))
        rows.append((lang, t))
    rows += [("en", None), ("en", ""), ("en", " . "), ("fr", "un deux trois quatre cinq. " * 40), rows[0], rows[0]]
    return rows


def mined(df, **options):
    return sorted(str(tuple(r)) for r in phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{}, {"shards": 7, "bits": 8}, {"shards": 1, "top": 5}], ids=["production", "many shards, full table", "one shard, few rows"])
def test_phrases_equal_brute_force(spark, options):
    rows = phrase_rows()
    df = frame(spark, rows, "lang string, text string").withColumns({"phrase": F.lit("clash"), "shard": F.lit("clash")})
    assert mined(df, least=8, **options) == brute_phrases(rows, 8, 4, options.get("top", 2000))


def test_phrases_of_no_rows(spark):
    assert mined(empty(spark)) == []


def test_a_phrase_is_counted_for_one_cycle_from_its_activation(spark, monkeypatch):
    """Lengths are interleaved: pairs are counted before the words' cycle ends."""
    seen = []
    real = phrases._count

    def noted(sent, step, shards, *rest):
        seen.append(step)
        return real(sent, step, shards, *rest)

    monkeypatch.setattr(phrases, "_count", noted)
    df = spark.createDataFrame([("en", "one two three four " * 50)] * 40, "lang string, text string").repartition(1)
    _, named, total = phrases.frequent_phrases(df, least=30, shards=4)
    got = {r.phrase: r.f for r in named.collect()}
    assert got["one two three four"] == 2000 and got["four one"] == 40 * 49 and [tuple(r) for r in total.collect()] == [("en", 8000)]
    assert len(seen) == 7  # words from step 0, pairs from 1, triples from 2, fours from 3: not four cycles


def test_op11_digest_is_of_the_kept_words(spark, tmp_path):
    rows = repeat_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.kept_sha256 for r in queries.op11_suffix_tree(spark, str(tmp_path)).collect())
    kept = [r.kept for r in suffix_tree.remove_repeats(frame(spark, rows)).collect()]
    assert got == sorted(hashlib.sha256(k.encode()).hexdigest() for k in kept)
