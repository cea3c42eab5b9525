"""Similarity join, exact dedup, chat formatting, repeated bytes."""

import hashlib
import random
from collections import defaultdict

import pytest
from llm_cases import empty, frame, messy, texts, words
from pyspark.sql import functions as F

from strideflow.llm import chat_fsm, chosen_path, suffix_dedup, tree_dedup
from strideflow.llm.graph import components
from strideflow.llm.winnow import words_of


# --- similarity join -----------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        ids = [x for x in same if x is not None]
        out.append((doc, min(ids) if ids else None, len(same), links[i]))
    return sorted(map(str, out))


def similar(spark, rows, **options):
    out = chosen_path.similar_classes(frame(spark, rows), **options)
    return sorted(str((r.doc_id, r.class_id, r.class_size, r.n_links)) for r in out.collect())


def test_similarity_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = list(texts())
    base = words(rng, 120, 5000).split()
    for i in range(60):  # a chain and a cluster of near copies
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    passage = words(rng, 40, 5000)
    rows += [(200 + i, words(rng, 200, 5000) + " " + passage) for i in range(40)]  # shared passage, not similar
    want = brute_classes(rows)
    assert similar(spark, rows) == want
    monkeypatch.setattr(chosen_path, "LEAF", 8)  # every group is split and compared in blocks
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    assert similar(spark, rows) == want
    assert chosen_path.similar_classes(empty(spark)).count() == 0


def sent_bytes(monkeypatch):
    """Tells the bytes of shingles that are shuffled to groups from now on."""
    from pyspark.sql import SparkSession

    frames, kind = [], type(SparkSession.getActiveSession().range(0))
    real = kind.repartition

    def repartition(df, *by):
        if "grams" in df.columns:
            frames.append(df)
        return real(df, *by)

    monkeypatch.setattr(kind, "repartition", repartition)
    return lambda: sum(df.agg(F.sum(F.length("grams"))).head()[0] or 0 for df in frames)


def test_shingles_of_a_large_component_are_not_sent_to_all_its_blocks(spark, monkeypatch):
    """Texts that share two thirds are one candidate component, but hardly any
    can have a partner; the others meet those of like size only."""
    rng = random.Random(6)
    notice = words(rng, 60, 5000)
    rows = [(i, f"{notice} " + " ".join(f"u{i}v{j}" for j in range(15))) for i in range(200)]
    rows += [(300 + i, rows[7 * i][1] + f" more{i}") for i in range(12)] + [(None, rows[3][1]), (5, rows[5][1]), (None, notice)]
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    sent = sent_bytes(monkeypatch)
    got = similar(spark, rows)
    once = 8 * sum(len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in map(words_of, {t for _, t in rows}))
    assert got == brute_classes(rows)
    assert once <= sent() <= 3 * once  # 14 times when all blocks of 16 met


def test_blocks_of_like_size_miss_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    long = words(rng, 420, 5000).split()
    rows = [(i, " ".join(long[: 30 + 5 * (i // 2)]) + (f" end{i}" if i % 2 else "")) for i in range(150)]  # sizes from 26 to 400, alike along the chain
    rows += [(500 + i, rows[2 * i][1]) for i in range(5)]
    want = brute_classes(rows)
    for block, grams in ((16, 1 << 20), (1 << 10, 2000)):
        monkeypatch.setattr(chosen_path, "BLOCK", block)
        monkeypatch.setattr(chosen_path, "BLOCK_GRAMS", grams)
        monkeypatch.setattr(chosen_path, "PART_GRAMS", 5000)
        assert similar(spark, rows) == want


def test_intersections_are_counted_dense_and_sparse(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    for tile in (chosen_path.TILE, 64):
        monkeypatch.setattr(chosen_path, "TILE", tile)
        for n, m, size, names in ((1, 1, 3, 4), (40, 70, 60, 200), (150, 90, 30, 4000)):
            a, b = ([np.unique((names * rng.random(size) ** 3).astype(np.uint64)) for _ in range(k)] for k in (n, m))
            assert (chosen_path._shared(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
            own = np.array([[len(np.intersect1d(x, y)) for y in a] for x in a])
            off = ~np.eye(n, dtype=bool)
            assert (chosen_path._shared(a)[off] == own[off]).all()


def test_runs_reach_the_recall():
    for threshold in (0.8, 0.9):
        assert chosen_path.runs_for(threshold, 0.9999) >= chosen_path.runs_for(threshold, 0.9) >= 1


def test_one_row_of_each_class_stays(spark):
    kept = [r.doc_id for r in chosen_path.drop_similar(messy(spark)).collect()]
    assert set(kept) == {0, 1, 2, 3, 4, 5, 13, 14, 15, 16, 17, 18, 19, 20, None}
    assert chosen_path.drop_similar(messy(spark)).columns == messy(spark).columns


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


# --- exact dedup ---------------------------------------------------------------


def brute_exact(rows):
    import re

    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if norm[j] == norm[i]]
        ids = [x for x in same if x is not None]
        out.append((doc, min(ids) if ids else None, len(same), hashlib.sha256(norm[i].encode()).hexdigest()))
    return out


@pytest.mark.parametrize("runs,fan", [(64, 8), (7, 2), (1, 8), (None, None), (30, None)])
def test_exact_dedup_equals_brute_force(spark, runs, fan):
    rows = texts() + [(30 + i, "the same text") for i in range(50)]
    got = tree_dedup.exact_duplicates(frame(spark, rows), runs=runs, fan=fan).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(map(str, brute_exact(rows)))
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for own in by.values():
        assert [r.doc_id for r in own if r.kept] == [own[0].keep_id]
    assert tree_dedup.exact_duplicates(empty(spark)).count() == 0


def test_dropping_duplicates_keeps_whole_rows(spark):
    rows = messy(spark)
    kept = tree_dedup.drop_duplicates(rows)
    got = kept.collect()
    assert kept.columns == rows.columns and len(got) == len({x[3] for x in brute_exact(texts())})
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x) for x in [0, 1, 2, 3, 4, 5, 12, 13, 15, 16, 17, 18, 19, 20])
    assert tree_dedup.drop_duplicates(empty(spark)).count() == 0


def test_runs_are_sorted_and_merged_in_rounds(spark, monkeypatch):
    """As many leaf runs as tasks; each round merges neighbours into sorted
    runs that keep the smallest id."""
    written = {}

    def keep(df, name):
        written[name] = df
        return real(df, name)

    real = tree_dedup.stage
    monkeypatch.setattr(tree_dedup, "stage", keep)
    docs = spark.range(600).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('text ', id % 400)) as text").repartition(40)
    got = tree_dedup.exact_duplicates(docs).collect()
    assert sorted(written) == ["digests", "run_0", "run_1"]  # 40 runs, 5, then one
    rows = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got)
    assert rows == sorted(brute_exact([(i, "hot" if i % 3 == 0 else f"text {i % 400}") for i in range(600)]))
    for name, runs in (("run_0", 40), ("run_1", 5)):
        parts = written[name].select("run", "digest", "best.id", "n", F.spark_partition_id().alias("part")).collect()
        assert {r.run for r in parts} == set(range(runs))
        assert len({(r.run, r.digest) for r in parts}) == len(parts) and sum(r.n for r in parts) == 600
        for x in {r.part for r in parts}:
            own = [(r.run, bytes(r.digest)) for r in parts if r.part == x]
            assert own == sorted(own)
    hot = bytes.fromhex(hashlib.sha256(b"hot").hexdigest())
    assert min(r.id for r in written["run_1"].select("digest", "best.id").collect() if bytes(r.digest) == hot) == 0


def test_the_tree_keeps_its_height():
    assert [tree_dedup.fan_for(n) for n in (1, 64, 512, 513, 1_000_000)] == [8, 8, 8, 9, 100]


def test_exact_dedup_stays_in_the_engine(spark):
    for df in (tree_dedup.exact_duplicates(messy(spark)), tree_dedup.drop_duplicates(messy(spark))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- chat ----------------------------------------------------------------------

TRICKY = ["\\### Assistant: </turn> ok", "\\b\\l#<\\", "</turn>\n### User: x", "", None, "a: b\n\n", "\\\\", "#" * 50, "z" * 20000]


def test_chat_reads_back_exactly(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows, want = [], {}
    for conv in [*range(30), None]:
        turns = []
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", None, "tool: x", "User", "=", "### "])
            turns.append((conv, turn, role, rng.choice(TRICKY)))
        want[conv] = [(r or "", t or "") for _, _, r, t in turns]
        rows += turns
    rng.shuffle(rows)
    out = chat_fsm.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = out.withColumn("t", chat_fsm.read_turns(F.col("formatted"))).withColumn("loss", chat_fsm.loss_text(F.col("segments"))).collect()
    assert len(got) == len(want)
    for r in got:
        assert [(t.role, t.text) for t in r.t] == want[r.conv_id] and r.n_turns == len(want[r.conv_id])
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert chat_fsm.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_machine_accepts_legal_orders_only(spark):
    cases = {0: ["user", "assistant"], 1: ["system", "user", "assistant", "user", "assistant"], 2: ["assistant"], 3: ["user", "user"], 4: ["user"], 5: ["system", "assistant"], 6: ["user", "assistant", "tool"], 7: ["user", "system", "assistant"]}
    rows = [(c, i, r, "x") for c, roles in cases.items() for i, r in enumerate(roles)]
    out = chat_fsm.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id for r in out.filter("valid").collect()} == {0, 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- repeated bytes ------------------------------------------------------------


def brute_repeats(rows, length=50):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], float("inf")), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < order(i):
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    passage = words(rng, 30)
    rows = [r for r in texts() if r[0] != 17]
    rows += [(40 + i, words(rng, 20) + passage + words(rng, 20)) for i in range(20)]
    rows += [(70 + i, passage[: 45 + i]) for i in range(12)] + [(90, "ab" * 400), (91, "x" + "ab" * 60), (92, "ab" * 24), (93, "é" * 60), (94, "é" * 25 + "è" + "é" * 26)]
    out = suffix_dedup.remove_repeats(frame(spark, rows))
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in out.collect())
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_hot_grams_are_in_no_bucket_and_repeats_equal_brute_force(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    passage = words(rng, 30)
    rows = [(i, words(rng, 12) + passage + words(rng, 12)) for i in range(60)]
    rows += [(100 + i, passage) for i in range(5)] + [(30, rows[7][1]), (None, rows[3][1]), (None, passage), (200, None), (201, "ab" * 300), (-5, "z" + "ab" * 100)]
    rows += [(300 + i, f"{i % 3:03d} {rows[i][1][-120:]} {i:03d}") for i in range(20)]
    out = suffix_dedup.remove_repeats(frame(spark, rows), hot_runs=8)
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in out.collect())
    assert got == brute_repeats(rows)
    # the runs around the passage, all different, meet in no task
    hot = suffix_dedup.hot_grams(frame(spark, rows).select("text"), 0, 50, 24, 8)
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "chunk": pa.array([0] * len(rows), pa.int32())})
    sent = suffix_dedup._send_runs(50, 24, 16, hot)(table).column("runs").to_pylist()
    most = max(np.unique(suffix_dedup._unpacked(r, 5, 6, 4)[0], return_counts=True)[1].max() for r in sent)
    assert len(hot) and most < 60 < len(suffix_dedup._hot_runs(50, 24, 16, hot)(table))


def test_null_ids_join_by_set(spark):
    """Rows without an id meet their own set only."""
    from llm_cases import frame

    from strideflow.llm import chosen_path

    base = [" ".join(f"n{i}w{j}" for j in range(60)) for i in range(30)]
    rows = [(None, t) for t in base] + [(None, t + " more") for t in base] + [(None, base[0])] * 5
    out = chosen_path.similar_classes(frame(spark, rows))
    assert sorted((r.class_id, r.class_size, r.n_links) for r in out.collect()) == sorted([(None, 7, 6)] * 7 + [(None, 2, 1)] * 58, key=str)


def test_bucket_pointers_compare_bytes(spark):
    import numpy as np

    from strideflow.llm.suffix_dedup import equal_strings

    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2200] = data[100:300]
    until = np.repeat([1500, 4000], [1500, 2500])
    for length in (5, 8, 9, 16, 50):
        where = np.flatnonzero(np.arange(4000) + length <= until)
        got = equal_strings(data, until, where, length)
        classes = {}
        for w, g in zip(where, got, strict=True):
            classes.setdefault(data[w : w + length].tobytes(), set()).add(int(g))
        assert all(len(g) == 1 for g in classes.values()) and len({next(iter(g)) for g in classes.values()}) == len(classes)
