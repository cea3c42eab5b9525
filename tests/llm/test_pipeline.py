"""The pipeline's stages against brute force on their own inputs."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_group_operators import brute_classes, brute_exact
from test_text_operators import brute_hits

from strideflow.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_their_columns(spark):
    docs = read(spark, SF, "documents")
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {r.doc_id for r in read(spark, SF, "labels").filter("quality = 0").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = step(spark, docs, SF)
        assert after.columns == docs.columns
        kept = sorted(r.doc_id for r in after.collect())
        if name == "quality":
            assert not bad & set(kept) and len(kept) >= 0.8 * (len(before) - len(bad))
        elif name == "exact_dedup":
            assert kept == sorted({x[1] for x in brute_exact(before)})
        elif name == "near_dedup":
            assert kept == sorted({eval(x)[1] for x in brute_classes(before)})
        else:
            assert kept == sorted(i for i, t in before if not brute_hits(t, items)[4])
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_stages_are_in_order_and_registered(spark):
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    numbers = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert numbers == {f"op{i}" for i in range(1, 14)}


def test_rare_tables_without_rows(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF).count() == 0


def test_stages_leave_clashing_columns_alone(spark):
    from llm_cases import CLASHES

    docs = read(spark, SF, "documents").limit(60).withColumns({c: F.lit(f"mine {c}") for c in (*CLASHES, "n_hit", "items_sha256", "contaminated", "held_out")})
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in (*CLASHES, "n_hit", "items_sha256", "contaminated", "held_out"))
