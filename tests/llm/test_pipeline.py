"""The pipeline's stages against plain Python on a small table."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("corpusloom.llm")
import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("sf"))
    item = [f"b{i}" for i in range(20)]
    prose = lambda n: " ".join(f"word{rng.randint(0, 5000)}" for _ in range(n))
    rows, kinds = [], {}
    for i in range(200):
        t = prose(80) + "\ncommon footer line\n" + prose(60)
        kind = "clean"
        if i % 10 == 3:
            t, kind = " ".join(f"***{j}***" for j in range(50)), "junk"
        elif i % 10 == 4:
            t, kind = prose(40) + " " + " ".join(item).upper() + " " + prose(40), "leak"
        elif i % 10 == 5 and i > 10:
            t, kind = rows[0][1].replace("\n", "\n"), "copy"
        rows.append((i, t, "en", f"src{i % 20}", len(t)))
        kinds[i] = kind
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kinds


def test_stages_in_order(spark, folder):
    path, kinds = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs = docs.cache()
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == {i for i, k in kinds.items() if k != "junk"}
    assert sum("common footer line" in r.text for r in seen[1].values()) == 1
    assert all(r.n_chars == len(r.text) for r in seen[1].values())
    assert set(seen[2]) == {i for i, k in kinds.items() if k in ("clean", "leak")}
    assert set(seen[3]) == {i for i, k in kinds.items() if k == "clean"}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen[3])


def test_run(spark, folder):
    path, kinds = folder
    out = corpus_pipeline.run(spark, path)
    assert out.select("doc_id").distinct().count() == sum(k == "clean" for k in kinds.values())
