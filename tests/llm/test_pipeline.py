"""The pipeline's stages on a small corpus, each against what its input asks for."""

import pytest


@pytest.fixture(scope="module")
def corpus(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, ("aa", "bb")[i % 2], "s", len(t) if t else None) for i, t in enumerate(texts)]
    turned = [" ".join(reversed(texts[i].split())) for i in range(20, 25)]
    rows += [rows[0], *((900 + i, "key token=abcdefghijklmnop0123 end of " + t, "ab"[i % 2] * 2, "s", 0) for i, t in enumerate(turned))]
    rows += [(950, "intro " + " ".join(texts[25].split()[:25]) + " outro " + texts[30][:60], "bb", None, 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    item = " ".join(texts[25].split()[3:22])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, corpus):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline
    from breezeframe.llm.minhash import near_duplicates

    assert [n for n, _ in pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "secrets", "packing"]
    docs, kept = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == pipeline.COLUMNS
        docs.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near_dedup":
            assert docs.count() == len(kept[name])  # the repeated row is gone
    spoken = {i for i, t in first.items() if any(map(str.isalpha, t or ""))}
    assert set(kept["language"]) <= spoken and len(kept["language"]) > 0.8 * len(spoken)
    groups = near_duplicates(spark.read.parquet(f"{corpus}/language")).select("doc_id", "component_id").distinct().collect()
    assert set(kept["near_dedup"]) == {r["component_id"] for r in groups}
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {25, 950}
    assert set(kept["secrets"]) == set(kept["decontaminate"])
    changed = {i for i, t in kept["secrets"].items() if t != kept["decontaminate"][i]}
    assert changed and changed == {i for i in kept["secrets"] if 900 <= i < 905}
    assert all(kept["secrets"][i].startswith("key [SECRET] end of") for i in changed)
    pieces = pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["secrets"])
    whole = pipeline.run(spark, corpus).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces)


def test_stages_on_nothing(spark, corpus, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
