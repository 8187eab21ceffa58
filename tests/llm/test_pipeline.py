"""The pipeline against the same decisions made by brute force."""

import pathlib

import corpus_pipeline
from tests.llm.test_small_formats import pieces, plain_ids
from tests.llm.test_text_operators import brute_components, brute_hits, brute_spans


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_dir(spark, f"t-{name}")
        stage(spark, kept, sf).write.parquet(path)
        kept = spark.read.parquet(path)
        seen[name] = kept
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lettered = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted(r["doc_id"] for r in seen["language_id"].collect()) == sorted(i for i, _ in lettered)
    first = {i for i, _, c in brute_components(lettered) if i == c}
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == first and len(first) < len(lettered)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_hits([x for x in lettered if x[0] in first], items) if not r[-1]}
    assert {r["doc_id"] for r in seen["decontamination"].collect()} == clean
    hidden = {r["doc_id"]: r["text"] for r in seen["secret_scan"].collect()}
    texts = dict(lettered)
    assert set(hidden) == clean
    for i, t in hidden.items():
        if not brute_spans(texts[i]):
            assert t == texts[i] or "[SECRET]" in t
        else:
            assert "[SECRET]" in t and not brute_spans(t)
    got = sorted((r["doc_id"], r["piece"], r["length"]) for r in seen["best_fit_packing"].collect())
    want = sorted((i, k, b - a) for i, t in hidden.items() for k, (a, b) in enumerate(pieces(len(plain_ids(t)) + 1, 1024)))
    assert got == want


def test_run(spark, sf):
    """All rows come, and of what the run has written only they stay."""
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there = {p.name for p in shared.iterdir()}
    assert corpus_pipeline.run(spark, sf).count() > 100
    assert [n.partition("-")[2].rpartition("-")[0] for n in {p.name for p in shared.iterdir()} - there] == ["best_fit_packing"]


def test_run_on_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows, and columns with the names that the operators use inside."""
    prose = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(12).collect()
    rows = [(i, r["text"], "en") for i, r in enumerate(prose)] + [(0, prose[0]["text"], None), (0, prose[0]["text"], None), (None, None, None), (50, "", "en"), (51, "12 !?", None), (52, "a long text " * 30_000, None), (None, "only here, without an id", None)]
    names = ("row", "key", "digest", "base", "comp", "node", "_id", "lang_pred", "piece")
    d = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_dir(spark, f"odd-{name}")
        stage(spark, d, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name == "best_fit_packing":
            assert after.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
            break
        assert after.columns == d.columns and after.where(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0
        ids = sorted((r["doc_id"] for r in after.select("doc_id").collect()), key=str)
        if name == "language_id":
            assert 51 not in ids and 50 not in ids and ids.count(0) == 3 and ids.count(None) == 1
            assert after.where("lang is null").count() == 0
        if name == "near_duplicates":
            assert ids.count(0) == 1 and 52 in ids and ids.count(None) == 1
        d = after
