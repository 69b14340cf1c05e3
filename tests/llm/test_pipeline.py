import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_neardup import brute as near
from tests.llm.test_repeats import brute as repeated


def test_every_stage_takes_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[list(seen)[-1]], sf_dir).write.parquet(str(tmp_path / name))
        seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert seen[name].columns == columns
    rows = {n: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for n, df in seen.items() if n != "sentencepiece"}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in rows["quality"] for d in good) > 0.95 * len(good)
    assert len(rows["quality"]) < len(rows["documents"])
    groups = near(sorted(rows["quality"].items()), k=5)
    assert set(rows["near-dedup"]) == {d for d, g in groups.items() if g[2]}
    left = repeated(sorted(rows["near-dedup"].items()))
    for d, (size, removed, *_) in left.items():
        text = rows["repeats"].get(d)
        assert text is None if size and removed == size else (removed > 0) == (text != rows["near-dedup"][d])
    mixed = [r.doc_id for r in seen["mixing"].select("doc_id").collect()]
    assert set(mixed) <= set(rows["repeats"]) and max(map(mixed.count, mixed)) <= 2 < len(set(mixed))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in seen["sentencepiece"].collect():
        assert r.ids == library.encode(rows["mixing"][r.doc_id]) and r.decoded == library.decode(r.ids)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_near_dedup_joins_the_ids_that_go(spark, documents):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    docs = documents((1, text), (2, text + " end"), (3, other), (7, other), (7, "of its own, and the id is kept"), (None, text), (None, None), (9, None))
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert "LeftAnti" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(False, 1, text), (False, 3, other), (False, 7, other), (False, 7, "of its own, and the id is kept"), (True, 0, text), (True, 0, ""), (False, 9, "")]
    )
