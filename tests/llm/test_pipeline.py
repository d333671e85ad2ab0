"""The pipeline's stages against brute force over a small corpus, and on odd tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near import classes_by_hand
from tests.llm.test_text_operators import contaminated, frame, odd

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "mixture"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, before, SF).write.parquet(out)
        after = spark.read.parquet(out)
        if name == "near_duplicates":
            rows = before.select("doc_id", "text").collect()
            label = classes_by_hand([r["text"] for r in rows])
            first = {}
            for r, c in zip(rows, label):
                first[c] = min(first.get(c, 1 << 60), r["doc_id"])
            assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(first.values())
        if name == "decontamination":
            rows = before.select("doc_id", "text").collect()
            hit = contaminated([r["text"] for r in rows], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
            assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(r["doc_id"] for i, r in enumerate(rows) if not hit[i][1])
        if name == "pii":
            assert after.count() == before.count() and after.filter(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.")).count() == 0
            assert after.filter(F.char_length("text") != F.col("n_chars")).count() == 0
        if k < 4:
            assert after.columns == columns
            before = after
        else:
            assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() > 0


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    for tag, start in (("odd", odd(spark)), ("none", frame(spark, ["x"]).limit(0))):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{tag}-{name}")
            stage(spark, docs, SF).write.parquet(out)
            docs = spark.read.parquet(out)


def test_run_leaves_no_scratch(spark):
    from terraspark.llm.common import made

    mark = made()
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made(mark)]
    # the documents of the last stage, and what it is read from
    assert left[0] == "pii" and set(left[1:]) <= {"sizes", "sources", "taken"}
