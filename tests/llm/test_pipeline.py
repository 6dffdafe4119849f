"""The pipeline's stages, one by one, against brute force on what the stage before kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordshield.llm import quality_classifier, queries

from .test_operators import ODD, brute_components, brute_hits, brute_repeats, check_packing

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def raw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(k, t, None, None, None) for k, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.union(odd.withColumn("doc_id", F.col("doc_id") + 100_000)).withColumns({"_t0": F.lit("x"), "row": F.lit(1), "spans": F.lit(2), "kept_text": F.lit(3)})


def test_stages(spark, raw, tmp_path):
    docs = raw
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, SF)
        if name == "quality_classifier":
            scores = quality_classifier.score(docs, queries.quality_model(spark, docs, SF))
            want = Counter(r["id"] for r in scores.where("score >= 0.7").collect())
            assert Counter(k for k, _ in rows_of(out)) == want and sum(want.values()) < len(before)
        elif name == "near_dedup":
            kept = {k for (k, _, _, keep) in brute_components(before, width=5) if keep}
            # equal rows become one; a null text and an empty one are equal
            want = Counter(k for k, _ in {(k, t or "") for k, t in before} if k in kept and k is not None)
            assert Counter(k for k, _ in rows_of(out)) == want + Counter([None])  # of the rows without an id, one copies another
        elif name == "suffix_dedup":
            want = Counter((k, b.decode(errors="ignore")) for (k, _, _, b), n in brute_repeats(before).items() for _ in range(n))
            assert Counter((k, t or "") for k, t in rows_of(out)) == want
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
            want = Counter(x[0] for x, n in brute_hits(before, items).items() for _ in range(n) if not x[4])
            assert Counter(k for k, _ in rows_of(out)) == want
        else:
            bins, bound = check_packing(docs, out)
            assert bound <= bins <= bound * 1.02 + 1
            break
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)


def test_run_on_the_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_empty_table(spark, raw):
    docs = raw.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
