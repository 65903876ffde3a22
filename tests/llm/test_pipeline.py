"""The pipeline against its stages applied one by one to plain Python sets."""

import corpus_pipeline
from recordloom.llm import decontaminate, near_dup, quality, toxicity
from recordloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_filter_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    left = {r[0] for r in docs.select("doc_id").collect()}
    verdicts = {
        "quality": lambda d: {r[0] for r in quality.score(d, labels).filter("predicted = 1").collect()},
        "toxicity": lambda d: {r[0] for r in toxicity.score(d, labels).filter("predicted = 0").collect()},
        "near_duplicates": lambda d: {r[0] for r in near_dup.near_duplicates(d, 5, 80).filter("kept").collect()},
        "decontamination": lambda d: {r[0] for r in d.select("doc_id").collect()}
        - {r[0] for r in decontaminate.contained_items(d, items).collect()},
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == left
            break
        want = verdicts[name](docs)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} == want and len(rows) == len(want) and want <= left
        left = want
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns; then no rows at all."""
    ids = lambda d: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in d.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF)
        if name == "packing":
            assert set(ids(out)) == set(ids(odd_docs))
        else:
            assert out.columns == odd_docs.columns
            left = ids(out)
            if name == "near_duplicates":
                assert len(left) == len(set(left)) and {-1, 1, 2, 3, 4, 5} <= set(left) and not {6, 15} & set(left)
            elif name == "decontamination":
                assert left == ids(odd_docs)
            else:  # equal texts and repeated rows share their fate
                assert left.count(15) in (0, 2) and (1 in left) == (15 in left) and (5 in left) == (6 in left) and (2 in left) == (3 in left)
        assert stage(spark, no_docs, SF).count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
