from collections import Counter

import corpus_pipeline as P


def test_stages_over_files(spark, sf_dir, documents, tmp_path):
    docs, counts = documents, []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(P.STAGES) - 1:
            assert out.columns == P.COLUMNS, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    n = documents.count()
    assert counts[0] >= 0.97 * n and counts[1] <= counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    assert docs.where("not lossless").count() == 0


def test_stages_on_odd_rows(spark, sf_dir, odd):
    docs = odd
    for name, stage in P.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == P.COLUMNS, name
    assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 3
    named = P.STAGES[0][1](spark, odd, sf_dir)
    assert named.columns == P.COLUMNS and {r.doc_id for r in named.collect()} <= {1, 2, 3, 8, 9, 10, None}
    pieces = P.STAGES[4][1](spark, odd, sf_dir).collect()
    assert len(pieces) == odd.count() and all(r.lossless for r in pieces) and {r.n_pieces for r in pieces if r.doc_id in (4, 5)} == {0}
    for _, stage in P.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
