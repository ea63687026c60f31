"""The stages one by one against brute-force versions, and whole."""

from collections import defaultdict

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_packing import check_whole
from tests.llm.test_simhash import brute_near
from waymesh.llm.common import read
from waymesh.llm.packing import CAPACITIES


def test_stages(spark, sf_dir, tmp_path):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        stages[name](spark, df, sf_dir).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    have = texts(docs)
    one = step("language identification", docs)
    assert one.columns == columns
    kept = texts(one)
    assert all(not any(c.isalpha() for c in have[i]) or len(have[i]) < 200 for i in set(have) - set(kept))

    two = step("exact deduplication", one)
    want = {i for i, keep, _, _ in exact(sorted(kept.items())) if i == keep}
    kept = texts(two)
    assert set(kept) == want and two.columns == columns

    three = step("near deduplication", two)
    label = brute_near(kept)
    kept = texts(three)
    assert set(kept) == {i for i in label if label[i] == i} and three.columns == columns

    four = step("benchmark decontamination", three)
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    grams = lambda t: set(t.lower().split())
    near = {i: [x for x in items if len(grams(x[1]) & grams(t)) > 8 or len(x[1].split()) < 14] for i, t in kept.items()}
    clean = {i for i, t in kept.items() if not contamination(t, near[i])[4]}
    kept = texts(four)
    assert set(kept) == clean and four.columns == columns

    rows = stages["best-fit packing"](spark, four, sf_dir).collect()
    check_whole(rows, {i: len(t.encode()) + 1 for i, t in kept.items()}, CAPACITIES)

    whole = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        whole[r.doc_id].append((r.start, r.length))
    assert {i: sorted(x) for i, x in whole.items()} == {r.doc_id: sorted((q.start, q.length) for q in rows if q.doc_id == r.doc_id) for r in rows}
