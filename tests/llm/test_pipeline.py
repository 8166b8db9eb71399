"""The pipeline against plain versions of its stages, each on what the stage before kept."""

from __future__ import annotations

import numpy as np
from test_llm_operators import naive_line_dedup, naive_links

import corpus_pipeline
from loomgraph.llm import quality_rules


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()))


def without_earlier_strings(texts):
    seen, out = {}, []
    for i, text in sorted(texts):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        out.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def test_stages(spark, docs):
    # Distinct ids and no very long text, so that the plain versions end soon.
    docs = docs.where("doc_id <> 48")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_join", "suffix_dedup", "best_fit_packing"]

    good = corpus_pipeline.stored(stages["quality_rules"](spark, docs, ""), "t")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert rows(good) == sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept) and len(kept) > 10

    lined = corpus_pipeline.stored(stages["line_dedup"](spark, good, ""), "t")
    assert rows(lined) == sorted(naive_line_dedup(rows(good)).items())

    single = corpus_pipeline.stored(stages["ngram_join"](spark, lined, ""), "t")
    classes = naive_links(rows(lined))
    assert rows(single) == [(i, t) for i, t in rows(lined) if classes[i][0] == i]

    cut = corpus_pipeline.stored(stages["suffix_dedup"](spark, single, ""), "t")
    assert rows(cut) == without_earlier_strings(rows(single))
    for df in (good, lined, single, cut):
        assert df.columns == docs.columns
        assert all(r["n_chars"] == len(r["text"] or "") for r in df.collect())

    packed = stages["best_fit_packing"](spark, cut, "")
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in rows(cut)}


def test_run_on_small_tables(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 100
    worst = found.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert worst <= 2048
