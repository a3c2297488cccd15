"""The corpus pipeline, stage by stage, against what each stage must do to its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import packing
from graphloom.llm.common import settle

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [x.lower() for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = kept.get("last", docs), settle(stage(spark, kept.get("last", docs), sf_dir), f"test-{name}")
        assert after.columns == docs.columns
        kept[name], kept["last"] = (before, after), after
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in kept["quality"][1].collect()}
    marked = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    assert sum((d in good) == bool(q) for d, q in marked) / len(marked) > 0.95
    rows = [(r["doc_id"], shingles(r["text"])) for r in kept["near_duplicates"][1].collect()]
    assert not [1 for i, (_, a) in enumerate(rows) for _, b in rows[:i] if a and 100 * len(a & b) >= 80 * len(a | b)]
    texts = dict(kept["repeated_spans"][0].select("doc_id", "text").collect())
    assert all(len(r["text"]) <= len(texts[r["doc_id"]]) for r in kept["repeated_spans"][1].collect())
    count = lambda df: df.agg(F.sum(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"))).first()[0]
    before, after = kept["source_mix"]
    assert abs(count(after) / count(before) - 1) < 0.02
    packed = corpus_pipeline.STAGES[-1][1](spark, kept["last"], sf_dir).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0) > 0
    assert len(packed) == packing.cut_pieces(kept["last"], 2048, 1, packing.default_path()).count()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)


def test_repeated_spans_take_passages(spark, sf_dir):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(1, f"Alpha opens {passage} then alpha closes."), (2, f"Beta begins {passage} while beta ends.")]
    stage = dict(corpus_pipeline.STAGES)["repeated_spans"]
    assert dict(stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf_dir).collect()) == {1: rows[0][1], 2: "Beta begins while beta ends."}
