"""The pipeline, stage by stage, against what each stage should keep."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from songloom.llm.queries import WEIGHTS, table
from songloom.llm.mixing import taken_words
from songloom.llm.toxicity import toxicity
from test_near import brute_texts


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        out = stage(spark, docs, small)
        if name != "bin_slack_packing":
            assert out.columns == table(spark, small, "documents").columns
        out.write.parquet(path)
        kept[name] = (docs.collect(), spark.read.parquet(path).collect())
        docs = spark.read.parquet(path)
    ids = lambda rows: sorted(r.doc_id for r in rows)

    before, after = kept["toxicity"]
    bad = {r.doc_id for r in toxicity(table(spark, small, "documents"), table(spark, small, "labels")).collect() if r.predicted}
    assert ids(after) == ids(r for r in before if r.doc_id not in bad)

    before, after = kept["exact_dedup"]
    largest = defaultdict(int)
    for r in before:
        largest[lowered(r.text)] = max(largest[lowered(r.text)], r.doc_id)
    assert ids(after) == sorted(largest.values())

    before, after = kept["ngram_jaccard_join"]
    assert ids(after) == [d for d, _, _, k in brute_texts([(r.doc_id, r.text) for r in before]) if k]

    before, after = kept["cube_mixing"]
    want = Counter()
    for r in taken_words(spark.createDataFrame(before), WEIGHTS).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in after) == +want

    before, after = kept["bin_slack_packing"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    assert max(Counter({s: sum(r.length for r in after if r.sequence_id == s) for s in {r.sequence_id for r in after}}).values()) <= 2048
    assert set(corpus_pipeline.run(spark, small).columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
