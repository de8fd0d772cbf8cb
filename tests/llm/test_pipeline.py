"""The pipeline's stages one after another on a small table with planted cases."""

import random

import numpy as np

import corpus_pipeline
from leakloom.llm import byte_bpe

WORDS = "the of and to in river stone light garden window summer bread paper silver road music winter letter market morning".split()


def _text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) * (r.random() < 0.3) for _ in range(n))


def test_stages(spark, tmp_path):
    rows = [(k, _text(k), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(100, _text(1), "en", "s0", 1), (101, _text(2) + " extra", "en", "s1", 1), (102, "short", "en", "s1", 1), (103, " ".join(w + "###" for w in _text(3).split()), "en", "s2", 1), (104, _text(104) + " joe.b@x.example.com", "en", "s2", 1), (105, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at.write.parquet(f"{tmp_path}/{len(seen)}")
        at = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = [r["doc_id"] for r in at.collect()]
    assert not {102, 103, 105} & set(seen["quality rules"]) and set(range(60)) <= set(seen["quality rules"])
    assert not {100, 101} & set(seen["near-duplicates"]) and set(range(60)) <= set(seen["near-duplicates"])
    assert sorted(seen["personal data"]) == sorted(seen["near-duplicates"])
    assert at.filter("text like '%joe.b@%'").count() == 0
    assert max(map(seen["mixing"].count, set(seen["mixing"]))) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(seen["mixing"])
    codec = byte_bpe.codec()
    texts = {r["doc_id"]: r["text"] for r in at.collect()}
    assert all(bytes(r["ids"]) == codec.encode([texts[r["doc_id"]]])[0].tobytes() and r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4")) for r in out)
