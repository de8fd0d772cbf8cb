"""How much of a batch is in Python at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm import byte_bpe


def test_a_batch_goes_to_python_in_parts(spark):
    texts = spark.range(0, 3000, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), F.when(F.col("id") == 7, 2 * S.PART_BYTES).otherwise(4000).cast("int"))).alias("text"))
    size = S.text_udf("n long, first string", lambda t: [{"n": sum(map(len, t)), "first": x[:6].rstrip("x")} for x in t])
    rows = texts.select("id", size("text").alias("r")).select("id", "r.*").collect()
    assert len(rows) == 3000 and all(r["first"] == str(r["id"]) for r in rows)
    assert max(r["n"] for r in rows if r["id"] != 7) <= S.PART_BYTES  # 12 MB in one call before
    assert next(r["n"] for r in rows if r["id"] == 7) == 2 * S.PART_BYTES + 1


def test_parts_keep_all_rows_in_order():
    texts, numbers = pa.array([None, "", "a" * 50, "b", None, "c" * 9]), pa.array(range(6))
    for most in (1, 20, 60, 1 << 20):
        found = [tuple(c.to_pylist() for c in part) for part in S.parts([texts, numbers], most)]
        assert [x for t, _ in found for x in t] == texts.to_pylist() and [x for _, n in found for x in n] == list(range(6))
    assert len(list(S.parts([texts, numbers], 1))) == 6 and [len(c[0]) for c in S.parts([texts[:0], numbers[:0]])] == [0]


def test_ids_of_empty_and_null_texts_and_of_an_empty_table(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert [len(r["ids"]) for r in byte_bpe.encode(rows).orderBy("doc_id").collect()] == [0, 0, 8]
    assert byte_bpe.encode(rows.limit(0)).collect() == []
