"""The finding on the pipeline's memory: texts of a batch become Python's a few at a time."""

from pyspark.sql import functions as F

from gridloom.llm import quality


def test_accepted_takes_texts_in_parts(spark):
    class Watched(quality.ByteConvNet):
        def scores(self, batch):
            assert len(batch) <= 256
            return quality.ByteConvNet.scores(self, batch)

    text = F.when(F.col("id") % 7 > 0, F.concat(F.lit("word "), F.col("id") * 37, F.lit(" é"))).when(F.col("id") % 2 == 0, "")
    docs = spark.range(3000).repartition(2).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = docs.collect()
    want = {r["doc_id"] for r, s in zip(rows, quality.ByteConvNet().scores([r["text"] or "" for r in rows])) if s >= 0.5}
    assert {r["doc_id"] for r in quality.accepted(docs, Watched()).collect()} == want and 0 < len(want) < 3000
    assert quality.accepted(docs, 0.5).count() == 3000 and quality.accepted(docs.limit(0), Watched()).count() == 0
