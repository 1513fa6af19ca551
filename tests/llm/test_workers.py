"""What workers hold between tasks, and how much crosses to them at a time."""

import corpus_pipeline
import pyarrow as pa

from folioscope.llm import tokens, workers


def test_other_work_starts_without_the_tokens_memory():
    tokens._encoders["some file"] = object()
    list(workers.tidy(lambda batches: batches, "tokens")(iter([])))
    assert "some file" in tokens._encoders
    list(workers.tidy(lambda batches: batches)(iter([])))
    assert not tokens._encoders


def test_long_texts_cross_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    texts = spark.range(3000).selectExpr("id doc_id", "repeat('the words of a text ', 400) text", "'en' lang").coalesce(1)
    try:
        assert corpus_pipeline.identify_language(spark, texts, "").count() == 3000

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

        found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 4 and max(found) < 5_000_000
    finally:
        spark.conf.set(setting, before)
