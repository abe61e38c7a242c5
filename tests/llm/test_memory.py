"""What Python workers hold while the pipeline's stages take turns in them."""

import corpus_pipeline
from foliant.llm import common, packing, toxicity


def test_a_worker_forgets_what_another_operator_left():
    path = packing.tokenizer_path()
    ids = packing.ids_of([b"some words here"], path)
    assert packing._words and packing._tokenizer
    common.claim("toxicity", lambda: None)
    assert not packing._words and not packing._tokenizer
    assert packing.ids_of([b"some words here"], path) == ids


def test_toxicity_tasks_drop_the_words_of_packing(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word", "en", "s", 9) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_documents(docs, labels)

    def held(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._words)] * b.num_rows, pa.int64())], names=["n"])

    def packed(batches):
        packing.ids_of([b"some words here"], packing.tokenizer_path())
        yield from batches

    few = spark.range(4).coalesce(1)
    few.mapInArrow(packed, "id long").count()
    assert scored.count() == 40
    kept = [r["n"] for r in scored.coalesce(1).select("doc_id").mapInArrow(held, "n long").collect()]
    assert set(kept) == {0}


def test_stages_send_long_texts_in_small_batches(spark):
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        rows = [(i, "word " * 20, "en", "s", 100) for i in range(2500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        corpus_pipeline.pack_sequences(spark, docs, "")
        assert [int(spark.conf.get(k)) for k in keys] == [common.BATCH_ROWS, common.BATCH_BYTES]

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        assert max(r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()) <= common.BATCH_ROWS
        spark.conf.set(keys[0], "100")
        common.small_batches(spark)
        assert spark.conf.get(keys[0]) == "100"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
