"""Every sampled segmentation decodes to its text."""

import zlib

from lodestone.llm import segmentations as SG


def test_samples_give_their_texts_back(spark):
    texts = {1: "the cat sat on the mat", 2: "  two  spaces\nand a line ", 3: "snow \u2603 and \U0001f600 end", 4: "", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = SG.sampled(docs, with_ids=False).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and len(rows) > 6
    for r in rows:
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
