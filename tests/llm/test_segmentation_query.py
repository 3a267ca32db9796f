"""op7 returns the ids it samples, and they decode to the document's text."""

import zlib

import numpy as np

from lodestone.llm import queries as Q
from lodestone.llm import segmentations as SG


def test_query_returns_ids_that_give_the_text_back(spark, tmp_path):
    texts = {1: "the cat sat on the mat", 2: "  two  spaces\nand a line ", 3: "snow ☃ and \U0001f600 end", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.QUERIES["op7_sentencepiece_samples"](spark, str(tmp_path)).collect()
    words = SG.vocabulary(SG.default_path())
    assert {(r.doc_id, r.place) for r in rows} == {(d, p) for d in (1, 2, 3) for p in range(4)}
    for r in rows:
        assert len(r.ids) == r.n_pieces and SG.decode(words, np.array(r.ids, np.int32)) == texts[r.doc_id] and r.same_text
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
