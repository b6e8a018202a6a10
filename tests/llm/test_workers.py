"""What Python workers hold between tasks."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from lodestone.llm import packing
from lodestone.llm.common import map_arrow
from lodestone.llm.tokens import WordEncoder

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_a_later_stage_frees_the_encoders(spark):
    docs = spark.range(8, numPartitions=8).selectExpr("id AS doc_id", "concat('some text ', id) AS text")

    def held(batches):
        from lodestone.llm import tokens

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), tokens.encoder.cache_info().currsize))], names=["n"])

    want = packing.pieces(docs, WORD, 1).orderBy("doc_id").collect()
    assert [r["n"] for r in map_arrow(docs, held, "n long").collect()] == [0] * 8
    assert packing.pieces(docs, WORD, 1, cached=2).orderBy("doc_id").collect() == want


def test_a_small_cache_gives_the_same_ids():
    texts = [f"word{i % 7} Some{chr(97 + i % 26)}thing, else{chr(98 + i % 25)}." for i in range(60)]
    small, usual = WordEncoder(WORD, True, limit=5), WordEncoder(WORD, True)
    for text in texts:
        assert small.encode(text) == usual.encode(text)
        assert len(small.cache) + len(small.cache.older) <= 2 * (5 + 12)
