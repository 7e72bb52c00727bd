"""The characters that ids stand for, against the library's own offsets."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gablework.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aab  \n\t'st.é中🧿"), st.characters(codec="utf-8")), max_size=60))
def test_spans_equal_the_librarys(text):
    own = bpe.codec(RANKS)
    (ids,) = own.encode([text])
    ((tokens, offsets),) = own.encode_with_offsets([text])
    assert np.frombuffer(ids, "<u4").tolist() == tokens
    assert [tuple(x) for x in own.spans(text, ids).tolist()] == offsets


def test_encoded_with_offsets(spark):
    docs = spark.createDataFrame([(1, "ab é 🧿"), (2, None), (None, "")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in bpe.encoded(docs, RANKS, offsets=True).collect()}
    assert rows[2].spans == rows[None].spans == [] and rows[1].spans[0].start == 0 and rows[1].spans[-1].end == 6
    assert len(rows[1].spans) == rows[1].n_tokens
    assert bpe.encoded(docs.limit(0), RANKS, offsets=True).count() == 0
