import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import queries
from corvane.llm.tokens import ChunkEncoder, cuts, encoder, token_ids

PATH = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the public vocabularies aren't here")
CASES = ["", " ", "a", "l'été", "  deux  blancs  \n\n fin ", "<|endoftext|> mot", "don't we'll they're", "  x", "漢字かな🏽‍🌾", "a" * 5000, " " * 5000, "it's 'quoted' " * 800, "\r\n".join("ligne %d, été" % i for i in range(2000))]


def test_exact_and_reused():
    e = encoder(PATH)
    texts = CASES + [c * 2 for c in CASES] + CASES
    m = ChunkEncoder(e.encode_ordinary)
    assert m.texts(texts) == [e.encode_ordinary(t) for t in texts]
    assert m.reused > 0
    small = ChunkEncoder(e.encode_ordinary, memo_chars=200)
    assert small.texts(texts) == [e.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab é'’s.,\n\t 12漢", "'ll", "  "]), max_size=1500).map("".join), max_size=5))
def test_any_text(texts):
    e = encoder(PATH)
    assert ChunkEncoder(e.encode_ordinary).texts(texts) == [e.encode_ordinary(t) for t in texts]


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 20_000).astype(np.uint32)
    a, b = cuts(body), cuts(np.r_[rng.integers(97, 123, 777).astype(np.uint32), body]) - 777
    assert set(a.tolist()) <= set(b.tolist()) and len(a) > 40


def test_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = [(i, c, "clash") for i, c in enumerate(CASES)] + [(99, None, "c"), (None, "x", "c"), (3, CASES[3], "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = token_ids(df, "doc_id", "text", PATH)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    want = [(i, t.encode(c, add_special_tokens=False).ids if c else []) for i, c, _ in rows]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert token_ids(df.limit(0), "doc_id", "text", PATH).count() == 0
