import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.bpe import encode, encoder, lengths, tokenizer_dir

PATH = f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \t", "hello world", "don't  stop  now\x1c\x85x", "日本語のテキスト。", "a" * 3000, "👩‍💻 x²⅓ Ⅷ", "<|endoftext|>", "x 　 y", " leading", "trailing  ", "tab\t\tx\r\n y", "ß" * 500]


def test_texts(reference):
    for t in TEXTS:
        assert encoder(PATH).encode(t) == reference.encode_ordinary(t), repr(t[:30])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert encoder(PATH).encode(text) == reference.encode_ordinary(text)


def test_round_trip_of_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode(docs).collect():
        t = texts[r.doc_id]
        assert (r.ids is None) == (t is None)
        if t is not None:
            assert list(r.ids) == reference.encode_ordinary(t)
    for r in lengths(docs).collect():
        assert r.n_tokens == len(reference.encode_ordinary(texts[r.doc_id] or ""))


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.ids) for r in encode(df).collect() if r.ids is not None) == [(2, []), (2, [220])]
    assert encode(df.limit(0)).count() == 0
