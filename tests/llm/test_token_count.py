import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.queries import QUERIES
from quire.llm.token_count import token_counts

NAME = "word_bpe_49k.json"


def plain(text):
    return len(Tokenizer.from_file(public_tokenizers.path(NAME)).encode(text or "", add_special_tokens=False).ids)


def test_query_against_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op7_token_count"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted(
        (i, len((t or "").encode()), plain(t), plain(t) > 2048) for i, t in docs.items()
    )


@pytest.mark.parametrize(("stride", "overlap"), [(40, 30), (64, 8), (500, 100)])
def test_chunks_give_the_same(spark, stride, overlap):
    texts = [
        "plain words and some more of them, don't we'll it's " * 30,
        "x" * 3000,
        "é ́a é   12345 \U0001f600\U0001f600 " * 60,
        "<|endoftext|> a <|startoftext|>b<|endoftext|>" * 40,
        " \n\t" * 500,
        "ab" * 100 + " " * 400 + "cd " * 100,
        "",
        None,
    ]
    docs = spark.createDataFrame([(1, t, 5) for t in texts] * 2, "n_tokens long, text string, _row long")
    got = token_counts(docs, stride=stride, overlap=overlap).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r._doc.n_tokens == 1 and r._doc._row == 5
        assert (r.n_bytes, r.n_tokens) == (len((r._doc.text or "").encode()), plain(r._doc.text))


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
