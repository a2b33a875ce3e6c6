"""BPE and token counts against the public tokenizers, prefix by prefix."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basin.llm import bpe, queries
from basin.llm import token_counts as tc
from tests.llm.helpers import empty, odd_documents, rows, with_extra_columns

PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'re", "'s", "'ll", "'", "''", "!", "1", "23", "É", "é", "日本", "<|endoftext|>",
         "<|ENDOFTEXT|>", "<|end", "ing", "\x1c", "\x85", "　", "Σ", "😀", "The", "word.", "x.,", "...", "é.,", "İ", "İ", "K",
         "߷", "՘", "aaaa", "\r\n", "    "]
random.seed(11)
TEXTS = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 30))) for _ in range(400)]


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_prefix_counts_are_exact_at_every_prefix():
    byte, counter = tokenizer("byte_bpe_50k.json"), tc.PrefixCounter(queries.vocabulary("byte_bpe_50k.json"))
    for text in TEXTS[:250]:
        want = [len(byte.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, repr(text)
        budget = len(text) // 3
        assert counter.count(text, budget) == (want[-1], max(i for i, n in enumerate(want) if n <= budget))


def test_token_counts_query_columns(spark):
    byte = tokenizer("byte_bpe_50k.json")
    docs = with_extra_columns(odd_documents(spark, TEXTS[:50]))
    got = tc.token_counts(docs, queries.vocabulary("byte_bpe_50k.json"), budget=512)
    want = [(r.doc_id, len((r.text or "").encode()), len(byte.encode(r.text or "", add_special_tokens=False).ids))
            for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert rows(tc.token_counts(empty(docs), queries.vocabulary("byte_bpe_50k.json"), 512)) == []
    arrays = {r.doc_id: r.prefix_counts for r in tc.prefix_counts(docs, queries.vocabulary("byte_bpe_50k.json")).collect()}
    assert arrays[2] == [0] and len(arrays[1]) == len("One two three four.") + 1


@pytest.mark.parametrize("table_words", [100_000, 20, 0])
def test_bpe_equals_the_library_whatever_the_table(spark, table_words):
    word = tokenizer("word_bpe_49k.json")
    spec = queries.vocabulary("word_bpe_49k.json")
    docs = with_extra_columns(odd_documents(spark, TEXTS))
    decoded = bpe.decode(bpe.encode(docs, spec, table_words=table_words), bpe.pieces(spark, spec))
    want = []
    for r in docs.collect():
        ids = word.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, word.decode(ids, skip_special_tokens=False)))
    assert rows(decoded) == sorted(want, key=repr)


def other_tokenizers():
    """A vocabulary that keeps case, and one that leaves stops and commas at their words."""
    cased, joined = (json.loads(queries.vocabulary("word_bpe_49k.json")) for _ in range(2))
    cased["normalizer"]["normalizers"] = [n for n in cased["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    joined["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    return json.dumps(cased), json.dumps(joined)


@pytest.mark.parametrize("table_words", [100_000, 3])
@pytest.mark.parametrize("spec", other_tokenizers(), ids=["cased", "joined"])
def test_bpe_of_other_tokenizers_whatever_the_table(spark, spec, table_words):
    assert bpe.parts_are_plain(queries.vocabulary("word_bpe_49k.json")) and not bpe.parts_are_plain(spec)
    texts = TEXTS[:60] + ["the The THE. The, the the, the. The.,", "The the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = Tokenizer.from_str(spec)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, spec, table_words=table_words).collect()}
    assert got == {i: word.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_bpe_empty_table_and_digests(spark):
    spec = queries.vocabulary("word_bpe_49k.json")
    docs = odd_documents(spark)
    assert rows(bpe.encode(empty(docs), spec)) == []
    digests = {r.doc_id: r for r in queries.bpe_digests(docs).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (digests[2].n_tokens, digests[2].ids_sha256, digests[2].decoded_sha256) == (0, nothing, nothing)
    unknown = bpe.decode(spark.createDataFrame([(1, [10**6, 267]), (2, None)], "doc_id long, ids array<int>"), bpe.pieces(spark, spec))
    assert {r.doc_id: r.decoded for r in unknown.collect()} == {1: tokenizer("word_bpe_49k.json").id_to_token(267), 2: ""}


def test_frequent_words_keep_whole_counts(spark):
    words = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "word string, n long")
    assert {r.word for r in bpe.frequent(words, 2).collect()} == {"a"}
    assert {r.word for r in bpe.frequent(words, 3).collect()} == {"a", "b", "c"}
    assert bpe.frequent(words, 0).count() == 0


def test_prefix_table_of_long_pieces():
    counter = tc.PrefixCounter(queries.vocabulary("byte_bpe_50k.json"))
    byte = tokenizer("byte_bpe_50k.json")
    text = "x" * 500 + " " + "=" * 300 + " 日本" * 50
    counts = counter.prefix_counts(text)
    for i in np.linspace(0, len(text), 40).astype(int):
        assert counts[i] == len(byte.encode(text[:i], add_special_tokens=False).ids)
