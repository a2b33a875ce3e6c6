"""Byte-level BPE against the public library."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from basin.llm import byte_bpe, queries
from basin.llm._common import pack, unpack
from tests.llm.helpers import DOCS, empty, odd_documents, rows, with_extra_columns
from tests.llm.test_tokens import TEXTS

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
#: Characters newer than the encoding library's tables, other blanks, digits, marks, a long word.
ODD = ["a\u088fb c\u1c8a1 \u0558x", "\x1c\x1d \x1e", "\u2003\u2028x\u3000 ", "x²³ ½ ٣٤", "e\u0301\u0301 'S's 'LL", "ab" * 3000,
       "\U00016d40\U0001e5d0 \U0001ccf0", "\ufeffz\x00y"]


def test_pattern_cuts_as_the_library_does():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    find = re.compile(byte_bpe.explicit(public_tokenizers.PATTERN)).findall
    for text in ODD + TEXTS + ["".join(f"a{c} {c}1" for c in every[i:i + 40]) for i in range(0, len(every), 40)]:
        words = find(text)
        assert "".join(words) == text
        assert [i for w in words for i in LIBRARY._encode_single_piece(w)] == LIBRARY.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("block_chars", [50, 1000, byte_bpe.BLOCK_CHARS])
def test_ids_and_round_trip(spark, block_chars):
    docs = with_extra_columns(odd_documents(spark, TEXTS + ODD)).repartition(3)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_chars=block_chars), RANKS)
    want = [(r.doc_id, LIBRARY.encode_ordinary(r.text or ""), bytearray((r.text or "").encode())) for r in docs.collect()]
    assert rows(decoded) == sorted(want, key=repr)


def test_each_distinct_word_is_encoded_in_one_place(spark):
    docs = odd_documents(spark, ["the cat the dog", "the cow"] * 50).repartition(4)
    blocks = byte_bpe.word_blocks(docs, public_tokenizers.PATTERN, block_chars=100)
    words = blocks.selectExpr("block", "posexplode(words) as (number, word)")
    assert blocks.count() > 10 and blocks.filter("size(words) <> size(array_distinct(words))").isEmpty()
    plan = byte_bpe.encode_words(words, RANKS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(word") == 1 and plan.count("Exchange") == 2  # the other is the test's own


def test_only_words_and_their_ids_are_shuffled(spark):
    encoded = byte_bpe.encode(odd_documents(spark, TEXTS), RANKS, public_tokenizers.PATTERN)
    encoded.collect()
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan


def test_decoding_starts_no_python_worker(spark):
    """Another worker beside the one that puts texts together took an executor over its memory."""
    encoded = spark.createDataFrame([(1, [267, 0, 50255]), (2, []), (3, [-1])], "`my id` long, `the ids` array<int>")
    decoded = byte_bpe.decode(encoded, RANKS, "my id", "the ids")
    assert not re.search("Python|Arrow|Pandas", decoded._jdf.queryExecution().executedPlan().toString())
    assert [bytes(r.decoded) for r in decoded.sort("my id").collect()] == [LIBRARY.decode_bytes([267, 0, 50255]), b"", b""]
    odd = byte_bpe.decode(spark.createDataFrame([([0, 1, 2, 3], 1)], "ids array<int>, doc_id long"), {b"\xff,": 1, b"\x00": 3})
    assert bytes(odd.first().decoded) == b"\xff,\x00" and byte_bpe.decode(encoded.toDF("doc_id", "ids"), {}).count() == 3


@pytest.mark.parametrize("sizes", [[0, 3, 0, 25, 1, 1, 0], [10], [0, 0], [4, 4, 4, 0, 4], []])
@pytest.mark.parametrize("slice_size", [1, 7, 10, 100])
def test_texts_are_put_together_in_slices(monkeypatch, sizes, slice_size):
    monkeypatch.setattr(byte_bpe, "WORDS_PER_SLICE", 10)
    codes = np.arange(sum(sizes), dtype="<u4")
    found = list(byte_bpe._text_slices((codes[i:i + slice_size] for i in range(0, len(codes) + 1, slice_size)), np.array(sizes, np.int32)))
    assert [t for a, b, _ in found for t in range(a, b)] == list(range(len(sizes)))
    assert [len(c) for *_, c in found] == [sum(sizes[a:b]) for a, b, _ in found]
    assert np.concatenate([codes[:0], *(c for *_, c in found)]).tolist() == codes.tolist()


def test_positions_are_packed_in_slices(spark):
    n = byte_bpe.WORDS_PER_SLICE
    docs = spark.createDataFrame([(1, "a " * n), (2, "b"), (3, " c" * (n // 2)), (4, "a a")], "doc_id long, text string").coalesce(1)
    block = byte_bpe.word_blocks(docs, public_tokenizers.PATTERN).first()
    assert len(block.codes) == 2 and len(unpack(bytes(block.codes[0]))) >= n
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {r.doc_id: LIBRARY.encode_ordinary(r.text) for r in docs.collect()}


def test_empty_table_other_ids_and_packing(spark):
    docs = odd_documents(spark)
    assert rows(byte_bpe.encode(empty(docs), RANKS, public_tokenizers.PATTERN)) == []
    named = docs.selectExpr("cast(doc_id AS string) AS `my.id`", "text AS `the text`").filter("`the text` IS NOT NULL")
    renamed = byte_bpe.encode(named.toDF("id", "t"), RANKS, public_tokenizers.PATTERN, "id", "t")
    assert renamed.schema["id"].dataType.simpleString() == "string" and renamed.count() == named.count()
    unknown = spark.createDataFrame([(1, [10**6, 267, None]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(unknown, RANKS).collect()} == {1: LIBRARY.decode_bytes([267]), 2: b""}
    for numbers in ([], [0], [1, 2**32 - 1, 70_000]):
        assert unpack(pack(numbers)).tolist() == numbers


def test_query(spark, tmp):
    texts = TEXTS[:100] + ODD + [None, ""]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp}/documents.parquet")
    got = queries.QUERIES["op13_byte_bpe"](spark, tmp)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert rows(got) == sorted(want, key=repr)
