"""BPE encoding and decoding through a distinct-word table.

Texts are cut into words at blanks (space, tab, line feed, carriage return), which no merge of a
white-space-dropping vocabulary crosses. Spark counts the distinct words of the corpus; each is
encoded once into the word table. Ids are joined back by position: a text's ids are its words' ids
in order. Decoding joins ids to the vocabulary's pieces.

The word table grows with the corpus, so only its most frequent rows, at most ``table_words``, are
sent to every task; the cut-off count comes from a histogram of counts, never from a sort of the
table. Other words are encoded in the task that meets them, once for each block of texts (a form with a
shuffled join for them moves every text's ids twice; see README). Results do not depend on the cut-off.

Edge cases: null and empty texts have no ids and decode to the empty string; special strings in a
text become their ids, as the tokenizer does by default; repeated rows give repeated results; ids
outside the vocabulary decode to nothing; other input columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basin.llm._common import stored, worker_cache

#: Words of the broadcast part of the word table: about 20 MB for each Python worker.
TABLE_WORDS = 100_000
BLANKS = " \t\n\r"
#: Output of one Arrow batch of a task.
CHARS_PER_SLICE = 1_000_000
IDS_PER_SLICE = 250_000


def distinct_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word with its number of occurrences. Counted map-side first."""
    words = docs.select(F.explode(F.split(text_col, f"[{BLANKS}]+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def frequent(words: DataFrame, at_most: int) -> DataFrame:
    """The rows with the largest counts, as many whole counts as fit ``at_most`` rows."""
    levels = words.groupBy("n").agg(F.count("*").alias("words"))
    by_count = levels.selectExpr("n", "sum(words) OVER (ORDER BY n DESC) AS so_far")  # a row for each count
    least = by_count.filter(F.col("so_far") <= at_most).agg(F.min("n")).first()[0]
    return words.filter(F.col("n") >= (2 ** 62 if least is None else least))


def word_table(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """(word, ids): each distinct word encoded once by the tokenizer."""
    spec = words.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        tokenizer = _tokenizer(spec)
        for batch in batches:
            ids = [_bytes(e.ids) for e in tokenizer.encode_batch_fast(batch.column(0).to_pylist(),
                                                                      add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids binary")


def _tokenizer(spec):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    cache = worker_cache("tokenizer")
    key = hash(spec.value)
    if key not in cache:
        tokenizer = Tokenizer.from_str(spec.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cache.clear()
        cache[key] = tokenizer
    return cache[key]


def _bytes(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Words(dict):
    """Word -> its ids as bytes. Words outside the shared table are encoded when first met."""

    def __init__(self, shared, tokenizer, plain):
        super().__init__(shared)
        self.shared, self.tokenizer, self.plain, self.limit = shared, tokenizer, plain, len(shared) + 100_000
        self[""] = b""

    def __missing__(self, word):
        if len(self) > self.limit:
            self.clear()
            self.update(self.shared)
            self[""] = b""
        got = self[word] = self.plain and self._known(word) or _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return got

    def _known(self, word):
        """Ids from those of the word without case, stops and commas, where ``parts_are_plain`` holds."""
        base = word.rstrip(".,")
        tail = word[len(base):]
        if not base.isascii() or not base[-1:].isalpha() or "<|" in base:
            return None
        head = self.get(base) or self.shared.get(base.lower()) if tail else self.shared.get(base.lower())
        if head is None:
            return None
        return head + self[tail] if tail else head


def parts_are_plain(tokenizer_json: str) -> bool:
    """True if the tokenizer is known to lower-case its text and to cut stops and commas off a letter before them, so
    that a word's ids follow from those of its parts. Read from the normalizer and the first pre-tokenizer."""
    conf = json.loads(tokenizer_json)
    normalizer, splitter = conf["normalizer"] or {}, conf["pre_tokenizer"] or {}
    normal = [n["type"] for n in normalizer.get("normalizers", [normalizer]) if n]
    first = (splitter.get("pretokenizers") or [splitter])[0]
    classes = first.get("pattern", {}).get("Regex", "").split("|") if first.get("type") == "Split" else []
    return ("Lowercase" in normal and {"[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"} <= set(classes)
            and all(t["content"].startswith("<|") for t in conf["added_tokens"]))


def _encoder(docs, tokenizer_json, id_col, text_col, table_words):
    """The task's step from (id, text) batches to (id, ids) batches, with the word table at hand."""
    sc = docs.sparkSession.sparkContext
    counts = stored(distinct_words(docs, text_col), "bpe-words")
    table = word_table(frequent(counts, table_words), tokenizer_json)
    shared = sc.broadcast({r.word: bytes(r.ids) for r in table.collect()})  # at most table_words rows
    spec = sc.broadcast(tokenizer_json)
    plain = parts_are_plain(tokenizer_json)

    def run(batches):
        words = None
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            words = words or _Words(shared.value, _tokenizer(spec), plain)
            while at < batch.num_rows:
                rows, size, start = [], 0, at
                while at < batch.num_rows and size < CHARS_PER_SLICE:
                    text = texts[at].as_py() or ""
                    size += len(text)
                    split = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                    rows.append(b"".join(map(words.__getitem__, split)))
                    at += 1
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(rows), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([keys.slice(start, at - start), ids], [id_col, "ids"])

    return run


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
           table_words: int = TABLE_WORDS) -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = _encoder(docs, tokenizer_json, id_col, text_col, table_words)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def pieces(spark, tokenizer_json: str) -> DataFrame:
    """(id, piece): the vocabulary with its added tokens."""
    conf = json.loads(tokenizer_json)
    rows = {i: s for s, i in conf["model"]["vocab"].items()} | {t["id"]: t["content"] for t in conf["added_tokens"]}
    return spark.createDataFrame(sorted(rows.items()), "id int, piece string")


def _decoder(vocabulary, id_col, ids_col, joiner):
    """The task's step from (id, ids) batches to (id, ids, decoded) batches. The vocabulary has a fixed size, so
    its table is sent to every task and the join needs no shuffle."""
    table = vocabulary.sparkSession.sparkContext.broadcast({r.id: r.piece for r in vocabulary.collect()})

    def run(batches):
        lookup = table.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # bounded output, however long the rows
                start, size, out = at, 0, []
                while at < batch.num_rows and size < IDS_PER_SLICE:
                    row = batch.column(1)[at].values
                    numbers = row.to_numpy(zero_copy_only=False).tolist() if row is not None else []
                    try:
                        out.append(joiner.join(map(lookup.__getitem__, numbers)))
                    except KeyError:
                        out.append(joiner.join(lookup[i] for i in numbers if i in lookup))
                    size += len(numbers) + 1
                    at += 1
                n = at - start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(out, pa.string())],
                    [id_col, ids_col, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
           joiner: str = " ") -> DataFrame:
    """(id, ids, decoded): each id joined to its piece, pieces joined by ``joiner`` (what a tokenizer
    without a decoder does)."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(
        _decoder(vocabulary, id_col, ids_col, joiner), f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string")


def encode_decode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
                  table_words: int = TABLE_WORDS) -> DataFrame:
    """``decode`` of ``encode`` in one pass: (id, ids, decoded), with one Python worker for each task."""
    encoder = _encoder(docs, tokenizer_json, id_col, text_col, table_words)
    decoder = _decoder(pieces(docs.sparkSession, tokenizer_json), id_col, "ids", " ")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        lambda batches: decoder(encoder(batches)), f"`{id_col}` {kind}, ids array<int>, decoded string")
