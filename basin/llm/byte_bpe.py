"""Byte-level BPE encoding and decoding through one shuffle of distinct words.

Texts are cut into pre-tokens by the tokenizer's split pattern; no merge crosses them. A task numbers
the distinct pre-tokens of a block of its texts and writes down each text's numbers in order, that
is, its pre-tokens by position. The blocks' distinct words are exploded and shuffled by word, so
equal words of all blocks lie next to each other and each is encoded once; its ids go back to every
(block, number) that asked, and a block's texts are put together by position. Decoding looks each id
up in the array of token bytes in Spark's own expressions, so no second Python worker stands beside
the one that puts texts together.

Blocks are written in buckets of their number, so only words and their ids are shuffled, never
positions or texts. A word comes once from each block, however frequent it is, so no word is hot;
what a task holds is bounded by the block, but for a text that is larger than a block.

Edge cases: null and empty texts have no ids and decode to no bytes; special strings are ordinary
text; repeated rows give repeated results; a null id is kept; ids outside the vocabulary, and null
ids, decode to nothing; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.llm._common import pack, stored_by, unpack, worker_cache

#: A block is closed after this many characters or distinct words (about 100 bytes each in the task).
BLOCK_CHARS = 32_000_000
BLOCK_WORDS = 600_000
#: Encoded words of a task that are sorted by block at once, and positions packed or put together at once.
PACK_ROWS = 200_000
WORDS_PER_SLICE = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def explicit(pattern: str) -> str:
    """The split pattern with the characters of its classes written out as the encoding library has them, which
    may follow another Unicode version than Python does."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}

    def members(name):
        found = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        codes = np.frombuffer(bytes(found).decode("utf-8").encode("utf-32-le"), "<u4")
        cut = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[cut].tolist(), codes[np.append(cut[1:], len(codes)) - 1].tolist()))

    classes = {name: members(name) for name in set(re.findall(r"\\p\{\w+\}|\\s", pattern.replace(r"\S", r"\s")))}

    def write_out(m):
        if m.group().startswith("["):
            return re.sub(r"\\p\{\w+\}|\\s", lambda c: classes[c.group()], m.group())
        return f"[^{classes[chr(92) + 's']}]" if m.group() == r"\S" else f"[{classes[m.group()]}]"

    return re.sub(r"\[[^\]]*\]|\\p\{\w+\}|\\[sS]", write_out, pattern)


def word_blocks(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, ids, sizes, codes, words), a row for each block of texts: the texts' ids and numbers of
    pre-tokens, the number of each pre-token in order (packed in slices), and the distinct words by number."""
    split = explicit(pattern)

    def run(batches):
        from pyspark import TaskContext
        find, task = re.compile(split).findall, TaskContext.get().partitionId()
        open_block = lambda: (defaultdict(), [], [], [], [])
        number, keys, sizes, codes, waiting = open_block()
        number.default_factory = number.__len__
        chars, pending, n = 0, 0, 0
        for batch in batches:
            start = 0
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py() or ""
                words = find(text)
                waiting.append(np.fromiter(map(number.__getitem__, words), "<u4", len(words)))
                sizes.append(len(words))
                chars, pending = chars + len(text) + 1, pending + len(words)
                if pending >= WORDS_PER_SLICE:
                    codes.append(np.concatenate(waiting))
                    waiting, pending = [], 0
                full = chars >= block_chars or len(number) >= BLOCK_WORDS
                if full or at + 1 == batch.num_rows:  # a copy: a slice would hold the batch's texts
                    keys.append(batch.column(0).take(pa.array(np.arange(start, at + 1))))
                    start = at + 1
                if full:
                    yield _block(task << 32 | n, number, keys, sizes, codes, waiting)
                    number, keys, sizes, codes, waiting = open_block()
                    number.default_factory = number.__len__
                    chars, pending, n = 0, 0, n + 1
        if keys:
            yield _block(task << 32 | n, number, keys, sizes, codes, waiting)

    def _block(block, number, keys, sizes, codes, waiting):
        codes.append(np.concatenate([np.zeros(0, "<u4"), *waiting]))
        counts = sum(np.bincount(part, minlength=len(number)) for part in codes)
        by_count = np.argsort(-counts, kind="stable")  # small numbers for common words
        rank = np.empty(len(number), np.uint32)
        rank[by_count] = np.arange(len(number), dtype=np.uint32)
        words = pa.array(list(number), pa.string()).take(pa.array(by_count))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), one(pa.concat_arrays(keys)), one(pa.array(sizes, pa.int32())),
             one(pa.array([pack(rank[part]) for part in codes], pa.binary())), one(words)],
            ["block", "ids", "sizes", "codes", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"block bigint, ids array<{kind}>, sizes array<int>, codes array<binary>, words array<string>")


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, numbers, sizes, ids), packed, of (word, block, number): each distinct word is encoded once.

    Words are shuffled and sorted, so equal ones are neighbours in one task.
    """
    shared = words.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary of fixed size

    def run(batches):
        encode, last, got, waiting, rows = _encoder(shared), None, b"", [], 0
        for batch in batches:
            ids = []
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, got = word, np.array(encode(word), "<u4").tobytes()
                ids.append(got)
            waiting.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), ids))
            rows += len(ids)
            if rows >= PACK_ROWS:
                yield _packed(waiting)
                waiting, rows = [], 0
        if waiting:
            yield _packed(waiting)

    def _packed(waiting):
        blocks, numbers = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
        ids = [i for w in waiting for i in w[2]]
        order = np.argsort(blocks, kind="stable")
        cut = np.flatnonzero(np.diff(blocks[order], prepend=-1))
        out = []
        for part in np.split(order, cut[1:]):
            mine = [ids[i] for i in part.tolist()]
            out.append((int(blocks[part[0]]), pack(numbers[part]), pack([len(i) // 4 for i in mine]),
                        pack(np.frombuffer(b"".join(mine), "<u4"))))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                          ["block", "numbers", "sizes", "ids"])

    near = words.select("word", "block", "number").repartition("word").sortWithinPartitions("word")
    return near.mapInArrow(run, "block bigint, numbers binary, sizes binary, ids binary")


def _encoder(shared):
    """Encodes one pre-token, whatever its characters."""
    cache = worker_cache("byte-bpe")
    key = hash(frozenset(shared.value.items()))
    if key not in cache:
        cache.clear()
        cache[key] = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
    return cache[key].encode_ordinary


def _gather(values, starts, sizes):
    """values[start:start + size] of every pair, end to end."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _binaries(packed):
    """The elements of a list of binaries, one at a time."""
    return (v.as_py() for v in packed.values)


def _text_slices(codes, sizes):
    """(first text, end, its codes): ``codes`` comes in any slices; texts come whole, as many as a slice holds."""
    ends, held, first, at = np.cumsum(sizes, dtype=np.int64), np.zeros(0, "<u4"), 0, 0
    waiting, n = [], 0
    for part in codes:
        waiting.append(part)
        n += len(part)
        if n < WORDS_PER_SLICE:
            continue
        last = int(np.searchsorted(ends, at + n, "right"))
        if last > first:
            held, used = np.concatenate(waiting), int(ends[last - 1]) - at
            yield first, last, held[:used]
            waiting, n, first, at = [held[used:].copy()], n - used, last, at + used
    if first < len(sizes):
        yield first, len(sizes), np.concatenate([held[:0], *waiting])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids array<int>) of every whole text, without special tokens."""
    field = docs.schema[id_col]
    blocks = stored_by(word_blocks(docs, pattern, id_col, text_col, block_chars), "block", "byte_bpe")
    words = blocks.select("block", F.posexplode("words").alias("number", "word"))
    coded = encode_words(words, ranks)

    def put_together(texts: pa.Table, parts: pa.Table) -> pa.Table:
        unpacked = [[unpack(v.as_py()) for v in parts[c]] for c in ("numbers", "sizes", "ids")]
        numbers, sizes, ids = (np.concatenate([np.zeros(0, "<u4"), *u]) for u in unpacked)
        size = np.zeros(len(numbers), np.int64)
        start = np.zeros(len(numbers), np.int64)
        size[numbers], start[numbers] = sizes, np.cumsum(sizes, dtype=np.int64) - sizes
        ids = ids.astype(np.int32)
        del unpacked, numbers, sizes
        out = []
        for row in range(texts.num_rows):
            keys, per_text = texts["ids"][row].values, texts["sizes"][row].values.to_numpy()
            for a, b, codes in _text_slices(map(unpack, _binaries(texts["codes"][row])), per_text):
                found = size[codes]
                so_far = np.concatenate([[0], np.cumsum(found)])
                ends = so_far[np.concatenate([[0], np.cumsum(per_text[a:b], dtype=np.int64)])]
                flat = [_gather(ids, start[codes[i:i + WORDS_PER_SLICE]], found[i:i + WORDS_PER_SLICE])
                        for i in range(0, len(codes), WORDS_PER_SLICE)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
                out.append(pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], [id_col, "ids"]))
        return pa.Table.from_batches(out)

    sides = coded.groupBy("block"), blocks.select("block", "ids", "sizes", "codes").groupBy("block")
    return sides[1].cogroup(sides[0]).applyInArrow(put_together, f"`{id_col}` {field.dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes of each id, joined. The vocabulary has a fixed size, so its table goes
    to every task as one constant array by id and the lookup needs no shuffle and no Python."""
    by_id = [""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        by_id[i] = token.hex()
    table = F.split(F.lit(",".join(by_id)), ",")  # a constant: Spark splits it once
    found = F.array_join(F.transform(F.col(f"`{ids_col}`"), lambda i: F.get(table, i)), "")
    return encoded.select(f"`{id_col}`", f"`{ids_col}`", F.unhex(F.coalesce(found, F.lit(""))).alias("decoded"))
