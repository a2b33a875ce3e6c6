"""Alignment of the tokens of two tokenizers by lockstep merging.

A byte-level BPE (A) and a SentencePiece model (B) cut the same bytes, a space and the text. Two
tokens are linked if their byte ranges overlap; where tokens of both end at the same byte, the tokens
so far since the last such place are a group. All texts of a slice are merged in lockstep: one NumPy
vector holds the next A token of every text, one the next B token. Each step links the current pairs,
cuts where both end, advances whichever token ends first (both at a cut) and drops finished texts.

``link_statistics`` judges links by how often the corpus links their two ids. Each slice of texts is a
block: it writes its texts' results, its distinct id pairs and, for each text, which of them its links are.
Pairs are counted over all blocks, joined back to the blocks that hold them and added up per text. Blocks lie
in buckets of their number, so neither texts nor links are shuffled, only distinct pairs of blocks.

Edge cases: texts that are null or empty, and those whose tokens' bytes do not join to the space and the
text (a text that holds U+2581 itself), have no tokens, links or groups; special strings are ordinary
text; repeated rows give repeated results and count each time; a null id is kept; other columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.llm._common import pack, stored_by, unpack, worker_cache

#: Characters merged at once (about 60 bytes each in the task); a longer text is merged alone.
BLOCK_CHARS = 3_000_000


def byte_level(tokenizer_json: str) -> tuple[dict[bytes, int], list[int], dict[int, bytes]]:
    """(rank of each token's bytes, id of each rank, bytes of each id) of a byte-level BPE vocabulary."""
    model = json.loads(tokenizer_json)["model"]
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves
    rest = [b for b in range(256) if b not in set(keep)]
    byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    tokens = [*byte, *(a + b for a, b in merges)]
    raw = [bytes(byte[c] for c in t) for t in tokens]
    ids = [model["vocab"][t] for t in tokens]
    return {r: k for k, r in enumerate(raw)}, ids, dict(zip(ids, raw))


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, in a worker."""

    def __init__(self, ranks, rank_ids, a_bytes, pattern, model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.rank_ids = np.array(rank_ids, np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in range(size)]
        self.a_size = np.zeros(max(rank_ids) + 1, np.int64)
        self.a_size[list(a_bytes)] = [len(v) for v in a_bytes.values()]
        self.b_size = np.array([len(v) for v in self.b_bytes], np.int64)
        top = max(len(self.a_size), size)
        self.named = [f"{i}{mark}".encode() for mark in ",|;" for i in range(top)]
        self.top = top

    def tokens(self, texts):
        """Ids of A and B for each text; empty for both where the bytes differ."""
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            raw = b" " + (text or "").encode("utf-8")
            if not text or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            a = self.rank_ids[self.a.encode_to_numpy(" " + text, disallowed_special=())]
            out.append((a, np.array(b, np.int64)) if self.a_size[a].sum() == len(raw)
                       else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return out


def lockstep(a_ends, b_ends, a_next, b_next, a_last):
    """Links and cuts of many texts at once.

    ``a_ends``, ``b_ends``: last byte of every token within its text, all texts end to end; ``a_next``, ``b_next``:
    the first token of each text, ``a_last``: its last A token. Returns the linked A and B tokens in the
    order of the steps, and for every token whether a group ends with it.
    """
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    links_a, links_b = [a_next[:0]], [b_next[:0]]
    while len(a_next):
        links_a.append(a_next)
        links_b.append(b_next)
        a_end, b_end = a_ends[a_next], b_ends[b_next]
        both = a_end == b_end
        a_cut[a_next[both]] = True
        b_cut[b_next[both]] = True
        a_next, b_next = a_next + (a_end <= b_end), b_next + (b_end <= a_end)
        open_ = a_next <= a_last
        if not open_.all():
            a_next, b_next, a_last = a_next[open_], b_next[open_], a_last[open_]
    return np.concatenate(links_a), np.concatenate(links_b), a_cut, b_cut


class Slice:
    """The alignment of some texts: tokens, links (as token numbers of the slice) and cuts."""

    def __init__(self, both: Tokenizers, texts):
        self.both = both
        pairs = both.tokens(texts)
        self.n_a, self.n_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
        self.a_base, self.b_base = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        some = self.n_a > 0
        ends = (self._ends(both.a_size[self.a], self.n_a), self._ends(both.b_size[self.b], self.n_b))
        self.link_a, self.link_b, self.a_cut, self.b_cut = lockstep(
            *ends, self.a_base[some], self.b_base[some], (self.a_base + self.n_a - 1)[some])
        text = np.repeat(np.arange(len(pairs)), self.n_a)[self.link_a]
        small = np.uint16 if len(pairs) < 2 ** 16 else np.int64
        order = np.argsort(text.astype(small), kind="stable")  # steps of a text stay in order
        self.link_a, self.link_b = self.link_a[order], self.link_b[order]
        self.n_links = np.bincount(text, minlength=len(pairs))
        self.n_groups = np.bincount(np.repeat(np.arange(len(pairs)), self.n_a)[self.a_cut], minlength=len(pairs))

    @staticmethod
    def _ends(sizes, n):
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], ends])[np.cumsum(n) - n]
        return ends - np.repeat(before, n)

    def groups(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        a_group, b_group = (np.cumsum(c) - c for c in (self.a_cut, self.b_cut))
        total = int(self.a_cut.sum())
        a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=total)) for g in (a_group, b_group))
        named = np.empty(len(self.a) + len(self.b), np.int64)
        b_before = np.concatenate([[0], b_upto])
        named[np.arange(len(self.a)) + b_before[a_group]] = self.a + self.a_cut * self.both.top
        named[np.arange(len(self.b)) + a_upto[b_group]] = self.b + self.b_cut * 2 * self.both.top
        out, ends = [], np.cumsum(self.n_a + self.n_b).tolist()
        for start, end in zip([0, *ends], ends):
            out.append(b"".join(map(self.both.named.__getitem__, named[start:end].tolist()))[:-1])
        return out


def _tokenizers(shared) -> Tokenizers:
    cache = worker_cache("alignment")
    key = hash((shared.value[3], shared.value[4], len(shared.value[0])))
    if key not in cache:
        cache.clear()
        cache[key] = Tokenizers(*shared.value)
    return cache[key]


def _slices(batches, chars):
    """(ids, texts) of consecutive rows, closed after ``chars`` characters."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            text = batch.column(1)[at].as_py()
            keys.append(batch.column(0).slice(at, 1))
            texts.append(text)
            size += len(text or "") + 1
            if size >= chars:
                yield pa.concat_arrays(keys), texts
                keys, texts, size = [], [], 0
    if keys:
        yield pa.concat_arrays(keys), texts


def _shared(spark, a_json, b_model, pattern):
    return spark.sparkContext.broadcast((*byte_level(a_json), pattern, b_model))  # two vocabularies of fixed size


def align(docs: DataFrame, a_json: str, b_model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, a, b, links, groups) of every whole text: ids of both tokenizers, the linked pairs of token numbers (from
    0, in order) and the groups as text."""
    shared = _shared(docs.sparkSession, a_json, b_model, pattern)

    def lists(values, sizes):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    def run(batches):
        for keys, texts in _slices(batches, block_chars):
            s = Slice(_tokenizers(shared), texts)
            ends = [pa.array((link - np.repeat(base, s.n_links)).astype(np.int32))
                    for link, base in ((s.link_a, s.a_base), (s.link_b, s.b_base))]
            yield pa.RecordBatch.from_arrays(
                [keys, lists(pa.array(s.a.astype(np.int32)), s.n_a), lists(pa.array(s.b.astype(np.int32)), s.n_b),
                 lists(pa.StructArray.from_arrays(ends, ["a", "b"]), s.n_links),
                 pa.array([g.decode() for g in s.groups()], pa.string())], [id_col, "a", "b", "links", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, a array<int>, b array<int>, links array<struct<a:int,b:int>>, groups string")


def _blocks(docs, a_json, b_model, pattern, summary, id_col, text_col, block_chars):
    """A row for each slice: results of its texts, its distinct id pairs with counts, and each link's pair (packed)."""
    shared = _shared(docs.sparkSession, a_json, b_model, pattern)

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for n, (keys, texts) in enumerate(_slices(batches, block_chars)):
            s = Slice(_tokenizers(shared), texts)
            code, pairs = pd.factorize(s.a[s.link_a] << 32 | s.b[s.link_b])
            count = np.bincount(code, minlength=len(pairs))
            by_count = np.argsort(-count, kind="stable")  # small numbers for common pairs
            rank = np.empty(len(pairs), np.uint32)
            rank[by_count] = np.arange(len(pairs), dtype=np.uint32)
            numbers = [one(pa.array(v.astype(np.int32))) for v in (s.n_a, s.n_b, s.n_groups, s.n_links)]
            groups = pa.array([summary(g) if m else "" for g, m in zip(s.groups(), s.n_a.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | n], pa.int64()), one(keys), *numbers, one(groups),
                 pa.array([pack(rank[code])], pa.binary()), one(pa.array(pairs[by_count])), one(pa.array(count[by_count]))],
                ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "pairs", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"block bigint, ids array<{kind}>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, "
             "groups array<string>, codes binary, pairs array<bigint>, counts array<bigint>")


def link_statistics(docs: DataFrame, a_json: str, b_model: bytes, pattern: str,
                    summary: Callable[[bytes], str] = bytes.decode, id_col: str = "doc_id", text_col: str = "text",
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every whole text.

    An id pair's count is the number of links over all texts that hold it. ``n_best``: links whose pair has
    the highest count of all pairs of its B id, ties included; ``count_sum``: counts of the links added up.
    ``groups``: what ``summary`` makes, in the task, of the groups' text (the text itself by default), empty
    where there are no tokens.
    """
    blocks = stored_by(_blocks(docs, a_json, b_model, pattern, summary, id_col, text_col, block_chars), "block", "alignment")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("number", "held")).select(
        F.col("block").alias("holder"), "number", F.col("held.pairs").alias("pair"), F.col("held.counts").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.expr("pair & 4294967295"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    judged = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    judged = held.select("holder", "number", "pair").join(judged, "pair").select("holder", "number", "n", "best")

    def add_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        number = pairs["number"].to_numpy()
        n, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        n[number], best[number] = pairs["n"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
        out = []
        for row in range(texts.num_rows):
            code = unpack(texts["codes"][row].as_py())
            ends = np.concatenate([[0], np.cumsum(texts["n_links"][row].values.to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(v[code])])[ends] for v in (best, n)]
            plain = [texts[c][row].values.cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            out.append(pa.table([texts["ids"][row].values, *plain, *(pa.array(np.diff(v)) for v in sums),
                                 texts["groups"][row].values],
                                [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
        return pa.concat_tables(out)

    kind = docs.schema[id_col].dataType.simpleString()
    texts = blocks.select("block", "ids", "n_a", "n_b", "n_groups", "n_links", "groups", "codes")
    return texts.groupBy("block").cogroup(judged.groupBy("holder")).applyInArrow(
        add_up, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                "count_sum bigint, groups string")
