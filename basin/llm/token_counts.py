"""Token counts by prefix dynamic programming (byte-level BPE).

For a pre-token of n bytes one pass over its end positions finds, for every prefix, the last token
of that prefix's encoding: it is the only vocabulary entry t ending there whose pair with the last
token of the shorter prefix survives the merges. The count is then the shorter prefix's count plus
one. Concatenated over the pre-tokens of a text this gives the exact token count of *every* prefix
of the text, so truncation ("longest prefix within 512 tokens") and budget questions are lookups.

No shuffle: every text is handled in the task that scans it. Prefix tables of pre-tokens are kept
in a bounded cache per Python worker.

Edge cases: null and empty texts have 0 tokens and the table [0]; a very long pre-token costs its
length times the longest vocabulary entry; repeated rows give repeated results; other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from basin.llm._common import worker_cache

#: Letters, digits and blanks below U+0250, in the public split pattern of the
#: byte-level vocabulary. Texts with any other character are split by the tokenizer itself.
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
DIGITS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
BLANKS = "\\t-\\r \\x85\\xa0"
SPLIT = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+"
         f"|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
CACHE_ENTRIES = 400_000
#: Characters of the longest pre-token kept in the cache (four bytes each: its counts fit a byte).
SHORT = 63
CHARS_PER_SLICE = 2_000_000


class PrefixCounter:
    """Prefix tables over one byte-level BPE vocabulary (the text of its tokenizer .json)."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        chars = _byte_chars()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in conf["model"]["merges"]]
        vocab = conf["model"]["vocab"]
        self.step, self.token, nodes = {}, [None], 1  # byte trie: (node, byte) -> node; the token that ends there
        for s, t in vocab.items():
            at = 0
            for c in s:
                key = at << 8 | chars[c]
                at = self.step.setdefault(key, nodes)
                if at == nodes:
                    nodes += 1
                    self.token.append(None)
            self.token[at] = t
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        made = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in reversed(list(enumerate(merges)))}
        # edge tokens from the last (first) byte up to t, each with the rank of the merge that absorbs it
        self.right = {t: _spine(t, made, 1) for t in vocab.values()}
        self.left = {t: _spine(t, made, 0) for t in vocab.values()}
        special = sorted((t["content"] for t in conf["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = re.compile(SPLIT)
        self.plain = re.compile("[\\0-\\u024f]*")
        self.blanks = regex.compile(r"\s\s+")
        self.library_split = Tokenizer.from_str(spec).pre_tokenizer
        self.survives: dict = defaultdict(dict)  # token -> next token -> whether the pair stays as it is
        self.tables = _Tables(self)

    def _pair(self, a, b):
        """True if the merges leave token ``a`` followed by token ``b`` as they are."""
        xs, ys, i, j, never = self.right[a], self.left[b], 0, 0, float("inf")
        while True:
            (x, ex), (y, ey) = xs[i], ys[j]
            m = self.rank.get((x, y), never)
            if m < ex and m <= ey:
                return False
            if ex == never and ey == never:
                return True
            if ex <= ey:
                i += 1
            else:
                j += 1

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one pre-token, one per character."""
        raw = piece.encode("utf-8", "surrogatepass")
        n, step, token, survives = len(raw), self.step, self.token, self.survives
        last, count = [None] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, at, end = last[start], 0, start
            known = survives[before]
            while end < n:
                at = step.get(at << 8 | raw[end])
                if at is None:
                    break
                end += 1
                t = token[at]
                if t is None or last[end] is not None:
                    continue
                if start:
                    ok = known.get(t)
                    if ok is None:
                        ok = known[t] = self._pair(before, t)
                    if not ok:
                        continue
                last[end], count[end] = t, count[start] + 1
        if n == len(piece):
            return count[1:]
        return [count[k] for k in range(1, n) if raw[k] & 0xC0 != 0x80] + [count[n]]

    def pieces(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.library_split.pre_tokenize_str(text)]

    def _rows(self, pieces):
        """The pieces' tables end to end, each piece's length and total count."""
        if len(self.tables) > CACHE_ENTRIES:
            self.tables.clear()
        if len(self.tables) == 0:
            self.survives.clear()
        if max(map(len, pieces)) <= SHORT:
            rows = list(map(self.tables.__getitem__, pieces))
            flat = np.frombuffer(b"".join(rows), np.uint8)
        else:
            rows = [self.piece_counts(p) if len(p) > SHORT else self.tables[p] for p in pieces]
            flat = np.concatenate([np.array(r, np.int64) if type(r) is list else np.frombuffer(r, np.uint8) for r in rows])
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        return flat, lens, flat[np.cumsum(lens) - 1].astype(np.int64)

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts of text[:1], ..., text, for a text without special strings."""
        if not text:
            return np.zeros(0, np.int32)
        pieces = self.pieces(text)
        flat, lens, totals = self._rows(pieces)
        counts = (flat + np.repeat(np.cumsum(totals) - totals, lens)).astype(np.int32)
        before = lambda k: int(counts[k - 1]) if k else 0
        for m in self.blanks.finditer(text):  # cut inside a run of blanks, the run is one piece up to the cut
            a, b = m.span()
            counts[a:b] = before(a) + np.array(self.piece_counts(m.group()), np.int32)
        if "'" in text:
            starts, base = np.cumsum(lens) - lens, np.cumsum(totals) - totals
            for k in (k for k, p in enumerate(pieces) if p in ("'re", "'ve", "'ll")):
                a = int(starts[k])  # cut after two characters: a quote and a letter
                counts[a + 1] = base[k] + self.piece_counts("'")[-1] + self.piece_counts(pieces[k][1])[-1]
        return counts

    def _segments(self, text: str):
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at:m.start()], m.group()
            at = m.end()
        yield text[at:], ""

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., text."""
        parts, base = [np.zeros(1, np.int32)], 0
        for ordinary, special in self._segments(text):
            counts = self._ordinary(ordinary + special[:-1])  # cut inside a special string, it is ordinary text
            parts.append(base + counts)
            if special:
                base += (int(counts[len(ordinary) - 1]) if ordinary else 0) + 1
                parts.append(np.array([base], np.int32))
        return np.concatenate(parts)

    def count(self, text: str, budget: int) -> tuple[int, int]:
        """The text's token count, and the length of its longest prefix of at most ``budget`` tokens, both read off the
        table of every prefix."""
        counts = self.prefix_counts(text)
        within = len(counts) - 1 if counts.max() <= budget else int(np.flatnonzero(counts <= budget)[-1])
        return int(counts[-1]), within


class _Tables(dict):
    """Prefix tables of short pre-tokens as bytes, made when first asked for."""

    def __init__(self, counter):
        self.counter = counter

    def __missing__(self, piece):
        got = self[piece] = bytes(self.counter.piece_counts(piece))
        return got


def _spine(t, made, side):
    out, absorbed = [], float("inf")
    while True:
        out.append((t, absorbed))
        if t not in made:
            return out[::-1]
        a, b, absorbed = made[t]
        t = b if side else a


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def _counter(spec) -> PrefixCounter:
    cache = worker_cache("prefix-counter")
    key = hash(spec.value)
    if key not in cache:
        cache.clear()
        cache[key] = PrefixCounter(spec.value)
    return cache[key]


def _by_text(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, schema: str, row):
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, a few MB

    def run(batches):
        counter = _counter(spec)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:  # bounded output per Arrow batch, however long the texts
                rows, size, start = [], 0, at
                while at < batch.num_rows and size < CHARS_PER_SLICE:
                    text = texts[at].as_py() or ""
                    size += len(text) + 1
                    rows.append(row(counter, text))
                    at += 1
                cols = [ids.slice(start, at - start), *(pa.array(c) for c in zip(*rows))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)

    out = _arrow_schema(docs.select(id_col).schema.fields[0].dataType, id_col, schema)
    return docs.select(id_col, text_col).mapInArrow(run, _spark_schema(docs, id_col, schema))


def _spark_schema(docs, id_col, schema):
    return f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {schema}"


def _arrow_schema(id_type, id_col, schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string
    return to_arrow_schema(StructType([StructField(id_col, id_type), *_parse_datatype_string(schema).fields]))


def prefix_counts(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_counts): element k is the exact token count of the text's first k characters."""
    return _by_text(docs, tokenizer_json, id_col, text_col, "prefix_counts array<int>",
                    lambda counter, text: (counter.prefix_counts(text),))


def token_counts(docs: DataFrame, tokenizer_json: str, budget: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, within_budget_chars) of every text, read off its prefix table.

    ``within_budget_chars`` is the length in characters of the longest prefix of at most ``budget``
    tokens.
    """
    def row(counter, text):
        n, cut = counter.count(text, budget)
        return len(text.encode("utf-8", "surrogatepass")), n, cut

    return _by_text(docs, tokenizer_json, id_col, text_col,
                    "n_bytes bigint, n_tokens bigint, within_budget_chars bigint", row)
