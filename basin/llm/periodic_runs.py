"""Runs of repeated words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q that holds at least ``min_exponent``
periods and that no neighbouring word extends. For each power of two, every stretch of that many
words (a basic factor) gets a name, equal stretches of a text the same one: the name of a stretch is
the pair of the names of its halves, numbered by one sort. A factor's successor is the next start
of an equal factor. Inside a run of at least three periods the successors of a factor no shorter
than the period lie exactly one period on, so they form arithmetic progressions whose step is the
period; progressions that start at neighbouring words make a block, and the block's two ends are
where the run's extension stops. Of the successors within twice the factor's length only those within its length
are taken: the farther ones are the nearer ones of the next power. Each period belongs to one power;
a run found twice would be one row still.

Names are made for all texts of an Arrow batch together, as arrays; only factors that occur again in
the same text go on to the next power. No shuffle: a text is handled whole in the task that scans it.

Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed text; other texts
collapse to their kept words joined by one space; repeated rows give repeated results; a null id is
kept; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters laid out at once in a task; a longer text is laid out alone.
CHARS_PER_SLICE = 3_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def runs_of(names: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in a sequence, by start, then period.

    ``names`` numbers the words; words of different texts have different numbers, and a negative
    number between two texts equals nothing.
    """
    found, size = [np.zeros((0, 3), np.int64)], 1
    at = np.flatnonzero(names >= 0)
    key = names[at]
    while len(at):
        order = np.argsort(key, kind="stable")
        starts, key = at[order], key[order]
        same = key[1:] == key[:-1]
        found.append(_blocks(starts, same, size, min_length, min_exponent))
        again = np.zeros(len(starts), bool)
        again[1:] |= same
        again[:-1] |= same
        name = np.full(len(names), -1, np.int64)
        name[starts[again]] = np.cumsum(np.concatenate([[True], ~same]))[again]
        at = np.flatnonzero(name >= 0)
        at = at[:np.searchsorted(at, len(names) - size)]
        at = at[name[at + size] >= 0]
        key = name[at] * (len(starts) + 1) + name[at + size]
        size *= 2
    return np.unique(np.concatenate(found), axis=0)


def _blocks(starts, same, size, min_length, min_exponent):
    """Runs whose period is in (size / 2, size], from the successors of factors of ``size`` words."""
    step = starts[1:] - starts[:-1]
    near = same & (step <= size) & (2 * step > size)
    first, step = starts[:-1][near], step[near]
    if not len(first):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(first)
    first, step = first[order], step[order]
    cut = np.flatnonzero((np.diff(first, prepend=-2) != 1) | (np.diff(step, prepend=0) != 0))
    last = np.append(cut[1:], len(first)) - 1
    begin, period = first[cut], step[cut]
    length = first[last] - begin + size + period
    keep = length >= np.maximum(min_length, min_exponent * period)
    return np.stack([begin, length, period], 1)[keep]


def _slice(texts, min_length, min_exponent):
    """Runs of each text (rows, and how many each text has) and the collapsed texts."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    number = defaultdict(count().__next__)
    plain = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    names = np.full(len(plain) + len(words), -1, np.int64)
    names[np.arange(len(plain)) + doc] = doc * len(number) + plain  # one place after each text stays empty
    base = np.cumsum(sizes + 1) - sizes - 1
    runs = runs_of(names, min_length, min_exponent)
    owner = np.searchsorted(base, runs[:, 0], "right") - 1
    change = np.zeros(len(names) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change) > 0
    for d in np.unique(owner):
        gone = dropped[base[d]:base[d] + sizes[d]]
        words[d] = [w for w, out in zip(words[d], gone.tolist()) if not out]
    runs[:, 0] -= base[owner]
    collapsed = [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]
    return runs, np.bincount(owner, minlength=len(words)), collapsed


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) of every whole text.

    ``runs``: all runs of at least ``min_length`` words and ``min_exponent`` (3 or more) periods, as
    (start, length, period) in words, by start, then period. ``collapsed``: the text's words, without
    those that lie in any run after its first period, joined by one space. Words are what lies between
    blanks (space, tab to carriage return).
    """
    if min_exponent < 3:
        raise ValueError("runs are found from three periods on")

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, start = [], 0, at
                while at < batch.num_rows and size < CHARS_PER_SLICE:
                    texts.append(batch.column(1)[at].as_py())
                    size += len(texts[-1] or "") + 1
                    at += 1
                runs, n, collapsed = _slice(texts, min_length, min_exponent)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                fields = [pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)]
                found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, at - start), found, pa.array(collapsed, pa.string())],
                    [id_col, "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, runs {RUNS}, collapsed string")
