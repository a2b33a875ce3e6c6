"""Runs against a brute-force search over every start and period."""

import hashlib
import random
import re
import zlib

import pytest

from basin.llm import queries
from basin.llm.periodic_runs import periodic_runs
from tests.llm.helpers import DOCS, empty, odd_documents, with_extra_columns

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def plain_runs(words, min_length=6, min_exponent=4):
    n, found = len(words), set()
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exponent * q):
                part = words[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 80):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 7))[:rng.randint(1, 50)]
        out.append(rng.choice([" ", "  ", "\n", " \x0b"]).join(words))
    return out


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 3), (10, 5)])
def test_runs_equal_brute_force(spark, least, exponent):
    texts = random_texts(least, 300) + ["a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "\x1c \x1c \x1c " * 4, "é\xa0é " * 6]
    docs = with_extra_columns(odd_documents(spark, texts))
    got = periodic_runs(docs, least, exponent).collect()
    assert len(got) == docs.count()
    want = {}
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        runs = plain_runs(words, least, exponent) if len(words) < 1000 else None
        want[r.doc_id] = words, runs
    for r in got:
        words, runs = want[r.doc_id]
        if runs is None:
            assert [tuple(x) for x in r.runs] == [(0, 30_000, 1)] and r.collapsed == "word end"
        else:
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == plain_collapse(words, runs)


def test_long_periods_and_an_all_equal_text(spark):
    rng = random.Random(3)
    unit = [str(rng.randrange(50)) for _ in range(1000)]
    texts = [" ".join(["x", *unit * 4, "y"]), " ".join((unit * 5)[:-1]), " ".join((unit * 4)[:-1]), "z " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(docs).collect()}
    assert got == {0: [(1, 4000, 1000)], 1: [(0, 4999, 1000)], 2: [], 3: [(0, 100_000, 1)]}


def test_too_small_an_exponent_is_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs(odd_documents(spark), min_exponent=2)


def test_empty_table(spark):
    assert periodic_runs(empty(odd_documents(spark))).count() == 0


def plain_query(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, top = plain_runs(words), None
    for s, size, q in runs:
        if top is None or size * top[2] > top[1] * q:
            top = (s, size, q)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(plain_collapse(words, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp):
    texts = random_texts(8, 400) + [None, "", "one"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, tmp)
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(tuple(r) for r in got.collect()) == [plain_query(i, t) for i, t in enumerate(texts)]
    assert sum(1 for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10 == 0) > 20


def test_query_takes_odd_rows(spark, tmp):
    docs = odd_documents(spark)
    docs.write.parquet(f"{tmp}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, tmp).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(got[2])[1:] == (0, None, None, None, None, nothing, nothing)
    assert (got[5].n_runs, got[None].n_runs) == (1, 0)
