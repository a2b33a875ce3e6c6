"""Token alignment against the two public libraries and a plain search over byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from basin.llm import alignment, queries
from tests.llm.helpers import DOCS, empty, odd_documents, rows, with_extra_columns
from tests.llm.test_byte_bpe import ODD
from tests.llm.test_tokens import TEXTS

JSON = queries.vocabulary("byte_bpe_50k.json")
A = Tokenizer.from_str(JSON)
A.encode_special_tokens = True
with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()
B = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
STAND_IN = {c: b for c, b in zip(
    [*map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), *map(chr, range(256, 324))],
    [*range(33, 127), *range(161, 173), *range(174, 256), *range(33), *range(127, 161), 173])}


def spans(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(text):
    """ids of A, of B, links as token numbers, groups text."""
    if not text:
        return [], [], [], ""
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_bytes = [bytes(STAND_IN[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], ""
    sa, sb = spans(a_bytes), spans(b_bytes)
    links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]] if len(sa) < 2000 else None
    groups, cuts = [], sorted({e for _, e in sa} & {e for _, e in sb})
    for start, end in zip([0, *cuts], cuts):
        groups.append("|".join(",".join(str(t) for t, s in zip(ids, at) if start <= s[0] < end) for ids, at in ((a, sa), (b, sb)))
                      if len(sa) < 2000 else "")
    return a, b, links, ";".join(groups)


def test_a_is_the_library_on_words_and_every_character():
    ranks, rank_ids, _ = alignment.byte_level(JSON)
    import tiktoken
    mine = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinshrdlu'ABÉé.,19 "), size=12)) for _ in range(5000)]
    texts = ["".join(f"a{c} {c}1" for c in every[i:i + 200]) for i in range(0, len(every), 200)] + words + list(A.get_vocab())[:20_000]
    for text, want in zip(texts, A.encode_batch(texts, add_special_tokens=False)):
        assert [rank_ids[r] for r in mine.encode_ordinary(text)] == want.ids


def test_alignment_equals_brute_force(spark):
    docs = with_extra_columns(odd_documents(spark, TEXTS[:200] + ODD + ["a ▁ b", "▁", "<unk> <s>", " lead"])).repartition(2)
    for chars in (100, alignment.BLOCK_CHARS):
        got = alignment.align(docs, JSON, MODEL, public_tokenizers.PATTERN, block_chars=chars)
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in got.collect():
            a, b, links, groups = plain(texts[r.doc_id])
            assert (r.a, r.b) == (a, b)
            if links is not None:
                assert [tuple(x) for x in r.links] == links and r.groups == groups, texts[r.doc_id]


def statistics(rows):
    """What the query returns, from (doc_id, text) rows."""
    done = [(i, *plain(t)) for i, t in rows]
    count = Counter((a[x], b[y]) for _, a, b, links, _ in done for x, y in links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for i, a, b, links, groups in done:
        pairs = [(a[x], b[y]) for x, y in links]
        out.append((i, len(a), len(b), groups.count(";") + 1 if a else 0, len(links), sum(count[p] == most[p[1]] for p in pairs),
                    sum(count[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("files", [1, 5])
def test_query_equals_brute_force(spark, tmp, files):
    texts = TEXTS[:150] + ODD[:4] + [None, "", "a ▁ b", TEXTS[0], TEXTS[0]]
    docs = spark.createDataFrame([(i // 2, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    docs.repartition(files).write.parquet(f"{tmp}/documents.parquet")
    got = queries.QUERIES["op12_alignment"](spark, tmp)
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert rows(got) == sorted(statistics([(i // 2, t) for i, t in enumerate(texts)]), key=repr)


def test_odd_rows_and_empty_table(spark):
    run = lambda d, **k: alignment.link_statistics(d, JSON, MODEL, public_tokenizers.PATTERN, **k)
    docs = with_extra_columns(odd_documents(spark))
    assert rows(run(empty(docs))) == []
    got = {r.doc_id: r for r in run(docs, block_chars=30).collect()}
    assert tuple(got[2])[1:] == tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[5].n_a > 30_000 and got[None].n_links > 0 and got[6].count_sum == got[1].count_sum
    assert len(run(docs).collect()) == docs.count()


def test_links_are_not_shuffled(spark):
    found = alignment.link_statistics(odd_documents(spark, TEXTS), JSON, MODEL, public_tokenizers.PATTERN)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert "Bucketed: true" in plan
    assert not any("codes" in line for line in plan.splitlines() if "Exchange" in line)
