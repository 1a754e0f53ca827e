"""Tokenizer alignment against a plain walk over both token lists."""
import collections
import hashlib
import random

import numpy as np
import pytest

from lurescope.llm import alignment as M
from tests.llm.helpers import awkward, docs, prose


@pytest.fixture(scope="module")
def vocab():
    return M.Vocabularies(*[open(f"{M.TOKENIZERS}/{f}", "rb").read() for f in (M.A_FILE, M.B_FILE)])


def test_ranks_encode_as_the_merges_do(vocab):
    """Every code point, in several neighbourhoods, by both encoders of the same file."""
    from tokenizers import Tokenizer
    assert vocab.ranked is not None
    merges = Tokenizer.from_file(f"{M.TOKENIZERS}/{M.A_FILE}")
    merges.encode_special_tokens = True
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for low in range(0, len(points), 30_000):
        texts = [f"x{c}1{c}{c} {c}!{c}  {c} a" for c in points[low:low + 30_000]]
        for e, t in zip(merges.encode_batch_fast(texts, add_special_tokens=False), texts):
            assert e.ids == vocab.ranked.encode_ordinary(t), ascii(t)


def test_other_files_use_their_own_tokenizer():
    import json
    spec = json.loads(open(f"{M.TOKENIZERS}/{M.A_FILE}", "rb").read())
    spec["model"]["dropout"] = 0.1
    assert M.ranked_encoding(spec, {}) is None


def brute(vocab, rows):
    count, found = collections.Counter(), []
    for doc, text in rows:
        (a, b), = vocab.encode([text or ""])
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((vocab.a_bytes, a), (vocab.b_bytes, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for cut in cuts:
            k, l = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:l])))
            links.append((a[k - 1], b[l - 1]))
            i, j = k, l
        count.update(links)
        found.append((doc, len(a), len(b), groups, links))
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((doc, a, b, len(g), len(l), sum(count[x] == top[x[1]] for x in l), sum(count[x] for x in l),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for doc, a, b, g, l in found), key=str)


ROWS = [(r[0], r[1]) for r in awkward()] + [
    (50, "<|endoftext|> and <s> </s> <unk> <0x0A> stay text"), (51, "a▁b keeps no bytes"), (52, "  two  spaces \n\n\t tab"), (53, "naïve 漢字 🙂 \x00 ​"),
    (54, " lead"), (55, "\n"), (56, "don't we'll 12345 +++"), (57, "x" * 20000), (58, "漢" * 3000), (59, "é" * 7)]


@pytest.mark.parametrize("extra", [False, True])
def test_same_as_plain_walk(spark, vocab, extra):
    got = M.align(docs(spark, ROWS, extra).repartition(3))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(vocab, ROWS)


def test_blocks_and_pieces_do_not_show(spark, vocab, monkeypatch):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 90))) for i in range(60)]
    monkeypatch.setattr(M, "BLOCK_DOCS", 7)  # the driver's value; tasks use their own copy
    whole = M.Block(vocab, [t for _, t in rows])
    for piece in (1, 2, 3, 7, 64):
        cut = M.Block(vocab, [t for _, t in rows], piece)
        assert (cut.a_last == whole.a_last).all() and (cut.b_last == whole.b_last).all() and (cut.n_groups == whole.n_groups).all()
    assert sorted((tuple(r) for r in M.align(docs(spark, rows)).collect()), key=str) == brute(vocab, rows)


def test_overlaps_are_the_shared_bytes():
    rng = np.random.RandomState(4)
    for _ in range(60):
        n = rng.randint(1, 40)
        ends = [np.append(np.sort(rng.choice(np.arange(1, n), rng.randint(0, n), replace=False)) if n > 1 else [], n).astype(np.int64) for _ in "ab"]
        want = []
        for i, e in enumerate(ends[0]):
            for j, f in enumerate(ends[1]):
                low = max(ends[0][i - 1] if i else 0, ends[1][j - 1] if j else 0)
                if low < min(e, f):
                    want.append((i, j, low, min(e, f), e == f))
        for piece in (1, 2, 5, 1000):
            assert list(zip(*[c.tolist() for c in M.overlaps(*ends, piece)])) == want


def test_diagonals_cut_equal_work():
    rng = np.random.RandomState(5)
    a, b = np.cumsum(rng.randint(1, 5, 5000)), np.cumsum(rng.randint(1, 30, 700))
    d = np.arange(0, 5701, 100)
    i = M.crossings(a, b, d)
    merged = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
    assert i.tolist() == [sum(1 for m in merged[:k] if m[1] == 0) for k in d]


def test_groups_of_a_document(spark, vocab):
    rows = {r.doc_id: r.groups for r in M.token_groups(docs(spark, [(1, "naïve tokenizers"), (2, None), (3, "a▁b")])).collect()}
    whole = " naïve tokenizers".encode()
    assert rows[2] == [] and rows[3] == []
    assert [g["start"] for g in rows[1]] == [0] + [g["end"] for g in rows[1]][:-1] and rows[1][-1]["end"] == len(whole)
    for g in rows[1]:
        assert b"".join(vocab.a_bytes[i] for i in g["a"]) == whole[g["start"]:g["end"]] == b"".join(vocab.b_bytes[i] for i in g["b"])


def test_empty_table(spark):
    assert M.align(docs(spark, [])).collect() == []
