"""Near-duplicate components against brute force over all pairs."""
import random
import re

import pytest

from lurescope.llm import minhash
from lurescope.llm.components import components
from tests.llm.helpers import awkward, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, percent=85):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def run(spark, rows, extra=False):
    got = minhash.near_duplicates(docs(spark, rows, extra))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    rows = awkward()
    assert run(spark, rows, extra) == brute(rows)


def family(rng, first, size, words, edits):
    base = prose(rng, words, 3000).split(" ")
    for i in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield first + i, " ".join(w)


def test_families_of_edited_copies(spark):
    rng = random.Random(7)
    rows = [r for f in range(12) for r in family(rng, 1000 * f, 25, 60 + 20 * f, 4 + f)]
    rows += [(50_000 + i, prose(rng, 90, 3000)) for i in range(60)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_large_family_without_a_common_original(spark):
    """Chains: every copy is edited further, so no leader is near all of them."""
    rng = random.Random(8)
    rows, w = [], prose(rng, 120, 3000).split(" ")
    for i in range(150):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def invoices(rng, size, values, fields=14):
    """Alike but below the threshold: one template whose fields have ``values`` values each."""
    base = prose(rng, 120, 3000).split(" ")
    for i in range(size):
        w = list(base)
        for f in range(fields):
            w[4 + 8 * f] = f"f{f}v{rng.randrange(values)}"
        yield i, " ".join(w)


def paired(spark, rows, percent):
    sets = [(i, len(s), [hash(x) % 2**61 for x in s]) for i, s in ((i, shingle_set(t)) for i, t in rows)]
    sets = spark.createDataFrame(sets, "rep long, n long, items array<long>")
    pairs = minhash.prefix_pairs(sets.selectExpr("rep", "rep as component", "true as apart"), sets, percent)
    return {tuple(r) for r in pairs.collect()}


def test_template_family(spark):
    rng = random.Random(9)
    rows = list(invoices(rng, 200, 12))
    rows += [(1000, rows[5][1] + " more"), (1001, rows[7][1] + " than before")]
    assert run(spark, rows) == brute(rows)
    assert {(5, 1000), (7, 1001)} <= paired(spark, rows, 85)


def test_template_family_costs_near_its_size(spark):
    """A value of a field is in about eight documents whatever the size: pairs per document stay alike."""
    small, large = (len(paired(spark, list(invoices(random.Random(12), size, size // 8)), 85)) / size for size in (160, 640))
    assert large < 1.3 * small < 30


def test_items_of_many_prefixes_are_split(spark, monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(minhash, "ITEM_ROWS", 3)
    rows = [r for f in range(4) for r in family(rng, 1000 * f, 30, 80, 12)] + [(9000 + i, t) for i, t in invoices(rng, 40, 12, 6)]
    assert run(spark, rows) == brute(rows)


def test_prefix_pairs_lose_no_link(spark):
    """Every pair over the threshold, from classes that are all apart."""
    rng = random.Random(11)
    rows = [r for f in range(5) for r in family(rng, 100 * f, 20, 50 + 10 * f, 9)]
    full = {i: shingle_set(t) for i, t in rows}
    for percent in (80, 85):
        want = {(i, j) for i in full for j in full if i < j and 100 * len(full[i] & full[j]) >= percent * len(full[i] | full[j])}
        assert want and want <= paired(spark, rows, percent)


def test_one_document_of_each_group_stays(spark):
    rows = awkward()
    kept = minhash.keep_documents(docs(spark, rows))
    got = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert got == sorted({i for i, _, c, k in brute(rows) if k and i is not None})
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.filter("doc_id is null").count() == 1


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "x long, y long")).collect()))
    assert set(got[i] for i in range(61)) == {0}
    assert set(got[i] for i in range(100, 130)) == {100}
