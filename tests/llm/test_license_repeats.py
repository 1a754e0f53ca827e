"""Rows that repeat are scanned like single ones."""
from tests.llm.test_licenses import NOTICES, brute, run


def test_repeated_notices(spark):
    texts = ["Creative Commons Attribution 4.0", " and ".join(NOTICES), "MIT License, then the MIT License"]
    rows = [(i, t) for i, t in enumerate(texts)]
    repeated = rows + rows[:2] + [rows[2]] * 3 + [(None, texts[0])] * 2 + [(0, texts[2])]
    got = run(spark, repeated)
    assert got == brute(repeated)
    assert next(r[6] for r in got if r[:2] == (0, 5)) == "cc-by-4.0"
