"""Plain Python versions of the operators, for small tables."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = set("#*$%&|<>")


def nulls_last(x):
    return (x is None, x or "")


# ---- mixing ---------------------------------------------------------------

def mix_keys(rows, seed=17):
    """(size, key) per row (doc_id, text, lang, source)."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        u = (int(hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 1) / 2 ** 52
        w = max(0.05, 1 - 4 * sum(c in SYMBOLS for c in t) / max(1, len(t)))
        out.append((len(WORD.findall(t)), max(1e-18, -math.log(u) / w)))
    return out


def targets(sizes: dict, weights=(5, 2, 1), cap=3):
    """Water-filling by repeated resharing."""
    names = sorted(sizes, key=nulls_last)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else share[s] for s in names}
        capped.update(over)


# ---- sharding -------------------------------------------------------------

def hilbert(point, bits):
    """Index along the curve, by the axes-to-transpose method on whole integers."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def codes(values, bits=8):
    names = sorted(set(values), key=nulls_last)
    return {v: k * (1 << bits) // len(names) for k, v in enumerate(names)}


def shards(rows, n_shards=24):
    """(doc_id, size, crc, shard, slot) per row."""
    by_source, by_lang = codes([r[3] for r in rows]), codes([r[2] for r in rows])
    keyed = []
    for i, text, lang, source in rows:
        raw = (text or "").encode()
        size = len(raw) + 8
        code = min(255, int(math.floor(math.log2(size + 1) * 8)))
        curve = hilbert((by_source[source], by_lang[lang], code), 8)
        keyed.append(((curve, (i is not None, i or 0), zlib.crc32(raw)), i, size, zlib.crc32(raw)))
    keyed.sort(key=lambda k: k[0])
    n, out = len(keyed), []
    for pos, (_, i, size, crc) in enumerate(keyed):
        shard = pos * n_shards // n
        start = -(-shard * n // n_shards)
        out.append((i, size, crc, shard, pos - start))
    return out


# ---- quality rules --------------------------------------------------------

def text_counts(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update((i, i + 1, i + 2))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in SYMBOLS for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def bucket(v, sub_bits=5):
    shift = max(0, v.bit_length() - sub_bits - 1)
    return ((v >> shift) + 1 << shift) - 1


def quality(rows, least=30):
    """(doc_id, counts, base_failed, kept) per row.

    Limits: of the three shares the bucket after that of the 95 % or 99 % quantile, at most the language's;
    of the word length the third quartile, 3 interquartile ranges and 2 characters.
    """
    quantile = {"symbol_share": 950, "dup_line_share": 990, "repeat_share": 990}
    stats = []
    for i, text, lang, source in rows:
        c = text_counts(text)
        s = {"symbol_share": 10_000 * c["n_symbols"] // max(1, c["word_chars"]),
             "dup_line_share": 10_000 * c["n_dup_lines"] // max(1, c["n_lines"]),
             "repeat_share": 10_000 * c["n_repeat_words"] // max(1, c["n_words"]),
             "word_length": 100 * c["word_chars"] // max(1, c["n_words"])}
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        stats.append((i, lang, source, c, s, failed))
    groups = defaultdict(list)
    for _, lang, source, _, s, failed in stats:
        if not failed:
            for key in ((lang, source), (lang, "*all*"), "*all*"):
                groups[key].append(s)

    def of_group(key, name):
        values = sorted(bucket(s[name]) for s in groups[key])
        at = lambda part, whole: next(v for k, v in enumerate(values, 1) if whole * k >= part * len(values))
        if name in quantile:
            return bucket(at(quantile[name], 1000) + 1)
        return at(3, 4) + 3 * (at(3, 4) - at(1, 4)) + 200

    def limit(lang, source, name):
        if (lang, source) not in groups:
            return None
        if len(groups[lang, source]) >= least:
            own = of_group((lang, source), name)
            return min(own, of_group((lang, "*all*"), name)) if name in quantile else own
        return of_group((lang, "*all*") if len(groups[lang, "*all*"]) >= least else "*all*", name)

    out = []
    for i, lang, source, c, s, failed in stats:
        over = not failed and any(s[k] > limit(lang, source, k) for k in [*quantile, "word_length"])
        out.append((i, c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], failed, not failed and not over))
    return out
