"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans.  The text between them
is cut into units that can be personal data at all: runs of digits with single or
double separators, and words with a digit or an @; every other word can't have a
label.  The units of a document, base spans included, are the nodes of a CRF:
features of the unit and the word before it, an edge to the next unit, and skip
edges between distant units that repeat (same text or same digits) or resemble
each other (same national number, same four parts, local part of an address).
Base spans are observed labels; loopy message passing carries them along the
edges, so a mention in another form gets the label that the document gave the
same thing elsewhere.  Kinds whose form a unit can't have are barred (a phone has
7 to 15 digits, a card passes Luhn, an ip has four parts up to 255).  A unit that
has a kind with a marginal of 0.5 or more adds a span.

A unit of a group that shares a key has one skip edge: to the group's first base
span if there is one, else to the unit before it in the group; never all pairs.

The model is learned from the base spans of at most SAMPLE_DOCS documents that
hold a unit, in order of a hash of the id, and of those at most SAMPLE_UNITS units
(whole documents); every text is scanned and tagged whole.  Training has no random
choice, so reruns agree.

Defined results: null text is empty and has no spans; rows that repeat get equal
rows; an empty table gives no rows; without any base span in the sample the model
knows only its prior and adds nothing but what skip edges carry; extra columns are
ignored; each pattern runs in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import common as C
from lurescope.llm import skip_chain as crf

SAMPLE_DOCS, SAMPLE_UNITS = 4000, 60_000
KINDS = ("email", "ip", "card", "phone")
NONE = 0
#: Labels: 0 none, then the kinds in order.
LABELS = 1 + len(KINDS)
NEXT, REPEATS, RESEMBLES = 0, 1, 2
#: Prior weight of equal labels along an edge, by kind of edge.
AGREE = {NEXT: 0.0, REPEATS: 9.0, RESEMBLES: 8.0}
#: Longest run of digits that can be the same number elsewhere.
LONGEST = 40

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_ANY = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])*+|@")
_WORD_END = re.compile(r"[A-Za-z0-9._%+@-]*")
_WORD_CHARS = _LOCAL + "@"
_BEFORE = re.compile(r"[^\W\d_]+")


# ---- base spans --------------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of address characters before an @ (not in the match before), and its domain."""
    out, free, since = [], 0, 0
    for m in _DOMAIN.finditer(text):
        before = text[max(free, since):m.start()]
        since = m.start() + 1
        run = len(before) - len(before.rstrip(_LOCAL))
        if run:
            out.append((m.start() - run, m.end()))
            free = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans per kind, in the order of KINDS."""
    if not _ANY.search(text):
        return [[], [], [], []]
    return [emails(text) if "@" in text else [], ips(text), cards(text), phones(text) if "+" in text else []]


# ---- units -------------------------------------------------------------------------------------

def _glued_before(text: str, low: int, start: int) -> bool:
    """Whether text[start] continues a word: after a letter, perhaps with one sign between."""
    last = text[max(low, start - 2):start]
    return bool(last) and (last[-1] in _WORD_CHARS and last[-1] not in "+-." or len(last) == 2 and last[0].isascii() and last[0].isalpha() and last[1] in "-.")


def _loose_units(text: str, low: int, high: int):
    """Units of text[low:high]: numbers with what introduces them, and words with a digit or an @."""
    at = low
    for m in _NUMBER.finditer(text, low, high):
        if m.start() < at:
            continue
        start, end = m.span()
        glued = m.group() == "@" or _glued_before(text, at, start) \
            or end < high and (text[end].isascii() and text[end].isalpha() or text[end] in "_%@")
        if glued:
            before = text[at:start]
            start -= len(before) - len(before.rstrip(_WORD_CHARS))
            end = _WORD_END.match(text, m.start(), high).end()
            word = text[start:end].rstrip(".-+%")
            end = start + len(word)
            start += len(word) - len(word.lstrip(".-+%"))
        else:
            lead = text[max(at, start - 2):start]
            start -= 2 if lead in ("+(", "((") else 1 if lead[-1:] in ("+", "(") and lead else 0
        if end > start:
            yield start, end
        at = max(end, m.start() + 1)


def units(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(start, end, label or -1) in order of the text; of base spans that overlap the first kind's is the unit."""
    if not _ANY.search(text):
        return []
    taken = sorted((s, k, e) for k, spans in enumerate(base, 1) for s, e in spans)
    out, at = [], 0
    for s, k, e in taken:
        if s < at:
            continue
        out += [(a, b, -1) for a, b in _loose_units(text, at, s)]
        out.append((s, e, k))
        at = e
    return out + [(a, b, -1) for a, b in _loose_units(text, at, len(text))]


def keys(unit: str) -> list[tuple[int, str]]:
    """(kind of edge, key): units that share a key are tied."""
    digits = _NOT_DIGIT.sub("", unit) if len(unit) <= 4 * LONGEST else ""
    out = []
    if any(c.isalpha() or c == "@" for c in unit[:200]):
        word = unit.lower().strip(".-+%")
        out.append((REPEATS, "w" + word[:200]))
        local = word.split("@")[0]
        if len(local) >= 4:
            out.append((RESEMBLES, "l" + local[:200]))
        return out
    if 7 <= len(digits) <= LONGEST:
        out.append((REPEATS, "d" + digits))
    if 9 <= len(digits) <= 15:
        out.append((RESEMBLES, "p" + digits[-9:]))
    parts = [p for p in _NOT_DIGIT.split(unit) if p] if digits else []
    if len(parts) == 4:
        out.append((RESEMBLES, "i" + ".".join(parts)))
    return out


#: Feature numbers: 0 bias, then fixed blocks, then the hashed word before the unit.
_CONTEXT = 256
FEATURES = 1 + 24 + 8 + 16 + _CONTEXT + 1
ACTIVE = 9


def feature_ids(text: str, start: int, end: int) -> list[int]:
    """ACTIVE feature numbers of a unit; the last feature is padding."""
    unit = text[start:min(end, start + 400)]
    digits = _NOT_DIGIT.sub("", unit)
    parts = [p for p in _NOT_DIGIT.split(unit) if p]
    letters = any(c.isalpha() for c in unit)
    out = [0, 1 + min(len(digits), 23), 25 + min(len(parts), 7)]
    flags = (letters, "@" in unit, unit[:1] == "+", "(" in unit, "-" in unit, " " in unit, "." in unit,
             13 <= len(digits) <= 19 and not letters and luhn(digits), len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts),
             "@" in unit and "." in unit.split("@")[-1])
    out += [33 + i for i, on in enumerate(flags) if on][:5]
    before = _BEFORE.findall(text[max(0, start - 24):start])
    if before:
        out.append(49 + xxhash.xxh32_intdigest(before[-1].lower()) % _CONTEXT)
    return (out + [FEATURES - 1] * ACTIVE)[:ACTIVE]


def barred(unit: str, label: int) -> list[float]:
    """Log weights that bar the kinds whose form the unit can't have, in whatever way it is written."""
    digits = _NOT_DIGIT.sub("", unit) if len(unit) <= 4 * LONGEST else "0" * (LONGEST + 1)
    letters = any(c.isalpha() or c == "@" for c in unit[:200])
    parts = [p for p in _NOT_DIGIT.split(unit) if p] if len(digits) <= LONGEST else []
    may = (True, letters, not letters and len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts),
           not letters and 13 <= len(digits) <= 19 and luhn(digits), not letters and 7 <= len(digits) <= 15)
    return [0.0 if ok or k == label else crf.EXCLUDED for k, ok in enumerate(may)]


class Graph:
    """Units and edges of some documents, laid end to end."""

    def __init__(self) -> None:
        self.bars: list[list[float]] = []
        self.spans: list[tuple[int, int, int]] = []
        self.ids: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, text: str, base: list[list[tuple[int, int]]]) -> tuple[int, int]:
        """The range of the document's units."""
        low, last = len(self.spans), {}
        found = [(start, end, label, keys(text[start:end])) for start, end, label in units(text, base)]
        seen: dict[tuple[int, str], int] = {}  # the first observed unit of each key
        for n, (_, _, label, own) in enumerate(found, low):
            if label >= 0:
                for key in own:
                    seen.setdefault(key, n)
        for n, (start, end, label, own) in enumerate(found, low):
            self.spans.append((start, end, label))
            self.ids.append(feature_ids(text, start, end))
            self.bars.append(barred(text[start:end], label))
            if n > low:
                self.edges.append((n - 1, n, NEXT))
            tied = set()
            for key in own:
                m = seen[key] if label < 0 and key in seen else last.get(key)
                if m is not None and m not in tied:
                    tied.add(m)
                    self.edges.append((min(m, n), max(m, n), key[0]))
                last[key] = n
        return low, len(self.spans)

    def arrays(self):
        ids = np.array(self.ids, np.int64).reshape(-1, ACTIVE)
        label = np.array([s[2] for s in self.spans], np.int64)
        e = np.array(self.edges, np.int64).reshape(-1, 3)
        return ids, np.array(self.bars, np.float64).reshape(-1, LABELS), label, e[:, 0], e[:, 1], e[:, 2]


def prior() -> np.ndarray:
    return np.stack([AGREE[k] * np.eye(LABELS) for k in (NEXT, REPEATS, RESEMBLES)])


# ---- Spark jobs --------------------------------------------------------------------------------

TAGGED = "doc_id long, entities array<struct<kind:string,start:long,end:long,base:boolean,p:double>>"
_ENTITY = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("p", pa.float64())]))
_UNITS_AT_ONCE = 50_000


def entities(texts: list[str], model: crf.Model) -> list[list[dict]]:
    """All spans of each text, by kind and start; ``p`` is the marginal of the span's kind (1 for base spans)."""
    graph, base, ranges = Graph(), [base_spans(t) for t in texts], []
    for text, spans in zip(texts, base):
        ranges.append(graph.add(text, spans))
    ids, bars, observed, u, v, kind = graph.arrays()
    p = crf.marginals(model, ids, bars, observed, u, v, kind) if len(ids) else np.zeros((0, LABELS))
    best = p.argmax(axis=1)
    out = []
    for spans, (low, high) in zip(base, ranges):
        found = [(k, s, e, True, 1.0) for k, own in enumerate(spans) for s, e in own]
        for n in range(low, high):
            start, end, label = graph.spans[n]
            if label < 0 and best[n] != NONE and p[n, best[n]] >= 0.5:
                found.append((int(best[n]) - 1, start, end, False, float(p[n, best[n]])))
        out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b, "p": q} for k, s, e, b, q in sorted(found)])
    return out


def _entity_rows(model: crf.Model):
    def rows(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            low, size = 0, 0
            for n in range(len(texts)):
                size += len(texts[n].as_py() or "") // 16  # about the units it may have
                if size >= _UNITS_AT_ONCE or n == len(texts) - 1:
                    found = entities([t or "" for t in texts[low:n + 1].to_pylist()], model)
                    yield pa.RecordBatch.from_arrays([ids[low:n + 1], pa.array(found, _ENTITY)], ["doc_id", "entities"])
                    low, size = n + 1, 0
    return rows


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(F.col("text")).alias("text"))


_GRAPHS = "doc_id long, ids array<long>, label array<long>, edges array<long>"


def _graph_rows(batches):
    for batch in batches:
        graphs = []
        for text in batch.column("text"):
            g = Graph()
            g.add(text.as_py(), base_spans(text.as_py()))
            graphs.append(g)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([[i for ids in g.ids for i in ids] for g in graphs], longs),
             pa.array([[s[2] for s in g.spans] for g in graphs], longs), pa.array([[x for e in g.edges for x in e] for g in graphs], longs)],
            ["doc_id", "ids", "label", "edges"])


def fit(docs: DataFrame) -> crf.Model:
    """The model, from the base spans of a bounded sample of documents."""
    d = _texts(docs).filter(F.col("text").rlike("[0-9@]"))
    order = [F.xxhash64("doc_id", F.xxhash64("text")), "doc_id"]
    chosen = d.select("doc_id", F.xxhash64("text").alias("th")).orderBy(F.xxhash64("doc_id", "th"), "doc_id").limit(SAMPLE_DOCS)
    chosen = C.materialize(chosen.groupBy(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th")).count(), "pii_sample")
    sample = d.join(chosen, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.xxhash64("text") == F.col("c_th"))).select("doc_id", "text")
    graphs = sample.dropDuplicates(["doc_id", "text"]).orderBy(*order).select("doc_id", "text").mapInArrow(_graph_rows, _GRAPHS)
    ids, labels, edges, n = [], [], [], 0
    for r in graphs.toLocalIterator():
        if n + len(r.label) > SAMPLE_UNITS:
            break
        ids.append(np.array(r.ids, np.int64).reshape(-1, ACTIVE))
        labels.append(np.array(r.label, np.int64))
        edges.append(np.array(r.edges, np.int64).reshape(-1, 3) + [n, n, 0])
        n += len(r.label)
    if not n:
        return crf.Model(np.zeros((FEATURES, LABELS)), prior())
    e = np.concatenate(edges)
    return crf.train(np.concatenate(ids), np.maximum(np.concatenate(labels), NONE), e[:, 0], e[:, 1], e[:, 2], FEATURES, prior())


def find(docs: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """``doc_id, entities``: the base spans and the added ones of every document."""
    return _texts(docs).mapInArrow(_entity_rows(model if model is not None else fit(docs)), TAGGED)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count_base(kind: str):
    return F.size(F.filter("entities", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans as text."""
    base = F.filter("entities", lambda x: x["base"])
    return found.select("doc_id", *[_count_base(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("entities")).alias("spans"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(C.read(spark, sf_dir, "documents")))
