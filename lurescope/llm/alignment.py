"""Alignment of two tokenizers by merge-path partitioning of their token ends.

Both tokenizers encode the same bytes (a space and the text), so their tokens are
two sorted lists of end offsets.  The documents of a block (a bounded number of
bytes of one task; a longer text is a block of its own) are laid end to end, and
the two lists are merged as one path of n_a + n_b steps.  A binary search on each
diagonal finds where the path crosses it, which cuts the path into independent
pieces of PIECE steps, however long or short the documents are.  A piece emits its
overlaps (token of A, token of B, the bytes that they share begin and end) and
which of them end both tokens; where two equal ends lie on both sides of a
diagonal, the boundary is stitched.  Groups are the runs of overlaps up to such a
common end.

How often a pair of ids is linked in the whole corpus: each block holds its
distinct pairs once (its dictionary) and its documents refer to them by position.
The dictionaries are summed by pair, the counts are joined to the dictionaries
again and go back to the blocks, so what is shuffled is a block's distinct pairs
and not its links, and a frequent pair is one row a block.

Defined results: texts that are null, empty, or that a tokenizer does not keep
byte by byte have no tokens (zeros and an empty digest); the tokenizers' special
tokens inside a text are plain text; rows that repeat count as often as they
occur; an empty table gives no rows; extra columns are ignored; no token is empty
(checked when the vocabularies are read), so ends rise within a document.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import common as C

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how byte-level BPE cuts a text before it merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Steps of the merge path in a piece.
PIECE = 1 << 16
#: Characters and documents after which a block is closed, and characters that are encoded at once.
BLOCK_CHARS, BLOCK_DOCS, ENCODED_CHARS = 1_000_000, 4096, 100_000


# ---- vocabularies ------------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranked_encoding(spec: dict, ids: dict[bytes, int]):
    """The same byte-level BPE as ranks, which encodes several times faster; None if the file asks for anything else.

    Ranks decide as the merges do where the n-th merge makes the n-th id after the
    single bytes.  (tests/llm compares both encoders over every code point.)
    """
    import tiktoken
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and spec.get("normalizer") is None
             and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True))
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if not plain or any(model["vocab"].get("".join(m)) != 256 + n for n, m in enumerate(pairs)) or len(ids) != 256 + len(pairs):
        return None
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ids, special_tokens={})


class Vocabularies:
    """Both tokenizers, the bytes of every id, and the pieces of the groups' text."""

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        self.files = a_json, b_model
        alphabet, spec = byte_alphabet(), json.loads(a_json)
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.ranked = ranked_encoding(spec, {self.a_bytes[i]: i for t, i in vocab.items() if t not in special})
        self.a = None
        if self.ranked is None:
            self.a = Tokenizer.from_str(a_json.decode("utf-8"))
            self.a.no_padding()
            self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
        if not all(self.b_bytes) or not all(self.a_bytes[i] for i in vocab.values()):
            raise ValueError("a vocabulary has an empty token")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        #: ids as text: A within and at the end of its side of a group, then B likewise
        self.parts = [f"{i}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]

    def __reduce__(self):
        return Vocabularies, self.files  # a pickled tokenizer forgets its settings

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B; none for texts that are empty or not kept byte by byte.

        A few texts at a time: the tokenizers' own results take many times the memory of the ids.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        low, size = 0, 0
        for n, text in enumerate(texts, 1):
            size += len(text)
            if size >= ENCODED_CHARS or n == len(texts):
                out += self._encode(texts[low:n])
                low, size = n, 0
        return out

    def _encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        spaced = [" " + t for t in texts]
        if self.ranked is not None:
            by_a = map(self.ranked.encode_ordinary, spaced)
        else:
            self.a.encode_special_tokens = True
            by_a = (e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False))
        out = []
        for text, whole, ids, b in zip(texts, spaced, by_a, self.b.encode(texts, num_threads=1)):
            raw = whole.encode("utf-8")
            same = text and b"".join(map(self.a_bytes.__getitem__, ids)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((np.array(ids if same else [], np.int32), np.array(b if same else [], np.int32)))
        return out


_loaded: dict[tuple[str, str], Vocabularies] = {}


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A tokenizer file: of this machine, or of any file system that Spark can open."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def vocabularies(files) -> Vocabularies:
    """The tokenizers of a broadcast pair of files (each worker process reads them once)."""
    key = tuple(hashlib.sha1(x).hexdigest() for x in files.value)
    if key not in _loaded:
        _loaded[key] = Vocabularies(*files.value)
    return _loaded[key]


# ---- merge path --------------------------------------------------------------------------------

def crossings(a_end: np.ndarray, b_end: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d, how many of the first d merged ends are A's (equal ends: A first).

    One binary search a diagonal, all of them in step.
    """
    low, high = np.maximum(0, diagonals - len(b_end)), np.minimum(diagonals, len(a_end))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        a_first = np.zeros(len(diagonals), bool)
        a_first[open_] = a_end[mid[open_]] <= b_end[diagonals[open_] - mid[open_] - 1]
        low, high = np.where(open_ & a_first, mid + 1, low), np.where(open_ & ~a_first, mid, high)
    return low


def piece_overlaps(a_end: np.ndarray, b_end: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Overlaps of one piece of the path: A index, B index, first byte, end byte, whether it ends both tokens."""
    a, b = a_end[i0:i1], b_end[j0:j1]
    begin = max(a_end[i0 - 1] if i0 else 0, b_end[j0 - 1] if j0 else 0)
    b_below_a, a_upto_b = np.searchsorted(b, a, "left"), np.searchsorted(a, b, "right")
    at_a, at_b = np.arange(len(a)) + b_below_a, np.arange(len(b)) + a_upto_b
    n = len(a) + len(b)
    end, ia, jb, both = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    end[at_a], end[at_b] = a, b
    ia[at_a], ia[at_b] = i0 + np.arange(len(a)), i0 + a_upto_b
    jb[at_a], jb[at_b] = j0 + b_below_a, j0 + np.arange(len(b))
    # a common end: the next end of B is the same; for the last end of A that may lie in the next piece (the stitch)
    following = j0 + b_below_a
    inside = following < len(b_end)
    both[at_a[inside]] = b_end[following[inside]] == a[inside]
    first = np.concatenate(([begin], end[:-1]))
    real = end > first  # B's half of a common end covers no bytes
    return ia[real], jb[real], first[real], end[real], both[real]


def overlaps(a_end: np.ndarray, b_end: np.ndarray, piece: int = PIECE):
    """All overlaps in order of their bytes, from independent pieces of ``piece`` steps of the merge path."""
    total = len(a_end) + len(b_end)
    diagonals = np.append(np.arange(0, total, piece), total)
    i = crossings(a_end, b_end, diagonals)
    j = diagonals - i
    parts = [piece_overlaps(a_end, b_end, *cut) for cut in zip(i[:-1], i[1:], j[:-1], j[1:])]
    return [np.concatenate(column) if parts else np.zeros(0, np.int64) for column in zip(*parts)] or [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]


class Block:
    """The aligned tokens of some documents laid end to end."""

    def __init__(self, vocab: Vocabularies, texts: list[str], piece: int = PIECE) -> None:
        encoded = vocab.encode(texts)
        self.n_a = np.array([len(a) for a, _ in encoded], np.int64)
        self.n_b = np.array([len(b) for _, b in encoded], np.int64)
        empty = [np.zeros(0, np.int32)]
        self.a = np.concatenate([a for a, _ in encoded] or empty).astype(np.int64)
        self.b = np.concatenate([b for _, b in encoded] or empty).astype(np.int64)
        self.a_end, self.b_end = np.cumsum(vocab.a_len[self.a]), np.cumsum(vocab.b_len[self.b])
        ia, jb, _, end, both = overlaps(self.a_end, self.b_end, piece)
        #: last token of A and of B in each group, and the byte where it ends
        self.a_last, self.b_last, self.end = ia[both], jb[both], end[both]
        self.a_off, self.b_off = np.concatenate(([0], np.cumsum(self.n_a))), np.concatenate(([0], np.cumsum(self.n_b)))
        self.doc = np.searchsorted(self.a_off[1:], self.a_last, "right")
        self.n_groups = np.bincount(self.doc, minlength=len(texts))

    def group_digests(self, vocab: Vocabularies) -> list[str]:
        """SHA-256 of each document's groups as text; '' without tokens."""
        n_a, n_b = len(vocab.a_bytes), len(vocab.b_bytes)
        ends_a, ends_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        ends_a[self.a_last], ends_b[self.b_last] = True, True
        group_a = np.cumsum(ends_a) - ends_a
        group_b = np.cumsum(ends_b) - ends_b
        b_before = np.concatenate(([0], self.b_last + 1))
        place_a = np.arange(len(self.a)) + b_before[group_a]
        place_b = np.arange(len(self.b)) + self.a_last[group_b] + 1
        items = np.empty(len(self.a) + len(self.b), np.int64)
        items[place_a] = self.a + n_a * ends_a
        items[place_b] = self.b + 2 * n_a + n_b * ends_b
        cut = self.a_off + self.b_off
        return [hashlib.sha256(b"".join(map(vocab.parts.__getitem__, items[s:e].tolist()))[:-1]).hexdigest() if e > s else ""
                for s, e in zip(cut[:-1], cut[1:])]

    def pairs(self, vocab: Vocabularies) -> np.ndarray:
        """The linked ids of each group as one number: A id * size of B's vocabulary + B id."""
        return self.a[self.a_last] * len(vocab.b_bytes) + self.b[self.b_last]

    def groups(self, k: int) -> list[dict]:
        """Document k's groups: byte range within a space and the text, ids by A and by B."""
        own = np.flatnonzero(self.doc == k)
        base = self.a_end[self.a_off[k] - 1] if self.a_off[k] else 0
        out, i, j, at = [], self.a_off[k], self.b_off[k], base
        for g in own:
            out.append({"start": int(at - base), "end": int(self.end[g] - base), "a": self.a[i:self.a_last[g] + 1].tolist(),
                        "b": self.b[j:self.b_last[g] + 1].tolist()})
            i, j, at = self.a_last[g] + 1, self.b_last[g] + 1, self.end[g]
        return out


def _blocks(batches):
    """(doc_ids, texts) of at most BLOCK_CHARS characters or BLOCK_DOCS documents; one longer text alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            text = text.as_py() or ""
            if ids and (size + len(text) > BLOCK_CHARS or len(ids) >= BLOCK_DOCS):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc.as_py())
            texts.append(text)
            size += len(text)
    if ids:
        yield ids, texts


# ---- Spark jobs --------------------------------------------------------------------------------

GROUPS = "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"
ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "link_at array<int>, link_n array<int>, pairs array<long>, pair_n array<long>")
_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("link_at", pa.list_(pa.int32())), ("link_n", pa.list_(pa.int32())),
                    ("pairs", pa.list_(pa.int64())), ("pair_n", pa.list_(pa.int64()))])


def _files(spark: SparkSession, a_path: str, b_path: str):
    """Both tokenizer files for every task (2 MB; they do not grow with the input)."""
    return spark.sparkContext.broadcast((read_bytes(spark, a_path), read_bytes(spark, b_path)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(F.col("text")).alias("text"))


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _align_rows(files):
    """A row a document, and a row a block with its dictionary of linked pairs (``pairs`` is null in the others)."""
    def rows(batches):
        vocab, task, count = vocabularies(files), TaskContext.get().partitionId(), 0
        for ids, texts in _blocks(batches):
            number, count = (task << 32) | count, count + 1
            block = Block(vocab, texts)
            pairs, at, n = np.unique(block.pairs(vocab), return_inverse=True, return_counts=True)
            # each document's distinct pairs, by their place in the dictionary
            cell, times = np.unique(block.doc * max(1, len(pairs)) + at, return_counts=True)
            offsets = np.searchsorted(cell // max(1, len(pairs)), np.arange(len(ids) + 1))
            docs = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(docs, number)), pa.array(ids, pa.int64()), pa.array(block.n_a), pa.array(block.n_b),
                pa.array(block.n_groups, pa.int64()), pa.array(block.n_groups, pa.int64()), pa.array(block.group_digests(vocab), pa.string()),
                _lists(cell % max(1, len(pairs)), offsets, pa.int32()), _lists(times, offsets, pa.int32()),
                pa.nulls(docs, _ARROW.field("pairs").type), pa.nulls(docs, _ARROW.field("pair_n").type)], schema=_ARROW)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), *[pa.nulls(1, f.type) for f in list(_ARROW)[1:9]],
                _lists(pairs, np.array([0, len(pairs)]), pa.int64()), _lists(n, np.array([0, len(pairs)]), pa.int64())], schema=_ARROW)
    return rows


def _group_rows(files):
    def rows(batches):
        vocab = vocabularies(files)
        for ids, texts in _blocks(batches):
            block = Block(vocab, texts)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            for k, doc in enumerate(ids):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([block.groups(k)], kind)], ["doc_id", "groups"])
    return rows


def token_groups(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}") -> DataFrame:
    """Every document's groups: byte range, ids by A, ids by B."""
    return _texts(docs).mapInArrow(_group_rows(_files(docs.sparkSession, a_path, b_path)), GROUPS)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``pair, count, best``: how often each pair of ids is linked, and whether no pair of its B id is more frequent."""
    cells = aligned.filter(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("c"))
    counts = cells.groupBy(F.col("c.pairs").alias("pair")).agg(F.sum("c.pair_n").alias("count"))
    top = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("top"))
    return counts.join(top, F.col("pair") % b_size == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """The links of one block's documents against its dictionary with the corpus-wide counts."""
    places = right.column("at").to_numpy()
    count, best = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    count[places], best[places] = right.column("count").to_numpy(), right.column("best").to_numpy()
    at, n = left.column("link_at").combine_chunks(), left.column("link_n").combine_chunks()
    bounds = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))))
    at, n = at.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def per_doc(values):
        sums = np.concatenate(([0], np.cumsum(values)))
        return pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())

    own = {"n_best": per_doc(n * best[at]), "count_sum": per_doc(n * count[at])}
    return pa.Table.from_arrays([own[f.name] if f.name in own else left.column(f.name) for f in _RESULT], schema=_RESULT)


def align(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}") -> DataFrame:
    """Per document: tokens by A and B, groups, links, links that are their B id's most frequent, sum of their counts, digest of the groups."""
    spark = docs.sparkSession
    files = _files(spark, a_path, b_path)
    b_size = len(Vocabularies(*files.value).b_bytes)
    aligned = C.materialize(_texts(docs).mapInArrow(_align_rows(files), ALIGNED), "aligned")
    words = aligned.filter(F.col("pairs").isNotNull()) \
                   .select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair")) \
                   .join(pair_counts(aligned, b_size), "pair").select("of", "at", "count", "best")
    rows = aligned.filter(F.col("pairs").isNull()).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_at", "link_n")
    return rows.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(_look_up, RESULT)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(C.read(spark, sf_dir, "documents"))
