"""Best-fit packing planned on the histogram of lengths.

1. Every document becomes token ids, then one end id; what is longer than a sequence is cut.
2. The histogram of piece lengths (at most ``SEQ`` rows, whatever the corpus) goes to the driver,
   where best-fit decreasing runs over counts: all pieces of a length move at once, and sequences
   that hold the same lengths are one group.
3. The plan is a table of slot intervals for each length. A piece takes the slot at its rank within
   its length. Ranks come from counts of (length, hash bucket) and a row number inside a bucket, so
   a length that most pieces share is ranked by many tasks.

The plan's size depends on ``SEQ`` alone, so it goes to every task, where a piece finds its slot by binary search. Null and empty texts give the end id.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialise, read_table

SEQ, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PER_BUCKET = 50_000
_CACHE_WORDS = 300_000  # words in a generation; two are remembered
_AT_ONCE, _LONGEST = 1 << 17, 64  # words at once, and bytes of the longest that are merged together: they bound memory and steps
_SPACE, _ALNUM, _MARK, _QUOTE, _LEAD, _LATIN = 1, 2, 4, 8, 16, 32  # kinds of bytes; the last two make a letter of Latin-1
_KINDS = bytes(
    _SPACE if c in b" \t\n\r\x0b\x0c" else _ALNUM if chr(c).isalnum() and c < 128 else _QUOTE if c == 0x27 else _MARK if 0x20 < c < 0x7F else _LEAD if c == 0xC3
    else _LATIN if 0x80 <= c < 0xC0 and c not in (0x97, 0xB7) else 0 for c in range(256)
)
# how byte-level vocabularies write a byte: itself where it prints, else the next character from 256 on
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}
_tokenizers: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Merges:
    """Byte-pair merges of many words at once: in each step every word merges its best pair, the leftmost of equals."""

    NONE, EDGE = (1 << 63) - 1, 0xFFFF

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        chars = [chr(_BYTE_CHARS.get(b, b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = np.array([vocab[x + y] for x, y in parts], np.int64)
        self.slots = 1 << (4 * len(parts)).bit_length()  # a pair stands in the slot of its hash or in the next free one
        self.pairs = np.full(self.slots, -1, np.int64)
        self.ranks = np.full(self.slots, -1, np.int64)
        pairs = np.array([vocab[x] << 16 | vocab[y] for x, y in parts], np.int64)
        for rank, (pair, at) in enumerate(zip(pairs.tolist(), self._slot(pairs).tolist())):
            while self.pairs[at] not in (-1, pair):
                at = (at + 1) % self.slots
            self.pairs[at], self.ranks[at] = pair, rank

    @classmethod
    def read(cls, path: str) -> _Merges | None:
        """Merges of a tokenizer file; none where its model is of another kind."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if max(vocab.values()) >= cls.EDGE or any(c + e not in vocab for c in (chr(_BYTE_CHARS.get(b, b)) for b in range(256)) for e in ("", suffix)):
            return None
        return cls(vocab, model["merges"], suffix)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair * 0x9E3779B1 >> 15) & (self.slots - 1)

    def _key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of each pair above its place; NONE where there is no such merge."""
        pair = left << 16 | right
        slot = self._slot(pair)
        there, rank = self.pairs[slot], self.ranks[slot]
        open_ = np.flatnonzero((there != pair) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.slots
            now = self.pairs[slot[open_]]
            there[open_], rank[open_] = now, self.ranks[slot[open_]]
            open_ = open_[(now != pair[open_]) & (now >= 0)]
        return np.where(there == pair, rank << 32 | at, self.NONE)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words, none empty, in ascending order of length."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n, end = len(data), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        first = np.concatenate([[0], end[:-1]])
        sym = np.append(self.inner[data], self.EDGE)  # place n stands beyond the edges of all words
        sym[end - 1] = self.last[data[end - 1]]
        place = np.arange(n + 1)
        after, before = np.append(place[1:], n), place - 1
        after[end - 1], before[first] = n, n
        alive = np.ones(n, bool)
        key = self._key(sym, sym[after], place)
        go = first
        while len(go):
            best = np.minimum.reduceat(key[go[0] : n], go - go[0])  # a word that is done has no pair, so it may join the segment before it
            more = best != self.NONE
            go, best = go[more], best[more]
            at = best & 0xFFFFFFFF
            sym[at] = self.made[best >> 32]
            gone = after[at]
            alive[gone], key[gone] = False, self.NONE
            right, left = after[gone], before[at]
            after[at], before[right] = right, at
            key[at] = self._key(sym[at], sym[right], at)
            key[left] = self._key(sym[left], sym[at], left)
        out = sym[:n][alive].astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.add.reduceat(alive, first, dtype=np.int64))).tolist()
        return [out[lo:hi] for lo, hi in zip([0, *stop], stop)]


class _Words:
    """A tokenizer and the packed ids of words that this worker met lately, in two generations."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use every core
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.merges = _Merges.read(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, here: list[bytes]) -> list[bytes]:
        """Packed ids of different words of normalised texts."""
        if len(self.young) > _CACHE_WORDS:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        found = list(map(known.get, here))
        new = []
        for w in (w for w, ids in zip(here, found) if ids is None):
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        self._learn(new)
        return [known[w] if ids is None else ids for w, ids in zip(here, found)]

    def _learn(self, new: list[bytes]) -> None:
        known, model = self.young, self.full.model
        letters, rest = [], []  # letters alone are one word to the tokenizer: its model needs no more than their bytes
        for w in new:
            if w.isascii():
                (letters if w.isalpha() else rest).append(w)
                continue
            x = w.decode()
            if x.isalpha():
                letters.append(w)
            elif unicodedata.is_normalized("NFC", x):
                rest.append(w)
            else:  # lower-casing left characters that composing once more would join
                known[w] = _packed([t.id for part, _ in self.full.pre_tokenizer.pre_tokenize_str(x) for t in model.tokenize(part)])
        letters.sort(key=len)
        most = bisect.bisect_right(letters, _LONGEST if self.merges else 0, key=len)
        for at in range(0, most, _AT_ONCE):
            part = letters[at : min(at + _AT_ONCE, most)]
            known.update(zip(part, self.merges.ids(part)))
        for w in letters[most:]:
            known[w] = _packed([t.id for t in model.tokenize(w.decode("latin-1").translate(_BYTE_CHARS))])
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for w, e in zip(part, self.full.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                known[w] = _packed(e.ids)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _words(path: str) -> _Words:
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    return _tokenizers[path]


def _normal(text: str) -> bytes:
    """What the tokenizer makes of a text before it looks for words: composed, then lower-cased, each character alone."""
    if text.isascii():
        return text.encode().lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return (text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))).encode("utf-8", "replace")


def _split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of normalised texts, and the place where each text's words end.

    A word ends at ASCII white space, between a letter or digit (of ASCII or Latin-1) and an ASCII mark after it, and
    between a mark and a letter or digit of ASCII after it, unless the mark is an apostrophe, which may begin a word.
    """
    joined = b"\n".join([*texts, b""])
    data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
    solid = kind != _SPACE
    before, here = kind[:-1], kind[1:]
    letter = before == _ALNUM
    letter[1:] |= (before[:-1] == _LEAD) & (before[1:] == _LATIN)
    head = solid.copy()
    head[1:] &= ~solid[:-1] | (letter & ((here & (_MARK | _QUOTE)) > 0)) | ((before == _MARK) & (here == _ALNUM))
    kept = data[solid]
    starts = np.append(np.flatnonzero(head[solid]), len(kept))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(kept)])
    return words, np.searchsorted(np.flatnonzero(head), np.cumsum([len(t) + 1 for t in texts]))


def encode_packed(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text.

    This vocabulary composes, lower-cases, never joins characters across white space (ASCII white space is
    a subset of what it drops), and parts letters or digits from marks; so a text's ids are those of the
    words and marks of its normal form. Ids of the different words of all texts stand one after another,
    and every word is a run of them.
    """
    own = _words(path)
    words, ends = _split([b"" if "<|" in t else _normal(t) for t in texts])
    found = words.dictionary_encode()
    _, stops, data = found.dictionary.buffers()
    stops, data = (np.frombuffer(stops, np.int64)[: len(found.dictionary) + 1].tolist(), data.to_pybytes()) if len(words) else ([], b"")
    which, table = found.indices.to_numpy(), own.of([data[lo:hi] for lo, hi in zip(stops, stops[1:])])
    size = np.fromiter(map(len, table), np.int64, len(table)) >> 2
    ids, first = np.frombuffer(b"".join(table), "<u4"), np.cumsum(size) - size
    parts, done = [], [np.zeros(1, np.int64)]
    for at in range(0, len(which), _AT_ONCE):
        part = which[at : at + _AT_ONCE]
        n = size[part]
        stop = np.cumsum(n)
        parts.append(ids[np.repeat(first[part] - stop + n, n) + np.arange(stop[-1])].tobytes())
        done.append(stop + done[-1][-1])
    flat, stops = b"".join(parts), (4 * np.concatenate(done)[ends]).tolist()
    for t, lo, hi in zip(texts, [0, *stops], stops):
        if "<|" in t:  # it may hold the string of a special token, whose case matters
            yield _packed(own.full.encode(t, add_special_tokens=False).ids)
        else:
            yield flat[lo:hi]


def pieces(docs: DataFrame, path: str, seq: int = SEQ, end: int = END) -> DataFrame:
    """One row for each piece of each document of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        stop = end.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode_packed(texts, path)):
                    ids += stop
                    for k, lo in enumerate(range(0, len(ids), 4 * seq)):
                        own = ids[lo : lo + 4 * seq]
                        out.append((doc, k, lo // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, cut, PIECES)


def best_fit_plan(counts: dict[int, int], seq: int = SEQ) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, first sequence, offset), and the number of sequences.

    Longest first; a piece goes to the sequence with the least room that still takes it. Groups are
    runs of consecutive sequence numbers that hold the same lengths, kept by their room.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    open_: list[int] = []  # rooms in use, ascending
    slots, made = [], 0

    def put(r: int, first: int, n: int) -> None:
        if r not in room:
            room[r] = []
            bisect.insort(open_, r)
        room[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(open_, length)
            if at < len(open_):
                r = open_[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r]
                    open_.pop(at)
            else:
                r, first = seq, made
                n = -(-left // (seq // length))
                made += n
            fit = r // length  # as each piece leaves less room, the next best fit is the same sequence
            whole = min(n, left // fit)
            for j in range(fit):
                if whole:
                    slots.append((length, rank, rank + whole, first, seq - r + j * length))
                    rank += whole
            left -= whole * fit
            if whole:
                put(r - fit * length, first, whole)
            if whole < n:
                first, n = first + whole, n - whole
                if left < fit and left:
                    for j in range(left):
                        slots.append((length, rank, rank + 1, first, seq - r + j * length))
                        rank += 1
                    put(r - left * length, first, 1)
                    first, n, left = first + 1, n - 1, 0
                if n:
                    put(r, first, n)
    return slots, made


def packed(parts: DataFrame, seq: int = SEQ) -> DataFrame:
    """``parts`` (materialised pieces) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = best_fit_plan(counts, seq)
    buckets = max(16, sum(counts.values()) // PER_BUCKET)
    rows = parts.withColumn("_k", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by = rows.groupBy("length", "_k").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    by = by.select("length", "_k", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_k").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("_at", own - 1).join(by, ["length", "_k"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_at")).cast("long").alias("_rank"))
    return ranked.transform(map_arrow, _placer(slots), f"{PIECES}, sequence_id long, offset long")


def _placer(slots: list[tuple[int, int, int, int, int]]):
    """Puts each piece into the slot that holds its rank; the slots of a length tile its ranks, so a search finds it."""
    plan = np.array(sorted(slots), np.int64).reshape(-1, 5)
    lengths, start = np.unique(plan[:, 0], return_index=True)
    own = {int(n): part for n, part in zip(lengths, np.split(plan, start[1:]))} if len(plan) else {}

    def go(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                part = own[int(n)]
                slot = part[np.searchsorted(part[:, 1], rank[at], "right") - 1]
                seq[at], off[at] = slot[:, 3] + rank[at] - slot[:, 1], slot[:, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return go


def pack(docs: DataFrame, path: str | None = None, seq: int = SEQ, end: int = END) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of ``docs(doc_id, text)``."""
    parts = materialise(pieces(docs, path or vocabulary_path(), seq, end), "pieces")
    return packed(parts, seq).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))
