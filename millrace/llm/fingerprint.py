"""Improbable-feature digests of documents.

1. Every window of 64 bytes gets its Shannon entropy in thousandths of the most it can be (integer
   arithmetic, so equal bytes always give equal values).
2. A first pass over all documents counts windows by entropy; the rarer a value, the better its rank.
   Near-constant windows rank last.
3. A window that ranks best, leftmost first, in at least 16 of the 64-window stretches that hold it
   is a feature. A text that has none so popular uses its most popular windows; a text shorter than
   a window is one feature; an empty text has no filter.
4. Features enter 2048-bit Bloom filters by five 11-bit parts of a hash, 160 to a filter; filters
   form a chain.
5. Likeness: for each filter of the shorter chain the best normalised bit overlap (what exceeds
   chance, as a share of what could) in the other chain, then the mean. Two empty texts are alike.

Successors: documents are dealt into ranges of ``doc_id``, each with the first document of the next
range as a guest, and streamed in descending order. Null ids come last; equal ids go by text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, read_table

WINDOW, STRETCH, POPULAR, PER_FILTER, BITS = 64, 64, 16, 160, 2048
FLAT = 100  # thousandths; below it a window is nearly one byte repeated
_F = np.array([0] + [round(c * np.log2(c) * 4096) for c in range(1, WINDOW + 2)], np.int64)
_STEP = (_F[1:] - _F[:-1]).astype(np.int32)  # what one more of a byte adds
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)  # odd, any will do
CHUNK = 1 << 20  # bytes digested at once; it bounds memory, not texts


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of the window that starts at each byte; short of the end by 63."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        back[d:] += same
        ahead[:-d] += same
    step = np.empty(n - WINDOW + 1, np.int64)
    step[0] = _F[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.subtract(_STEP[back[WINDOW:]], _STEP[ahead[: n - WINDOW]], out=step[1:])
    total = np.cumsum(step)
    return 1000 - (total * 1000) // (_F[WINDOW])


def _spread(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    return data, starts, ends


def histogram(texts: list[bytes]) -> np.ndarray:
    """Windows by entropy, of all texts."""
    out = np.zeros(1001, np.int64)
    for group in _grouped(texts):
        data, starts, ends = _spread(group)
        e = entropies(data)
        inside = np.zeros(len(data) + 1, np.int32)
        for s, t in zip(starts, ends):
            if t - s >= WINDOW:
                inside[s] += 1
                inside[t - WINDOW + 1] -= 1
        if len(e):
            out += np.bincount(e[np.cumsum(inside[: len(e)]) > 0], minlength=1001)
    return out


def _grouped(texts: list[bytes]):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy: the rarest of all windows first, near-constant windows last."""
    order = np.lexsort((np.arange(len(counts)), counts))
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts))
    out[:FLAT] = 1022
    return out


def _features(data: np.ndarray, starts, ends, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the features, and the text of each."""
    n = len(data)
    e = entropies(data)
    if not len(e):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(e)
    owner = np.repeat(np.arange(len(starts)), np.asarray(ends) - starts)[:m]
    valid = np.arange(m) + WINDOW <= np.asarray(ends)[owner]
    key = np.where(valid, (rank[e] << 40) | np.arange(m, dtype=np.int64), np.int64(1) << 60)
    low, span = key, 1
    while span < min(STRETCH, m):  # doubling: the least of the span windows from here on, or of all that are left
        nxt = low.copy()
        nxt[: m - span] = np.minimum(low[: m - span], low[span:])
        low, span = nxt, span * 2
    at = low[valid] & ((1 << 40) - 1)
    pop = np.bincount(at, minlength=m)
    pick = (pop >= POPULAR) & valid
    have = np.zeros(len(starts), bool)
    have[owner[pick]] = True
    if not have.all():  # texts with no window so popular
        most = np.zeros(len(starts), np.int64)
        np.maximum.at(most, owner[valid], pop[valid])
        pick |= valid & ~have[owner] & (pop > 0) & (pop == most[owner])
    pos = np.flatnonzero(pick)
    return pos, owner[pos]


def _hash(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    out = np.zeros(len(pos), np.uint64)
    for at in range(0, len(pos), 20_000):
        own = np.ascontiguousarray(data[pos[at : at + 20_000, None] + np.arange(WINDOW)]).view("<u8")
        h = ((own ^ (own >> np.uint64(29))) * _MIX).sum(1, dtype=np.uint64)
        for s, k in ((31, 0), (27, 1), (33, 2)):
            h = (h ^ (h >> np.uint64(s))) * _MIX[k]
        out[at : at + 20_000] = h ^ (h >> np.uint64(29))
    return out


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filter chain of each text: uint64 array (filters, 32)."""
    out: list[np.ndarray] = []
    for group in _grouped(texts):
        data, starts, ends = _spread(group)
        pos, owner = _features(data, starts, ends, rank)
        h = _hash(data, pos)
        short = [i for i, t in enumerate(group) if 0 < len(t) < WINDOW]
        if short:
            h = np.concatenate([h, np.array([int.from_bytes(hashlib.blake2b(group[i], digest_size=8).digest(), "little") for i in short], np.uint64)])
            owner = np.concatenate([owner, short])
            pos = np.concatenate([pos, [starts[i] for i in short]])
        # a feature counts once in a text, where it first occurs
        order = np.lexsort((pos, h, owner))
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        keep = order[first]
        keep = keep[np.lexsort((pos[keep], owner[keep]))]
        h, owner = h[keep], owner[keep]
        n = np.bincount(owner, minlength=len(group)) if len(owner) else np.zeros(len(group), np.int64)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        filters = -(-n // PER_FILTER)
        base = np.cumsum(filters) - filters
        bits = np.zeros((int(filters.sum()), BITS), bool)
        row = base[owner] + at // PER_FILTER if len(owner) else np.zeros(0, np.int64)
        for k in range(5):
            bits[row, (h >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
        packed = np.packbits(bits, axis=1).view("<u8") if len(bits) else np.zeros((0, BITS // 64), np.uint64)
        out += [packed[b : b + f] for b, f in zip(base, filters)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean, over the shorter chain, of the best normalised overlap with a filter of the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b) and a.tobytes() == b.tobytes():
        return 1.0
    if len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for x, n in zip(a, na):
        best = 0.0
        for at in range(0, len(b), 4096):
            m = nb[at : at + 4096]
            common = np.bitwise_count(b[at : at + 4096] & x).sum(1, dtype=np.int64)
            chance, most = n * m / BITS, np.minimum(n, m)
            best = max(best, float(np.max((common - chance) / np.maximum(most - chance, 1e-9))))
        total += min(best, 1.0)
    return total / len(a)


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def edited(text: str, nxt: str) -> str:
    """``text`` with its last third replaced by as many characters from the start of ``nxt``."""
    k = len(text) // 3
    return text[: len(text) - k] + nxt[:k]


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks from the windows of all of ``docs(text)``; 1001 counts come to the driver."""

    def count(batches):
        total = np.zeros(1001, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                total += histogram([(t or "").encode("utf-8", "replace") for t in batch.slice(at, 500).column(0).to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["e", "n"])

    counts = np.zeros(1001, np.int64)
    for r in docs.select("text").transform(map_arrow, count, "e int, n long").groupBy("e").agg(F.sum("n").alias("n")).collect():
        counts[r["e"]] = r["n"]
    return ranks(counts)


MOST_RANGES = 20_000  # cut points that the driver holds at most; ranges grow beyond it
_NONE = -(1 << 63)  # stands for a null id, below all others


def in_ranges(docs: DataFrame, rows_per_range: int = 1500) -> DataFrame:
    """``docs(doc_id, text)`` in ranges of ids, sorted descending, each with the head of the next.

    Columns: _range, _guest, doc_id, text. The cut points (one for ``rows_per_range`` rows) come
    from quantiles of the ids alone.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = own.select("doc_id")
    n = ids.count()
    parts = min(max(1, -(-n // rows_per_range)), MOST_RANGES)
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 and n else []
    cuts = np.array(cuts, np.float64)

    def place(x: np.ndarray) -> np.ndarray:  # highest ids in range 0
        return len(cuts) - np.searchsorted(cuts, x.astype(np.float64), side="right")

    def tops(batches):
        best: dict[int, int] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            for r, i in zip(place(x).tolist(), x.tolist()):
                if best.get(r, _NONE - 1) < i:
                    best[r] = i
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.int64()), pa.array(best.values(), pa.int64())], ["r", "top"])

    head = {r["r"]: r["top"] for r in ids.transform(map_arrow, tops, "r long, top long").groupBy("r").agg(F.max("top").alias("top")).collect()}
    used = sorted(head)
    guests: dict[int, list[int]] = {}  # id -> ranges before the one that it heads
    for i, r in enumerate(used):
        guests.setdefault(head[used[(i + 1) % len(used)]], []).append(r)
    heads = np.array(sorted(guests), np.int64)

    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy()
            rows, where, guest = [np.arange(len(x))], [place(x)], [np.zeros(len(x), np.int64)]
            for k in np.flatnonzero(np.isin(x, heads)):
                for r in guests[int(x[k])]:
                    rows.append(np.array([k]))
                    where.append(np.array([r]))
                    guest.append(np.array([1]))
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where), pa.int64()), pa.array(np.concatenate(guest), pa.int32()), batch.column(0).take(rows), batch.column(1).take(rows)], ["_range", "_guest", "doc_id", "text"])

    dealt = own.transform(map_arrow, deal, "_range long, _guest int, doc_id long, text string")
    return dealt.repartition(max(8, parts // 4), "_range").sortWithinPartitions("_range", "_guest", F.desc("doc_id"), "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``, as ``OUT`` says."""
    rank = corpus_ranks(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(rows: list[tuple[int, str]], nxt: tuple[int, str] | None):
        """Of rows and their successors; the last row's is ``nxt``."""
        after = [t for _, t in rows[1:]] + [nxt[1]]
        own = [t.encode("utf-8", "replace") for t in [*(t for _, t in rows), nxt[1]]]
        new = [edited(t, a).encode("utf-8", "replace") for (_, t), a in zip(rows, after)]
        d, e = digests(own, rank), digests(new, rank)
        out = [(None if i == _NONE else i, len(t), hashlib.sha256(n).hexdigest(), as_text(x), as_text(y), likeness(x, y), likeness(x, z)) for (i, t), n, x, y, z in zip(rows, new, d, e, d[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def stream(batches):
        rows, size, at, closed = [], 0, None, False
        for batch in batches:
            for where, guest, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if where != at:
                    at, closed = where, False
                if closed:
                    continue
                if guest:
                    yield compare(rows, (i, t))
                    rows, size, closed = [], 0, True
                    continue
                if size >= CHUNK:
                    yield compare(rows, (i, t))
                    rows, size = [], 0
                rows.append((i, t))
                size += len(t)

    return in_ranges(docs).select("_range", "_guest", "doc_id", "text").transform(map_arrow, stream, OUT)


def op9_fingerprints(spark, sf_dir):
    return fingerprints(read_table(spark, sf_dir, "documents"))
