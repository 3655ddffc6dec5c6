"""Self-join of documents on the Jaccard likeness of their five-word shingles, by chosen paths.

1. Each document becomes the set of hashes of its five-word shingles (of all its words, if fewer).
   Documents with equal sets are one representative with a multiplicity; copies go no further.
2. In each run, a representative walks a path of shared tokens: at each node, the token of its set
   that a hash function of that run and depth puts first. Two sets of likeness s choose the same
   token with probability s. Buckets start at depth two; one of more than ``SMALL`` sets is split by
   the third token, then by the fourth. ``RUNS`` is the number of runs after which a pair at 0.8 is
   found with ``RECALL`` even where every bucket has to be split to the end; where buckets are small
   it is missed with probability (1 - 0.8**2)**RUNS = 5e-6.
3. A small bucket is brute-forced: pairs whose 64-byte sketches agree in 0.6 or more (four standard
   deviations below 0.8) are counted exactly on the whole texts' shingle sets. A pair belongs to the first run in
   which its sets share a small bucket, so it is counted once, and a text goes only to buckets that
   have a pair of it to count: at most one for each run, however many near copies there are.
4. Sets that share a bucket which four tokens did not split are all but equal. Such buckets, joined where they
   share sets, are dense groups; every pair of a group is counted exactly, block against block of
   ``BLOCK`` sets, so no task holds an unbounded group. Buckets leave those pairs out.
5. Tasks return numbers of links and spanning trees of true links, never all pairs.

Likeness is |A & B| / |A | B| of the sets of 64-bit hashes; links need ``9 * |A & B| >= 4 * (|A| + |B|)``,
that is 0.8. Null and empty texts (no word) have no set, no link and a class of their own. Words are
runs of ``\\w`` of the lower-cased text. Rows with the same id are rows like any others.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, map_arrow, materialise, read_table, release

SHINGLE, DEPTH, SMALL, SKETCH, NEAR, RECALL = 5, 4, 64, 64, 38, 0.997
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - 0.8**DEPTH))  # 12; a run has DEPTH of the SKETCH hash functions
BLOCK, BLOCK_CHARS = 1024, 16 << 20
SPREAD, SALTS = 64, 16
WORD = re.compile(r"\w+")
_rng = np.random.default_rng(20)
_MULT = (_rng.integers(1, 1 << 62, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POLY = (_rng.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_words: dict[str, int] = {}
_WORDS_KEPT = 150_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MULT[0]
    h = h ^ (h >> np.uint64(29))
    h = h * _MULT[1]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [WORD.findall(t.lower()) for t in texts]
    if len(_words) > _WORDS_KEPT:
        _words.clear()
    for w in {w for ws in words for w in ws if w not in _words}:
        _words[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    get, out = _words.__getitem__, []
    for ws in words:
        h = np.fromiter(map(get, ws), np.uint64, len(ws))
        if len(h) > SHINGLE:
            n = len(h) - SHINGLE + 1
            s = h[:n] * _POLY[0]
            for k in range(1, SHINGLE):
                s = s + h[k : k + n] * _POLY[k]
        elif len(h):
            s = np.array([(h * _POLY[: len(h)]).sum(dtype=np.uint64) + np.uint64((SHINGLE - len(h)) << 7)], np.uint64)
        else:
            s = h
        out.append(np.unique(mix(s)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set that is not empty, ``SKETCH`` smallest 32-bit hashes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), SKETCH), np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for k in range(SKETCH):
        out[full, k] = np.minimum.reduceat(((flat * _MULT[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits that name each set."""
    return np.array([int(mix(np.array([s.sum(dtype=np.uint64) ^ mix(np.array([np.bitwise_xor.reduce(s) + np.uint64(len(s))]))[0]]))[0]) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


_PATH = pa.struct([("node", pa.int64()), ("c", pa.int32()), ("d", pa.int32())])
_TABLE = "doc_id long, th long, sid long, n long, paths array<struct<node: long, c: int, d: int>>, sketch binary"


def shingle_table(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: set key, set size, paths of all runs and the sketch."""

    def go(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
                sig, n = signatures(sets), np.array([len(s) for s in sets], np.int64)
                lead = sig[:, : RUNS * DEPTH].reshape(len(sets), RUNS, DEPTH).astype(np.uint64)
                node = mix(((lead[:, :, 0] << np.uint64(32)) | lead[:, :, 1]) + np.arange(RUNS, dtype=np.uint64) * _POLY[0])
                flat = pa.StructArray.from_arrays([pa.array(node.view(np.int64).ravel()), pa.array(lead[:, :, 2].astype(np.uint32).view(np.int32).ravel()), pa.array(lead[:, :, 3].astype(np.uint32).view(np.int32).ravel())], fields=list(_PATH))
                paths = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * RUNS), flat)
                sketch = pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(set_keys(sets)), pa.array(n), paths, sketch], ["doc_id", "th", "sid", "n", "paths", "sketch"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return own.transform(map_arrow, go, _TABLE)


def _tree(adjacent: np.ndarray) -> np.ndarray:
    """Least index of the component of each row of a symmetric matrix."""
    m = len(adjacent)
    label = np.arange(m)
    while True:
        low = np.where(adjacent, label[None, :], m).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def buckets(reps: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Small buckets as rows (leaf, r, sid), and edges (a, b) that span each bucket that could not be split."""
    rows = reps.select("sid", F.posexplode("paths").alias("r", "p")).select("sid", "r", "p.node", "p.c", "p.d")

    salt = F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int").alias("_salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")

    def sized(df, node):
        # a bucket that very many sets share is dealt over SALTS tasks; its count is combined before it moves
        counts = df.groupBy(node).agg(F.count("*").alias("_m")).where("_m > 1").select(node, "_m", salts)
        return df.select("*", salt).join(counts, [node, "_salt"]).drop("_salt")

    two = materialise(sized(rows, "node"), "depth2")
    three = two.where(f"_m > {small}").drop("_m").withColumn("node3", F.xxhash64("node", "c"))
    three = materialise(sized(three, "node3"), "depth3")
    four = three.where(f"_m > {small}").drop("_m").withColumn("node4", F.xxhash64("node3", "d"))
    four = materialise(sized(four, "node4"), "depth4")
    leaf = lambda df, node: df.where(f"_m <= {small}").select(F.col(node).alias("leaf"), "r", "sid")
    leaves = leaf(two, "node").unionByName(leaf(three, "node3")).unionByName(leaf(four, "node4"))
    rest = four.where(f"_m > {small}").select("node4", "sid")
    centre = rest.groupBy("node4").agg(F.min("sid").alias("b")).select("node4", "b", salts)
    whole = rest.select("*", salt).join(centre, ["node4", "_salt"]).where("sid <> b").select(F.col("sid").alias("a"), "b")
    return leaves, whole.distinct()


def _own_pairs(r: int, at: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Which pairs of a bucket of run ``r`` are counted there: not in an earlier run's bucket, nor in a dense group.

    ``at``: the buckets of each set by run, 0 for none; ``dense``: its dense group, 0 for none.
    """
    earlier = ((at[:, None, :r] == at[None, :, :r]) & (at[:, None, :r] != 0)).any(2)
    own = ~earlier & ((dense[:, None] != dense[None, :]) | (dense[:, None] == 0))
    np.fill_diagonal(own, False)
    return own


def to_verify(leaves: DataFrame) -> DataFrame:
    """``leaves(leaf, r, members array<struct<sid, sketch, at, dense>>)``: rows (leaf, r, sid, at, dense) of sets that have a pair to count there."""

    def go(batches):
        for batch in batches:
            out = []
            for leaf, r, members in zip(*(c.to_pylist() for c in batch.columns)):
                sk = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), SKETCH)
                near = (sk[:, None, :] == sk[None, :, :]).sum(2) >= NEAR
                if len(members) > 1 and near.sum() > len(members):
                    near &= _own_pairs(r, np.array([m["at"] for m in members], np.int64), np.array([m["dense"] for m in members], np.int64))
                    out += [(leaf, r, m["sid"], m["at"], m["dense"]) for m, any_ in zip(members, near.any(1)) if any_]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()))], ["leaf", "r", "sid", "at", "dense"])

    return leaves.transform(map_arrow, go, "leaf long, r int, sid long, at array<long>, dense long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    df = np.diff(np.concatenate([first, [len(token)]]))
    out = np.zeros((m, m), np.int64)
    for k in range(2, 9):  # tokens of a few sets: their pairs
        at = first[df == k]
        for i in range(k):
            for j in range(k):
                if i != j and len(at):
                    out += np.bincount(owner[at + i] * m + owner[at + j], minlength=m * m).reshape(m, m) if m <= 64 else _add(m, owner[at + i], owner[at + j])
    often = np.flatnonzero(df > 8)
    for lo in range(0, len(often), 4096):  # tokens of many sets: a matrix product
        part = often[lo : lo + 4096]
        x = np.zeros((m, len(part)), np.float32)
        for c, t in enumerate(part):
            x[owner[first[t] : first[t] + df[t]], c] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    np.fill_diagonal(out, 0)
    return out


def _add(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((m, m), np.int64)
    np.add.at(out, (a, b), 1)
    return out


_LINKS = "sid long, links long, tied long"


def _links(rows: list[tuple], own) -> tuple[list, list, list]:
    """Sets that link, their links and the set that stands for their component, among rows (sid, mult, text, ...);
    ``own`` says of the rows kept which pairs count."""
    sets = shingle_sets([r[2] or "" for r in rows])
    best = {rows[k][0]: k for k, key in enumerate(set_keys(sets).tolist()) if key == rows[k][0]}  # a set that more rows carry counts once
    rows, sets = [rows[k] for k in best.values()], [sets[k] for k in best.values()]
    if len(rows) < 2:
        return [], [], []
    n, mask = np.array([len(s) for s in sets]), own(rows)
    np.fill_diagonal(mask, False)
    pairs = np.argwhere(np.triu(mask))
    if len(pairs) <= 16:
        near = np.zeros_like(mask)
        for i, j in pairs:
            near[i, j] = near[j, i] = 9 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= 4 * (n[i] + n[j])
    else:
        near = mask & (9 * _common(sets) >= 4 * (n[:, None] + n[None, :]))
    links, label, keep = near @ np.array([r[1] for r in rows]), _tree(near), np.flatnonzero(near.any(1))
    return [rows[k][0] for k in keep], links[keep].tolist(), [rows[label[k]][0] for k in keep]


def _by_group(groups: DataFrame, width: int, own) -> DataFrame:
    """``groups`` in order of its first ``width`` columns, the rest (sid, mult, text, ...): links of each group."""

    def emit(got):
        return pa.RecordBatch.from_arrays([pa.array([x for g in got for x in g[k]], pa.int64()) for k in range(3)], ["sid", "links", "tied"])

    def go(batches):
        at, rows, got = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != at:
                    if len(rows) > 1:
                        got.append(_links(rows, lambda kept: own(at, kept)))
                    at, rows = row[:width], []
                rows.append(row[width:])
            if len(got) > 500:
                yield emit(got)
                got = []
        if len(rows) > 1:
            got.append(_links(rows, lambda kept: own(at, kept)))
        yield emit(got)

    return groups.transform(map_arrow, go, _LINKS)


def verified_buckets(rows: DataFrame) -> DataFrame:
    """``rows(leaf, r, sid, mult, text, at, dense)`` sorted by bucket: links of the pairs that the bucket counts."""
    return _by_group(rows, 2, lambda at, kept: _own_pairs(at[1], np.array([r[3] for r in kept], np.int64), np.array([r[4] for r in kept], np.int64)))


def verified_blocks(rows: DataFrame) -> DataFrame:
    """``rows(root, bi, bj, sid, mult, text, side)`` sorted by the first three: links of a block's pairs, or of those across two blocks."""

    def across(at, kept):
        side = np.array([r[3] for r in kept])
        if at[1] == at[2]:
            return np.ones((len(kept), len(kept)), bool)
        return side[:, None] != side[None, :]  # pairs inside one block are counted elsewhere

    return _by_group(rows, 3, across)


def near_classes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, class_id, n_links, n_shingles), one for each row of ``docs(doc_id, text)``.

    ``class_id``: smallest id of all documents that links connect; ``n_links``: documents at 0.8 or more.
    """
    table = materialise(shingle_table(docs), "shingles")
    real = table.where("n > 0")
    run = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SPREAD)).cast("int").alias("_run")
    one = real.groupBy("sid", "n").agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "th")).alias("at"), F.count("*").alias("mult"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    reps = materialise(one, "sets")
    leaves, whole = buckets(reps)
    leaves = materialise(leaves, "leaves")
    dense = connected_components(whole).select(F.col("v").alias("sid"), F.col("root").alias("dense"))
    places = F.array(*[F.coalesce(F.max(F.when(F.col("r") == k, F.col("leaf"))), F.lit(0)) for k in range(RUNS)])
    info = leaves.groupBy("sid").agg(places.alias("at")).join(reps.select("sid", "sketch"), "sid").join(dense, "sid", "left")
    info = info.select("sid", F.struct("sid", "sketch", "at", F.coalesce("dense", F.lit(0)).alias("dense")).alias("m"))
    full = leaves.join(info, "sid").groupBy("leaf", "r").agg(F.collect_list("m").alias("members"))  # at most SMALL
    pending = materialise(to_verify(full), "pending")
    need = pending.select("sid").unionByName(dense.select("sid")).distinct()
    cand = need.join(reps.select("sid", F.xxhash64("at.doc_id", "at.th").alias("_row"), "mult"), "sid")
    body = F.coalesce("text", F.lit(""))
    text = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(body)).alias("_row"), body.alias("text"))
    # a merge join at every size: candidates grow with the corpus, and so would a broadcast of them
    with_text = cand.hint("merge").join(text, "_row")
    # rows of equal id and text are one
    with_text = materialise(with_text.groupBy("_row", "sid", "mult").agg(F.first("text").alias("text")).drop("_row"), "texts")
    each = pending.join(with_text, "sid").select("leaf", "r", "sid", "mult", "text", "at", "dense")
    found = verified_buckets(each.repartition("leaf").sortWithinPartitions("leaf", "r"))
    grouped = with_text.join(dense.withColumnRenamed("dense", "root"), "sid")
    parts = grouped.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("nb"))
    blocks = grouped.join(parts, "root").withColumn("b", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
    blocks = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    blocks = blocks.select("root", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "sid", "mult", "text", F.when(F.col("b") > F.col("o"), 1).otherwise(0).alias("side"))
    across = verified_blocks(blocks.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj"))
    links = materialise(found.unionByName(across), "links")
    release(with_text, pending, leaves)
    classes = connected_components(links.select(F.col("sid").alias("a"), F.col("tied").alias("b")))
    degree = links.groupBy("sid").agg(F.sum("links").alias("links"))
    every = reps.select("sid", "doc", "mult").join(classes.select(F.col("v").alias("sid"), "root"), "sid", "left").join(degree, "sid", "left")
    every = materialise(every.withColumn("root", F.coalesce("root", "sid")), "every")
    name = every.groupBy("root").agg(F.min("doc").alias("class_id"))
    sets = every.join(name, "root").select("sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    # back to documents: a set that many share is one row for each of SPREAD parts
    part = real.select("sid", run).distinct().join(sets, "sid")
    got = real.select("doc_id", "th", "n", "sid", run).join(part, ["sid", "_run"])
    got = got.select("doc_id", "th", "class_id", "n_links", F.col("n").alias("n_shingles"))
    none = table.where("n = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    return got.unionByName(none)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that another stands for: of each class the smallest id stays.

    Rows without an id stay, and so do rows with the class's id.
    """
    gone = near_classes(docs.select("doc_id", "text")).where("doc_id <> class_id").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    tagged = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    left = tagged.join(gone.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("_th") == F.col("_t")), "left_anti")
    return left.select("_row.*").select(*docs.columns)


def op4_jaccard_join(spark, sf_dir):
    return near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")
