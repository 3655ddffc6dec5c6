"""Exact duplicates by a tree-merge of sorted digest runs.

Each document gives (digest, id); ids deal documents into ``RUNS`` runs. A run is sorted by digest and
holds every digest once, with its count and its extreme identifier. The runs are merged in binomial rounds,
two levels of the tree at a time: runs whose numbers agree but for their last two bits exchange, and a
merge of up to ``FAN_IN`` sorted runs leaves one, until one logical run is left, spread over the cluster by
digest. A task sorts what it holds and aggregates it as a stream before the exchange and after it (no table
of digests is held), so a digest that a third of all rows share is one row per task after the first sort.

A digest is SHA-256, verified at every level by the length and an independent 64-bit hash: identifiers are
merged only where all three agree. The answers go back to the first level, at most ``RUNS`` rows of a
digest, and these join the documents by digest and run, so a digest's rows are spread by run.

Null text counts as empty. Of rows that also share the id, all count and one is kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, read_table

RUNS, FAN_IN = 64, 4
_KEY = ["_sha", "_len", "_xx"]


def fold_az(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_digest(docs: DataFrame) -> DataFrame:
    """``docs`` with the digest columns and the run of the first level."""
    text = fold_az(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({"_sha": F.sha2(text, 256), "_len": F.length(text), "_xx": F.xxhash64(text), "_run": F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(RUNS)).cast("int")})


def merged(digests: DataFrame, keep: str = "largest") -> tuple[DataFrame, DataFrame]:
    """First-level runs, and the single run that the rounds of merges leave: (run, digest, identifier, count)."""
    pick = F.max if keep == "largest" else F.min
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))
    # the extreme of a struct is aggregated in sorted order: sort, stream, exchange, sort, stream
    first = digests.groupBy("_run", *_KEY).agg(pick(own).alias("_best"), F.count("*").alias("_n"))
    run, level = RUNS, first
    while run > 1:
        run = -(-run // FAN_IN)
        level = level.groupBy(F.floor(F.col("_run") / FAN_IN).cast("int").alias("_run"), *_KEY).agg(pick("_best").alias("_best"), F.sum("_n").alias("_n"))
    return first, level.select(*_KEY, F.col("_best.doc_id").alias("_keep"), "_n")


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of ``docs(doc_id, text)``.

    ``kept`` is null-safe equality with ``keep_id``; rows of one text with the same id agree.
    """
    digests = materialise(with_digest(docs.select("doc_id", "text")).drop("text"), "digests")
    first, last = merged(digests, keep)
    down = first.select(*_KEY, "_run").join(last.select(*_KEY, "_keep", "_n"), _KEY)
    return digests.join(down, [*_KEY, "_run"]).select("doc_id", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all of its columns: one for each text."""
    names = docs.columns
    spot = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_spot")  # an id that joins by plain equality
    rows = with_digest(docs.select(F.struct(*names).alias("_row"), "doc_id", "text")).select("_row", "doc_id", spot, *_KEY, "_run")
    _, last = merged(rows.select("doc_id", *_KEY, "_run"), keep)
    best = last.select(*_KEY, F.coalesce(F.col("_keep").cast("string"), F.lit("")).alias("_spot"))
    left = rows.select("_row", *_KEY, "_spot").join(best, [*_KEY, "_spot"], "left_semi")
    # rows that also share the id are in one partition after the join: the first of them stays
    one = Window.partitionBy(*_KEY, "_spot").orderBy(F.xxhash64("_row"))
    return left.withColumn("_at", F.row_number().over(one)).where("_at = 1").select("_row.*").select(*names)


def op8_exact_dedup(spark, sf_dir):
    return exact_groups(read_table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
