"""Document quality by hierarchical empirical Bayes.

* Evidence of a document: a logistic model over measures of its whole text (lengths, shares of
  character kinds, repetition of words and lines). It is fitted on at most ``SAMPLE`` labelled rows
  that are not held out (those whose id hashes lowest); the odds of its score are the evidence.
* Sites: each document's expected label (its label where it is labelled for training, else the
  classifier's probability) is summed over all documents by host (the source) and by path below it
  (the language), map-side first. A path's posterior shrinks to its host's and a host's to the global
  prior; the strengths of both priors come from the data by the method of moments.
* The result is the document's evidence on the odds of its path's posterior instead of the global one. The
  document itself is taken out of both sums first, so that it doesn't count twice; the only one of a site
  gets what its site shrinks to.
* A site that has a ``PARTS``-th of all documents or more (at most ``PARTS`` such) is joined in parts.

Null text counts as empty. Null source and null language are a host and a path of their own. Rows
with the same id and text agree. Without labels of both kinds the evidence is nil.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import copied, dealt, hot_keys, map_arrow, materialise, read_table

SAMPLE, PARTS, EVIDENCE = 20_000, 64, 6.0
WORD = re.compile(r"\w+")
_PUNCT = re.compile(r"[^\w\s]")


def measures(text: str) -> list[float]:
    """Numbers that describe the whole text; all within a few units of 0."""
    n = max(1, len(text))
    words = WORD.findall(text.lower())
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    k = max(1, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    top = counts.most_common(1)[0][1] if counts else 0
    repeated = sum(c for x, c in Counter(lines).items() if c > 1)
    upper = sum(map(str.isupper, text))
    return [
        math.log1p(len(words)) / 5, sum(map(len, words)) / k / 5, len(counts) / k, top / k, (pairs.most_common(1)[0][1] if pairs else 0) / k,
        upper / n * 5, sum(map(str.isdigit, text)) / n * 10, len(_PUNCT.findall(text)) / n * 10, text.count("!") / n * 20, text.count("|") / n * 20,
        repeated / max(1, len(lines)), math.log1p(len(lines)) / 3, k / max(1, len(lines)) / 40, float(len(words) < 20), len(zlib.compress(text.encode("utf-8", "replace"), 1)) / n,
        sum(c for _, c in pairs.items() if c > 2) / k,
        text.count("#") / n * 20, text.count("$") / n * 20, text.count("?") / n * 20, sum(1 for c in text if not c.isascii()) / n * 5,
    ]


WIDTH = len(measures(""))


def _design(x: np.ndarray, centre, scale) -> np.ndarray:
    """Standardised measures, their squares and products, and a constant."""
    z = np.clip((x - centre) / scale, -6, 6)
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j] / 3], 1)


class Model:
    def __init__(self, centre, scale, beta, base):
        self.centre, self.scale, self.beta, self.base = centre, scale, beta, base

    def evidence(self, rows: list[list[float]]) -> np.ndarray:
        """Log odds of each row beyond those of the sample, within ``EVIDENCE``."""
        if self.beta is None or not rows:
            return np.zeros(len(rows))
        return np.clip(_design(np.array(rows), self.centre, self.scale) @ self.beta - self.base, -EVIDENCE, EVIDENCE)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Model:
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, base)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    d = _design(x, centre, scale)
    beta = np.zeros(d.shape[1])
    beta[0] = base
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        g = d.T @ (p - y) + ridge * np.r_[0, beta[1:]]
        h = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(beta)) + 1e-9
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Model(centre, scale, beta, base)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def go(batches):
        for batch in batches:
            rows = [measures(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    got = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "quality").transform(map_arrow, go, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), WIDTH)
    order = np.lexsort((*x.T, y))  # the same sums however the rows arrive
    return fit(x[order], y[order])


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, source, lang, evidence) of ``docs``."""

    def go(batches):
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                out.append(model.evidence([measures(t or "") for t in batch.column(3).slice(at, 500).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "source", "lang", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "source", "lang", "text").transform(map_arrow, go, "doc_id long, source string, lang string, evidence double")


def _strength(sites: DataFrame, mean: str) -> F.Column:
    """Prior strength by moments: how many documents' worth a parent's mean counts in ``sites(n, s, <mean>)``."""
    m = F.col(mean)
    between = F.sum(F.col("n") * ((F.col("s") / F.col("n") - m) ** 2))
    within = F.sum(m * (1 - m))
    spread = (between - within) / F.sum("n")
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.sum(F.col("n") * m * (1 - m)) / F.sum("n") / F.greatest(spread, F.lit(1e-9))))


def sites(found: DataFrame, prior: float) -> tuple[DataFrame, float, float]:
    """Rows (_host, _path, n, s, host_n, host_s) of ``found(_host, _path, p)``: documents and their expected
    labels at a path and at its host; and the strengths of the priors of hosts and of paths."""
    paths = materialise(found.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("p"), 6).alias("s")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("m", F.lit(prior))
    a = hosts.agg(_strength(hosts, "m").alias("a")).first()["a"] or 1.0
    both = paths.join(hosts.select("_host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "_host")
    m = (F.col("host_s") + a * prior) / (F.col("host_n") + a)
    b = both.select("n", "s", m.alias("m")).transform(lambda df: df.agg(_strength(df, "m").alias("b"))).first()["b"] or 1.0
    return both, a, b


def shrunken(prior: float, a: float, b: float) -> tuple[F.Column, F.Column]:
    """Posterior of a document's host and path from the other documents there, over columns of ``sites`` and ``p``."""
    host = (F.col("host_s") - F.col("p") + a * prior) / (F.col("host_n") - 1 + a)
    path = (F.col("s") - F.col("p") + b * host) / (F.col("n") - 1 + b)
    inside = lambda x: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), x))
    return inside(host), inside(path)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, evidence, host_posterior, path_posterior, quality, kept), one for each row of ``docs``."""
    model = train(docs, labels)
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    found = materialise(evidence(docs, model), "evidence")
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_l")).agg(F.max(F.col("quality").cast("double")).alias("y"))
    found = found.select("doc_id", "evidence", key(F.col("source")).alias("_host"), key(F.col("lang")).alias("_path"), F.xxhash64("doc_id", "evidence", F.lit(9)).alias("_spread"))
    rows = found.join(known, F.col("doc_id") == F.col("_l"), "left").drop("_l")
    rows = rows.withColumn("p", F.coalesce("y", 1 / (1 + F.exp(-(F.col("evidence") + model.base)))))
    prior, by = 1 / (1 + math.exp(-model.base)), ["_host", "_path"]
    site, a, b = sites(rows, prior)
    site = materialise(site, "sites")
    hot = materialise(hot_keys(site.select(*by, "n"), by, PARTS), "hot")
    got = dealt(rows, hot, by, PARTS).join(copied(site, hot, by, PARTS), [*by, "_salt"])
    host, path = shrunken(prior, a, b)
    got = got.withColumns({"host_posterior": host, "path_posterior": path})
    z = F.col("evidence") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    got = got.withColumn("quality", 1 / (1 + F.exp(-z)))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= least).alias("kept"))


def op5_quality(spark, sf_dir):
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
