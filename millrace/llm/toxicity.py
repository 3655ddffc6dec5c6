"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

Training uses labelled rows only, at most ``SAMPLE`` of them (those whose id hashes lowest):
* Words, and beginnings of longer words (stems), that occur after many different words in toxic documents and
  hardly ever in others become the lexicon. Counting by left neighbour keeps the words of one much
  copied document out.
* The trie of the lexicon is intersected with a Levenshtein automaton (one edit for entries of five
  characters or more, not in the first character); states are made deterministic as words need them.
* A hit counts less the more its window looks like a quotation (quotation marks around it, words of
  reporting or of mention near it).
* Weights of (entry, edits) are shrunken log odds in the sample; a logistic of their sum is the score.

Null text counts as empty; a text without hits gets the score of no evidence. Rows with the same id
and text agree. Without labels of both kinds nothing is learned and every score is one low value.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialise, read_table

SAMPLE = 20_000
FUZZY_FROM, QUOTED, NEAR = 5, 0.85, 6
WORD = re.compile(r"\w+")
# characters put for letters, and what a word that has some goes on with
_MASK, _REST = re.compile(r"[0-9*@$!]"), re.compile(r"[\w*@$!]*")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_OPEN, _CLOSE = "\"“„«‹‘'”", "\"”“»›’'"
_WITHIN = re.compile(r"(?<=\w)['’](?=\w)")
# words that report or mention what others say
_MENTION = frozenset("said says say called calls calling quote quoted quotes word words term wrote writes mean means meaning spelled dit disait mot appelle sagte sagt wort nannte genannt dijo dice palabra llamó".split())
_WORDS_KEPT = 150_000


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- lexicon and automaton


class Lexicon:
    """Entries (text, is_stem) as a trie, with the automaton of all words near an entry."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, (text, _) in enumerate(entries):
            at = 0
            for c in text:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                at = self.kids[at][c]
            self.ends[at].append(i)
        # the most edits that an entry below a node allows
        self.allowed = [0] * len(self.kids)
        for text, _ in entries:
            at = 0
            for c in text:
                at = self.kids[at][c]
                self.allowed[at] = max(self.allowed[at], int(len(text) >= FUZZY_FROM))
        self.start()

    def start(self):
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.known: dict[str, tuple[int, int] | None] = {}
        self.first = self._id(frozenset({(0, 0, -1)}))

    def __getstate__(self):
        return {"entries": self.entries}

    def __setstate__(self, state):
        self.__init__(state["entries"])

    def _id(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
        return self.ids[states]

    def _move(self, states: frozenset, c: str) -> frozenset:
        """States are (node, edits, stem); stem is -1 inside the trie, -2 - i where stem i is complete
        and i once more followed it, which takes any rest."""
        out = set()
        for node, e, stem in states:
            if stem != -1:
                out.add((node, e, stem if stem >= 0 else -2 - stem))
                continue
            kid = self.kids[node].get(c)
            if kid is not None:
                out.add((kid, e, -1))
            if node and e < 1:
                if self.allowed[node]:
                    out.add((node, 1, -1))  # an extra character
                for k, n in self.kids[node].items():
                    if self.allowed[n]:
                        if k != c:
                            out.add((n, 1, -1))  # another character
                        after = self.kids[n].get(c)
                        if after is not None:
                            out.add((after, 1, -1))  # a missing character
        for node, e, stem in list(out):
            if stem == -1:
                out.update((0, e, -2 - i) for i in self.ends[node] if self.entries[i][1] and (not e or len(self.entries[i][0]) >= FUZZY_FROM))
        # of the same place, the fewest edits do
        return frozenset(s for s in out if s[1] == 0 or (s[0], 0, s[2]) not in out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the nearest entry; with as many edits, the longest, then the first."""
        if word in self.known:
            return self.known[word]
        at = self.first
        for c in word:
            nxt = self.moves[at].get(c)
            if nxt is None:
                nxt = self.moves[at][c] = self._id(self._move(self.sets[at], c))
            at = nxt
            if not self.sets[at]:
                break
        best = None
        for node, e, stem in self.sets[at]:
            if stem < -1:
                continue
            for i in [stem] if stem >= 0 else self.ends[node] + [j for c, n in (self.kids[node].items() if e < 1 and node else ()) for j in self.ends[n] if self.allowed[n]]:
                d = e if stem >= 0 or i in self.ends[node] else e + 1  # the last character may be missing
                text, is_stem = self.entries[i]
                if (is_stem and stem == -1) or (d and len(text) < FUZZY_FROM):
                    continue
                key = (d, -len(text), i)
                if best is None or key < best:
                    best = key
        out = None if best is None else (best[2], best[0])
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        if len(self.sets) > _WORDS_KEPT:
            known = self.known
            self.start()
            self.known = known
        self.known[word] = out
        return out


def quotation(text: str, spans: list[tuple[int, int]], k: int) -> float:
    """How much the window around word ``k`` looks like a quotation or a mention, 0 to 1."""
    s, e = spans[k]
    lo, hi = spans[max(0, k - NEAR)][0], spans[min(len(spans) - 1, k + NEAR)][1]
    before, after = text[lo:s].rpartition("\n")[2], text[e : hi + 2].partition("\n")[0]
    # an apostrophe between letters is no quotation mark
    before, after = _WITHIN.sub("", before), _WITHIN.sub("", after)
    score = 0.0
    if any(q in before for q in _OPEN) and any(q in after for q in _CLOSE):
        score += 0.6
    if any(text[a:b].lower() in _MENTION for a, b in spans[max(0, k - NEAR) : k + NEAR + 1]):
        score += 0.4
    return min(1.0, score)


def masked_words(low: str) -> list[tuple[int, str]]:
    """Start and plain form of each word that has other characters in place of some letters."""
    out, end = [], 0
    for m in _MASK.finditer(low):
        a = m.start()
        if a < end:
            continue
        lo = a
        while lo > end and (low[lo - 1].isalnum() or low[lo - 1] == "_"):
            lo -= 1
        end = _REST.match(low, a).end()
        run = low[lo:end].strip("!*")
        plain = run.translate(_PLAIN)
        if plain != run or "*" in run:
            out.append((lo, plain))
    return out


def hits(text: str, lexicon: Lexicon) -> tuple[dict[tuple[int, int], float], int]:
    """For each (entry, edits) of the whole text: the sum of what quotation leaves of its hits; the number of words."""
    low = text.lower()
    words = WORD.findall(low)
    match, known = lexicon.match, lexicon.known
    at = [(i, (i, words[i])) for i, w in enumerate(words) if (known[w] if w in known else match(w)) is not None]
    masked = [(a, t) for a, t in masked_words(low) if match(t) is not None]
    if not at and not masked:
        return {}, len(words)
    spans = [m.span() for m in WORD.finditer(low)]
    same = len(low) == len(text)
    hit = {i for i, _ in at}
    found = [(i, match(w)) for i, (_, w) in at]
    for start, t in masked:  # a masked word counts as an edited one, at the first of its parts
        i = bisect.bisect_right(spans, (start, 1 << 60)) - 1
        i = max(i, 0) if spans and i >= 0 and spans[i][1] > start else i + 1
        if i < len(spans) and i not in hit:
            found.append((i, (match(t)[0], 1)))
            hit.add(i)
    out: dict[tuple[int, int], float] = defaultdict(float)
    for i, key in found:
        out[key] += 1 - QUOTED * quotation(text if same else low, spans, i)
    return dict(out), len(words)


# ---------------------------------------------------------------- training


def _words_of(rows: DataFrame) -> DataFrame:
    """``rows(text, toxic)``: for each word and class, 64 left-neighbour flags and the occurrences."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        import zlib

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left = 0
                for w in WORD.findall((text or "").lower()):
                    own = seen.get(w)
                    if own is None:
                        own = seen[w] = [0, 0, 0, 0]
                    own[2 * y] |= 1 << left
                    own[2 * y + 1] += 1
                    left = zlib.crc32(w.encode("utf-8", "replace")) & 63
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        items = list(seen.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part]), *(pa.array([sign(v[k]) for _, v in part], pa.int64()) for k in range(4))], ["w", "cm", "cn", "tm", "tn"])

    one = rows.transform(map_arrow, count, "w string, cm long, cn long, tm long, tn long")
    return one.groupBy("w").agg(F.bit_or("cm").alias("cm"), F.sum("cn").alias("cn"), F.bit_or("tm").alias("tm"), F.sum("tn").alias("tn"), F.lit(1).alias("kinds"))


def _strong(stats: DataFrame, share: float) -> DataFrame:
    """Of ``stats(cm, tm)``: what is seen after many words in toxic documents, and hardly elsewhere."""
    # how many left neighbours, from how many of the 64 flags are up
    t, c = (-64 * F.log(1 - F.least(F.bit_count(m), F.lit(63.5)) / 64) for m in ("tm", "cm"))
    part = t / (t + c)
    llr = t * F.log(part / share) + F.when(c > 0, c * F.log((1 - part) / (1 - share))).otherwise(0.0)
    return stats.where("tn > 0").withColumn("t", t).withColumn("llr", llr).where((part >= 0.8) & (F.col("llr") >= 14))


def learn_entries(words: DataFrame, share: float) -> list[tuple[str, bool]]:
    """Lexicon entries from the word counts of the sample, which bounds them."""
    top = lambda df: df.collect()
    strong = {r["w"]: r["tn"] for r in top(_strong(words, share)) if len(r["w"]) >= 3}
    begin = words.where("length(w) > 3").select("*", F.explode(F.sequence(F.lit(3), F.least(F.lit(9), F.length("w") - 1))).alias("k"))
    begin = begin.groupBy(F.expr("substring(w, 1, k)").alias("w")).agg(F.bit_or("cm").alias("cm"), F.bit_or("tm").alias("tm"), F.sum("cn").alias("cn"), F.sum("tn").alias("tn"), F.count("*").alias("kinds"), F.max("tn").alias("most"))
    stems = {r["w"]: r for r in top(_strong(begin, share).where("kinds >= 4 and most < 0.8 * tn"))}
    chosen: list[str] = []
    for s in sorted(stems, key=len):
        if any(s.startswith(c) for c in chosen) or sum(stems[c]["tn"] for c in chosen if c.startswith(s)) >= 0.97 * stems[s]["tn"]:
            continue
        # as long as a longer beginning covers nearly the same occurrences, it is the better one
        while longer := [x for x in stems if len(x) == len(s) + 1 and x.startswith(s) and stems[x]["tn"] >= 0.97 * stems[s]["tn"]]:
            s = longer[0]
        chosen.append(s)
    return [(s, True) for s in chosen] + [(w, False) for w in sorted(strong) if not any(w.startswith(s) for s in chosen)]


class Model:
    """Lexicon, weights of (entry, edits), and the logistic of their sum."""

    def __init__(self, entries, weights, rates, slope, base):
        self.lexicon, self.weights, self.rates, self.slope, self.base = Lexicon(entries), weights, rates, slope, base

    def evidence(self, found: dict[tuple[int, int], float], words: int) -> float:
        """Sum of weights; of each (entry, edits) up to three hits beyond what so long a clean text has."""
        return sum(self.weights.get(k, 0.0) * max(0.0, min(n - 2 * words * self.rates.get(k, 0.0), 3.0)) for k, n in found.items())

    def score(self, text: str) -> float:
        z = self.evidence(*hits(text, self.lexicon))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * z))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows that are not held out; at most ``sample`` of them."""
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic"), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    odds = math.log((pos + 0.5) / (neg + 0.5))
    if not pos or not neg:
        return Model([], {}, {}, 1.0, min(odds, -2.0))  # nothing is learned, so nothing is toxic
    words = materialise(_words_of(rows), "words")
    total = words.agg(F.sum("tn").alias("t"), F.sum("cn").alias("c")).first()
    share = min(0.5, max(0.01, (total["t"] or 0) / max(1, (total["t"] or 0) + (total["c"] or 0))))
    entries = learn_entries(words, share)
    lexicon = Lexicon(entries)

    def look(batches):
        for batch in batches:
            found = [hits(t or "", lexicon) for t in batch.column(0).to_pylist()]
            keys = [[(i, d, n) for (i, d), n in f.items()] for f, _ in found]
            kind = pa.struct([("i", pa.int32()), ("d", pa.int32()), ("n", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([[dict(zip("idn", k)) for k in ks] for ks in keys], pa.list_(kind)), pa.array([k for _, k in found], pa.int64())], ["y", "f", "words"])

    got = rows.transform(map_arrow, look, "y int, f array<struct<i: int, d: int, n: double>>, words long").where("size(f) > 0").collect()
    by: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.0, 0.0])
    rates: dict[tuple[int, int], float] = defaultdict(float)
    for r in got:
        for k in r["f"]:
            by[k["i"], k["d"]][r["y"]] += 1
            if not r["y"]:
                rates[k["i"], k["d"]] += k["n"] / max(1, total["c"])
    weights: dict[tuple[int, int], float] = {}
    for i in range(len(entries)):
        for d in (0, 1):
            c, t = by[i, d]
            prior = 4.0 if d == 0 else weights[i, 0] * 0.75  # what a hit is taken to say before any was seen
            seen = math.log((t + 0.5) / (c + 0.5)) - odds
            weights[i, d] = max(0.0, min(8.0, (prior * 2 + seen * (t + c)) / (2 + t + c)))
    model = Model(entries, weights, dict(rates), 1.0, odds)
    x = [model.evidence({(k["i"], k["d"]): k["n"] for k in r["f"]}, r["words"]) for r in got] + [0.0, 0.0]
    y = [float(r["y"]) for r in got] + [0.0, 1.0]
    quiet = n[0] - sum(r["y"] == 0 for r in got), n[1] - sum(r["y"] == 1 for r in got)
    x, y, w = np.array(x), np.array(y), np.array([1.0] * len(got) + [quiet[0] + 1e-3, quiet[1] + 1e-3])
    model.slope, _ = _logistic(np.minimum(x, 12.0), y, w)
    model.base = -model.slope * _boundary(x[: len(got)], y[: len(got)])
    return model


def _boundary(x: np.ndarray, y: np.ndarray, place: float = 0.55) -> float:
    """Evidence that parts the classes with the fewest errors: a place inside the widest such interval."""
    if not len(x):
        return 3.0
    order = np.argsort(x, kind="stable")
    x, y = np.concatenate([[0.0], x[order]]), np.concatenate([[0.0], y[order]])
    wrong = np.cumsum(y)[:-1] + (np.sum(y == 0) - np.cumsum(y == 0))[:-1]  # cut after each place but the last
    gap = np.where(wrong == wrong.min(), np.diff(x), -1.0)
    k = int(gap.argmax())
    return float(x[k] + place * (x[k + 1] - x[k])) if gap[k] > 0 else float(x[k]) + 0.5


def _logistic(x, y, w, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton steps; the slope is held near 1 by a weak prior."""
    a, b = 1.0, -3.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() + 4 * (a - 1), r.sum() + 0.5 * (b + 3)])
        h = np.array([[(v * x * x).sum() + 4, (v * x).sum()], [(v * x).sum(), v.sum() + 0.5]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


# ---------------------------------------------------------------- application


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) of ``docs(doc_id, text)``."""

    def go(batches):
        for batch in batches:
            p = [model.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, go, "doc_id long, score double")


def reject_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all of its columns."""
    at = docs.columns.index("text")

    def go(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") < least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.transform(map_arrow, go, docs.schema)


def op1_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
