"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a maximal run of ``SHORTEST`` secret characters or more outside the spans of the patterns;
a run that such a span cuts gives a candidate on either side. The network sees the whole candidate (in
overlapping windows when it is long; the best counts) and the characters around it. It is trained in
numpy on labelled findings that ``labelled_findings`` writes from formats and from a seed, on all of
their windows; findings that training does not see calibrate the scores (a logistic of the raw score)
and give the threshold, the largest that keeps ``RECALL`` of the true ones. Spans of the patterns always
stay. Work is linear in the text. Null text counts as empty; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, read_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
RECALL, SHORTEST = 0.985, 12
BODY, SIDE, WIDE, FILTERS = 48, 20, 5, 24
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
_CLASS = np.zeros(256, np.int64)  # 0: padding
for _i, _c in enumerate(string.ascii_letters + string.digits + "+/_.=-:\"' @#(),"):
    _CLASS[ord(_c)] = _i + 1
_OTHER = int(_CLASS.max()) + 1
_CLASS[(_CLASS == 0) & (np.arange(256) > 0)] = _OTHER
CLASSES = _OTHER + 1
# what the network sees of a class: the letter in either case or the other character, and its kind (capital, digit)
_SEEN = np.zeros((CLASSES, CLASSES - 26 + 2))
for _i in range(1, CLASSES):
    _SEEN[_i, _i if _i <= 26 else _i - 26] = 1
_SEEN[27:53, -2] = 1
_SEEN[53:63, -1] = 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and not overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Runs of secret characters outside ``taken``, spans in order of their starts; one pass over both."""
    out, at = [], 0

    def put(lo: int, hi: int) -> None:
        while hi > lo and text[hi - 1] in ".-_/+":
            hi -= 1
        while lo < hi and text[lo] in ".-_/+":
            lo += 1
        if hi - lo >= SHORTEST:
            out.append((lo, hi))

    for m in _RUN.finditer(text):
        lo, hi = m.span()
        while at < len(taken) and taken[at][0] < hi:
            start, _, end = taken[at]
            if end > lo:
                put(lo, min(start, hi))
                lo = max(lo, end)
                if lo >= hi:
                    break  # the span may reach into the next run
            at += 1
        put(lo, hi)
    return out


def windows(text: str, lo: int, hi: int) -> list[str]:
    """Windows of one candidate: context, body, context, each of a fixed width."""
    left = text[max(0, lo - SIDE) : lo].rjust(SIDE, "\0")
    right = text[hi : hi + SIDE].ljust(SIDE, "\0")
    body = text[lo:hi]
    starts = [0] if len(body) <= BODY else [*range(0, len(body) - BODY, 32), len(body) - BODY]
    return [left + body[s : s + BODY].ljust(BODY, "\0") + right for s in starts]


def encode(ws: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(ws).encode("latin-1", "replace"), np.uint8)
    return _CLASS[raw].reshape(len(ws), 2 * SIDE + BODY)


class CharNet:
    """One convolution over characters, pooled over the body (largest, mean) and the context (largest)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.25, (WIDE, _SEEN.shape[1], FILTERS))
        self.b = np.zeros(FILTERS)
        self.v = rng.normal(0, 0.2, 3 * FILTERS)
        self.c = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _conv(self, x):
        n = x.shape[1] - WIDE + 1
        of_class = _SEEN @ self.w
        z = self.b + sum(of_class[k][x[:, k : k + n]] for k in range(WIDE))
        mid = x[:, WIDE // 2 : WIDE // 2 + n] > 0
        body = np.zeros(n, bool)
        body[SIDE - WIDE // 2 : SIDE + BODY - WIDE // 2] = True
        return np.maximum(z, 0), mid & body, mid & ~body

    def _pool(self, x):
        z, body, side = self._conv(x)
        zb, zs = z * body[..., None], z * side[..., None]
        n = np.maximum(body.sum(1), 1)[:, None]
        return z, body, side, zb, zs, n, np.concatenate([zb.max(1), zb.sum(1) / n, zs.max(1)], 1)

    def raw(self, x):
        return self._pool(x)[-1] @ self.v + self.c

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -40, 40)))

    def fit(self, x, y, epochs: int = 14, batch: int = 128, rate: float = 0.01, seed: int = 5):
        rng = np.random.default_rng(seed)
        params = [self.w, self.b, self.v, np.array([self.c])]
        m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                z, body, side, zb, zs, n, pooled = self._pool(x[own])
                d = (1 / (1 + np.exp(-np.clip(pooled @ self.v + params[3][0], -40, 40))) - y[own]) / len(own)
                g = d[:, None] * self.v
                gz = body[..., None] * (g[:, FILTERS : 2 * FILTERS] / n)[:, None, :]
                i, f = np.arange(len(own))[:, None], np.arange(FILTERS)[None]
                np.add.at(gz, (i, zb.argmax(1), f), g[:, :FILTERS] * (zb.max(1) > 0))
                np.add.at(gz, (i, zs.argmax(1), f), g[:, 2 * FILTERS :] * (zs.max(1) > 0))
                gz *= z > 0
                flat, gw = gz.reshape(-1, FILTERS), np.zeros_like(self.w)
                for k in range(WIDE):
                    hot = np.zeros((flat.shape[0], CLASSES))
                    hot[np.arange(flat.shape[0]), x[own][:, k : k + z.shape[1]].ravel()] = 1
                    gw[k] = _SEEN.T @ (hot.T @ flat)
                t += 1
                for j, grad in enumerate((gw, flat.sum(0), pooled.T @ d + 1e-4 * self.v, np.array([d.sum()]))):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    s[j] = 0.999 * s[j] + 0.001 * grad**2
                    params[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
        self.c = float(params[3][0])
        return self

    def calibrate(self, x, y, owner, recall: float = RECALL):
        """Logistic of the raw score, then the largest threshold that keeps ``recall`` of the findings.

        ``owner`` numbers the candidate of each window.
        """
        r = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -40, 40)))
            a -= 0.05 * float(((p - y) * r).mean() + 0.01 * (a - 1))
            b -= 0.05 * float((p - y).mean())
        self.scale, self.shift = a, b
        best = np.zeros(int(owner.max()) + 1)
        np.maximum.at(best, owner[y == 1], self.score(x)[y == 1])
        found = np.sort(best[np.unique(owner[y == 1])])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
        return self


def labelled_findings(n: int = 3600, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): secrets in the usual formats, and long tokens that are none."""
    rng = np.random.default_rng(seed)

    def of(chars: str, lo: int, hi: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(lo, hi + 1)))

    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alnum, hexa = low + up + dig, "0123456789abcdef"
    word = lambda: "".join("bcdfghlmnprstv"[rng.integers(14)] + "aeiou"[rng.integers(5)] for _ in range(rng.integers(1, 5)))
    part = "the and ing tion ion ent er en ung keit lich sch ein der die und que ment con por est los las ado ant for her ver ge be re un an in is or al ar es te de sh sch ch tz pf ck th ns ss zu ach ich auf aus wh ly ble ght str qu ll rr tt".split()
    begin, vowel = "b br c ch cl d dr f fl g gr h j k kl l m n p pf ph pl pr qu r s sch sh sp st str t th tr tz v w wh z".split(), "a e i o u ai au ea ei eu ie oo ou".split()
    close = "b ch ck d ff g l ld ll m n nd ng nt p r rd rn rt s ss st t th tz x".split()
    one = lambda of: of[rng.integers(len(of))]
    syllable = lambda: (one(begin) if rng.random() < 0.85 else "") + one(vowel) + (one(close) if rng.random() < 0.5 else "")
    long_word = lambda: "".join(one(part) if rng.random() < 0.5 else syllable() for _ in range(rng.integers(4, 8)))
    b64 = lambda k: base64.b64encode(rng.bytes(k)).decode()
    good = [
        lambda: of(hexa, 32, 64), lambda: of(hexa, 16, 40), lambda: "AKIA" + of(up + dig, 16, 16), lambda: b64(int(rng.integers(18, 48))),
        lambda: f"{of(low, 2, 3)}_{of(alnum, 28, 40)}", lambda: f"sk-{of(alnum, 24, 48)}", lambda: f"eyJ{of(alnum, 17, 30)}.eyJ{of(alnum, 30, 50)}.{of(alnum + '-_', 30, 43)}",
        lambda: of(alnum, 20, 40), lambda: f"xox{'bp'[rng.integers(2)]}-{of(dig, 10, 12)}-{of(alnum, 20, 24)}", lambda: of(alnum + "+/", 40, 40),
        lambda: of(up, 20, 40), lambda: of(low, 24, 40), lambda: of(up + dig, 20, 36), lambda: of(low + dig, 20, 36),
    ]
    bad = [
        lambda: "_".join(word() for _ in range(rng.integers(2, 5))) + of(dig, 1, 2), lambda: word() + "".join(word().title() for _ in range(rng.integers(2, 4))),
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}T{rng.integers(24):02}", lambda: "/".join(word() for _ in range(rng.integers(2, 5))) + f"/{rng.integers(1, 99)}.html",
        lambda: f"{rng.integers(1, 20)}.{rng.integers(30)}.{rng.integers(99)}-{word()}.{word()}", lambda: f"www.{word()}{rng.integers(9)}.{word()}.com", lambda: of(dig, 12, 20),
        lambda: f"+{rng.integers(1, 99)}-{rng.integers(100, 999)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}", lambda: f"{word()}{word()}-{rng.integers(100)}.{word()}", lambda: f"{word()}.{word().title()}", lambda: "=" * 4 + of(dig, 1, 2) + "-" * 12,
        lambda: f"{rng.integers(1000)}.{rng.integers(1000, 99999)}e-{rng.integers(10)}{word()}", lambda: long_word(), lambda: long_word(), lambda: long_word().upper(), lambda: long_word().upper(), lambda: long_word().upper(), lambda: f"{long_word()}-{long_word()}", lambda: long_word().title() + ".",
        lambda: "-=_."[rng.integers(4)] * int(rng.integers(12, 60)),
    ]
    lead = ["key: ", "secret = ", "Authorization: Bearer ", "aws_secret_access_key=", "client_secret '", "auth ", "pwd:", "private ", ""]
    out = []
    while len(out) < n:
        label = int(rng.random() < 0.5)
        body = (good if label else bad)[rng.integers(len(good if label else bad))]()
        before = " ".join(word() for _ in range(rng.integers(0, 6))) + " "
        if rng.random() < (0.5 if label else 0.08):
            before += lead[rng.integers(len(lead))]
        text = before + body + " " + " ".join(word() for _ in range(rng.integers(0, 6)))
        if len(body) >= SHORTEST:
            out.append((text, len(before), len(before) + len(body), label))
    return out


_model: list[CharNet] = []


def trained() -> CharNet:
    """The network, trained once in this process; the same each time."""
    if not _model:
        rows = [(w, label, k) for k, (text, lo, hi, label) in enumerate(labelled_findings()) for w in windows(text, lo, hi)]
        x, y, owner = encode([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
        cut = int(np.searchsorted(owner, 3 * (owner[-1] + 1) // 4))
        _model.append(CharNet().fit(x[:cut], y[:cut]).calibrate(x[cut:], y[cut:], owner[cut:]))
    return _model[0]


def scan(texts: list[str], net: CharNet) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text."""
    found = [base_spans(t) for t in texts]
    owner, ws = [], []
    for i, t in enumerate(texts):
        for lo, hi in candidates(t, found[i]):
            own = windows(t, lo, hi)
            ws += own
            owner += [(i, lo, hi)] * len(own)
    best: dict[tuple, float] = {}
    for at in range(0, len(ws), 512):
        for key, p in zip(owner[at : at + 512], net.score(encode(ws[at : at + 512]))):
            best[key] = max(best.get(key, 0.0), float(p))
    for (i, lo, hi), p in best.items():
        if p >= net.threshold:
            found[i].append((lo, 3, hi))
    return [sorted(f) for f in found]


def find_secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """Rows (doc_id, spans array<struct<start, kind, stop>>) of ``docs(doc_id, text)``; code points."""
    net = net or trained()
    span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())])

    def go(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = scan([t or "" for t in part.column(1).to_pylist()], net)
                rows = [[{"start": s, "kind": KINDS[k], "stop": e} for s, k, e in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, go, "doc_id long, spans array<struct<start: long, kind: string, stop: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of what ``find_secrets`` returns."""
    said = lambda which: F.concat_ws(",", F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op10_secret_scan(spark, sf_dir):
    return digest(find_secrets(read_table(spark, sf_dir, "documents")))


def base_digest(text: str | None) -> str:
    """``base_sha256`` of one text."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text or "")).encode()).hexdigest()
