"""Column functions; every one stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MAX = 4_294_967_295
LEASE_MARGIN_MS = 5_000
RESERVED_HEADER = "workflow."
RESERVED_KEY = "workflow/"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def backoff_delay(attempts, base, most) -> Column:
    """``min(base * 2^(attempts - 1), most)``; the exponent and the power saturate at 32 bits, base 0 gives 0."""
    n = F.greatest(_c(attempts) - 1, F.lit(0))
    power = F.when(n >= 32, F.lit(U32_MAX)).otherwise(F.expr("1L") * F.pow(F.lit(2.0), F.least(n, F.lit(31))).cast("bigint"))
    return F.when(_c(base) <= 0, F.lit(0).cast("bigint")).otherwise(F.least(_c(base).cast("bigint") * power, _c(most).cast("bigint")))


def remaining_delay(stored_at, now, delay) -> Column:
    """What is left of a delay; both differences saturate at 0."""
    return F.greatest(_c(delay) - F.greatest(_c(now) - _c(stored_at), F.lit(0)), F.lit(0))


def cutoff(now, retention) -> Column:
    return F.greatest(_c(now) - _c(retention), F.lit(0))


def lease_extended(expiry, now, remaining, margin: int = LEASE_MARGIN_MS) -> Column:
    """A lease that covers ``remaining`` more plus a margin; never shorter than it is."""
    return F.greatest(_c(expiry), _c(now) + _c(remaining) + margin)


def sha256_hex(x) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def run_marker_key(ts, run_id) -> Column:
    """Zero-padded time, slash, run id: oldest first in key order."""
    return F.concat(F.lit("workflow/terminals/"), F.lpad(_c(ts).cast("string"), 20, "0"), F.lit("/"), _c(run_id))


def result_marker_name(ts, job_id) -> Column:
    """Inverted time, underscore, job id: newest first in name order."""
    inverted = F.lit("18446744073709551615").cast("decimal(20,0)") - _c(ts).cast("decimal(20,0)")
    return F.concat(F.lpad(inverted.cast("decimal(20,0)").cast("string"), 20, "0"), F.lit("_"), _c(job_id))


def parse_result_marker(name) -> Column:
    """Time of a result marker; NULL where the name is none."""
    head = F.regexp_extract(_c(name), r"\A([0-9]{20})_.+", 1)
    return F.when(head != "", (F.lit("18446744073709551615").cast("decimal(20,0)") - head.try_cast("decimal(20,0)")).cast("bigint"))


def valid_id(x) -> Column:
    """1 to 128 of the characters that ids may have; no trailing newline slips through."""
    return F.coalesce(_c(x).rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def valid_queue_name(x) -> Column:
    """1 to 255 bytes."""
    return F.coalesce((F.octet_length(_c(x)) >= 1) & (F.octet_length(_c(x)) <= 255), F.lit(False))


def http_class(status) -> Column:
    """2xx success; 4xx but 408 and 429 permanent; all else transient."""
    s = _c(status)
    return F.when((s >= 200) & (s < 300), "success").when((s >= 400) & (s < 500) & ~s.isin(408, 429), "permanent").otherwise("transient")


def timeout_ms(header, default: int = 30_000) -> Column:
    """Timeout of a request from its header; NULL where the header is no number."""
    return F.when(_c(header).isNull(), F.lit(default).cast("bigint")).otherwise(F.when(_c(header).rlike(r"\A[0-9]+\z"), _c(header).try_cast("bigint")))


def step_number(header) -> Column:
    """An unsigned 32-bit step number, else NULL."""
    n = F.when(_c(header).rlike(r"\A\+?[0-9]{1,19}\z"), _c(header).try_cast("bigint"))
    return F.when(n.between(0, U32_MAX), n)


def user_headers(headers) -> Column:
    """Headers without the reserved ones."""
    return F.map_filter(_c(headers), lambda k, _: ~F.startswith(k, F.lit(RESERVED_HEADER)))


def offloaded(payload_bytes, threshold: int | None) -> Column:
    """Whether a payload of so many bytes goes to the object store; no threshold, never."""
    return F.lit(False) if threshold is None else _c(payload_bytes) > threshold


def word_count(text) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+")).cast("bigint")


def key_field(x) -> Column:
    """Order-preserving hex of a non-negative integer: 16 digits."""
    return F.lpad(F.hex(_c(x)), 16, "0")


def parse_key_field(x) -> Column:
    return F.conv(_c(x), 16, 10).cast("bigint")


def effect_verdict(sealed, key, value_bytes, conflicts, most: int = 262_144) -> Column:
    """First rule that a staged effect breaks: sealed, reserved prefix, size, conflict."""
    return F.when(_c(sealed), "sealed").when(F.startswith(_c(key), F.lit(RESERVED_KEY)), "reserved").when(_c(value_bytes) > most, "too_large").when(_c(conflicts), "conflict").otherwise("ok")
