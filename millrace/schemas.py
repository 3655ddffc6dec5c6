"""Record layouts and configuration of the task store. Times are epoch milliseconds; all integers are BIGINT."""

from __future__ import annotations

from dataclasses import dataclass

JOB = """id STRING, queue STRING, payload_ref STRING, headers MAP<STRING, STRING>, status STRING, attempts BIGINT,
max_attempts BIGINT, enqueued_at BIGINT, claimed_at BIGINT, run_at BIGINT, woken_at BIGINT, wake_payload STRING,
priority BIGINT, last_error STRING, dedup_key STRING, completed_at BIGINT, failed_at BIGINT, cancel_requested BOOLEAN,
claim_token BIGINT, lease_expires_at BIGINT"""
ATTEMPT = "id STRING, queue STRING, attempt BIGINT, claimed_at BIGINT, recorded_at BIGINT, outcome STRING, error STRING"
KV = "key STRING, value STRING"
STATUSES = ("Pending", "Scheduled", "Claimed", "Done", "Dead")


@dataclass(frozen=True)
class QueueConfig:
    """What a queue does with its jobs; ``None`` retention keeps forever."""

    max_attempts: int = 3
    lease_ms: int = 30_000
    default_priority: int = 1000
    backoff_base_ms: int = 1_000
    backoff_max_ms: int = 300_000
    keep_done_ms: int | None = None
    dead_retention_ms: int | None = 604_800_000

    def __post_init__(self):
        for name in ("max_attempts", "lease_ms"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("keep_done_ms", "dead_retention_ms"):
            if (x := getattr(self, name)) is not None and x < 1:
                raise ValueError(f"{name} must be at least 1 ms")


@dataclass(frozen=True)
class RuntimeConfig:
    """Engine-wide settings."""

    promote_every_ms: int = 1_000
    reap_every_ms: int = 5_000
    offload_bytes: int | None = 262_144
    max_concurrent_steps: int = 16

    def __post_init__(self):
        if self.max_concurrent_steps < 1:
            raise ValueError("max_concurrent_steps must be at least 1")
