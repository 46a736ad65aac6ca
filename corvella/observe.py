"""Durations, memory and log fields: what is slow is a warning, what is secret isn't written."""

from __future__ import annotations

import logging
import resource
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

# The threshold of a slow operation and the names of fields that are never logged.
SLOW_MS = 500
HIDDEN = frozenset({"password", "token", "authorization", "apiKey", "api_key", "secret", "accessToken", "access_token", "refreshToken", "refresh_token"})

log = logging.getLogger("corvella")


def redacted(fields: Mapping) -> dict:
    """The fields with secret ones marked, at any depth."""
    return {k: "[Redacted]" if k in HIDDEN else redacted(v) if isinstance(v, Mapping) else v for k, v in fields.items()}


def peak_memory_mb() -> float:
    """Of this process so far; the executors' is in Spark's own metrics."""
    return round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 2)


@contextmanager
def timed(operation: str, **fields) -> Iterator[dict]:
    """Gives a dict that holds durationMs at the end; over SLOW_MS it is a warning, failures included."""
    out: dict = {}
    began = time.monotonic()
    try:
        yield out
    finally:
        out["durationMs"] = round(1000 * (time.monotonic() - began))
        slow = out["durationMs"] > SLOW_MS
        log.log(logging.WARNING if slow else logging.DEBUG, "%s operation %s took %d ms, peak memory %.0f MB %s", "slow" if slow else "", operation, out["durationMs"], peak_memory_mb(), redacted(fields))
