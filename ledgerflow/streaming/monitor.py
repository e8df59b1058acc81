"""Live stream metrics read from query progress (A13 live lag, late-row counts).

Progress reports are small per-trigger summaries kept by the driver; these
helpers only read them.
"""

from __future__ import annotations


def _progresses(query) -> list[dict]:
    return [p for p in (query.recentProgress or []) if p]


def consumer_lag(query) -> dict[str, float]:
    """A13 live: the largest ``maxOffsetsBehindLatest`` reported by each source
    (brokers that report it, e.g. Kafka), keyed by source description."""
    lag: dict[str, float] = {}
    for p in _progresses(query):
        for src in p.get("sources", []):
            behind = (src.get("metrics") or {}).get("maxOffsetsBehindLatest")
            if behind is not None:
                key = src.get("description", "source")
                lag[key] = max(lag.get(key, 0.0), float(behind))
    return lag


def rows_dropped_by_watermark(query) -> int:
    """Late rows dropped by stateful operators over the query's recent triggers."""
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for p in _progresses(query) for op in p.get("stateOperators", []))


def rows_processed(query) -> int:
    """Input rows over the query's recent triggers (drain throughput, A10 live)."""
    return sum(int(p.get("numInputRows", 0)) for p in _progresses(query))
