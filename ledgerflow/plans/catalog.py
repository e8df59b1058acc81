"""All registered queries (imported for their registration side effect)."""

from __future__ import annotations

from . import q_board, q_ingest, q_ops, q_panels, q_process, q_stream, q_triage, q_verdict  # noqa: F401
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
