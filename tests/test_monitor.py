"""Live stream metrics read from query progress (A13 live)."""

from types import SimpleNamespace

from ledgerflow.streaming.monitor import consumer_lag, rows_dropped_by_watermark, rows_processed


def test_metrics_from_progress_reports():
    progress = [
        {"numInputRows": 10, "sources": [{"description": "KafkaV2[Subscribe[payments.requested]]",
                                          "metrics": {"maxOffsetsBehindLatest": "7"}}],
         "stateOperators": [{"numRowsDroppedByWatermark": 2}]},
        {"numInputRows": 5, "sources": [{"description": "KafkaV2[Subscribe[payments.requested]]",
                                         "metrics": {"maxOffsetsBehindLatest": "3"}}],
         "stateOperators": [{"numRowsDroppedByWatermark": 1}]},
        None,
    ]
    q = SimpleNamespace(recentProgress=progress)
    assert consumer_lag(q) == {"KafkaV2[Subscribe[payments.requested]]": 7.0}
    assert rows_dropped_by_watermark(q) == 3 and rows_processed(q) == 15
