"""The intake stream answers every valid request, with the TTL carried across micro-batches."""

from datetime import timedelta
from decimal import Decimal

from ledgerflow.streaming.effectively_once import ANSWERS, AcceptSink
from ledgerflow.streaming.staging import run_folder

from helpers import T0

COLS = ("request_id bigint, received_at timestamp, idempotency_key string, amount decimal(19,4), currency string, "
        "customer_id string, card_last4 string, country string, merchant string")


def test_answers_follow_the_ttl_across_batches(spark):
    def batch(*requests):
        return spark.createDataFrame([(rid, T0 + timedelta(hours=h), key, Decimal("10.00"), "USD", "c", "4242", "US", "m")
                                      for rid, key, h in requests], COLS)

    sink = AcceptSink(spark, run_folder(spark, "answers-test"))
    sink(batch((0, "k", 0), (1, "k", 5), (2, None, 6)), 0)
    sink(batch((3, "k", 23), (4, "k", 25), (5, "j", 25)), 1)        # 25 h: from the table, cached until 49 h
    again = batch((6, "k", 48), (7, "k", 50), (8, "k", 60), (9, "j", 30))
    sink(again, 2)
    sink(again, 2)                                                  # a batch that runs again
    answers = sink.log.committed("answers", ANSWERS).collect()
    assert len(answers) == 9 and len({r["payment_id"] for r in answers}) == 2
    got = {r["request_id"]: r["accept_result"] for r in answers}
    assert got == {0: "created", 1: "idempotent_redis", 3: "idempotent_redis", 4: "idempotent_db", 5: "created",
                   6: "idempotent_redis", 7: "idempotent_db", 8: "idempotent_redis", 9: "idempotent_redis"}
    assert {r["status"] for r in answers} == {"RECEIVED"}
    assert sink.log.committed("payments", "payment_id string").count() == 2
