"""Scalar functions, the scorer hook and retry re-entry."""

import pandas as pd
from pyspark.sql import functions as F

from ledgerflow.functions import scalars as X
from ledgerflow.operators import process as P
from ledgerflow.operators.features import activity_snapshot
from ledgerflow.schemas import DEFAULT_RULES
from ledgerflow.operators.rules import rule_findings
from ledgerflow.operators.triage import triage
from ledgerflow.operators.verdict import score_prompts, verdict_reasoner

from helpers import payments
from test_process_cases import deliveries, event, no_claims, stored, stub


def test_reasons_json_round_trip_and_fallback(spark):
    df = spark.createDataFrame([('["a","b"]',), ("plain text",), (None,), ("",)], "raw string")
    got = [list(r[0]) for r in df.select(X.reasons_from_json(F.col("raw"))).collect()]
    assert got == [["a", "b"], ["plain text"], [], []]
    out = spark.createDataFrame([(["x", "y"],), (None,)], "a array<string>").select(X.reasons_json(F.col("a")))
    assert [r[0] for r in out.collect()] == ['["x","y"]', "[]"]


def test_deterministic_uuid_is_stable(spark):
    df = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "k string")
    ids = [r[0] for r in df.select(X.deterministic_uuid(F.col("k"), F.lit("payment"))).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 36 and ids[0].count("-") == 4


def test_cached_value_codec(spark):
    df = spark.createDataFrame([("id-1", "RECEIVED")], "i string, s string")
    enc = df.select(X.encode_cached(F.col("i"), F.col("s")).alias("v"))
    i, s = X.decode_cached(F.col("v"))
    assert enc.select(i, s).first() == ("id-1", "RECEIVED")


def test_scorer_hook_feeds_the_reconciler(spark):
    pays = payments(spark, [("c", 0, "6000.00", "US")])
    findings = rule_findings(activity_snapshot(pays), DEFAULT_RULES)

    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        assert pdf["prompt"].str.contains('"floor":').all()
        return pd.DataFrame({"payment_id": pdf["payment_id"], "decision": "BLOCK", "risk_score": 0.85,
                             "reasons": [["model says block"]] * len(pdf)})

    verdicts = score_prompts(findings, scorer)
    out = triage(pays, reasoner=verdict_reasoner(verdicts)).first()
    assert out["decision"] == "BLOCK" and out["model_used"] and out["risk_score"] == 0.85


def test_retried_records_reenter_and_dedupe(spark):
    main = deliveries(spark, [event("e1", "p1")])
    retry = deliveries(spark, [event("e1", "p1")]).withColumn("offset", F.lit(99).cast("bigint"))
    r = P.process(main, stored(spark, "p1"), no_claims(spark), stub(spark, "APPROVE"), retries=retry)
    assert r.claims.count() == 1 and r.duplicates.count() == 1


def test_payment_reasons_outer_and_inner(spark):
    from ledgerflow.operators.board import payment_reasons
    df = spark.createDataFrame([("p1", '["a","b"]'), ("p2", None)], "payment_id string, fraud_reasons string")
    outer = sorted((r["payment_id"], r["pos"], r["reason"]) for r in payment_reasons(df).collect())
    assert outer == [("p1", 0, "a"), ("p1", 1, "b"), ("p2", None, None)]
    assert payment_reasons(df, keep_empty=False).count() == 2


def test_any_reason_contains_ignores_case(spark):
    df = spark.createDataFrame([(["Velocity: 6 charges", "x"],), (["amount"],)], "r array<string>")
    got = [row[0] for row in df.select(X.any_reason_contains(F.col("r"), "VELOCITY")).collect()]
    assert got == [True, False]
