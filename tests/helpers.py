"""Small literal tables for hand cases."""

from datetime import datetime, timedelta
from decimal import Decimal

T0 = datetime(2026, 1, 1, 0, 0, 0)
PAYMENT_COLS = ("payment_id string, event_id bigint, created_at timestamp, customer_id string, "
                "amount decimal(19,4), currency string, card_last4 string, country string, merchant string")


def payments(spark, rows):
    """rows: (customer, seconds offset, amount text, country) in arrival order."""
    data = []
    for i, (cust, secs, amount, country) in enumerate(rows):
        data.append((f"p{i}", i, T0 + timedelta(seconds=secs), cust, Decimal(amount), "USD", "4242",
                     country, "Acme"))
    return spark.createDataFrame(data, PAYMENT_COLS)


def by_id(df, *cols):
    return {r["payment_id"]: (r if not cols else tuple(r[c] for c in cols)) for r in df.collect()}


def crash_once(at):
    """A commit log that fails once, after batch ``at``'s outputs are written and before its marker."""
    from ledgerflow.streaming.effectively_once import CommitLog

    class CrashOnce(CommitLog):
        left = [at]

        def commit(self, batch_id):
            if batch_id in self.left:
                self.left.clear()
                raise RuntimeError(f"injected crash before the marker of batch {batch_id}")
            super().commit(batch_id)

    return CrashOnce
