"""Exact dedup against plain Python: clashing digests, several micro-batches, files that come later."""

from collections import Counter

import pytest

from ledgerflow.llm.exact_dedup import Deduplicator, dedup

SCHEMA = "doc_id long, text string, lang string"


def brute(rows):
    """Multiset of (id, keep, size, kept) for (id, text) rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        stays = True
        for i in ids:
            out[i, keep, len(ids), i == keep and stays] += 1
            stays = stays and i != keep
    return out


def told(df):
    return Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def write(spark, rows, path, files=1, mode="append", schema=SCHEMA):
    spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(files).write.mode(mode).parquet(path)


ROWS = ([(i, f"text {i % 17}") for i in range(100)] + [(None, "text 3"), (None, "only null"), (None, "only null"), (5, "text 5"), (5, "text 5"),
        (200, None), (201, ""), (202, " "), (203, "Text 3"), (204, "x" * 300_000), (205, "x" * 300_000), (206, "x" * 299_999 + "y")])


@pytest.mark.parametrize("digits", [64, 1])
def test_equals_brute_force_also_when_digests_clash(spark, tmp_path, digits):
    path = f"{tmp_path}/docs.parquet"
    write(spark, ROWS, path, 5)
    out = dedup(spark, path, digits=digits, rounds=3)
    assert told(out) == brute(ROWS)
    assert out.columns == ["id", "keep_id", "group_size", "kept", "digest"]


def test_state_outlives_a_run(spark, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    write(spark, ROWS[:60], path, 2)
    seen = Deduplicator(spark, path)
    seen.take()
    assert told(seen.result()) == brute(ROWS[:60])
    write(spark, ROWS[60:], path, 2)
    seen.take()
    assert told(seen.result()) == brute(ROWS)
    seen.take()                                            # nothing new
    assert told(seen.result()) == brute(ROWS)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    write(spark, [], f"{tmp_path}/none.parquet")
    assert dedup(spark, f"{tmp_path}/none.parquet").collect() == []
    rows = [(1, "a"), (2, "a"), (3, "b")]
    for n, extra in enumerate(("digest", "at", "_metadata", "keep", "n", "id")):
        path = f"{tmp_path}/extra-{n}.parquet"
        write(spark, rows, path, schema=f"doc_id long, text string, {extra} string")
        assert told(dedup(spark, path)) == brute(rows)


def test_one_hot_text_and_no_python_in_the_plans(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"own {i}") for i in range(3000)]
    write(spark, rows, f"{tmp_path}/hot.parquet", 4)
    out = dedup(spark, f"{tmp_path}/hot.parquet")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert told(out) == brute(rows)
