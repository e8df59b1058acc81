"""Each stage of the pipeline against brute force on what it got."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_line_dedup import brute as brute_lines
from test_mixing import brute_targets
from test_quality import WORD, counts
from test_simhash import brute_components, brute_fp
from test_tokens import tik

import corpus_pipeline
from __spark_entry__ import queries
from ledgerflow.llm.quality import learn
from ledgerflow.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])


def test_quality(spark, steps):
    rules = learn(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).rules
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    passed = {r.doc_id for r in steps[0].collect() if not counts(r.text)[-1]}
    assert kept <= passed and (rules or kept == passed)
    assert not [d for d in passed - kept if labels.get(d) == 1]


def test_lines(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    gone = brute_lines(rows)
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows}
    got = {r.doc_id: (r.text, r.n_chars) for r in steps[2].collect()}
    assert got == {d: (t, len(t)) for d, t in want.items() if WORD.search(t)}


def test_simhash(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[2].collect())
    roots = brute_components([brute_fp(t) for _, t in rows])
    assert sorted((r.doc_id, r.text) for r in steps[3].collect()) == [r for i, r in enumerate(rows) if roots[i] == i]


def test_mix(steps):
    words = lambda t: len(WORD.findall(t))
    sizes, most, taken = Counter(), Counter(), Counter()
    for r in steps[3].collect():
        sizes[r.source] += words(r.text)
        most[r.source] = max(most[r.source], words(r.text))
    for r in steps[4].collect():
        taken[r.source] += words(r.text)
    want = brute_targets(sizes, 1.5, 2.0, (3, 1, 2))
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    times = Counter(r.doc_id for r in steps[4].collect())
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in steps[3].collect()}


def test_ids(steps):
    lib = tik()
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    got = steps[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in steps[4].collect())
    for r in got:
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_run(spark, steps):
    assert Counter(r.ids_sha256 for r in queries()["pipeline"](spark, SF).collect()) == Counter(r.ids_sha256 for r in steps[5].collect())


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, null and repeated ids, extra columns, and a text of 10 MB."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc", F.lit("x")).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    line = lambda n: " ".join("".join(random.Random(100 * n + i).choices("aeioulmnrst", k=6)) for i in range(80))
    rnd = random.Random(4)
    long = " ".join("".join(rnd.choices("abcdefghijklmnoprstu", k=rnd.randint(3, 9))) for _ in range(1_450_000))
    odd = [(None, line(1), None, None, None), (None, None, None, None, None), (7, line(2), None, None, 5), (7, line(3), "en", "src0", None),
           (7, line(3), "en", "src0", None), (8, long, None, "src1", 1), (9, "", "en", "src1", 0)]
    extra = spark.createDataFrame([(*r, None, None) for r in odd], T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    rows = docs.where("doc_id > 9").unionByName(extra)
    schema, kept = rows.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == schema
        rows = materialize(rows)
        kept.append(Counter((r.doc_id, hash(r.text)) for r in rows.where("doc_id is null or doc_id < 10").collect()))
    assert len(long) > 10_000_000
    for text, doc, times in ((line(1), None, 1), (line(2), 7, 1), (line(3), 7, 2), (long, 8, 1)):
        assert [k[doc, hash(text)] for k in kept[:3]] == [times, times, 1], text[:20]       # near-dedup drops the repeat
    out = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert out.where("decoded_sha256 is null").count() == 0 and out.count() == rows.count()
    bare = spark.createDataFrame([(1, line(4), "s")], "doc_id long, text string, source string")
    assert corpus_pipeline.line_dedup_stage(spark, bare, SF).columns == bare.columns


def test_nothing_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
