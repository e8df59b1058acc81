"""Signals against plain Python, and the learned list on held-out labels."""

import random
import re
from collections import Counter

from ledgerflow.llm.quality import COUNTS, DecisionList, judge, keep, learn
from ledgerflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return n + (n[0] < 50 or 100 * n[4] > 50 * n[0],)


def test_counts(spark):
    rnd = random.Random(7)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a a a", "x\nx\n\nx\n \n ", "é🙂 <b>|#", "w\x85w w\x0bw",
             "one two three four " * 2000, "#" * 9000, "l1 a b\nl1 a b\r\nl1 a b\r\n"]
    texts += [" ".join(rnd.choices(["a", "b", "c!", "D|", "ee\n"], k=rnd.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, words string")
    got = judge(df, DecisionList()).collect()
    assert len(got) == len(texts)
    for r in got:
        want = counts(texts[r.doc_id])
        assert tuple(r[c] for c in COUNTS) + (r.base_failed,) == want, texts[r.doc_id]
        assert r.kept == (not want[-1])
    kept = keep(df, DecisionList())
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if not counts(t)[-1]]


def test_held_out_labels(spark):
    """Learned on documents with even ids, judged on those with odd ids."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = learn(docs, labels.where("doc_id % 2 = 0"))
    assert 1 <= len(rules.rules) <= 12
    marks = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    seen = Counter((marks[r.doc_id], r.kept) for r in judge(docs, rules).where("not base_failed").collect() if r.doc_id in marks)
    assert seen[1, False] <= 0.005 * (seen[1, False] + seen[1, True])
    assert seen[0, True] <= 0.1 * (seen[0, False] + seen[0, True])


def test_without_labels(spark):
    docs = spark.createDataFrame([(i, "some words " * 40) for i in range(5)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert learn(docs, none) == DecisionList()
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert learn(docs, one) == DecisionList()
    assert learn(docs.where("doc_id > 9"), one) == DecisionList()
    assert judge(docs.where("doc_id > 9"), DecisionList()).count() == 0


def test_repeated_rows_and_labels(spark):
    rnd = random.Random(1)
    good = lambda: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(60))
    rows = [(i, good() if i % 2 else " ".join(w + "##" for w in good().split())) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2, "doc_id long, quality int")
    rules = learn(docs, labels)
    got = judge(docs, rules).collect()
    assert len(got) == 220 and all(r.kept == bool(r.doc_id % 2) for r in got)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_quality_rules"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[c] for c in COUNTS) + (r.base_failed,) == counts(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    plan = QUERIES["op10_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert plan.count("regexp_extract_all") == 1          # the words of a text are found once
