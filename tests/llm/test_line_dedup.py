"""Line components against every pair, and the texts that are left."""

import random

import numpy as np
import pytest

from ledgerflow.llm import line_dedup as L
from ledgerflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def similar(a, b):
    a = {a[i:i + 5] for i in range(max(1, len(a) - 4))}
    b = {b[i:i + 5] for i in range(max(1, len(b) - 4))}
    return len(a & b) >= 0.8 * len(a | b)


def brute(rows):
    """Removed (doc, line) of rows (doc, text) with distinct ids."""
    lines = [(d, n, x) for d, t in sorted(r for r in rows if r[0] is not None and r[1]) for n, x in enumerate(t.split("\n")) if x.split()]
    up = list(range(len(lines)))
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for _, _, x in lines]
    alike = lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if alike(sets[i], sets[j]) and find(i) != find(j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {(lines[i][0], lines[i][1]): lines[find(i)][:2] for i in range(len(lines)) if find(i) != i}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrst", k=rnd.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    pool = [line(rnd.randint(1, 60)) for _ in range(60)]

    def near(x):
        w = x.split(" ")
        for _ in range(max(1, len(w) // 25)):
            w[rnd.randrange(len(w))] = word()
        return " ".join(w)

    texts = []
    for _ in range(80):
        part = [rnd.choice(pool) if rnd.random() < .3 else near(rnd.choice(pool)) if rnd.random() < .5 else line(rnd.randint(1, 40))
                for _ in range(rnd.randint(1, 8))]
        texts.append("\n".join(x + rnd.choice(["", "", "\n", "\n \t"]) for x in part))
    texts += [None, "", "\n\n", "a", "a", "ab", "é🙂" * 400, "é🙂" * 400 + "!", "z" * 60_000, "same\nsame\nsame", "x\r\nx", "hot line\n" * 500]
    return list(enumerate(texts))


def test_against_every_pair(spark, rows):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, line string, no int").repartition(5)
    got = {(r.doc, r.line): (r.kept_doc, r.kept_line) for r in L.removed_lines(df).collect()}
    assert got == brute(rows)
    clean = L.without_lines(df, L.removed_lines(df))
    assert clean.columns == df.columns
    texts = dict(rows)
    for r in clean.collect():
        t = texts[r.doc_id]
        assert r.text == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (r.doc_id, n) not in got))


def test_recall_of_short_and_long_lines():
    """Pairs a little above the similarity share a band nearly always."""
    rnd = random.Random(2)
    for size in (30, 60, 120, 300, 900):
        found = tried = 0
        while tried < 150:
            a = "".join(rnd.choices("abcdefghijklmnop ", k=size))
            b = list(a)
            for _ in range(max(1, size // 50)):
                b[rnd.randrange(size)] = "Z"
            b = "".join(b)
            if similar(a, b):
                tried += 1
                keys = L.band_keys(L.signatures([a, b]))
                found += bool((keys[0] == keys[1]).any())
        assert found >= 0.98 * tried, (size, found)


def test_signatures_do_not_depend_on_the_batch(monkeypatch):
    lines = ["a", "ab cd", "x" * 50, "the quick brown fox jumps over the lazy dog", "é🙂" * 9]
    whole = L.signatures(lines)
    assert np.array_equal(whole, np.concatenate([L.signatures([x]) for x in lines]))
    monkeypatch.setattr(L, "CHUNK", 10)
    assert np.array_equal(whole, L.signatures(lines))
    assert (whole != L.EMPTY).all()


def test_bands_split_into_components_are_compared_in_full(spark):
    """A chain: each line is like the next but not like the first."""
    line = [f"word{i:03d}" for i in range(60)]
    chain = []
    for k in range(0, 30, 3):
        chain.append(" ".join(["other%d" % (j * 7) if j < k else w for j, w in enumerate(line)]))
    rows = list(enumerate(chain))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc, r.line): (r.kept_doc, r.kept_line) for r in L.removed_lines(df).collect()} == brute(rows)


@pytest.mark.parametrize("told, small", [(0, 2), (64, 2), (64, 1000)])
def test_prefix_filter_keeps_every_pair_that_holds(spark, monkeypatch, told, small):
    """Pairs at and about the similarity, in one band, each a component of its own."""
    monkeypatch.setattr(L, "BEFORE", told)
    monkeypatch.setattr(L, "SMALL", small)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdeé漢", k=rnd.randint(1, 6)))
    lines = {"a", "ab", "abcde", "abcdef"}
    for n in (1, 2, 4, 9, 30):
        base = [word() for _ in range(n)]
        for _ in range(60):
            lines.add(" ".join(word() if rnd.random() < .05 else w for w in base)[:rnd.choice([None, None, -1, -3])])
    lines = sorted(x for x in lines if x.strip())
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    alike = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if similar(lines[i], lines[j])}
    texts = L.with_sizes(spark.createDataFrame(list(enumerate(lines)), "node long, line string"))
    placed = spark.createDataFrame([(k, i, i, len(sets[i])) for i in range(len(lines)) for k in (7, 8, -9)],
                                   "key long, node long, root long, size long")
    got = [(r.a, r.b) for r in L.pairs_across(placed, texts, L.Stages(spark, "test")).collect()]
    assert len(got) == len(set(got)) and alike <= set(got) and len(alike) > 100
    assert small == 1000 or len(got) < len(lines) * (len(lines) - 1) / 4


def test_a_group_of_near_copies_makes_few_pairs(spark):
    """Lines that differ from each other in a fifth of their words are not paired, those that are alike are."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    base = [word() for _ in range(30)]
    lines = [" ".join(base[:24] + [word() for _ in range(6)]) for _ in range(300)]
    lines += [x + "s" for x in lines[:20]]
    n = [len({x[i:i + 5] for i in range(len(x) - 4)}) for x in lines]
    texts = L.with_sizes(spark.createDataFrame(list(enumerate(lines)), "node long, line string"))
    placed = spark.createDataFrame([(1, i, i, n[i]) for i in range(len(lines))], "key long, node long, root long, size long")
    got = {(r.a, r.b) for r in L.pairs_across(placed, texts, L.Stages(spark, "test")).collect()}
    assert {(i, i + 300) for i in range(20)} <= got and len(got) < 500


def test_bitmaps_never_part_lines_that_are_alike():
    rnd = random.Random(9)
    met = 0
    for _ in range(4000):
        a = "".join(rnd.choices("abcdef é漢", k=rnd.choice([1, 4, 5, 6, 20, 80, 300])))
        b = "".join(rnd.choice("abcdef") if rnd.random() < .03 else c for c in a) + rnd.choice(["", "x"])
        x, y = ({t[i:i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
        bits = [L.bitmap(L.shingle_hashes(t)) for t in (a, b)]
        apart = int(np.bitwise_count((bits[0] ^ bits[1]).view("u8")).sum())     # of two's complements, as Spark counts
        assert apart <= len(x ^ y)
        met += similar(a, b)
        if similar(a, b):
            assert 9 * apart <= len(x) + len(y)
    assert met > 500


def lines_to_measure():
    rnd = random.Random(12)
    lines = ["".join(rnd.choices("abc é" + ("漢🙂\u1000" if i % 9 == 0 else "\u0fff"), k=rnd.randint(1, 90))) for i in range(400)]
    return lines + ["a", "ab", "abcd", "abcde", "z" * 3000, "abcde" * 700]


@pytest.mark.parametrize("chunk", [1, 10, 1000, 1 << 17])
def test_lines_measured_together_are_as_alone(monkeypatch, chunk):
    lines = lines_to_measure()
    monkeypatch.setattr(L, "CHUNK", chunk)
    sizes, maps = L.measured(lines)
    assert sizes.tolist() == [len(L.shingle_set(x)) for x in lines]
    assert np.array_equal(maps, [L.bitmap(L.shingle_hashes(x)) for x in lines])
    assert [len(x) for x in L.measured([])] == [0, 0]
    alone, compare = L.Comparer(), L.Comparer()
    compare.learn(dict(enumerate(lines)))
    for i, x in enumerate(lines):
        assert i not in compare.known or np.array_equal(compare.known[i], L.shingle_codes(x))
        j = (7 * i + 1) % len(lines)
        assert compare.similar(i, j, x, lines[j]) == alone.similar(i, j, x, lines[j]) == similar(x, lines[j])


def test_usual_lines_are_not_measured_one_by_one(monkeypatch):
    """The cost of a call for each line made line dedup miss its CPU limit."""
    lines = [x for x in lines_to_measure() if max(x) < "\u1000"]
    assert len(lines) > 300

    def never(line):
        raise AssertionError("one line alone")

    for name in ("shingle_hashes", "shingle_codes", "shingle_set"):
        monkeypatch.setattr(L, name, never)
    assert len(L.measured(lines)[0]) == len(lines)
    compare = L.Comparer()
    compare.learn(dict(enumerate(lines)))
    assert compare.similar(0, 0, lines[0], lines[0])


def test_keys_are_dealt_once_and_equal_keys_to_one_part():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64).repeat(2))
    batch = L.packed(keys, np.arange(len(keys), dtype=np.uint64), 51, False).to_pydict()
    got = [(part, k, n) for part, a, b in zip(batch["part"], batch["keys"], batch["nodes"])
           for k, n in zip(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint64).tolist())]
    assert [(k, n) for _, k, n in got] == list(zip(keys.tolist(), range(len(keys))))
    assert batch["part"] == list(range(51)) and len({(p, k) for p, k, _ in got}) == len(set(keys.tolist()))


def test_blank_lines_are_those_without_a_word():
    lines = ["", " ", "\t\v\f\r ", "\x1c", "\x85", "\xa0", "\u2003", "\0", " a ", "x\r"]
    assert L.lines_of("\n".join(lines)) == lines[3:]


def test_repeated_rows_and_null_ids(spark):
    rows = [(4, "one line of text here\nand one more"), (4, "one line of text here\nand one more"), (None, "one line of text here"),
            (2, "one line of text here\nsomething quite different")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, L.without_lines(df, L.removed_lines(df)).collect()), key=str)
    assert got == sorted([(2, rows[3][1]), (4, "and one more"), (4, "and one more"), (None, "")], key=str)


def test_rows_that_share_an_id_are_several_documents(spark):
    rows = [(1, "alpha beta gamma delta line\nunique one here"), (1, "zeta eta theta iota line\nsecond unique text"),
            (0, "alpha beta gamma delta line"), (None, "zeta eta theta iota line\nof no name at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in L.without_lines(df, L.removed_lines(df)).collect() if r.doc_id is not None)
    assert got == [(0, rows[2][1]), (1, "unique one here"), (1, rows[1][1])]
    assert [r.text for r in L.without_lines(df, L.removed_lines(df)).collect() if r.doc_id is None] == ["of no name at all"]


def test_extra_columns_of_any_name_and_type(spark):
    names = "doc string, key string, gone string, KEPT string, line int, h long, `a``b` map<string,int>"
    df = spark.createDataFrame([(i, "the same line of words here", "a", "b", "c", "d", 1, 2, {"x": i}) for i in range(2)],
                               f"doc_id long, text string, {names}")
    got = L.without_lines(df, L.removed_lines(df), told="lines")
    assert got.columns == df.columns + ["lines"]
    assert sorted((r.doc_id, r.text, r.gone, r["a`b"]["x"]) for r in got.collect()) == [(0, "the same line of words here", "c", 0), (1, "", "c", 1)]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_line_dedup"](spark, SF).collect()
    want = brute(list(docs.items()))
    assert len(got) == len(docs)
    for r in got:
        mine = {n: k for (d, n), k in want.items() if d == r.doc_id}
        assert r.n_removed == len(mine) and r.kept_in == sorted({d for d, _ in mine.values()})
        assert r.n_lines == sum(bool(x.split()) for x in docs[r.doc_id].split("\n"))
        assert r.text == "\n".join(x for n, x in enumerate(docs[r.doc_id].split("\n")) if n not in mine)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.removed_lines(none).count() == 0
    assert L.without_lines(none, L.removed_lines(none)).count() == 0


def test_comparer_equals_sets():
    rnd = random.Random(8)
    lines = ["".join(rnd.choices("abcé" + ("漢🙂" if i % 3 == 0 else ""), k=rnd.randint(1, 40))) for i in range(60)] + ["a", "ab", "abcde"]
    for room in (10, 10 ** 6):
        compare = L.Comparer(room)
        for i, x in enumerate(lines):
            for j, y in enumerate(lines):
                assert compare.similar(i, j, x, y) == similar(x, y)


def lines_alone_and_not():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrst", k=rnd.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(20))
    alone, near, twice_in_a_text, in_two_texts = [line() for _ in range(300)], line(), line(), line()
    texts = ["\n".join(alone[i:i + 3]) for i in range(0, 300, 3)]
    texts += [near, near + "s", f"{twice_in_a_text}\n \n{twice_in_a_text}", in_two_texts, f"\n{in_two_texts}", None, ""]
    return list(enumerate(texts)), near, twice_in_a_text, in_two_texts


@pytest.mark.parametrize("parts, held", [(1, 1 << 20), (9, 1 << 20), (9, 4)])
def test_only_lines_that_share_a_band_or_repeat_go_on(spark, monkeypatch, parts, held):
    """All lines went through the shuffles for texts and for copies, which made line dedup miss its CPU limit."""
    monkeypatch.setattr(L, "HELD", held)
    rows, near, twice, two = lines_alone_and_not()
    df = spark.createDataFrame(rows, "doc long, text string").where("text is not null").repartition(parts)
    members = L.band_members(df).cache()
    got = [tuple(r) for r in members.collect()]
    node = {x: int(L.node_hashes([x]).view("i8")[0]) for x in (near, near + "s", twice, two)}
    bands = [r for r in got if r[0] is not None]
    low = min(node[near], node[near + "s"])
    assert len(bands) == len(set(bands)) > 10 and {r[1:] for r in bands} == {(node[x], low, 2) for x in (near, near + "s")}
    assert sorted(r[1] for r in got if r[0] is None) == sorted([node[twice], node[two]])
    seen = spark.sparkContext.broadcast(L.seen_bits(members))
    places = L.line_places(df, seen).collect()
    assert sorted((r.doc, r.no, r.h) for r in places) == [
        (100, 0, node[near]), (101, 0, node[near + "s"]), (102, 0, node[twice]), (102, 2, node[twice]), (103, 0, node[two]), (104, 1, node[two])]
    assert sorted(r.line for r in places if r.line is not None) == sorted([near, near + "s"])


def test_pairs_with_a_bands_least_line_are_not_made_again(spark, monkeypatch):
    """They are checked in the first place; bands of two lines have no other pair."""
    rnd = random.Random(5)
    base = [f"word{i:03d}" for i in range(60)]
    rows = [(k, " ".join(f"other{rnd.randrange(99)}" if rnd.random() < .01 * k else w for w in base)) for k in range(24)]
    given, real = [], L.pairs_across

    def pairs_across(placed, texts, stages):
        given.extend((r.key, r.node) for r in placed.collect())
        return real(placed, texts, stages)

    monkeypatch.setattr(L, "pairs_across", pairs_across)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.line): (r.kept_doc, r.kept_line) for r in L.removed_lines(df).collect()}
    assert got == brute(rows) and 0 < len(got) < 23
    bands = {}
    for key, node in zip(L.band_keys(L.signatures([x for _, x in rows])).view("i8").tolist(), L.node_hashes([x for _, x in rows]).view("i8").tolist()):
        for k in key:
            bands.setdefault(k, set()).add(node)
    want = {(k, n) for k, nodes in bands.items() if len(nodes) > 2 for n in nodes - {min(nodes)}}
    assert len(given) == len(set(given)) > 20 and set(given) == want


def test_a_full_bit_table_changes_no_result(spark, monkeypatch, rows):
    monkeypatch.setattr(L, "SEEN", 128)
    few = rows[:40] + rows[-6:]
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    assert {(r.doc, r.line): (r.kept_doc, r.kept_line) for r in L.removed_lines(df).collect()} == brute(few)


@pytest.mark.parametrize("told", [0, 64])
def test_bands_beyond_the_middle_go_through_the_prefix_filter(spark, monkeypatch, told):
    monkeypatch.setattr(L, "MIDDLE", 2)
    test_prefix_filter_keeps_every_pair_that_holds(spark, monkeypatch, told, 2)


@pytest.mark.parametrize("abreast", [1, 7, 64])
def test_bitmaps_of_a_band_leave_what_the_sql_leaves(spark, monkeypatch, abreast):
    monkeypatch.setattr(L, "ABREAST", abreast)
    rnd = np.random.default_rng(8)
    n = 150
    maps = rnd.integers(-2 ** 63, 2 ** 63, (5, L.LONGS))[rnd.integers(0, 5, n)]
    flips = rnd.random((n, L.LONGS)) < .6
    maps = maps ^ np.where(flips, np.int64(1) << rnd.integers(0, 63, (n, L.LONGS)), 0)
    rows = [(7, int(k) * 13 - 900, int(rnd.integers(0, 9)), int(rnd.integers(1, 90)), *map(int, m)) for k, m in enumerate(maps)]
    df = spark.createDataFrame(rows, "key long, node long, root long, size long, " + ", ".join(f"{b} long" for b in L.BITS)).cache()
    want = df.alias("x").join(df.alias("y"), L.F.expr(f"x.root != y.root and x.node < y.node and {L.maybe_alike('x', 'y')}"))
    want = sorted((r[0], r[1]) for r in want.select("x.node", "y.node").collect())
    got = sorted(map(tuple, L.pairs_by_bitmaps(df.withColumn("key", L.F.lit(1))).collect()))
    assert got == want and 50 < len(got) < n * (n - 1) / 4


class Counting(L.Stages):
    """Tells how many rows each table had."""

    def table(self, df, name):
        out = super().table(df, name)
        self.rows = getattr(self, "rows", {}) | {name: out.count()}
        return out


def test_a_line_of_a_middle_band_makes_one_row(spark):
    """A row for each of its rarest shingles, twice, took more disk than the table at 6 GB."""
    rnd = random.Random(3)
    base = [f"word{i:03d}" for i in range(60)]
    lines = [" ".join(f"w{rnd.randrange(9999)}" if rnd.random() < .1 else w for w in base) for _ in range(100)]
    texts = L.with_sizes(spark.createDataFrame(list(enumerate(lines)), "node long, line string")).cache()
    placed = texts.selectExpr("1L as key", "node", "node as root", "size")
    stages = Counting(spark, "test")
    got = {(r.a, r.b) for r in L.pairs_across(placed, texts, stages).collect()}
    assert {(i, j) for i in range(100) for j in range(i + 1, 100) if similar(lines[i], lines[j])} <= got
    assert stages.rows["prefixes"] == stages.rows["split"] == 0 and stages.rows["apart"] == 100


def test_only_the_removed_lines_stay_on_disk(spark, monkeypatch, rows):
    """The tables of all steps stayed until the session's end, while the texts were shuffled."""
    made = []
    monkeypatch.setattr(L, "Stages", lambda *a: made.append(Counting(*a)) or made[-1])
    L.removed_lines(spark.createDataFrame(rows[:30], "doc_id long, text string"))
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(made[0].root)
    left = [x.getPath().getName() for x in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    assert left == ["removed"] and len(made[0].rows) > 8
