"""Quality rules as a learned decision list, in DataFrame functions only.

Signals of a text (word, symbol, line and repetition figures) are built-in
expressions over its words and lines. From labelled documents, sequential
covering learns an ordered list of conjunctions of thresholds that describe bad
documents: a conjunction grows literal by literal by information gain on one
part of the labelled rows, is pruned to the prefix that does best on the other
part, and is kept if it is precise enough there; the rows it covers are set
aside and the next one grows. All counts come from aggregations of binned
signals. The list is emitted as one conditional expression, whose first true
condition decides; what no rule rejects is kept.

Null texts count as empty; repeated rows get a row each; documents without a
label don't matter for learning, nor do labels without a quality. Without
labelled rows of both classes the list is empty and keeps all. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Stages, id_text, named

#: Labelled rows from which the list is learned, at most (drawn by hash of the id).
MAX_LABELLED = 20_000
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SIGNALS = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "shouts", "digits"]


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Number of words in windows of three that stand twice or more in ``words``."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))
    same = lambda g, h, i: F.coalesce(g["h"] == F.get(h, i)["h"], F.lit(False))
    twice = lambda grams: F.filter(grams, lambda g, i: same(g, grams, i - 1) | same(g, grams, i + 1))
    starts = F.sort_array(F.transform(let(F.sort_array(grams), twice), lambda g: g["at"]))
    covered = F.aggregate(starts, F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
                          lambda a: a["n"])
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(covered)


def signals(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Columns ``keep`` with the counts of :data:`COUNTS`, the signals of :data:`SIGNALS` and
    ``mark`` of each row. ``mark`` is never negative; a condition that uses it stays above
    the expressions here, so that they are not evaluated again in a pushed-down filter."""
    text = F.col(text)
    of_words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"),
        repeated_words(w).alias("n_repeat_words")))
    of_lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    taken = lambda chars: (F.char_length(text) - F.char_length(without(text, chars))).cast("long")
    df = df.select(*keep, of_words.alias("of_words"), of_lines.alias("of_lines"),
                   F.char_length(without(text, BLANKS)).cast("long").alias("word_chars"),
                   taken(SYMBOLS).alias("n_symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
                   taken("!").alias("n_shouts"), taken("0123456789").alias("n_digits"),
                   F.monotonically_increasing_id().alias("mark"))
    df = df.select(*keep, "of_words.*", "of_lines.*", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_digits", "mark")
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return df.select(*keep, *COUNTS, part("word_chars", "n_words").alias("word_length"),
                     part("n_symbols", "n_words").alias("symbols"), part("n_dup_lines", "n_lines").alias("dup_lines"),
                     part("n_repeat_words", "n_words").alias("repeats"), part("n_distinct", "n_words").alias("distinct"),
                     part("n_capitals", "word_chars").alias("capitals"), part("n_shouts", "n_words").alias("shouts"),
                     part("n_digits", "word_chars").alias("digits"), "mark")


@dataclass(frozen=True)
class Literal:
    signal: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.signal) > self.threshold if self.above else F.col(self.signal) <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; each is a conjunction of literals that rejects."""

    rules: tuple[tuple[Literal, ...], ...] = ()

    def kept(self) -> Column:
        """The list as one conditional expression."""
        out = None
        for rule in self.rules:
            out = F.when(all_of(rule), F.lit(False)) if out is None else out.when(all_of(rule), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def all_of(rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.holds()
    return out


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str,
             label_col: str) -> DataFrame:
    """Signals of labelled documents: ``bad`` and ``grow`` (the part a row belongs to)."""
    marks = labels.select(named(id_col).cast("long").alias("id"), named(label_col).cast("int").alias("good")) \
        .where("id is not null and good in (0, 1)")
    n = marks.count()
    if n > max_labelled:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(950_000 * max_labelled / n))
    rows = id_text(docs, id_col, text_col).join(F.broadcast(marks), "id")       # bounded by max_labelled
    return signals(rows, "id", "good").select(
        (F.col("good") == 0).alias("bad"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0).alias("grow"), *SIGNALS)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_rules: int = 12, max_literals: int = 3,
          min_precision: float = 0.97, min_covered: int = 2, bins: int = 24, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> DecisionList:
    """Learn the list that rejects documents labelled 0."""
    stages = Stages(docs.sparkSession, "quality")
    rows = stages.table(labelled(docs, labels, max_labelled, id_col, text_col, label_col), "labelled")
    steps = [i / bins for i in range(bins + 1)]
    cut_points = rows.agg(*[F.percentile_approx(F.when(F.col("bad") == bad, F.col(s)), steps, 2000).alias(f"{s}_{bad}")
                            for s in SIGNALS for bad in (True, False)]).first()
    if cut_points is None or any(cut_points[f"{SIGNALS[0]}_{bad}"] is None for bad in (True, False)):
        return DecisionList()
    cuts = {s: sorted({float(x) for bad in (True, False) for x in cut_points[f"{s}_{bad}"]}) for s in SIGNALS}
    binned = [F.struct(F.lit(k).alias("k"), bin_of(s, cuts[s]).alias("bin")) for k, s in enumerate(SIGNALS)]
    rows = stages.table(rows.withColumn("binned", F.array(*binned)), "binned")
    left, rules = F.lit(True), []
    while len(rules) < max_rules:
        rule = grow(rows.where("grow").where(left), cuts, max_literals)
        if not rule:
            break
        rule, bad, good = prune(rows.where("not grow").where(left), rule)
        if bad < min_covered or bad < min_precision * (bad + good):
            break
        rules.append(rule)
        left = left & ~all_of(rule)
    return DecisionList(tuple(rules))


def bin_of(signal: str, cuts: list[float]) -> Column:
    """Number of cut points below the signal."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(signal) > c))


def grow(rows: DataFrame, cuts: dict[str, list[float]], max_literals: int) -> tuple[Literal, ...]:
    """The conjunction that adds, each time, the literal of the highest information gain."""
    rule: list[Literal] = []
    while len(rule) < max_literals:
        counts = (rows.where(all_of(rule)).select("bad", F.explode("binned").alias("b"))
                  .groupBy("b.k", "b.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
                  .collect())                             # a row a signal and bin
        total_bad = sum(r["bad"] for r in counts if r["k"] == 0)
        total_good = sum(r["good"] for r in counts if r["k"] == 0)
        if not total_bad or not total_good:
            break
        base, best = math.log2(total_bad / (total_bad + total_good)), (1e-9, None)
        for k, signal in enumerate(SIGNALS):
            by_bin = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["k"] == k}
            low_bad = low_good = 0
            for b, cut in enumerate(cuts[signal]):        # bin b: values up to the cut, and above the one before
                low_bad, low_good = low_bad + by_bin.get(b, (0, 0))[0], low_good + by_bin.get(b, (0, 0))[1]
                for above, bad, good in ((False, low_bad, low_good), (True, total_bad - low_bad, total_good - low_good)):
                    if bad:
                        gain = bad * (math.log2(bad / (bad + good)) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, Literal(signal, above, cut))
        if best[1] is None:
            break
        rule.append(between(rows.where(all_of(rule)), best[1]))
    return tuple(rule)


def between(rows: DataFrame, literal: Literal) -> Literal:
    """The literal with its threshold half way between the values at either side."""
    s = F.col(literal.signal)
    low, high = rows.agg(F.max(F.when(s <= literal.threshold, s)), F.min(F.when(s > literal.threshold, s))).first()
    middle = literal.threshold if low is None or high is None else (low + high) / 2
    return Literal(literal.signal, literal.above, middle if low is None or high is None or low <= middle < high else low)


def prune(rows: DataFrame, rule: tuple[Literal, ...]) -> tuple[tuple[Literal, ...], int, int]:
    """The prefix of the rule that does best on rows it has not grown on, with the bad and good rows it covers."""
    prefixes = [rule[:n] for n in range(1, len(rule) + 1)]
    found = rows.agg(*[F.count_if(all_of(p) & (F.col("bad") == bad)) for p in prefixes for bad in (True, False)]).first()
    scored = [(p, found[2 * i], found[2 * i + 1]) for i, p in enumerate(prefixes)]
    return max(scored, key=lambda x: (x[1] - x[2]) / max(1, x[1] + x[2]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the counts, ``base_failed`` and ``kept`` of every row."""
    rows = signals(id_text(docs, id_col, text_col), "id")
    return rows.select(F.col("id").alias(id_col), *COUNTS, base_failed().alias("base_failed"),
                       (~base_failed() & rules.kept() & (F.col("mark") >= 0)).alias("kept"))


def keep(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, with their own columns."""
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"),
                       F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    kept = signals(rows, "row").where(~base_failed() & rules.kept() & (F.col("mark") >= 0))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
