"""Quality rules: a decision list learnt by sequential covering.

Statistics of a text are DataFrame expressions. On labelled texts, a rule
grows: the threshold on one statistic that gains most information about bad
texts is added until no good text of the growing share is left or nothing is
gained; it is then pruned, condition by condition from the last, on the other
share, and kept if it is precise enough there. Texts that it covers are set
aside and the next rule grows. Each step reads one table of counts by
statistic, bin and label, made by Spark. The list becomes one ordered
conditional expression. DataFrame operations only.

Words are runs of characters other than space and U+0009 to U+000D. A null or
empty text has no words; it fails the base rule (fewer than 50 words). Labels
without a text, null labels and repeated labels of one id: the first two are
left out, repeats count each. Without labels the list is empty and the base
rule decides alone. Repeated rows are judged each by itself; an empty table has no rows.
Other columns, of any name, don't matter. Long texts are counted whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.shared import BLANK, own_columns, stash, whole_text

#: The bound of the training sample: labelled texts, chosen by a hash of the id.
TRAINING_TEXTS = 20_000
BINS = 40
LEAST_PRECISION = 0.95
LEAST_COVERED = 20
MOST_RULES = 8
MOST_CONDITIONS = 3
#: What strips a text; the symbols that are counted.
STRIPPED = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"

STATISTICS = ["mean_word_chars", "symbols_per_word", "repeated_words", "repeated_lines", "capitals", "exclamations", "digits", "distinct_words"]


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the counts of its words and lines."""
    bare = F.btrim("text", F.lit(STRIPPED))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+"))
    worded = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(STRIPPED))) > 0)
    split = docs.withColumn("words", words).withColumn("lines", worded)
    grams = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    )
    counted = split.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        grams.alias("grams"),
        # A value that isn't deterministic: filters on the counts stay above this step, where each text is split once.
        F.monotonically_increasing_id().alias("row"),
    )
    return counted.withColumn("n_repeat_words", repeated_words(F.col("grams"))).select(
        "doc_id",
        "n_words",
        "word_chars",
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "n_distinct_words",
        "n_lines",
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", "[^!]+", "")).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace("text", "[^0-9]+", "")).cast("long").alias("n_digits"),
        F.monotonically_increasing_id().alias("row"),
    )


def repeated_words(grams: Column) -> Column:
    """How many words lie in a window of three that is found twice or more.

    Windows sorted by hash stand beside their likes; the places of those that
    have one, in order, each cover three words less what the next one covers.
    """
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(run: Column) -> Column:
        twice = F.filter(run, lambda x, i: (x["g"] == F.get(run, i - 1)["g"]) | (x["g"] == F.get(run, i + 1)["g"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    # Each step is bound once, as the element of a list of one.
    bound = F.get(F.transform(F.array(placed), lambda run: F.get(F.transform(F.array(places(run)), covered), F.lit(0))), F.lit(0))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(bound).cast("long")


def with_statistics(counts: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "repeated_words": F.col("n_repeat_words") / words,
            "repeated_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "capitals": F.col("n_capitals") / chars,
            "exclamations": F.col("n_exclamations") / words,
            "digits": F.col("n_digits") / chars,
            "distinct_words": F.col("n_distinct_words") / words,
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Condition:
    """A threshold on one statistic; ``cut`` is its place among the statistic's thresholds."""

    statistic: str
    above: bool
    threshold: float
    cut: int

    def column(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


def all_of(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def tally(sample: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int, bool, bool], int]:
    """How many rows there are of each (statistic, bin, bad, growing share); at most ``BINS`` + 1 bins a statistic."""
    binned = F.array(*[F.struct(F.lit(name).alias("statistic"), sum(((F.col(name) > t).cast("int") for t in cuts[name]), F.lit(0)).alias("bin")) for name in cuts])
    rows = sample.select("bad", "grow", F.explode(binned).alias("x")).groupBy("x.statistic", "x.bin", "bad", "grow").agg(F.count("*").alias("n")).collect()
    return {(r["statistic"], r["bin"], r["bad"], r["grow"]): r["n"] for r in rows}


def best_condition(counts: dict, cuts: dict[str, list[float]]) -> Condition | None:
    """The threshold of the greatest information gain for bad texts (FOIL), among the growing share."""
    best, found = 1e-9, None
    for name, thresholds in cuts.items():
        bins = [[counts.get((name, b, bad, True), 0) for bad in (True, False)] for b in range(len(thresholds) + 1)]
        p0, n0 = (sum(b[i] for b in bins) for i in (0, 1))
        if not p0:
            return None
        p, n = 0, 0
        for cut, threshold in enumerate(thresholds):
            p, n = p + bins[cut][0], n + bins[cut][1]
            for above, (q, m) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if q >= LEAST_COVERED // 2:
                    gain = q * (math.log2(q / (q + m)) - math.log2(p0 / (p0 + n0)))
                    if gain > best:
                        best, found = gain, Condition(name, above, threshold, cut)
    return found


def learn(sample: DataFrame) -> list[list[Condition]]:
    """The ordered rules that reject; ``sample`` has the statistics, ``bad`` and ``grow``."""
    shares = [i / BINS for i in range(1, BINS)]
    row = sample.agg(*[F.percentile_approx(name, shares, 10_000).alias(name) for name in STATISTICS]).first()
    cuts = {name: sorted(set(row[name] or [])) for name in STATISTICS}
    cuts = {name: values for name, values in cuts.items() if values}
    rules: list[list[Condition]] = []
    while cuts and len(rules) < MOST_RULES:
        rule: list[Condition] = []
        left = sample
        for earlier in rules:
            left = left.where(~all_of(earlier))
        while len(rule) < MOST_CONDITIONS:
            condition = best_condition(tally(left.where(all_of(rule)), cuts), cuts)
            if condition is None:
                break
            rule.append(condition)
            good = left.where(all_of(rule) & ~F.col("bad") & F.col("grow")).limit(1).count()
            if not good:
                break
        if not rule:
            break
        # Pruning: the shortest start of the rule whose worth on the other share is greatest.
        worth = left.where("not grow").agg(*[F.count_if(all_of(rule[:k]) & (F.col("bad") == bad)).alias(f"{'p' if bad else 'n'}{k}") for k in range(1, len(rule) + 1) for bad in (True, False)]).first()
        tried = [((worth[f"p{k}"] - worth[f"n{k}"]) / max(1, worth[f"p{k}"] + worth[f"n{k}"]), -k) for k in range(1, len(rule) + 1)]
        k = -max(tried)[1]
        p, n = worth[f"p{k}"], worth[f"n{k}"]
        if p + n < max(1, LEAST_COVERED // 4) or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule[:k])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one ordered expression: false at the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        out = F.when(all_of(rule), F.lit(False)) if out is None else out.when(all_of(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules from the labelled texts (``quality`` 0 is bad) that pass the base rule."""
    marked = own_columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAINING_TEXTS)
    texts = own_columns(docs, "doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    # The label rides on the id, so that the statistics stay those of the text alone.
    labelled = texts.select(F.struct("doc_id", "quality").alias("doc_id"), "text")
    sample = with_statistics(with_counts(labelled)).withColumn("failed", base_failed())
    sample = sample.select((F.col("doc_id.quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id.doc_id", F.lit("grow")), F.lit(3)) > 0).alias("grow"), "failed", *STATISTICS)
    return learn(stash(sample, "quality-sample").where("not failed"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of ``docs``."""
    rules = learn_rules(docs, labels)
    # Written once: a filter that a caller puts on the verdicts never reaches the texts.
    rows = with_statistics(stash(with_counts(own_columns(docs, "doc_id", "text").withColumn("text", whole_text())), "quality-counts"))
    judged = rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rules = learn_rules(docs, labels)
    # The whole row rides on the id.
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = [c.lower() for c in names].index("text")
    rows = plain.select(F.struct(*plain.columns).alias("doc_id"), F.coalesce(f"_{at}", F.lit("")).alias("text"))
    judged = with_statistics(with_counts(rows)).withColumn("kept", ~base_failed() & verdict(rules))
    return judged.where(F.col("kept") & (F.col("row") >= 0)).select("doc_id.*").toDF(*names)
