"""Quality rules: decision lists learned from labelled statistics, applied as one Spark conditional.

Everything is DataFrame expressions.  ``with_statistics`` counts each text in
its own row (no shuffle).  ``learn`` turns labelled rows into a table of cells
(bin of each feature -> number of rejected and kept rows) and covers the
rejected rows rule by rule: a rule grows one threshold condition at a time, by
information gain on the growing part of the cells, then loses last conditions
that do not pay on the pruning part.  Each step aggregates the cells in Spark and
brings a histogram of at most features x bins rows to the driver.  The rules, in
order, become ``CASE WHEN ... THEN 'rule n' ...``.

Defined cases: null and empty texts have no word and fail the base rules; a
labelled row without a text or label teaches nothing; repeated labels count as
often as they stand; with no labels the list is empty and only the base rules
reject; repeated rows and rows without a doc_id are judged like any other, each
on its own text; own columns may have any name; equal gains are settled by feature name, direction and threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lets import let
from tagloom.llm.shared import stored

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["distinct_share", "dup_line_share", "mark_share", "repeat_share", "symbol_share", "upper_share", "word_length"]
#: Rows of labels that a list is learned from, at most.
SAMPLE_ROWS = 12_000


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a generator, which the optimizer neither duplicates nor pushes filters through."""
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline_outer(row))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of eight words, by its first word."""

    def windows(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
        return F.when(F.size(h) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows that stand twice or more in the text.

    Windows are sorted by hash; equal neighbours are compared word by word.
    """

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, F.lit(WINDOW)) == F.slice(words, b["i"] + 1, F.lit(WINDOW)))

    def repeated(s: Column) -> Column:
        return F.transform(s, lambda x, k: F.when(
            F.coalesce((k > 0) & same(F.get(s, k - 1), x), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)), x["i"]))

    indexed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.sort_array(F.filter(let(indexed, repeated), lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0)


def _chars_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five base counts and the features of the learned rules, in the struct ``_stats``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = _once(docs, _words=F.array_remove(F.split(whole, SPACE), ""), _lines=F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _once(df, _windows=_window_hashes(F.col("_words")))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": _chars_of(whole, r"[#*$%&|<>]+"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated_words(F.col("_words"), F.col("_windows")),
        "_n_lines": F.size("_lines"),
        "_n_distinct": F.size(F.array_distinct("_words")),
        "_n_upper": _chars_of(whole, r"\p{Lu}+"),
        "_n_marks": _chars_of(whole, r"[^\p{L}\p{N}\s]+"),
    }
    df = _once(df, **{f"_s_{name}": c.cast("bigint") for name, c in counts.items()})
    s = lambda name: F.col(f"_s_{name}")
    words, chars = F.greatest(s("n_words"), F.lit(1)), F.greatest(s("word_chars"), F.lit(1))
    features = {
        "distinct_share": s("_n_distinct") / words,
        "dup_line_share": s("n_dup_lines") / F.greatest(s("_n_lines"), F.lit(1)),
        "mark_share": s("_n_marks") / chars,
        "repeat_share": s("n_repeat_words") / words,
        "symbol_share": s("n_symbols") / words,
        "upper_share": s("_n_upper") / chars,
        "word_length": s("word_chars") / words,
    }
    stats = F.struct(*[s(name).alias(name) for name in BASE], *[c.alias(name) for name, c in features.items()])
    return _once(df.select(*docs.columns, *[f"_s_{name}" for name in counts]), _stats=stats).drop(*[f"_s_{name}" for name in counts])


def base_failed(stats: Column) -> Column:
    few = stats["n_words"] < MIN_WORDS
    return few | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, stats: Column) -> Column:
        """``rule n`` of the first rule that rejects, else null."""
        result = None
        for n, rule in enumerate(self.rules, 1):
            holds = reduce(lambda a, b: a & b, [c.column(stats) for c in rule])
            result = F.when(holds, F.lit(f"rule {n}")) if result is None else result.when(holds, F.lit(f"rule {n}"))
        return F.lit(None).cast("string") if result is None else result.otherwise(F.lit(None))

    def __str__(self) -> str:
        return "\n".join(f"{n}: {' and '.join(map(str, rule))}" for n, rule in enumerate(self.rules, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text`` and ``reject`` of at most ``rows`` labels with a text, chosen by a hash of doc_id.

    The chosen labels are at most ``rows`` pairs of numbers, which is what is broadcast.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").alias("_label_doc"), (F.col("quality") == 0).alias("reject"))
    chosen = known.orderBy(F.xxhash64("_label_doc"), "_label_doc", "reject").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_doc")).select("doc_id", "text", "reject")


def learn(
    labelled: DataFrame,
    bins: int = 32,
    max_rules: int = 12,
    max_conditions: int = 3,
    min_precision: float = 0.75,
    min_cover: int = 8,
) -> DecisionList:
    """A decision list from rows with ``doc_id``, ``text`` and ``reject``; rows that the base rules reject are left out."""
    stats = with_statistics(labelled)
    rows = stats.filter(~base_failed(F.col("_stats"))).select("doc_id", "reject", *[F.col(f"_stats.{name}").alias(name) for name in FEATURES])
    rows = stored(rows, "quality-rows")
    # thresholds: the midpoints between quantiles of either class
    shares = [i / bins for i in range(bins + 1)]
    asked = [F.percentile_approx(F.when(side, F.col(name)), shares, 10_000).alias(f"{name}_{k}")
             for name in FEATURES for k, side in enumerate((F.col("reject"), ~F.col("reject")))]
    quantiles = rows.agg(*asked).first()
    cuts: dict[str, list[float]] = {}
    for name in FEATURES:
        values = sorted({v for k in (0, 1) for v in quantiles[f"{name}_{k}"] or []})
        cuts[name] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    binned = [_bin(name, cuts[name]).alias(name) for name in FEATURES]
    grows = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2
    tell = {"grow_pos": grows & F.col("reject"), "grow_neg": grows & ~F.col("reject"), "prune_pos": ~grows & F.col("reject"), "prune_neg": ~grows & ~F.col("reject")}
    cells = rows.select(*binned, *[c.alias(k) for k, c in tell.items()]).groupBy(*FEATURES).agg(*[F.count_if(k).alias(k) for k in tell])
    cells = stored(cells.coalesce(8), "quality-cells")

    def holds(rule: list[tuple[str, bool, int]]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f) > i if above else F.col(f) <= i for f, above, i in rule], F.lit(True))

    found: list[list[tuple[str, bool, int]]] = []
    left = cells
    for _ in range(max_rules):
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            step = _best_condition(left.filter(holds(rule)), cuts, min_cover)
            if step is None:
                break
            rule.append(step)
        if not rule:
            break
        rule = _pruned(left, rule, holds)
        pos, neg = left.filter(holds(rule)).agg(F.sum(F.col("grow_pos") + F.col("prune_pos")), F.sum(F.col("grow_neg") + F.col("prune_neg"))).first()
        if not pos or pos < min_cover or pos < min_precision * (pos + neg):
            break
        found.append(rule)
        left = left.filter(~holds(rule))
    return DecisionList([[Condition(f, above, cuts[f][i]) for f, above, i in rule] for rule in found])


def _bin(name: str, cuts: list[float]) -> Column:
    """How many thresholds the feature is above."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda t: F.col(name) > t))


def _best_condition(cells: DataFrame, cuts: dict[str, list[float]], min_cover: int) -> tuple[str, bool, int] | None:
    """The condition of largest gain: (feature, above, index of the threshold)."""
    entries = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).alias("bin")) for name in FEATURES])
    each = cells.select(F.explode(entries).alias("e"), "grow_pos", "grow_neg")
    histogram = each.groupBy("e.feature", "e.bin").agg(F.sum("grow_pos").alias("p"), F.sum("grow_neg").alias("n")).collect()
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in histogram:
        by.setdefault(r["feature"], {})[r["bin"]] = (r["p"], r["n"])
    best: tuple[float, str, bool, int] | None = None
    for name in FEATURES:
        held = by.get(name, {})
        pos, neg = sum(p for p, _ in held.values()), sum(n for _, n in held.values())
        if not pos:
            return None
        before = math.log2(pos / (pos + neg))
        below_p = below_n = 0
        for i in range(len(cuts[name])):  # bin i holds values at or below threshold i and above the one before
            p, n = held.get(i, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, p1, n1 in ((True, pos - below_p, neg - below_n), (False, below_p, below_n)):
                if p1 >= min_cover and n1 < neg:
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, name, above, i)
    return best and best[1:]


def _pruned(cells: DataFrame, rule: list, holds) -> list:
    """The first conditions of the rule that do best on the pruning part, by (p - n) / (p + n)."""
    sums = [F.sum(F.when(holds(rule[:k]), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c in ("prune_pos", "prune_neg")]
    row = cells.agg(*sums).first()

    def worth(k: int) -> float:
        p, n = row[f"prune_pos{k}"] or 0, row[f"prune_neg{k}"] or 0
        return (p - n) / (p + n) if p + n else -1.0

    best = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
    return rule[:best]


VERDICT = ["_stats", "base_failed", "rule", "kept"]


def _judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The columns of ``docs`` as ``_own_0``, ``_own_1``, ..., so that no name of theirs meets one of the verdict's."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)])
    stats = with_statistics(own, f"_own_{docs.columns.index('text')}")
    failed, rule = base_failed(F.col("_stats")), rules.verdict(F.col("_stats"))
    return _once(stats, base_failed=failed, rule=F.when(~failed, rule)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with ``_stats``, ``base_failed``, ``rule`` (the one that rejects, if any) and ``kept``, which replace own columns of these names; no shuffle."""
    own = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in VERDICT]
    return _judged(docs, rules).select(*own, *VERDICT)


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows that are not rejected, with their own columns only, whatever their names; no shuffle."""
    return _judged(docs, rules).filter("kept").select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])
