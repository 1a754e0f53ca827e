"""Quality classifier: a sparse ensemble of rules.

Statistics of each text feed a random forest; every path from a root to a node
of a tree is a conjunctive rule over the statistics.  A lasso logistic
regression over all rules keeps the few that matter, and the rules with their
weights are compiled into one Spark column expression, which is the model.

Training uses all labelled rows given to it (forest and regression are
distributed); scoring reads every text whole and needs no Python on the
executors.  Labels, language, source and id are never inputs.

Defined results: null text is empty; empty texts get the score of their (zero)
statistics; without labels every score is 0.5, with labels of one class only it
is that class's share of rows (smoothed); labels that repeat for a document are
averaged; rows that repeat get equal scores; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import common as C
from lurescope.llm import quality_rules

TREES = 12
DEPTH = 3
LASSO = 0.0005
ITERATIONS = 60
SEED = 41
STATISTICS = ["n_words", "symbol_share", "dup_line_share", "repeat_share", "word_length"]

#: A rule: statistic -> (above, at most); None is unbounded.
Rule = tuple[tuple[str, float | None, float | None], ...]

_SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)$")


def paths(tree_text: str, names: list[str]) -> list[Rule]:
    """The conjunction on the way to every node of a tree (as its printed form shows it)."""
    out, stack = [], []
    for line in tree_text.splitlines():
        m = _SPLIT.match(line)
        if not m:
            continue
        depth, feature, op, value = len(m[1]), names[int(m[2])], m[3], float(m[4])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, feature, op, value))
        bounds: dict[str, tuple[float | None, float | None]] = {}
        for _, f, o, v in stack:
            low, high = bounds.get(f, (None, None))
            if o == ">":
                low = v if low is None else max(low, v)
            else:
                high = v if high is None else min(high, v)
            bounds[f] = (low, high)
        out.append(tuple(sorted((f, lo, hi) for f, (lo, hi) in bounds.items())))
    return out


def condition(rule: Rule) -> Column:
    """A rule as a Spark condition."""
    c = F.lit(True)
    for name, low, high in rule:
        if low is not None:
            c = c & (F.col(name) > low)
        if high is not None:
            c = c & (F.col(name) <= high)
    return c


class RuleEnsemble:
    """An intercept and weighted rules; ``column()`` is the compiled model."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]) -> None:
        self.intercept, self.rules = intercept, rules

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        def one(name, low, high):
            return name + (f" > {low:g}" if low is not None else "") + (f" <= {high:g}" if high is not None else "")
        return [f"{w:+.3f}  " + " and ".join(one(*x) for x in r) for r, w in self.rules]


def fit(rows: DataFrame, names: list[str] = STATISTICS) -> RuleEnsemble:
    """``rows``: the statistics and a column label (0.0 or 1.0)."""
    counts = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n, ones = sum(counts.values()), counts.get(1.0, 0)
    if len(counts) < 2:
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
    vectors = rows.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in names])).alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="all",
                                    subsamplingRate=0.7, maxMemoryInMB=64).fit(vectors)
    rules = sorted({r for t in forest.trees for r in paths(t.toDebugString, names)}, key=str)
    if not rules:
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
    matrix = rows.select(array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=ITERATIONS, standardization=False).fit(matrix)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w != 0.0]
    return RuleEnsemble(float(lasso.intercept), weights)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def statistics(docs: DataFrame, carry: list[Column]) -> DataFrame:
    return quality_rules.with_statistics(docs, carry)


def classify(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int) -> DataFrame:
    """doc_id, held_out, score, predicted per document; learns from labelled rows that are not held out."""
    stats = C.materialize(statistics(docs, [F.col("doc_id").alias("_id")]).select("_id", *STATISTICS), "ensemble_stats")
    marked = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)) \
                   .groupBy(F.col("doc_id").alias("l_id")).agg((F.avg(target) >= 0.5).cast("double").alias("label"))
    rows = stats.join(marked, F.col("_id") == F.col("l_id")).select(*STATISTICS, "label")
    model = fit(C.materialize(rows, "ensemble_train"))
    score = model.column().cast("double")
    return stats.select(F.col("_id").alias("doc_id"), held_out(F.col("_id"), folds, fold).alias("held_out"), score.alias("score")) \
                .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"), "quality", 3, 1)
