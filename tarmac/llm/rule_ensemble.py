"""Quality classifier: tree paths as conjunctive rules, lasso logistic weights, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.doc_stats import features, with_stats
from tarmac.llm.workspace import Workspace

TREES, DEPTH, PENALTY, ITERATIONS, SEED = 12, 3, 0.002, 60, 7
CUT = 0.3
#: Labelled rows to learn from at most, chosen by a hash of the id; the bound lets them be broadcast to the scan of the texts.
MAX_LABELLED = 20_000
#: A tree's path: (feature, whether above, threshold) for each split.
Path = tuple[tuple[str, bool, float], ...]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, quality) of labelled documents that aren't held out; no other column."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")


def _paths(node, names: list[str], above: Path = ()) -> list[Path]:
    """Conditions from the root to each inner and outer node below it."""
    found = [above] if above else []
    if node.subtreeDepth() == 0:
        return found
    name, cut = names[node.split().featureIndex()], float(node.split().threshold())
    for child, over in ((node.leftChild(), False), (node.rightChild(), True)):
        found += _paths(child, names, (*above, (name, over, cut)))
    return found


def rule_column(path: Path) -> Column:
    out = F.lit(True)
    for name, over, cut in path:
        out = out & ((F.col(name) > F.lit(cut)) if over else (F.col(name) <= F.lit(cut)))
    return out


@dataclass
class RuleEnsemble:
    """Rules with weights other than 0; score is the logistic of their sum."""

    intercept: float
    rules: list[tuple[Path, float]]

    def score(self) -> Column:
        """Needs the columns of features()."""
        total = F.lit(self.intercept)
        for path, weight in self.rules:
            total = total + F.when(rule_column(path), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        said = [f"{w:+.3f} if " + " and ".join(f"{n} {'>' if o else '<='} {c:.5g}" for n, o, c in p) for p, w in self.rules]
        return "\n".join([f"{self.intercept:+.3f}", *said])


def learn(sample: DataFrame, ws: Workspace) -> RuleEnsemble:
    """Fits trees, takes their paths as 0/1 features, and keeps those that lasso gives a weight.

    Where the sample has no row, or one class, the score is a constant: 0.5, or that
    class's smoothed share.
    """
    names = list(features())
    stats = with_stats(sample).select(F.col("quality").cast("double").alias("label"), *(c.alias(k) for k, c in features().items()))
    table = ws.table(stats.repartition(4), "training_stats")
    good, n = table.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if good in (0.0, float(n)):
        import math

        return RuleEnsemble(math.log((good + 1) / (n - good + 1)), [])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="all", subsamplingRate=0.5, maxBins=64)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(table)
    model = forest.fit(vectors)
    paths = sorted({p for tree in model.trees for p in _paths(tree._java_obj.rootNode(), names)})
    rules = [F.when(rule_column(p), 1.0).otherwise(0.0).alias(f"r{i}") for i, p in enumerate(paths)]
    marked = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="features").transform(table.select("label", *rules))
    fit = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=ITERATIONS, standardization=False).fit(marked)
    weights = fit.coefficients.toArray()
    ws.drop("training_stats")
    return RuleEnsemble(float(fit.intercept), [(p, float(w)) for p, w in zip(paths, weights) if abs(w) > 1e-9])


def classify(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text); null and empty texts have zero statistics.

    Rows are independent, also those that repeat or have no id (which are not held out);
    equal texts score alike. Other columns are not read; an empty table gives no rows. A
    text of b bytes needs about 60 b of memory in its task.
    """
    out = with_stats(docs.select("doc_id", "text")).select("doc_id", *(c.alias(k) for k, c in features().items()))
    return out.select("doc_id", held_out().alias("held_out"), ensemble.score().alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= CUT, 1).otherwise(0)
    )
