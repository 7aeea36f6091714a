"""Quality rules: a learned decision list, compiled to one ordered conditional expression.

Sequential covering grows a conjunction of thresholds that covers low-quality rows,
prunes it on held-back rows, adds it to the list, and goes on with the rows that no rule
covers. Everything runs as DataFrame aggregates; the driver only sees counts per
statistic and threshold bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.doc_stats import features, with_stats
from tarmac.llm.workspace import Workspace

#: Labelled rows that the list is learned from at most; chosen by a hash of the id.
MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS, BINS = 8, 3, 48
#: Smoothed share of low-quality rows among those that a rule covers, on all rows and on those held back from growing it, and how many it covers at least.
MIN_PRECISION, MIN_HELD, MIN_COVER = 0.9, 0.75, 4
#: Rules that pruning leaves nothing of, before the search ends; the next search does not begin with their first condition.
MAX_FAILED = 6


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, quality) of at most max_rows labelled documents.

    The sample has a row bound, so it is broadcast to the scan of the documents, which
    are not shuffled. Null ids, texts of null and labels other than 0 and 1 are left out.
    """
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")


def learn_rules(sample: DataFrame, ws: Workspace) -> list[Rule]:
    """An ordered list of rules that reject; empty where the sample lacks either class."""
    names = list(features())
    stats = with_stats(sample).select("doc_id", "quality", *(c.alias(k) for k, c in features().items()))
    table = ws.table(stats, "labelled_stats")
    grid = [i / (BINS + 1) for i in range(1, BINS + 1)]
    cuts = table.agg(
        F.count_if(F.col("quality") == 0).alias("bad"),
        F.count_if(F.col("quality") == 1).alias("good"),
        *(F.percentile_approx(F.when(F.col("quality") == q, F.col(k)), grid, 1000).alias(f"{k}_{q}") for k in names for q in (0, 1)),
    ).first()
    if not cuts["bad"] or not cuts["good"]:
        return []
    bounds = {k: sorted({v for q in (0, 1) for v in cuts[f"{k}_{q}"]}) for k in names}
    binned = ws.table(
        table.select(
            "quality",
            (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("held_back"),
            *(_bin(k, bounds[k]).alias(k) for k in names),
        ),
        "labelled_bins",
    )
    index = {k: {v: i for i, v in enumerate(bounds[k])} for k in names}

    def on_bins(c: Condition) -> Column:
        i = index[c.feature][c.threshold]
        return F.col(c.feature) > i if c.above else F.col(c.feature) <= i

    def all_of(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & on_bins(c)
        return out

    rules: list[Rule] = []
    failed: set[tuple[str, bool]] = set()
    while len(rules) < MAX_RULES and len(failed) < MAX_FAILED:
        rest = binned
        for rule in rules:
            rest = rest.where(~all_of(rule))
        grown = _grow(rest.where("not held_back"), names, bounds, all_of, failed)
        if not grown:
            break
        kept = _prune(rest, grown, all_of)
        if kept:
            rules.append(kept)
        else:
            failed.add((grown[0].feature, grown[0].above))
    ws.drop("labelled_stats", "labelled_bins")
    return rules


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the statistic."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < F.col(name)))


def _grow(rows: DataFrame, names: list[str], bounds: dict[str, list[float]], all_of, failed: set[tuple[str, bool]]) -> Rule:
    """Adds the condition with the most information gain until only low-quality rows are left; none in failed comes first. Ties go to the first statistic and threshold."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        stacked = rows.where(all_of(rule)).select(
            "quality", F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in names))).alias("x")
        )
        counts = {
            (r["f"], r["b"]): (r["bad"], r["good"])
            for r in stacked.groupBy("x.f", "x.b").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good")).collect()
        }
        total = [sum(v[i] for (f, _), v in counts.items() if f == names[0]) for i in (0, 1)]
        if not total[0] or not total[1]:
            break
        prior = math.log2(total[0] / (total[0] + total[1]))
        best: tuple[float, Condition] | None = None
        for name in names:
            bad = good = 0
            for i, threshold in enumerate(bounds[name]):
                more = counts.get((name, i), (0, 0))
                bad, good = bad + more[0], good + more[1]
                for above, p, n in ((False, bad, good), (True, total[0] - bad, total[1] - good)):
                    if p >= MIN_COVER and p + n < sum(total) and (rule or (name, above) not in failed):
                        gain = p * (math.log2(p / (p + n)) - prior)
                        if best is None or gain > best[0]:
                            best = gain, Condition(name, above, threshold)
        if best is None or best[0] <= 0:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rest: DataFrame, rule: Rule, all_of) -> Rule:
    """The part of the rule, by dropping conditions, that is best on all rows and precise on those held back, too; none where no part is."""
    parts = [tuple(c for i, c in enumerate(rule) if m >> i & 1) for m in range(1, 1 << len(rule))]
    got = rest.agg(
        *(
            F.count_if(all_of(p) & (F.col("quality") == q) & (F.col("held_back") == held)).alias(f"n{i}_{q}_{int(held)}")
            for i, p in enumerate(parts) for q in (0, 1) for held in (False, True)
        )
    ).first()
    best, value = (), 0.0
    for i, p in enumerate(parts):
        (bad, bad_held), (good, good_held) = ((got[f"n{i}_{q}_0"], got[f"n{i}_{q}_1"]) for q in (0, 1))
        share, held = ((x + 1) / (x + y + 2) for x, y in ((bad + bad_held, good + good_held), (bad_held, good_held)))
        if bad + bad_held >= MIN_COVER and share >= MIN_PRECISION and (held >= MIN_HELD or not bad_held + good_held) and share * (bad + bad_held) > value:
            best, value = p, share * (bad + bad_held)
    return best


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does. Needs with_stats()."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept) per row.

    Null and empty texts have no words and fail the base. Repeated rows are judged each;
    other columns of docs are not read, whatever their names. An empty table gives an empty
    result. A text of b bytes needs about 60 b of memory in its task, for its words and
    the hashes of their triples.
    """
    out = with_stats(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        rule_number(rules).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that pass, with its columns as they are, whatever their names."""
    out = with_stats(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), "_text")
    passes = ~base_failed() & (rule_number(rules) == 0)
    return out.where(passes).select("_row.*")
