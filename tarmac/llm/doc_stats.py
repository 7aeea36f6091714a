"""Per-document text statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _repeat_words(words: str, n: int) -> list[tuple[str, Column]]:
    """Columns that lead to n_repeat_words: words in n-word windows found twice or more."""
    grams = F.expr(
        f"if(size({words}) < {n}, array(), transform(sequence(0, size({words}) - {n}), "
        f"i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(n))})))"
    ).cast("array<bigint>")
    return [
        ("_grams", grams),
        ("_repeats", F.size("_grams") > F.size(F.array_distinct("_grams"))),
        ("_sorted", F.expr("if(_repeats, sort_array(transform(_grams, (h, i) -> struct(h as h, i as i))), null)")),
        (
            "_starts",
            F.expr(
                "if(_repeats, sort_array(transform(filter(sequence(0, size(_sorted) - 1), k -> "
                "(k > 0 and _sorted[k].h = _sorted[greatest(k - 1, 0)].h) or "
                "(k < size(_sorted) - 1 and _sorted[k].h = _sorted[least(k + 1, size(_sorted) - 1)].h)), "
                "k -> _sorted[k].i)), null)"
            ),
        ),
        (
            "n_repeat_words",
            F.expr(
                # The task number keeps the optimizer from copying this whole chain into filters above it.
                f"if(_repeats and spark_partition_id() >= 0, {n}L + aggregate(zip_with(slice(_starts, 2, size(_starts)), slice(_starts, 1, size(_starts) - 1), "
                f"(b, a) -> least({n}, b - a)), 0L, (s, x) -> s + x), 0L)"
            ),
        ),
    ]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with counts that quality operators use; its own columns keep their names.

    Adds word_chars, n_words, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_upper (all long). Null text counts as no words. A
    document with more than one column of these names already has them replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", words_of(F.col(text)))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_upper": F.regexp_count(body, F.lit("[A-Z]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    for name, column in _repeat_words("_words", 3):
        out = out.withColumn(name, column)
    return out.drop("_words", "_lines", "_grams", "_repeats", "_sorted", "_starts")


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def features() -> dict[str, Column]:
    """Ratios that the learned operators see; none holds an id, a label, a language or a source."""
    return {
        "symbol_ratio": _per("n_symbols", "word_chars"),
        "mean_word": _per("word_chars", "n_words"),
        "dup_line_ratio": _per("n_dup_lines", "n_lines"),
        "repeat_ratio": _per("n_repeat_words", "n_words"),
        "upper_ratio": _per("n_upper", "word_chars"),
        "words_per_line": _per("n_words", "n_lines"),
    }
