"""Spelling variants: words one edit apart by pivotal bigrams, and the most frequent form of each."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.word_arrays import _BASE, _INVERSE, _powers, mix, slices
from tarmac.llm.workspace import Workspace

#: Fewest code points and fewest occurrences of a word.
SHORTEST, RAREST = 5, 3
#: A form has at least so many times the occurrences of a word.
FACTOR = 2
#: An occurrence whose checksum with its document's id is a multiple of this loses a code point.
NOISE = 97
#: Entries of a task's table of counts before it is sent on.
HELD = 1 << 19
#: Bigrams: two code points of the alphabet. One edit touches at most two of them; of two disjoint ones it leaves one alone.
GRAM, PIVOTS = 2, 2
PREFIX = GRAM + 1
#: Code points of a word are below this, so that there are at most its square of bigrams.
ALPHABET = 256
_RUN = re.compile("[a-zÀ-ÿ]+")
_U = np.uint64


def _counted_words(noise: int):
    """(word, n) of the runs of letters, those in question without one code point; counted within a task."""

    def batch_of(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # Runs of a document that are equal have equal checksums.
                    for word, n in Counter(_RUN.findall((text or "").encode().lower().decode("utf-8", "replace"))).items():
                        h = zlib.crc32(word.encode(), before)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= SHORTEST:
                            counts[word] += n
                if len(counts) >= HELD:
                    yield batch_of(counts)
                    counts.clear()
        if counts:
            yield batch_of(counts)

    return run


def word_counts(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(word, n): words of docs(doc_id, text) with at least SHORTEST code points and RAREST occurrences."""
    each = docs.select("doc_id", "text").mapInArrow(_counted_words(noise), "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {RAREST}")


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words one after another, where each begins, and the bigrams: their numbers, their words."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.utf8_length(words)))]).astype(np.int64)
    word = np.repeat(np.arange(len(words)), np.diff(cuts))
    inside = np.flatnonzero(word[:-1] == word[1:]) if len(word) else word
    return points, cuts, inside, points[inside] * ALPHABET + points[inside + 1]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET * ALPHABET, np.int64)
    for batch in batches:
        total += np.bincount(_grams(batch.column("word"))[3], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])


def pivots(places: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Which bigrams of each row are its two disjoint ones of least total cost; of ties those that end first.

    places and costs have a row for each word and a column for each bigram of its prefix,
    by place. Dynamic programming over the columns: the best last bigram of a choice of k
    among the first ones.
    """
    rows, columns = places.shape
    never = np.iinfo(np.int64).max // 4
    best = np.full((PIVOTS + 1, columns + 1, rows), never)
    best[0] = 0
    back = np.zeros((PIVOTS + 1, columns + 1, rows), np.int64)
    for k in range(1, PIVOTS + 1):
        for j in range(1, columns + 1):
            # Columns before j whose bigrams end before bigram j begins.
            free = (places[:, : j - 1] + GRAM <= places[:, j - 1 : j]).sum(axis=1)
            taken = best[k - 1, free, np.arange(rows)] + costs[:, j - 1]
            better = taken < best[k, j - 1]
            best[k, j] = np.where(better, taken, best[k, j - 1])
            back[k, j] = np.where(better, j, back[k, j - 1])
    chosen, at = np.zeros((rows, columns), bool), np.full(rows, columns)
    for k in range(PIVOTS, 0, -1):
        last = back[k, at, np.arange(rows)] - 1
        chosen[np.arange(rows), last] = True
        at = (places < (places[np.arange(rows), last] - GRAM + 1)[:, None]).sum(axis=1)
    return chosen


def _keys(shared):
    """(key, pivot, word, n, last): keys of the words' prefix bigrams and of their pivots.

    An edit that spares a bigram lies before or behind it, and the other side of the word
    stays as it is. A key therefore holds the bigram with all that comes before it (or
    behind it), its distance from that end of the word being the position limit, and the
    length that the other word has to have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            words = batch.column("word")
            if not len(words):
                continue
            points, cuts, at, gram = _grams(words)
            length = np.diff(cuts)
            word = np.repeat(np.arange(len(words)), length - 1)
            ranks, place = rank[gram], at - cuts[word]
            order = np.lexsort((place, ranks, word))
            first = cuts[:-1] - np.arange(len(words))
            three = order[first[:, None] + np.arange(PREFIX)]
            last = ranks[three[:, -1]]
            # Bigrams that tie with the third belong to the prefix, so that the order of bigrams alone decides what is in it.
            prefix = np.flatnonzero(ranks <= last[word])
            three = np.sort(three, axis=1)
            chosen = three[pivots(place[three], ranks[three])]
            total = np.concatenate([[_U(0)], np.cumsum(mix(points.astype(_U)) * _powers(_BASE, len(points)))])
            inverse = _powers(_INVERSE, len(points) + 1)
            out = []
            for who, pivot, lengths in ((prefix, False, (0,)), (chosen, True, (-1, 0, 1))):
                w, p = word[who], at[who]
                before = (total[p + GRAM] - total[cuts[w]]) * inverse[cuts[w]]
                behind = (total[cuts[w + 1]] - total[p]) * inverse[p]
                for d in lengths:
                    n = (length[w] + d).astype(_U)
                    out += [(mix(before * _U(4) + mix(n)), w, pivot), (mix(behind * _U(4) + mix(n) + _U(1)), w, pivot)]
            key, who = np.concatenate([k for k, _, _ in out]), np.concatenate([w for _, w, _ in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.concatenate([np.full(len(w), p) for _, w, p in out])), words.take(pa.array(who)), batch.column("n").take(pa.array(who)), pa.array(last[who])],
                ["key", "pivot", "word", "n", "last"],
            )

    return run


def near_words(words: DataFrame, ws: Workspace) -> DataFrame:
    """(word, n, near, near_n): each pair of words(word, n) exactly one inserted, deleted or replaced code point apart, both ways.

    Of two words one edit apart let a be the one whose prefix (its three rarest bigrams)
    ends no later in the order of rarity. The edit spares one of a's two pivots, which are
    disjoint; that bigram is in both words and no rarer than a's last, thus in b's prefix.
    """
    ranks = np.zeros(ALPHABET * ALPHABET, np.int64)
    # At most as many rows as there are pairs of letters.
    counted = words.mapInArrow(_gram_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    for rank, row in enumerate(sorted(counted.collect(), key=lambda r: (r["n"], r["gram"]))):
        ranks[row["gram"]] = rank
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    keys = words.mapInArrow(_keys(shared), "key bigint, pivot boolean, word string, n bigint, last bigint")
    keys = ws.table(keys, "keys")
    a = keys.where("pivot").drop("pivot")
    b = keys.where("not pivot").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("last").alias("near_last"))
    met = a.join(b, "key").where("last <= near_last and word <> near and levenshtein(word, near, 1) = 1")
    pairs = met.select(F.least("word", "near").alias("x"), F.greatest("word", "near").alias("y"), F.when(F.col("word") < F.col("near"), F.col("n")).otherwise(F.col("near_n")).alias("x_n"), F.when(F.col("word") < F.col("near"), F.col("near_n")).otherwise(F.col("n")).alias("y_n"))
    pairs = ws.table(pairs.distinct(), "pairs")
    ws.drop("keys")
    return pairs.select(F.col("x").alias("word"), F.col("x_n").alias("n"), F.col("y").alias("near"), F.col("y_n").alias("near_n")).unionAll(pairs.select("y", "y_n", "x", "x_n"))


def spelling_groups(docs: DataFrame, ws: Workspace, noise: int = NOISE, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs(doc_id, text).

    Words are runs of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased, of at least SHORTEST code
    points and RAREST occurrences; an occurrence whose crc32 with its doc_id is a multiple
    of `noise` first loses a code point. form is the near word of largest n, of ties the
    first by code points, where it has at least `factor` times the word's n; root follows
    forms to the last. A null text has no words, a null doc_id counts as an empty string.
    Repeated rows count again, other columns are not read, and an empty table gives no
    rows. A text of b bytes needs about 20 b of memory; a word may be as long as a text.
    """
    words = ws.table(word_counts(docs, noise), "words")
    # Of equal counts the first word: strings compare by bytes, as code points do.
    nearest = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    best = near_words(words, ws).groupBy("word").agg(F.count("*").alias("n_near"), nearest.alias("top"))
    form_n = F.when(-F.col("top.minus") >= factor * F.col("n"), -F.col("top.minus"))
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("top.near")).alias("form"))
    named = ws.table(named, "forms")
    ws.drop("pairs")
    return named.join(_roots(named, ws), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(named: DataFrame, ws: Workspace) -> DataFrame:
    """(word, root) of the words with a form. Each round a word's target becomes its target's; n at least grows by FACTOR along a chain, so that there are few rounds."""
    at = named.where("form is not null").select("word", F.col("form").alias("root"))
    turn = 0
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = at.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        further = ws.table(further, f"roots_{turn}")
        ws.drop(f"roots_{turn - 1}")
        at, turn = further.select("word", "root"), turn + 1
        if not further.where("moved").limit(1).count():
            return at
