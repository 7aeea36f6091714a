"""Phrase collocations by SON partitioning: shards mined at lowered support, then all candidates counted exactly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.word_arrays import Block, block, mix, slices, sliding, windows
from tarmac.llm.workspace import Workspace

#: Least occurrences of a phrase in its language.
SUPPORT = 100
#: Longest phrase, in words.
LONGEST = 5
#: Shards: the input's files, dealt by a hash of their names. A fixed number, so that local support stays above one occurrence however large the corpus is; each shard is mined by many tasks.
SHARDS = 16
#: Most bits of a bitmap of hashes; beyond it more phrases pass the bitmap, which costs time but changes no result.
MOST_BITS = 28
#: Hashes that a task gathers before it counts them.
HELD = 1 << 20
TOP, PERCENT, SCALE = 2000, 100, 1000

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[0x0A:0x0E] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_U = np.uint64


class _Phrases:
    """Words of some rows, their language mixed into the hashes, and where phrases can stand."""

    def __init__(self, part: pa.RecordBatch):
        self.b: Block = block(part.column("text"), lower=True, gap=_GAP)
        doc = self.b.doc_of_word()
        lang = mix(np.asarray(part.column("lang_hash")).view(_U))
        self.words = mix(self.b.hashes ^ lang[doc])
        piece = np.concatenate([[0], np.cumsum(_BREAK[self.b.data])])[self.b.starts] if len(doc) else doc
        #: Words from each word to the end of its piece.
        new = np.flatnonzero((np.diff(piece) != 0) | (np.diff(doc) != 0)) + 1 if len(doc) else doc
        ends = np.append(new, len(doc))
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(doc))
        self.doc = doc

    def hashes(self, size: int, of: np.ndarray | None = None) -> np.ndarray:
        """A hash for each run of `size` words, those that leave their piece included."""
        return windows(self.words if of is None else of, size)

    def inside(self, size: int, n: int) -> np.ndarray:
        return self.left[:n] >= size


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, lang, word, hash, n) of each batch's slices."""
    for batch in batches:
        for part in slices(batch, "text"):
            p = _Phrases(part)
            if not len(p.doc):
                continue
            shards = np.asarray(part.column("shard"))[p.doc]
            order = np.lexsort((p.words, shards))
            w, s = p.words[order], shards[order]
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])))
            at = order[first]
            texts = [p.b.data[x:y].tobytes().lower().decode("utf-8", "replace") for x, y in zip(p.b.starts[at], p.b.ends[at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[first]), part.column("lang").take(pa.array(p.doc[at])), pa.array(texts), pa.array(w[first].view(np.int64)), pa.array(np.diff(first, append=len(w)))],
                ["shard", "lang", "word", "hash", "n"],
            )


def _mine(sizes: range, below: int, shared):
    """(shard, support, hash, n) of phrases of these sizes whose parts of `below` words pass the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, total = shared.value, defaultdict(list), 0
        for batch in batches:
            for part in slices(batch, "text"):
                p = _Phrases(part)
                parts = p.hashes(below) if below > 1 else p.words
                frequent = _passes(known, parts)
                tags = np.stack([np.asarray(part.column("shard")).astype(np.int64), np.asarray(part.column("support"))])
                # Documents of one shard and language are counted together.
                kinds, kind = np.unique(tags, axis=1, return_inverse=True)
                kind = kind.reshape(-1)[p.doc]
                for size in sizes:
                    if len(p.doc) < size:
                        continue
                    h = p.hashes(size)
                    at = np.flatnonzero(sliding(frequent, size - below + 1, np.minimum)[: len(h)] & p.inside(size, len(h)))
                    at = at[np.argsort(kind[at], kind="stable")]
                    cuts = np.searchsorted(kind[at], np.arange(kinds.shape[1] + 1))
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        if y > x:
                            held[(int(kinds[0, k]), int(kinds[1, k]))].append(h[at[x:y]])
                    total += len(at)
                if total >= HELD:
                    yield from _counted(held)
                    held, total = defaultdict(list), 0
        yield from _counted(held)

    return run


def _counted(held: dict[tuple[int, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for (shard, support), each in held.items():
        value, n = np.unique(np.concatenate(each), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), shard)), pa.array(np.full(len(n), support)), pa.array(value.view(np.int64)), pa.array(n)], ["shard", "support", "hash", "n"]
        )


def _count_phrases(sizes: range, shared):
    """(lang, phrase, n) of the phrases whose hash passes the bitmap; counted as texts."""

    def flush(counts: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, each in counts.items():
            texts = pa.array([t.decode("utf-8", "replace") for t in each], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(each), pa.string()), texts, pa.array(list(each.values()), pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value, defaultdict(lambda: defaultdict(int))
        for batch in batches:
            for part in slices(batch, "text"):
                p = _Phrases(part)
                langs, other = part.column("lang").to_pylist(), mix(p.words + _U(1))
                lower = p.b.data.tobytes().lower()
                # Up to each word: bytes of words. A phrase whose words have one blank between them is its bytes.
                ends = np.concatenate([[0], np.cumsum(p.b.ends - p.b.starts)])
                tabs = b"\t" in lower
                for size in sizes:
                    if len(p.doc) < size:
                        continue
                    h, second = p.hashes(size), p.hashes(size, other)
                    at = np.flatnonzero(_passes(known, h) & p.inside(size, len(h)))
                    at = at[np.lexsort((second[at], h[at]))]
                    new = np.append(True, (np.diff(h[at]) != 0) | (np.diff(second[at]) != 0))[: len(at)]
                    first = np.flatnonzero(new)
                    at, n = at[first], np.diff(first, append=len(at))
                    begin, stop = p.b.starts[at], p.b.ends[at + size - 1]
                    plain = (stop - begin == ends[at + size] - ends[at] + size - 1) & (not tabs)
                    for lang, x, y, whole, k in zip(p.doc[at].tolist(), begin.tolist(), stop.tolist(), plain.tolist(), n.tolist()):
                        text = lower[x:y]
                        counts[langs[lang]][text if whole else b" ".join(text.split())] += k
                if sum(map(len, counts.values())) >= HELD >> 2:
                    yield from flush(counts)
                    counts.clear()
        yield from flush(counts)

    return run


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which leading bits some hash has: 16 bits of room for each hash, at most 2 ** MOST_BITS in all, whatever the number of hashes."""
    n = hashes.count()
    bits = int(min(MOST_BITS, max(16, (16 * n).bit_length())))
    place = F.expr(f"shiftrightunsigned(hash, {64 - bits})")
    cells = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("set"))
    found = cells.toArrow()
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[np.asarray(found.column("cell").combine_chunks())] = np.asarray(found.column("set").combine_chunks())
    return packed.astype("<i8").view(np.uint8)


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> _U(62 - len(bitmap).bit_length())
    return (bitmap[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def phrase_counts(docs: DataFrame, ws: Workspace, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 2 to `longest` words with f >= support, (lang, word, f) of all words, (lang, n) of languages.

    1. Words are counted by shard and language. A shard's support is the global one times
       its share of a language's words. A shard is some of the input's files, so that a task
       mostly counts for one shard; rows that come from no file are one shard.
    2. Each shard is mined: pairs of words that have the support over the corpus, then
       longer phrases of locally frequent pairs. A phrase with global support reaches the
       local one in at least one shard, so the union of what is locally frequent lacks none.
    3. All candidates are counted over the corpus, as texts, so that no hash decides a
       count.
    What tasks need to know of other tasks is in bitmaps of bounded size, which may let
    phrases pass that are not candidates, and never hold one back.
    """
    lang = F.coalesce("lang", F.lit("und"))
    rows = docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.pmod(F.xxhash64(F.input_file_name()), F.lit(shards)).cast("int").alias("shard"))
    each = rows.mapInArrow(_word_counts, "shard int, lang string, word string, hash bigint, n bigint")
    words = ws.table(each.groupBy("shard", "lang", "word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash")), "words")
    local = words.groupBy("lang", "shard").agg(F.sum("n").alias("local"))
    sizes = local.groupBy("lang").agg(F.sum("local").alias("n"))
    exact = F.expr(f"cast(({support} * cast(local as decimal(20,0)) + n - 1) div n as bigint)")
    supports = ws.table(local.join(sizes, "lang").select("lang", "shard", exact.alias("support")), "supports")
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash")).where(f"n >= {support}").select("hash")

    spark, marked = docs.sparkSession, rows.join(supports, ["lang", "shard"])
    shared = spark.sparkContext.broadcast(_bitmap(frequent))
    names = []
    for name, lengths, below in (("pairs", range(2, 3), 1), ("longer", range(3, longest + 1), 2)):
        if not lengths:
            continue
        mined = marked.mapInArrow(_mine(lengths, below, shared), "shard bigint, support bigint, hash bigint, n bigint")
        locally = mined.groupBy("shard", "support", "hash").agg(F.sum("n").alias("n")).where("n >= support").select("hash").distinct()
        candidates = ws.table(locally, name)
        names.append(name)
        shared.unpersist()
        shared = spark.sparkContext.broadcast(_bitmap(candidates))
    every = spark.read.schema("hash bigint").parquet(*(ws.path(name) for name in names))
    shared = spark.sparkContext.broadcast(_bitmap(every))
    counted = rows.mapInArrow(_count_phrases(range(2, longest + 1), shared), "lang string, phrase string, n bigint")
    phrases = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(f"f >= {support}")
    out = ws.table(phrases, "phrases")
    ws.drop(*names)
    return out, words.groupBy("lang", "word").agg(F.sum("n").alias("f")), sizes


def _least_cut(phrases: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the cut into two parts that scores lowest, of ties that after the fewest words."""
    w = F.split("phrase", " ")
    cut = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(w, k + 1, F.size(w)), " ").alias("right")))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.inline(cut))
    # Each part of a frequent phrase is at least as frequent: a frequent phrase, or a word.
    needed = phrases.select("lang", F.explode(w).alias("word")).distinct()
    parts = words.join(needed, ["lang", "word"], "left_semi").select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "f"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"part": side, "f": count}), ["lang", side])
    whole = "cast({} as decimal(19,0))".format
    score = F.expr(f"cast(({SCALE} * ({whole('a')} * {whole('n')})) div ({whole('l')} * {whole('r')}) as bigint)")
    best = cuts.join(sizes, "lang").withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("least"))
    return best.select("lang", "phrase", *(F.col(f"least.{c}").alias(c) for c in ("a", "l", "r", "n", "score")))


def _inside_longer(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of those whose words stand in a longer candidate that is nearly as frequent."""
    w = F.split("phrase", " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size(w) - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.array_join(F.slice(w, i, m), " ")),
        )
    )
    inner = phrases.where(F.size(w) > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("f").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"]).where(f"100 * cast(longer as decimal(20,0)) >= {percent} * cast(f as decimal(20,0))").select("lang", "phrase")


def collocations(docs: DataFrame, ws: Workspace, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` collocations of docs(text, lang).

    A text is split at .,;:!? and line ends into pieces and these at blanks and tabs into
    words, A-Z lower-cased. Of a phrase with a occurrences the score is floor(1000 a n / (l r))
    at its lowest cut into parts with l and r occurrences, n the language's words. A phrase
    inside a longer one with at least `percent` per cent of its occurrences is left out.
    Ranks go by score, then a (both descending), then the phrase's bytes, so that there are
    no ties. A null lang is und, a null text empty. Repeated rows count again, other columns
    are not read, and an empty table gives no rows. A text of b bytes needs about 60 b of
    memory.
    """
    phrases, words, sizes = phrase_counts(docs, ws, support, longest, shards)
    scored = ws.table(_least_cut(phrases, words, sizes).join(_inside_longer(phrases, percent), ["lang", "phrase"], "left_anti"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The window's limit keeps `top` rows of a language in each task before they meet.
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
