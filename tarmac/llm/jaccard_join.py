"""N-gram Jaccard self join by parity sketches: XOR-hashed shingles, pigeonhole keys per size band, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.components import connected_components
from tarmac.llm.word_arrays import block, mix, slices, windows
from tarmac.llm.workspace import Workspace

NGRAM = 5
#: Documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 64-bit words of a document's parity sketch.
SKETCH = 8
#: The keys are joined in as many slices, so that a shuffle holds one slice at a time.
SLICES = 8
#: In bands below this size each element is a group of its own.
SINGLE = 64
#: Sets that stay apart meet by one key in SOONER first; PARTNERS places hold the sets that each has met so, which do not meet by the other keys again.
SOONER, PARTNERS = 16, 1024
_SETS = ", ".join(
    [
        "node bigint, linkable boolean, up int, n_shingles bigint, total bigint, wanted bigint, set_a bigint, set_b bigint",
        *(f"s{i} bigint" for i in range(SKETCH)), "fine binary", *(f"keys{k} array<bigint>" for k in range(SLICES)),
    ]
)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles, ascending, text after text, and where each text's begin."""
    b = block(texts, lower=True)
    length, doc = np.diff(b.words), b.doc_of_word()
    grams = windows(b.hashes, NGRAM)
    inside = np.flatnonzero(b.left_in_doc()[: len(grams)] >= NGRAM)
    values, docs = [grams[inside]], [doc[inside]]
    for n in range(1, NGRAM):
        short = np.flatnonzero(length == n)
        if len(short):
            values.append(windows(b.hashes, n)[b.words[short]])
            docs.append(short)
    value, doc = mix(np.concatenate(values)), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(length) + 1))


def most_different(a, b):
    """Elements that just one of two linked sets of sizes a and b can hold."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def _keys(value: np.ndarray, bounds: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pigeonhole keys of the sets, and whose they are, in the band of their size (up = 0) or the next; keys each set needs, and has.

    A band holds the pairs whose larger set has 2 ** j elements or more, fewer than twice
    that. Linked sets differ in at most D elements. Dealt by the leading bits of their
    hashes, which lets all but D of the groups be equal in both sets, elements give a key
    for each group: the XOR of a second hash. Whatever order all keys of the corpus have,
    the first D + 1 of each set's keys hold one that both share, as at most D of a set's
    keys are not shared. A set that has fewer keys than that gets one for its empty groups.
    """
    n = np.diff(bounds)
    band = np.frexp(np.maximum(n, 1).astype(np.float64))[1].astype(np.int64) - 1 + up
    largest, top = n * 100 // PERCENT, (np.int64(2) << band) - 1
    valid = (n > 0) & ((up == 0) | (top // 2 + 1 <= largest))
    wanted = np.where(valid, most_different(n, np.minimum(top, largest)) + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    if not valid.all():
        value, owner = value[valid[owner]], owner[valid[owner]]
    shift = np.where(top < SINGLE, 0, 64 - band).astype(np.uint64)
    group = value >> shift[owner]
    new = np.ones(len(value), bool)
    new[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(mix(value), first) if len(first) else value
    owner, group = owner[first], group[first]
    key = mix(parity + group * np.uint64(0xD1342543DE82EF95) + band[owner].astype(np.uint64))
    lacking = np.flatnonzero(np.bincount(owner, minlength=len(n)) < wanted)
    if len(lacking):
        owner, key = np.concatenate([owner, lacking]), np.concatenate([key, mix(band[lacking].astype(np.uint64))])
        order = np.argsort(owner, kind="stable")
        owner, key = owner[order], key[order]
    return key, owner, wanted, np.bincount(owner, minlength=len(n))


def _sketches(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """The parity sketch of each set, and a finer one, of as many bits as elements or more, where a set outgrows the first."""
    bit, n = mix(value ^ np.uint64(77)), np.diff(bounds)
    spot = np.repeat(np.arange(len(n)), n) * (64 * SKETCH) + (bit % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = (np.bincount(spot, minlength=len(n) * 64 * SKETCH) & 1).astype(np.uint8)
    fine: list[bytes | None] = [None] * len(n)
    for i in np.flatnonzero(n > 64 * SKETCH).tolist():
        m = 1 << (int(n[i]) - 1).bit_length()
        own = bit[bounds[i] : bounds[i + 1]] % np.uint64(m)
        fine[i] = np.packbits((np.bincount(own.astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()
    return np.packbits(odd).view(np.int64).reshape(-1, SKETCH), fine


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text one row for each band it can link in, with its keys by slice; the first has its size, digests and sketches, too."""
    for batch in batches:
        for part in slices(batch, "text"):
            value, bounds = _sets(part.column("text"))
            n = np.diff(bounds)
            some = n > 0
            linkable = part.column("linkable").to_numpy(zero_copy_only=False)
            set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if some.any():
                set_a[some] = np.bitwise_xor.reduceat(mix(value ^ np.uint64(1)), bounds[:-1][some])
                set_b[some] = np.add.reduceat(mix(value ^ np.uint64(2)), bounds[:-1][some])
            sketch, fine = _sketches(value, bounds)
            for up in (0, 1):
                key, owner, wanted, total = _keys(value, bounds, up)
                rows = np.flatnonzero((wanted > 0) & linkable) if up else np.arange(len(n))
                key, owner = key[linkable[owner]], owner[linkable[owner]]
                place, lists = key % np.uint64(SLICES), []
                for k in range(SLICES):
                    own = place == k
                    counts = np.bincount(owner[own], minlength=len(n))[rows]
                    lists.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(key[own].view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").take(pa.array(rows)), pa.array(linkable[rows]), pa.array(np.full(len(rows), up, np.int32)), pa.array(n[rows]), pa.array(total[rows]), pa.array(wanted[rows]),
                        pa.array(set_a[rows].view(np.int64)), pa.array(set_b[rows].view(np.int64)),
                        *(pa.array(np.ascontiguousarray(sketch[rows, i])) for i in range(SKETCH)), pa.array([None if up else fine[i] for i in rows.tolist()], pa.binary()), *lists,
                    ],
                    [c.split(" ")[0] for c in _SETS.split(", ")],
                )


def _odd_bits(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches; the longer one is folded to the length of the other."""
    u, v = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(v) > len(u):
        half = len(v) // 2
        v = v[:half] ^ v[half:]
    return int(np.bitwise_count(u ^ v).sum())


def _finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose fine sketches have no more odd bits than linked sets can have different elements."""
    for batch in batches:
        sizes = (np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))).tolist()
        fines = zip(sizes, batch.column("fine_a"), batch.column("fine_b"))
        keep = [
            x.as_py() is None or y.as_py() is None or (100 + PERCENT) * _odd_bits(x.as_py(), y.as_py()) <= (100 - PERCENT) * n for n, x, y in fines
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets, built again from the whole texts, are alike."""
    for batch in batches:
        for part in slices(batch, "text_a", 1 << 19):
            (u, at), (v, to) = _sets(part.column("text_a")), _sets(part.column("text_b"))
            keep = []
            for i in range(part.num_rows):
                x, y = u[at[i] : at[i + 1]], v[to[i] : to[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may_link(x: str, y: str) -> Column:
    """Sizes near enough, and no more odd sketch bits than linked sets can have different elements."""
    odd = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n) & ((100 + PERCENT) * odd <= (100 - PERCENT) * (n + m))


def _same_set(x: str, y: str) -> Column:
    return (F.col(f"{x}.set_a") == F.col(f"{y}.set_a")) & (F.col(f"{x}.set_b") == F.col(f"{y}.set_b")) & (F.col(f"{x}.n_shingles") == F.col(f"{y}.n_shingles"))


class _Links:
    """Links found so far, and the component of each node under them."""

    def __init__(self, rows: DataFrame, sets: DataFrame, ws: Workspace):
        self.rows, self.sets, self.ws, self.turn = rows.select("node", "text"), sets, ws, 0
        self.parts: list[DataFrame] = []
        self.new, self.checks = False, 0
        self.labels: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        self.turn += 1
        self.parts.append(self.ws.table(links.select("a", "b"), f"links_{self.turn}"))
        self.new = self.new or not self.parts[-1].isEmpty()

    def relabel(self) -> None:
        if self.labels is not None and not self.new:
            return
        self.new = False
        every = self.parts[0]
        for more in self.parts[1:]:
            every = every.unionByName(more)
        self.labels = connected_components(every, self.ws, f"cc_{self.turn}")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that no path of links joins yet."""
        la, lb = self.labels.toDF("a", "_la"), self.labels.toDF("b", "_lb")
        joined = pairs.join(la, "a", "left").join(lb, "b", "left")
        return joined.where("coalesce(_la, a) <> coalesce(_lb, b)").select(*pairs.columns)

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches allow."""
        x, y = self.sets.alias("x"), self.sets.alias("y")
        out = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        return out.where(_may_link("x", "y")).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link. Fine sketches come first; only texts of pairs that these allow, too, move."""
        self.checks += 1
        fine = self.sets.select("node", "n_shingles", "fine")
        pairs = pairs.select("a", "b").join(fine.toDF("a", "n_a", "fine_a"), "a").join(fine.toDF("b", "n_b", "fine_b"), "b")
        pairs = self.ws.table(pairs.mapInArrow(_finely, "a bigint, b bigint"), f"fine_{self.checks}")
        if pairs.isEmpty():
            return pairs
        # As a table its size is known: Spark broadcasts it below its own limit and shuffles texts above.
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.ws.table(wanted, f"wanted_{self.checks}")
        texts = self.ws.table(self.rows.join(wanted, "node", "left_semi"), f"texts_{self.checks}")
        left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
        return pairs.join(left, "a").join(right, "b").mapInArrow(_check, "a bigint, b bigint")


def _same_sets(sets: DataFrame) -> DataFrame:
    """(a, b): the smallest node of each set that several nodes have, and each other one. Counted before the shuffle; hot ones are split by the skew join."""
    digest = ["n_shingles", "set_a", "set_b"]
    first = sets.groupBy(*digest).agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").drop("z")
    return sets.select("node", *digest).join(first.hint("shuffle_merge"), digest).where("node <> a").select("a", F.col("node").alias("b"))


def _shared_keys(described: DataFrame, copies: DataFrame, ws: Workspace) -> DataFrame:
    """(key, node): the keys by which a set can have links, rarest first.

    All keys are ordered by how many sets have them in the whole corpus. A set needs its
    first `wanted` keys; those that no other set has lead nowhere, so a set with that many
    of its own has no link. Keys of passages that many texts share come last, and count
    only where a text has little else.
    """
    shared = None
    for k in range(SLICES):
        each = described.select("node", "up", F.explode(f"keys{k}").alias("key"))
        often = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        part = ws.table(each.join(often.hint("shuffle_hash"), "key"), f"shared_{k}")
        shared = part if shared is None else shared.unionByName(part)
    # The keys themselves are not needed any more: their table goes before the next shuffle comes.
    sizes = ws.table(described.select("node", "up", "total", "wanted"), "key_counts")
    ws.drop("described")
    shared = shared.join(copies.select(F.col("b").alias("node")).hint("shuffle_merge"), "node", "left_anti")
    # One set's keys at a time: no more than its text has words.
    own = shared.groupBy("node", "up").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    known = own.join(sizes.hint("shuffle_merge"), ["node", "up"])
    need = (F.col("wanted") - F.col("total") + F.size("own")).cast("int")
    first = known.where(need > 0).select("node", F.explode(F.slice("own", F.lit(1), need)).alias("first"))
    out = ws.table(first.select(F.col("first.key").alias("key"), "node"), "first_keys")
    ws.drop(*(f"shared_{k}" for k in range(SLICES)))
    return out


def _heads(part: DataFrame) -> DataFrame:
    """(key, head): the smallest node of each key that several nodes have. Of keys that just the same nodes have (by count and digests) only one is given, as the others show the same pairs."""
    digest = [F.bit_xor(F.xxhash64("node")).alias("da"), F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(1)), 32)).alias("db")]
    each = part.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.count("*").alias("n"), *digest).where("head <> tail")
    return each.groupBy("head", "tail", "n", "da", "db").agg(F.min("key").alias("key")).select("key", "head")


def _meet(own: DataFrame, others: DataFrame, more: Column) -> DataFrame:
    """(a, b): the different pairs of each key's x and y that are apart and that the bounds allow, of two x just once, where more holds, too."""
    both = own.alias("p").join(others.alias("q").hint("shuffle_merge"), F.col("p.key") == F.col("q.key")).where("x <> y and p.label <> q.label and (x < y or not q.mine)")
    both = both.where(_may_link("p", "q")).where(more)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _partners(pairs: DataFrame) -> DataFrame:
    """(node, partners): nodes that each node of the pairs has met, at most PARTNERS, the smallest of each place. One that finds no place only meets again."""
    each = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("node", "partner")
    kept = each.groupBy("node", F.pmod(F.xxhash64("partner"), F.lit(PARTNERS)).alias("place")).agg(F.min("partner").alias("partner"))
    return kept.groupBy("node").agg(F.collect_list("partner").alias("partners"))


def similarity_links(rows: DataFrame, ws: Workspace, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The set of each of rows(node, text, linkable), and (node, component) of every node with a link to another one.

    known(a, b) are links that hold already. Nodes with equal sets link at once; the
    smallest stands for them. Each key's nodes first meet its smallest one. Only nodes that
    are then still apart from it are compared with the others of their key that they are
    still apart from, so all links are found up to connectivity, without all pairs of a group;
    a pair that a few of the keys show is not shown again by each other key that both have.
    """
    described = ws.table(rows.select("node", "text", "linkable").mapInArrow(_describe, _SETS), "described")
    every = described.where("up = 0").drop("up", "total", "wanted", *(f"keys{k}" for k in range(SLICES)))
    every = ws.table(every, "sets")
    sets = every.where("linkable and n_shingles > 0")
    found = _Links(rows, sets, ws)
    if known is not None:
        found.add(known)
    found.add(_same_sets(sets))
    part = _shared_keys(described, found.parts[-1], ws)
    met = ws.table(part.join(_heads(part).hint("shuffle_merge"), "key").where("node <> head"), "met")
    pairs = met.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    pairs = ws.table(found.plausible(pairs), "pairs")
    found.add(found.verified(pairs.groupBy("b").agg(F.min("a").alias("a"))))
    found.relabel()
    rest = ws.table(found.apart(pairs), "rest")
    if not rest.isEmpty():
        found.add(found.verified(rest))
        found.relabel()
    bad = ws.table(found.apart(met.withColumnsRenamed({"head": "a", "node": "b"})).select("key", F.col("b").alias("x")), "bad")
    if not bad.isEmpty():
        # Again each key's rest meets its smallest node first.
        firsts = bad.groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a <> z").select("key", "a")
        second = bad.join(firsts.hint("shuffle_merge"), "key").where("x <> a").select("a", F.col("x").alias("b")).distinct()
        found.add(found.verified(found.plausible(found.apart(second))))
        found.relabel()
        sketch = [f"s{i}" for i in range(SKETCH)]
        label = sets.select("node", "n_shingles", *sketch).join(found.labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        label = label.select("node", "n_shingles", *sketch, F.coalesce("component", "node").alias("label"))
        own = ws.table(bad.join(label.withColumnRenamed("node", "x"), "x"), "own")
        others = met.select("key", F.explode(F.array("head", "node")).alias("y")).join(bad.select("key").distinct(), "key", "left_semi")
        others = others.withColumn("mine", F.lit(False)).unionByName(bad.select("key", F.col("x").alias("y"), F.lit(True).alias("mine")))
        others = others.groupBy("key", "y").agg(F.max("mine").alias("mine"))
        others = ws.table(others.join(label.withColumnRenamed("node", "y"), "y"), "others")
        # Texts a little below the similarity share most of their keys: few of these show most pairs, which the rest then need not show again.
        sooner = ws.table(_meet(*(x.where(F.pmod("key", F.lit(SOONER)) == 0) for x in (own, others)), F.lit(True)), "sooner")
        found.add(found.verified(sooner))
        own = own.join(_partners(sooner).withColumnRenamed("node", "x").hint("shuffle_merge"), "x", "left")
        later = ws.table(_meet(own, others, ~F.coalesce(F.array_contains("p.partners", F.col("q.y")), F.lit(False))), "later")
        found.relabel()
        found.add(found.verified(found.apart(later)))
        found.relabel()
    return every, found.labels


def _rows(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs as (row, node): each row a node of its own, named once."""
    return ws.table(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("node")), "rows")


def jaccard_components(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text); other columns are not read.

    Texts are lower-cased for A-Z; shingles are NGRAM words, a shorter text is one
    shingle, a text without words or null has none and links with nothing. component_id
    is the smallest doc_id reachable by links. Rows that share a doc_id are joined,
    whatever their texts. A null doc_id links with nothing and is its own component
    (null). An empty table gives no rows. A text of b bytes needs about 40 b of memory.
    """
    rows = _rows(docs.select("doc_id", "text"), ws)
    named = rows.where("row.doc_id is not null").select("node", "row.doc_id")
    twice = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    twice = named.select("doc_id", F.col("node").alias("b")).join(twice.hint("shuffle_merge"), "doc_id").where("a <> b").select("a", "b")
    sizes, labels = similarity_links(rows.select("node", "row.text", F.col("row.doc_id").isNotNull().alias("linkable")), ws, twice)
    names = named.join(labels, "node")
    least = names.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = names.join(least.hint("shuffle_merge"), "component").select("node", "component_id")
    out = sizes.join(rows.select("node", "row.doc_id"), "node").join(names, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, or one without an id where no row has any.

    Here each row is a node of its own, also where rows share an id or have none; of equal
    ids the first row stays. Rows without words link with nothing and stay. All columns
    pass through, whatever their names; an empty table gives no rows.
    """
    rows = _rows(docs, ws)
    _, labels = similarity_links(rows.select("node", "row.text", F.lit(True).alias("linkable")), ws)
    linked = rows.select("node", "row.doc_id").join(labels, "node")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first"))
    gone = linked.join(first.hint("shuffle_merge"), "component").where("node <> first.node").select("node")
    return rows.join(gone, "node", "left_anti").select("row.*")
