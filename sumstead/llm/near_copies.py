"""Near copies for the pipeline: documents whose shingle sets have a Jaccard similarity of SIMILARITY at least.

SimHash fingerprints of the shingle sets (SHINGLE_WORDS words, lower case, cut
at ASCII blanks; a shorter text is one shingle) are linked through the BK-trees
of ``simhash_tree``, and each link is checked on the sets.  Fingerprints alone
miss most pairs near the bound, so an exact check follows for all that the
trees leave, with no chance of a missed pair: a set of n shingles that is
similar to another shares one of its first n // 5 + 1 shingles with it, in any
one order of all shingles.  The order takes rare shingles first.  How rare one is
comes from COUNTERS counters that every set adds to by its shingles' hashes: a
table of fixed size with room for every shingle, so that passages of many
documents come last however many there are.  Tasks add up their counters before
anything is shuffled.  The order decides the work and never the result.

1. Equal sets become one node before anything is compared.
2. Nodes whose fingerprints the trees link, or that have one fingerprint, are
   compared.
3. Each node deals its first shingles; those that no other node deals go.
4. Each node is compared with the least node of each shingle, unless it was in
   2, and components of what is similar are formed.  So a large group of copies
   needs no pairs.
5. Then all pairs of different components that share a first shingle are
   compared.  Pairs that share too few first shingles for their sizes are left
   out, by a bound that holds for every similar pair.

Texts are never shuffled to be looked up: rows that go, and rows whose sets are
compared, are found by their numbers alone and picked out in place (``sieve``).
Every link is verified on the whole sets.  Shingles are told apart by 64 bits,
equal sets by 128.

A null text has no shingles, as has a text of blanks; these are equal.  Null
ids are kept and never the smallest.  Of equal rows one stays.  An empty table
gives no rows; extra columns stay, whatever their names.  A long text is one
value and one batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumstead.llm import simhash_tree
from sumstead.llm.common import by_bytes, plain_names, with_text
from sumstead.llm.components import roots
from sumstead.llm.sieve import only, without
from sumstead.session import cut_lineage

SHINGLE_WORDS = 5
#: Similarity as a fraction of whole numbers; the bounds below follow from it.
SIMILARITY = (4, 5)
COUNTERS = 1 << 22
#: Counters that are shuffled as one value.
BLOCK = 1 << 12
_U = np.uint64
_MIX, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * _U(2) + _U(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE_WORDS, len(words))
    n = len(words) - size + 1 if words else 0
    sums = np.full(n, size, dtype=np.uint64)
    for i in range(size if n else 0):
        sums = (sums ^ (sums >> _U(29))) * _MIX + hashes[i : i + n] * _FACTORS[i]
    sums = (sums ^ (sums >> _U(31))) * _MIX2
    return np.unique(sums ^ (sums >> _U(32)))


def n_first(n: int) -> int:
    """So many shingles of a set of ``n`` have one in common with those of each similar set."""
    return n // 5 + 1 if n else 0


def first_shingles(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set in the order of its counters, then value."""
    return own[np.lexsort((own, counts[own % _U(len(counts))]))[: n_first(len(own))]]


def _per_text(batches: Iterator[pa.RecordBatch], column: str = "_text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in by_bytes(whole, column, 1 << 20):
            yield batch, [shingles(t.as_py() or b"") for t in batch.column(column).cast(pa.binary())]


def _texts(docs: DataFrame, text_column: str, *others: str) -> DataFrame:
    return docs.select(*others, F.col(text_column).cast("string").alias("_text"))


def _with_set(docs: DataFrame, text_column: str) -> DataFrame:
    """All columns, ``_n`` shingles, two hashes of the set and its fingerprint."""
    names = docs.columns
    marked, text = with_text(docs, text_column)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _per_text(batches, text):
            n = pa.array([len(s) for s in sets], pa.int32())
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            prints = pa.array([simhash_tree.of_hashes([s]) for s in sets], pa.int64())
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, n, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), prints],
                                             [*names, "_n", "_h", "_g", "_fp"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_n", T.IntegerType()), T.StructField("_h", T.LongType()),
                           T.StructField("_g", T.LongType()), T.StructField("_fp", T.LongType())])
    return marked.mapInArrow(add, schema)


def _keys(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """The first shingles of each node."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _per_text(batches):
            own = [first_shingles(s, shared.value) for s in sets]
            sizes = [len(o) for o in own]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), sizes)),
                     pa.array(np.repeat(np.array([len(s) for s in sets], dtype=np.int32), sizes))], ["key", "node", "n"])

    return texts.mapInArrow(emit, "key bigint, node bigint, n int")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows whose key another row has too."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = None, False  # the last row, and whether the one before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held is not None else [batch])
            key = table["key"].to_numpy()
            same = key[1:] == key[:-1]
            marks = np.append(same, False) | np.insert(same, 0, again)
            held, again = batch.slice(batch.num_rows - 1), bool(marks[-1])
            yield from table.slice(0, len(key) - 1).filter(pa.array(marks[:-1])).to_batches()
        if again:
            yield held

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(look, "key bigint, node bigint, n int")


def _packed(blocks: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Blocks of counters, each as the narrowest numbers that hold it; those of zeros only are left out."""
    own = [(block, zlib.compress(c.astype(np.min_scalar_type(c.max())).tobytes(), 1)) for block, c in blocks if c.any()]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int32()), pa.array([c for _, c in own], pa.binary())],
                                      ["block", "counts"])


def _unpacked(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    for block, packed in zip(rows["block"], rows["counts"], strict=True):
        own = zlib.decompress(packed.as_py())
        yield block.as_py(), np.frombuffer(own, dtype=f"u{len(own) // BLOCK}")


def shingle_counters(texts: DataFrame) -> np.ndarray:
    """How many shingles of all nodes fall on each counter: COUNTERS numbers, whatever the table's size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers are as wide as they have to be, as each worker holds all of them.
        counts = np.zeros(COUNTERS, dtype=np.uint8)
        for _, sets in _per_text(batches):
            at, c = np.unique(np.concatenate(sets) % _U(COUNTERS), return_counts=True)
            if len(at):
                counts = counts.astype(np.promote_types(counts.dtype, np.min_scalar_type(int(counts.max()) + int(c.max()))), copy=False)
                counts[at] += c.astype(counts.dtype)
        yield _packed(enumerate(counts.reshape(-1, BLOCK)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, np.zeros(BLOCK, dtype=np.uint64)
        for batch in batches:
            for block, counts in _unpacked(batch):
                if block != held:
                    yield _packed([(held, sums)])
                    held, sums = block, np.zeros(BLOCK, dtype=np.uint64)
                sums += counts
        yield _packed([(held, sums)])

    schema = "block int, counts binary"
    by_block = texts.mapInArrow(count, schema).repartition("block").sortWithinPartitions("block")
    counts = np.zeros((COUNTERS // BLOCK, BLOCK), dtype=np.uint64)
    for block, own in _unpacked(by_block.mapInArrow(add, schema).toArrow()):
        counts[block] = own
    return counts.reshape(-1).astype(np.min_scalar_type(counts.max()))


def _may_be_similar(a: Column, b: Column, c: Column) -> Column:
    """Whether sets of ``a`` and ``b`` shingles that share ``c`` of the first ones can be similar.

    What both have up to the smaller last of their first shingles is among the
    first of both, so only what one of them has behind these can come to it.
    """
    def behind(n: Column) -> Column:
        return n - F.floor(n / 5) - 1

    sizes = (4 * a <= 5 * b) & (4 * b <= 5 * a)
    return sizes & (9 * (c + F.greatest(behind(a), behind(b))) >= 4 * (a + b))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose sets are similar; ``pairs`` is a stored table."""
    nodes = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "compared")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _per_text(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["node", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
                own, other = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (a, b))
                common = len(np.intersect1d(own, other, assume_unique=True))
                right.append(9 * common >= 4 * (len(own) + len(other)))
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    sets = cut_lineage(only(texts, nodes, "node").mapInArrow(emit, "node bigint, set binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints (``fp``) are equal or linked by a tree; ``prints`` is a stored table."""
    least = cut_lineage(prints.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    ends = simhash_tree.links(least.select("fp"))
    for end in ("a", "b"):
        ends = ends.join(least.select(F.col("fp").alias(end), F.col("node").alias(f"_{end}")), end)
    equal = prints.join(least.withColumnRenamed("node", "_a"), "fp").where("node <> _a").select("_a", F.col("node").alias("_b"))
    both = ends.select("_a", "_b").unionByName(equal)
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


def links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect whatever nodes are similar.

    ``texts`` has ``node`` and ``_text``, ``prints`` ``node`` and ``fp``; both have one row for each set, and ``prints`` is stored.
    """
    met = cut_lineage(_by_fingerprint(prints), "met")
    trees = cut_lineage(_verified(met, texts), "trees")

    shared = cut_lineage(_shared(_keys(texts, shingle_counters(texts))), "shared")

    # Against the least node of each shingle.
    least = shared.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"))
    stars = shared.join(least, "key").where("node > least.node").groupBy(
        F.col("least.node").alias("a"), F.col("node").alias("b"), F.col("least.n").alias("na"), F.col("n").alias("nb"))
    tried = stars.agg(F.count(F.lit(1)).alias("c")).where(_may_be_similar(F.col("na"), F.col("nb"), F.col("c"))).select("a", "b")
    tried = cut_lineage(tried.join(met, ["a", "b"], "left_anti"), "tried")
    first = trees.unionByName(cut_lineage(_verified(tried, texts), "links"))

    # Whatever is left: pairs of two components.  Each has a node outside the least component of its shingle.
    found = roots(first)
    rooted = shared.join(found, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = cut_lineage(rooted, "rooted")
    mains = rooted.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("most")).where("main < most")
    members = cut_lineage(rooted.join(mains.select("key", "main"), "key"), "members")
    x, y = members.where("root <> main").alias("x"), members.alias("y")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where(
        "x.root <> y.root AND (y.root = y.main OR x.node < y.node) AND 4 * x.n <= 5 * y.n AND 4 * y.n <= 5 * x.n")
    a, b = F.struct("x.node", "x.n"), F.struct("y.node", "y.n")
    pairs = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = pairs.where(_may_be_similar(F.col("a.n"), F.col("b.n"), F.col("c"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    left = cut_lineage(pairs.join(met.unionByName(tried), ["a", "b"], "left_anti"), "left")
    return first.unionByName(_verified(left, texts))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows without near copies: of each component the row with the smallest id stays, one of equal rows."""
    given = docs.columns
    docs, (id_column, text_column) = plain_names(docs, id_column, text_column)
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    stored = cut_lineage(_with_set(numbered, text_column), "marked")
    order = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.col("_row").alias("row"))
    nodes = stored.groupBy("_h", "_g").agg(F.min(order).alias("first"), F.min("_fp").alias("fp"))
    nodes = cut_lineage(nodes.select("first", F.col("first.row").alias("node"), "fp"), "nodes")
    rows = stored.select("_row")
    copies = cut_lineage(rows.join(nodes.select(F.col("node").alias("_row")), "_row", "left_anti"), "copies")
    single, *doubted = without(stored.select("_row", text_column), copies, "_row")
    texts = single
    for rest in doubted:
        texts = texts.unionByName(cut_lineage(rest, "single"))
    found = roots(links(_texts(texts, text_column, F.col("_row").alias("node")), nodes.select("node", "fp")))
    kept = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    gone = cut_lineage(rows.join(kept.select(F.col("first.row").alias("_row")), "_row", "left_anti"), "gone")
    left, *doubted = without(stored, gone, "_row")
    for rest in doubted:
        left = left.unionByName(rest)
    return left.select(*docs.columns).toDF(*given)
