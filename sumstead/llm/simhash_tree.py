"""Operator 8: near-duplicates by 64-bit SimHash, linked through BK-trees.

Fingerprints within RADIUS differing bits agree on all but RADIUS of any
number of bit blocks, so each distinct fingerprint is dealt to a shard for
every choice of the blocks that agree, and shards need only be searched by
themselves.  A shard is a BK-tree: children are keyed by their Hamming
distance to the parent, and a search follows only the edges within the
radius.  Trees hold every fingerprint and so have no size bound; they are not
broadcast but grow where their shard's rows are.  The number of blocks is
chosen by the number of fingerprints, so shards stay small at any size; every
choice finds every link.

Equal fingerprints are one node, and a search passes by a subtree that lies in
one component with the searched value already, so large groups of copies cost
neither pairs nor visits.  Components come from ``components.roots``.

A null text has no words and fingerprint 0, as has a text of blanks; these are
linked like any other.  Null ids are kept and never the smallest.  Repeated
rows stay in the result.  An empty table gives no rows; extra columns are left
out of links, kept by ``keep_one``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumstead.llm.common import by_bytes, read_table
from sumstead.llm.components import roots
from sumstead.session import cut_lineage

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text; bytes.split cuts at exactly the six ASCII blanks."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    found = []
    for at in range(0, len(starts), _CHUNK):
        some = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        found.append(np.array([digest(joined[a:b], SEED) for a, b in some], dtype="<u8"))
    return of_hashes(found)


def of_hashes(parts: list[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes, as a signed number; 0 without hashes."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in parts:
        for at in range(0, len(hashes), _CHUNK):
            some = np.ascontiguousarray(hashes[at : at + _CHUNK], dtype="<u8")
            ones += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, column: str = "fp", text_column: str = "text",
                     shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """All columns and the fingerprint as a signed number."""
    names = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "_text"):
                found = [fingerprint(t.as_py() or b"", shingle_words) for t in batch.column("_text")]
                own = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.int64())], [*names, column])

    rows = docs.select("*", F.col(text_column).cast("string").cast("binary").alias("_text"))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])
    return rows.mapInArrow(add, schema)


class Tree:
    """A BK-tree that joins what it takes in to the components it holds."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # of the component, not of the tree
        self.mixed: list[bool] = []  # whether more than one component may be below

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, value: int) -> Iterator[tuple[int, int]]:
        """Takes the value in and yields a link for each component that it joins."""
        new, radius = len(self.values), self.radius
        self.values.append(value)
        self.children.append({})
        self.parent.append(new)
        self.mixed.append(False)
        open_nodes = [0] if new else []
        while open_nodes:
            node = open_nodes.pop()
            if not self.mixed[node] and self.find(node) == self.find(new):
                continue
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                a, b = self.find(node), self.find(new)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    yield value, self.values[node]
                if not self.mixed[node]:
                    continue
            for edge, child in self.children[node].items():
                if -radius <= edge - distance <= radius:
                    open_nodes.append(child)
        node = 0
        while node != new:
            if self.find(node) != self.find(new):
                self.mixed[node] = True
            node = self.children[node].setdefault((value ^ self.values[node]).bit_count(), new)


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect whatever values are within the radius."""
    tree = Tree(radius)
    return [link for value in values for link in tree.add(value)]


def block_choice(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """Numbers of blocks and of agreeing ones with the least expected work for ``n`` values.

    At least two blocks agree: with one, shards would soon have to give way to
    three times as many rows.
    """
    def work(agree: int) -> float:
        blocks = radius + agree
        shards = len(list(itertools.combinations(range(blocks), agree)))
        return shards * (1 + 0.2 * n / 2.0 ** (BITS * agree / blocks))

    best = min(range(2, 6), key=work)
    return radius + best, best


def masks(blocks: int, agree: int) -> list[int]:
    """The bits that agree, for every choice of blocks."""
    bounds = [round(BITS * i / blocks) for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(bounds)]
    return [sum(chosen) for chosen in itertools.combinations(own, agree)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("bigint")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the distinct values of ``fp`` within the radius; ``nodes`` is a stored table."""
    choice = masks(*block_choice(nodes.count(), radius))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(_signed(m)).alias("bits"))
                     for i, m in enumerate(choice)])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.bits", "fp")
    sharded = dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values = None, []
        for batch in itertools.chain(batches, [None]):
            found: list[tuple[int, int]] = []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch else [(None, None, 0)]
            for choice, bits, fp in rows:
                if (choice, bits) != key:
                    if len(values) > 1:
                        found += shard_links(values, radius)
                    key, values = (choice, bits), []
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return sharded.mapInArrow(search, "a bigint, b bigint")


def groups(rows: DataFrame, id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``fp``, ``root`` and the smallest id of the component; ``rows`` is a stored table with ``fp``."""
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(id_column).alias("least")), "nodes")
    found = roots(links(nodes, radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.drop("least").join(smallest, "root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS,
                    shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: its id, ``fingerprint`` in hexadecimal digits and ``component_id``."""
    own = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_body"))
    rows = cut_lineage(with_fingerprint(own, "fp", "_body", shingle_words).drop("_body"), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(groups(rows, id_column, radius), "fp").select(id_column, digits, "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS,
             shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows without near-duplicates: of each component the row with the smallest id stays, one of equal rows."""
    marked = with_fingerprint(docs, "_fp", text_column, shingle_words)
    stored = cut_lineage(marked.withColumn("_row", F.monotonically_increasing_id()), "marked")
    rows = stored.select(F.col("_fp").alias("fp"), F.col(id_column).alias("_id"), "_row")
    found = groups(rows, "_id", radius).select("fp", "root")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("first")
    kept = rows.join(found, "fp").groupBy("root").agg(first).select(F.col("first._row").alias("_row"))
    return stored.join(kept, "_row", "left_semi").select(*docs.columns)


def op8_simhash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_tree": op8_simhash_tree}
ORACLES: dict[str, str] = {}
