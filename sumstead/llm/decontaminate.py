"""Operator 6: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are lower-cased runs of letters and digits.  An item's seeds are those of
its windows of a few words that are rarest in the training documents, counted
over all of them.  A window around each seed that a document holds is aligned
with the item word by word; a document is contaminated if the best local
alignment reaches MIN_SCORE of what the item scores against itself.

No alignment that good is missed.  With MATCH 2, MISMATCH -1 and GAP -2, an
alignment of share t of an item of n words loses at most 2 (1 - t) n.  A window
of three words that it breaks costs 1 or more, so (2t - 1) n - 2 of these are
whole; two broken windows of two words cost 3 or more, a single one 2 or more;
and t n of the words are matched.  An item's seeds have the largest of these
three sizes of which one whole window is sure (at 0.6: three words from eleven
words on, two from two on), and only as many of the commonest are left out as
keep one seed in each such alignment.

Items are read in blocks of at most BLOCK_WORDS words (a larger item is a block
by itself); each block is broadcast and meets all documents in two scans.
Nothing is shuffled but one count per seed.

Documents left by a block are stored before the next block
reads them, so scans grow with the number of blocks only.

A null text has no words; an item without words matches nothing.  A very long
text is one value and one batch.  Repeated documents and repeated items are reported
each; null ids are kept.  Extra columns
are left out of matches and kept by ``clean``, whatever their names.  Empty tables give no matches.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import by_bytes, plain_names, read_table, texts_of, with_text
from sumstead.session import cut_lineage

#: Words of a seed, the largest that is sure first.
SEED_SIZES = (3, 2, 1)
MATCH, MISMATCH, GAP = 2, -1, -2
MIN_SCORE = 0.6
BLOCK_WORDS = 200_000
_WORD = re.compile(r"\w+")

MATCHES = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and where it ends in the item and in the words."""
    across = -GAP * np.arange(len(words) + 1)
    row, best = np.zeros(len(words) + 1, dtype=np.int64), (0, 0, 0)
    for i, word in enumerate(item.tolist(), 1):
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(words == word, MATCH, MISMATCH))
        # A gap along the words: the best earlier cell less the gap's length.
        row = np.maximum.accumulate(step + across) - across
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), i, at)
    return best


def span(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Score, first and last word of the best local alignment."""
    score, i, end = align(item, words)
    _, _, back = align(item[:i][::-1], words[:end][::-1])
    return score, end - back, end - 1


def sure_windows(n: int, size: int, min_score: float) -> int:
    """So many windows of ``size`` words of an item of ``n`` words are whole in each alignment that is good enough."""
    lost = 2 * (1 - min_score) * n + 1e-9
    if size == 3:
        return max(0, int(np.ceil(n - 2 - lost)))
    if size == 2:
        return max(0, n - 1 - 2 * int(lost // 3) - int(lost % 3 >= 2))
    return max(0, int(np.ceil(n - lost / 2)))


def seed_size(n: int, min_score: float) -> int:
    """Words of the seeds of an item of ``n`` words."""
    return next((size for size in SEED_SIZES if sure_windows(n, size, min_score)), SEED_SIZES[-1])


@dataclass(frozen=True)
class Block:
    """Items of bounded size, as word numbers, and their seeds."""

    ids: list
    items: list[np.ndarray]
    words: dict[str, int]
    #: Sorted codes of seeds, and for each code where it occurs: (item, offset).
    codes: np.ndarray
    places: list[list[tuple[int, int]]]
    #: Words of the seeds in it.
    sizes: list[int]

    @classmethod
    def of(cls, rows: list[tuple[object, list[str]]], min_score: float = MIN_SCORE) -> Block:
        words: dict[str, int] = {}
        items = [np.array([words.setdefault(w, len(words) + 1) for w in own], dtype=np.int64) for _, own in rows]
        found = defaultdict(list)
        for n, item in enumerate(items):
            for offset, code in enumerate(encode(item, len(words) + 1, seed_size(len(item), min_score)).tolist()):
                found[code].append((n, offset))
        sizes = sorted({seed_size(len(item), min_score) for item in items})
        return cls._with([doc for doc, _ in rows], items, words, found, sizes)

    @classmethod
    def _with(cls, ids: list, items: list, words: dict, found: dict, sizes: list[int]) -> Block:
        codes = np.array(sorted(found), dtype=np.int64)
        return cls(ids, items, words, codes, [found[c] for c in codes.tolist()], sizes)

    def rarest(self, frequency: dict[int, int], min_score: float) -> Block:
        """Leaves out the commonest seeds of each item that no good alignment depends on."""
        own = defaultdict(list)
        for code, places in zip(self.codes.tolist(), self.places, strict=True):
            for n, offset in places:
                own[n].append((frequency.get(code, 0), offset, code))
        found = defaultdict(list)
        for n, seeds in own.items():
            words = len(self.items[n])
            sure = sure_windows(words, seed_size(words, min_score), min_score)
            for _, offset, code in sorted(seeds)[: len(seeds) - max(0, sure - 1)]:
                found[code].append((n, offset))
        return Block._with(self.ids, self.items, self.words, found, self.sizes)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of a text (0: in no item), where seeds start in it, and which."""
        numbers = np.array(list(map(self.words.get, words_of(text), repeat(0))), dtype=np.int64)
        starts, seeds = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for size in self.sizes:
            codes = encode(numbers, len(self.words) + 1, size)
            at = np.flatnonzero(codes >= 0)
            own = np.searchsorted(self.codes, codes[at])
            right = own < len(self.codes)
            right[right] = self.codes[own[right]] == codes[at[right]]
            starts.append(at[right])
            seeds.append(own[right])
        return numbers, np.concatenate(starts), np.concatenate(seeds)

    def matches(self, text: str, min_score: float) -> Iterator[tuple[int, float, int, int]]:
        """Item number, score, first and last word of the best alignment with each item that is good enough."""
        numbers, at, own = self.hits(text)
        windows = defaultdict(list)
        for place, code in zip(at.tolist(), own.tolist(), strict=True):
            for n, offset in self.places[code]:
                size = len(self.items[n])
                slack = int((1 - min_score) * size) + 1
                windows[n].append((max(0, place - offset - slack), place - offset + size + slack))
        for n, spans in sorted(windows.items()):
            item, best = self.items[n], (0, 0, 0)
            most, needed = Counter(item.tolist()), min_score * MATCH * len(item)
            for start, stop in merged(spans):
                words = numbers[start:stop]
                there = Counter(words.tolist())
                if MATCH * sum(min(count, there[w]) for w, count in most.items()) < needed:
                    continue  # even if every shared word matched
                score, first, last = span(item, words)
                best = max(best, (score, -start - first, -start - last))
            if best[0] >= needed and best[0] > 0:
                yield n, best[0] / (MATCH * len(item)), -best[1], -best[2]


def encode(numbers: np.ndarray, base: int, size: int) -> np.ndarray:
    """One code for each window of ``size`` words, -1 where one of them is 0; codes of two sizes differ."""
    n = max(0, len(numbers) - size + 1)
    codes, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for i in range(size):
        own = numbers[i : i + n]
        codes = codes * base + own
        known &= own > 0
    return np.where(known, codes, -1)


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Overlapping spans as one."""
    start, stop = None, -1
    for a, b in sorted(spans):
        if start is not None and a <= stop:
            stop = max(stop, b)
            continue
        if start is not None:
            yield start, stop
        start, stop = a, b
    if start is not None:
        yield start, stop


def blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text",
           block_words: int = BLOCK_WORDS, min_score: float = MIN_SCORE) -> Iterator[Block]:
    """Items in blocks whose size doesn't depend on how many there are."""
    rows, size = [], 0
    texts = items.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    for row in texts.toLocalIterator():
        words = words_of(row["text"] or "")
        if rows and size + len(words) > block_words:
            yield Block.of(rows, min_score)
            rows, size = [], 0
        rows.append((row["id"], words))
        size += len(words)
    if rows:
        yield Block.of(rows, min_score)


def with_rare_seeds(docs: DataFrame, block: Block, min_score: float, text_column: str = "text") -> Block:
    """The block with the seeds that fewest documents hold."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value.codes), dtype=np.int64)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                for text in texts_of(batch, "text"):
                    seen[np.unique(shared.value.hits(text)[2])] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.codes[at]), pa.array(seen[at])], ["code", "n"])

    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    counted = texts.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    # One row for each seed of a block of bounded size.
    return block.rarest({r["code"]: r["n"] for r in counted.collect()}, min_score)


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, id_column: str = "doc_id",
                 text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item that it holds: the best alignment and where it lies, in words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    found = spark.createDataFrame([], MATCHES)
    for block in blocks(items, item_id, item_text, block_words, min_score):
        shared = spark.sparkContext.broadcast(with_rare_seeds(texts, block, min_score))
        found = found.unionByName(texts.mapInArrow(_matcher(shared, min_score), MATCHES))
    return found


def _matcher(shared, min_score: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                rows = [
                    (doc, block.ids[n], score, first, last)
                    for doc, text in zip(batch.column("id").to_pylist(), texts_of(batch, "text"), strict=True)
                    for n, score, first, last in block.matches(text, min_score)
                ]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "item_id", "score", "first_word", "last_word"],
                )

    return match


def clean(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, text_column: str = "text",
          item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that hold no item, with all their columns; nothing is shuffled."""
    given = docs.columns
    docs, (text_column,) = plain_names(docs, text_column)
    spark, schema, names = docs.sparkSession, docs.schema, docs.columns
    for n, block in enumerate(blocks(items, item_id, item_text, block_words, min_score)):
        if n:
            docs = cut_lineage(docs, "left")
        shared = spark.sparkContext.broadcast(with_rare_seeds(docs, block, min_score, text_column))
        marked, text = with_text(docs, text_column)
        docs = marked.mapInArrow(_filter(shared, min_score, names, text), schema)
    return docs.toDF(*given)


def _filter(shared, min_score: float, names: list[str], text: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, text):
                held = [next(shared.value.matches(t, min_score), None) is None for t in texts_of(batch, text)]
                own = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], names)
                yield own.filter(pa.array(held, pa.bool_()))

    return keep


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES: dict[str, str] = {}
