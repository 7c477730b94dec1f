"""Operator 12: spelling variants grouped through k-d trees over letter counts.

A word is a point whose coordinates are how often it has each letter.  One
replaced letter moves it by 1 down in one coordinate and 1 up in another, one
inserted letter by 1 up: an L1 distance of two at most.  So near words are found
by range searches, from each length in the trees of the same length and of the
next one.  A search enters a box only if the steps that lead there are among
those that one edit has, and compares letter by letter with the words of the
leaves it reaches.  Of two words of one length the one that gives up the
smaller letter searches, so each pair is found once.

Trees are split over tasks: the upper levels of each length's tree come from a
sample of SAMPLE words and cut its words into cells of some CELL_WORDS; a word
goes to its own cell as a point and, as a query, to the cells its search enters.
The sample decides where words go, never what is found.  A task grows the lower
levels for its cell and returns one row for each word: its near words, and the
best of them.  Words of equal letter counts can't be told apart by a tree and
stay in one cell; in a leaf of more than LEAF_WORDS they are met through their
shortened forms instead of one by one, which finds the same pairs.

Words are counted in each task before they are shuffled, so a frequent word is
one row of each task.  Roots are found by doubling: each round reads what the
form's form is, and as counts double at each step, chains are short.

A null text has no words; a null id is written as an empty one; repeated rows
count each; ties go as the contract says.  Long texts are read in parts cut
where no word is.  An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import by_bytes, read_table
from sumstead.session import cut_lineage

MISSPELT = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
FORM_FACTOR = 2
SAMPLE = 1 << 16
CELL_WORDS = 1 << 14
LEAF = 32
LEAF_WORDS = 2048
HELD_WORDS = 1 << 18
PART_CHARS = 1 << 20
BLOCK_BYTES = 1 << 22

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points of letters as coordinates; both in one order.
_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[97:123], _PLACE[192:256] = np.arange(26), np.arange(26, 90)
LETTERS = 90

COUNTED = "word string, n bigint"
DEALT = "length int, cell int, role int, word string, n bigint"
NEAR = "word string, near bigint, form_n bigint, form string"
POINT, SAME, LONGER = 0, 1, 2


# Words


def _parts(text: str) -> Iterator[str]:
    """Parts of a text of lower case, cut behind characters that are in no word."""
    start = 0
    while len(text) - start > PART_CHARS:
        cut = start + PART_CHARS
        run = _RUN.match(text, cut)
        cut = run.end() if run else cut
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def words_of(doc: int | None, text: str) -> Counter:
    """A text's words with their misspellings, and how often it has each."""
    runs: Counter = Counter()
    for part in _parts(text.encode().lower().decode()):
        runs.update(_RUN.findall(part))
    before, found = zlib.crc32(f"{'' if doc is None else doc}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        at = h % len(run)
        found[run if h % MISSPELT else run[:at] + run[at + 1 :]] += n
    return found


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) >= LEAST_LETTERS]
            words, counts = zip(*kept, strict=True) if kept else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in by_bytes(whole, "text"):
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    held.update(words_of(doc, text or ""))
                    if len(held) > HELD_WORDS:
                        yield rows()
                        held.clear()
        yield rows()

    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    counted = texts.mapInArrow(count, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def codes_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(codes), LETTERS), dtype=np.int16 if codes.shape[1] < 1 << 15 else np.int32)
    rows, places = np.arange(len(codes)), _PLACE[codes]
    for i in range(codes.shape[1]):
        counts[rows, places[:, i]] += 1
    return counts


# Trees


@dataclass(frozen=True)
class Tree:
    """A node splits by ``count[letter] <= limit``; a leaf has letter -1 and its number as ``low``."""

    letter: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: int


def grow(counts: np.ndarray, leaf: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree whose leaves hold at most ``leaf`` points, more where these are equal, and the points of each."""
    nodes, leaves = [[-1, 0, 0, 0]], []
    open_nodes = [(0, np.arange(len(counts)))]
    while open_nodes:
        node, own = open_nodes.pop()
        letter = -1
        if len(own) > leaf:
            here = counts[own]
            middle = np.sort(here, axis=0)[len(own) // 2]
            # The split nearest to the middle: behind the median or in front of it.
            below, upto = (here < middle).sum(axis=0), (here <= middle).sum(axis=0)
            smaller = np.maximum(np.minimum(below, len(own) - below), np.minimum(upto, len(own) - upto))
            if smaller.max():
                letter = int(smaller.argmax())
                front = min(below[letter], len(own) - below[letter]) == smaller[letter]
                limit = int(middle[letter]) - int(front)
        if letter < 0:
            nodes[node] = [-1, 0, len(leaves), 0]
            leaves.append(own)
            continue
        nodes[node] = [letter, limit, len(nodes), len(nodes) + 1]
        nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        side = counts[own, letter] <= limit
        open_nodes += [(nodes[node][2], own[side]), (nodes[node][3], own[~side])]
    return Tree(*np.array(nodes, dtype=np.int32).T.copy(), len(leaves)), leaves


def search(tree: Tree, counts: np.ndarray, role: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and the rows whose search enters them.

    A POINT goes to its own leaf.  SAME may lose one letter and get a larger
    one, LONGER may get one.
    """
    n = len(counts)
    start = np.full(n, -1, dtype=np.int16)
    todo = [(0, np.arange(n), start, start)]
    while todo:
        node, rows, lost, got = todo.pop()
        letter = int(tree.letter[node])
        if not len(rows):
            continue
        if letter < 0:
            yield int(tree.low[node]), rows
            continue
        limit = int(tree.limit[node])
        own = counts[rows, letter] + (got == letter) - (lost == letter)
        stays = own <= limit
        todo += [(int(tree.low[node]), rows[stays], lost[stays], got[stays]),
                 (int(tree.high[node]), rows[~stays], lost[~stays], got[~stays])]
        if role != POINT:
            up = (own == limit) & (got < 0) & (lost < letter)
            todo.append((int(tree.high[node]), rows[up], lost[up], np.full(int(up.sum()), letter, dtype=np.int16)))
        if role == SAME:
            down = (own == limit + 1) & (lost < 0) & ((got < 0) | (got > letter))
            todo.append((int(tree.low[node]), rows[down], np.full(int(down.sum()), letter, dtype=np.int16), got[down]))


# Letter order


def replaced(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which query becomes which point when one letter is replaced by a larger one."""
    differ = queries[:, None, :] != points[None, :, :]
    one = differ.sum(axis=2) == 1
    larger = points.sum(axis=1, dtype=np.int64)[None, :] > queries.sum(axis=1, dtype=np.int64)[:, None]
    return one & larger


def inserted(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which query becomes which point when one letter is put in."""
    size = queries.shape[1]
    front = queries[:, None, :] != points[None, :, :-1]
    back = (queries[:, None, :] != points[None, :, 1:])[:, :, ::-1]
    lead = np.where(front.any(axis=2), front.argmax(axis=2), size)
    tail = np.where(back.any(axis=2), back.argmax(axis=2), size)
    return lead + tail >= size


def by_shortened(queries: list[str], points: list[str], role: int) -> list[tuple[int, int]]:
    """The same pairs through an equality of words without one letter: for leaves of many words."""
    forms = defaultdict(set)
    for j, word in enumerate(points):
        for i in range(len(word)):
            forms[(i if role == SAME else 0, word[:i] + word[i + 1 :])].add(j)
    found = set()
    for i, word in enumerate(queries):
        if role == LONGER:
            found.update((i, j) for j in forms.get((0, word), ()))
        else:
            for at in range(len(word)):
                found.update((i, j) for j in forms.get((at, word[:at] + word[at + 1 :]), ()) if word[at] < points[j][at])
    return sorted(found)


def _matches(queries: np.ndarray, points: np.ndarray, query_words: list[str], point_words: list[str],
             role: int) -> tuple[np.ndarray, np.ndarray]:
    if len(points) > LEAF_WORDS:
        pairs = np.array(by_shortened(query_words, point_words, role), dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    step = max(1, BLOCK_BYTES // max(1, points.size))
    left, right = [], []
    for at in range(0, len(queries), step):
        i, j = np.nonzero((replaced if role == SAME else inserted)(queries[at : at + step], points))
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_in_cell(words: list[str], n: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a point (rows of the cell) that are one edit apart."""
    points = np.flatnonzero(roles == POINT)
    if not len(points):
        return points, points
    point_words = [words[i] for i in points.tolist()]
    codes = codes_of(point_words)
    tree, leaves = grow(letter_counts(codes), LEAF)
    left, right = [points[:0]], [points[:0]]
    for role in (SAME, LONGER):
        queries = np.flatnonzero(roles == role)
        if not len(queries):
            continue
        query_words = [words[i] for i in queries.tolist()]
        query_codes = codes_of(query_words)
        for leaf, rows in search(tree, letter_counts(query_codes), role):
            own = leaves[leaf]
            large = len(own) > LEAF_WORDS
            i, j = _matches(query_codes[rows], codes[own], [query_words[r] for r in rows] if large else [],
                            [point_words[r] for r in own] if large else [], role)
            left.append(queries[rows[i]])
            right.append(points[own[j]])
    return np.concatenate(left), np.concatenate(right)


# On Spark


def cell_trees(counted: DataFrame, cell_words: int) -> dict[int, Tree]:
    """The upper levels of each length's tree; a length without a sampled word is one cell."""
    total = counted.count()
    sample = counted.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).toArrow()["word"].to_pylist()
    by_length = defaultdict(list)
    for word in sample:
        by_length[len(word)].append(word)
    leaf = max(1, cell_words * len(sample) // max(1, total))
    return {size: grow(letter_counts(codes_of(own)), leaf)[0] for size, own in by_length.items()}


def dealt(counted: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Each word as a point of its cell and as a query of the cells its searches enter."""
    whole = Tree(*(np.array([v], dtype=np.int32) for v in (-1, 0, 0, 0)), 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                counts = letter_counts(codes_of([words[i] for i in at.tolist()]))
                for role in (POINT, SAME, LONGER):
                    length = size + (role == LONGER)
                    for cell, rows in search(trees.get(length, whole), counts, role):
                        own = batch.take(pa.array(at[rows]))
                        same = [pa.array(np.full(len(rows), v, dtype=np.int32)) for v in (length, cell, role)]
                        yield pa.RecordBatch.from_arrays([*same, own.column("word"), own.column("n")],
                                                         ["length", "cell", "role", "word", "n"])

    return counted.select("word", "n").mapInArrow(deal, DEALT)


def nearest_words(counted: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Each word with near words: how many, and the one of largest count (``form_n``, ``form``)."""
    def find(table: pa.Table) -> pa.Table:
        # A word is several rows of a cell; which of them stands for it doesn't matter.
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        left, right = near_in_cell(words, n, table["role"].to_numpy())
        names, place = np.unique(np.array(words, dtype=object), return_inverse=True)
        one, other = (place[np.concatenate(x)] for x in ((left, right), (right, left)))
        counts = np.zeros(len(names), dtype=np.int64)
        counts[place] = n
        order = np.lexsort((other, -counts[other], one))
        one, other = one[order], other[order]
        own, first, near = np.unique(one, return_index=True, return_counts=True)
        best = other[first]
        return pa.table([pa.array(names[own], pa.string()), pa.array(near.astype(np.int64)), pa.array(counts[best]),
                         pa.array(names[best], pa.string())], ["word", "near", "form_n", "form"])

    cells = dealt(counted, cell_trees(counted, cell_words)).groupBy("length", "cell").applyInArrow(find, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    found = cells.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of words that have a form; ``forms`` is a stored table of word and form."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(at.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, cell_words: int = CELL_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The words of all texts, their forms and roots."""
    counted = cut_lineage(word_counts(docs, id_column, text_column), "words")
    found = counted.join(nearest_words(counted, cell_words), "word", "left")
    is_form = F.col("form_n") >= FORM_FACTOR * F.col("n")
    found = cut_lineage(found.select(
        "word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    rooted = with_roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES: dict[str, str] = {}
