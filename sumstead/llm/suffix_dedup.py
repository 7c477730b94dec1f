"""Operator 10: removes bytes of repeated substrings that start in an earlier document.

A byte goes if a string of STRING bytes covers it that also starts in a document
with a smaller id.  Sorting every suffix by external induction costs several
tuples a byte; here only a sample of the suffixes is sorted, in external
shuffles, and the rest is induced from it:

1. Of the SPAN windows of GRAM bytes in each string the one with the least hash
   is its anchor (the sample, as local minima are in induced sorting).  Equal
   strings have equal anchors, and consecutive strings mostly share theirs: one
   record stands for such a run and carries a hash of the whole stretch of text
   that its strings cover, its common prefix with others.
2. Records are dealt by their anchor and sorted.  Within an anchor, runs with
   equal stretches repeat the one of the least document, whole.  Only where an
   anchor has several stretches, at the ends of what is repeated, is it open
   which of a run's strings repeat.
3. A string is at least half on one side of its anchor, so only runs that share
   their anchor and SIDE bytes on one side of it with another document go on.
   Their strings alone are hashed one by one; each that occurs in a smaller
   document is found by the least document of its hash.

Whole copies of a text are told by its hash beforehand.  A record that repeats
one of the same task is known to repeat and is dealt by its document, so one
passage in very many documents sends one record a task to its anchor.
What is broadcast has a counted size under BROADCAST_BYTES, else joins are
shuffled.  Hashes have 88 bits for records of one anchor and 64 for strings; rows that
share an id are told apart by all 64 bits of their text's hash.

A null text is an empty text.  A null id is smaller than any other.  Rows with
one id are one document: they repeat nothing of each other.  Extra columns are
left out.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import by_bytes, read_table
from sumstead.session import cut_lineage

STRING = 50
GRAM = 22
SPAN = STRING - GRAM + 1
SIDE = (STRING - GRAM) // 2
BUCKET_BYTES = 8 << 20
BROADCAST_BYTES = 24 << 20
_PIECE = 1 << 18
_FLUSH = 500_000
_KNOWN = 0x80
#: Places in bytes that are looked at together; there are less than this.
_PLACES = np.uint64((1 << 21) - 1)
_U = np.uint64
#: Odd multipliers of the hashes.
_BASE, _MIX, _MIX2, _MIX3 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

INTERVALS = "ord bigint, tag bigint, probe boolean, start int, stop int"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWERS = _powers(int(_BASE), 5 * _PIECE)
_INVERSES = _powers(pow(int(_BASE), -1, 1 << 64), 5 * _PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX2
    return h ^ (h >> _U(32))


class Rolling:
    """Hashes of any stretches of some bytes, the same wherever they lie."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _POWERS[: len(data)], out=self.sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        """Of all stretches of one size."""
        return mix((self.sums[size:] - self.sums[:-size]) * _INVERSES[: len(self.sums) - size])

    def stretches(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * _INVERSES[starts]


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: first string, one past the last, anchor, hashes of it and of the stretch.

    ``ends`` are where texts end in ``data``; no string crosses an end.
    """
    if len(data) < STRING:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    rolling = Rolling(data)
    grams = rolling.fixed(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    # Among equal hashes the last place: the choice depends on the string alone.
    least = (grams & ~_PLACES) | (_PLACES - place)
    size = 1
    while 2 * size <= SPAN:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
    anchor = (_PLACES - (least & _PLACES)).astype(np.int64)
    for end in ends.tolist():
        anchor[max(0, end - STRING + 1) : end] = -1
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    starts, stops = np.concatenate([[0], change]), np.concatenate([change, [len(anchor)]])
    own = anchor[starts] >= 0
    starts, stops = starts[own], stops[own]
    anchors = anchor[starts]
    shape = ((stops - starts) * 64 + (anchors - starts)).astype(np.uint64) * _MIX3
    return starts, stops, anchors, grams[anchors], mix(rolling.stretches(starts, stops + STRING - 1) ^ shape)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Text number, place and bytes: a long text in parts that overlap by all but one byte of a string."""
    for n, text in enumerate(texts):
        for at in range(0, max(1, len(text) - STRING + 1), _PIECE):
            yield n, at, text[at : at + _PIECE + STRING - 1]


def joined(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces together: their bytes, where each ends, its text's number and its place there."""
    some, size = [], 0
    for piece in itertools.chain(pieces(texts), [None]):
        if some and (piece is None or size + len(piece[2]) > 4 * _PIECE):
            ends = np.cumsum([len(p[2]) for p in some])
            data = np.frombuffer(b"".join(p[2] for p in some), dtype=np.uint8)
            yield data, ends, np.array([p[0] for p in some]), np.array([p[1] for p in some])
            some, size = [], 0
        if piece is not None and len(piece[2]) >= STRING:
            some.append(piece)
            size += len(piece[2])


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low bytes of numbers, one plane each; planes that hardly change shrink in a shuffle."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _numbers(data: bytes, n: int, at: int, size: int) -> np.ndarray:
    planes = np.zeros((n, 8), dtype=np.uint8)
    planes[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return planes.reshape(-1).view("<i8")


#: Bytes kept of anchor, stretch, place of the text in a list, first string, number of strings.
_SIZES = (5, 6, 4, 4, 1)


def _pack(anchor: np.ndarray, stretch: np.ndarray, doc: np.ndarray, tag: np.ndarray, text: np.ndarray, start: np.ndarray,
          count: np.ndarray) -> bytes:
    """Records, and ahead of them the documents and tags of their texts once each; equal ``text``, equal document and tag."""
    _, first, place = np.unique(text, return_index=True, return_inverse=True)
    columns = zip((anchor.view(np.int64), stretch.view(np.int64), place, start, count), _SIZES, strict=True)
    return len(first).to_bytes(4, "little") + _planes(doc[first], 8) + _planes(tag[first], 8) + b"".join(_planes(c, s) for c, s in columns)


def _unpack(data: bytes) -> list[np.ndarray]:
    """Anchor, stretch, document, tag, first string and number of strings of each record."""
    texts, at, found = int.from_bytes(data[:4], "little"), 4, []
    doc, tag = _numbers(data, texts, at, 8), _numbers(data, texts, at + 8 * texts, 8)
    at += 16 * texts
    n = (len(data) - at) // sum(_SIZES)
    for size in _SIZES:
        found.append(_numbers(data, n, at, size))
        at += n * size
    anchor, stretch, place, start, count = found
    return [anchor, stretch, doc[place], tag[place], start, count]


def _dealt(records: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Records by bucket; one that repeats a smaller document's of the same task goes by its document."""
    anchor, stretch, doc, tag, text, start, count = (np.concatenate(c) for c in zip(*records, strict=True))
    both = anchor ^ (stretch * _MIX3)
    order = np.argsort(both)
    groups = np.flatnonzero(np.concatenate([[True], np.diff(both[order]) != 0]))
    least = np.empty(len(doc), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], groups), np.diff(np.append(groups, len(doc))))
    known = doc > least
    spread = np.where(known, (doc.astype(np.uint64) * _MIX2) >> _U(40), anchor >> _U(40))
    bucket = (spread % _U(buckets)).astype(np.int64)
    count = count | np.where(known, _KNOWN, 0)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
    for a, b in itertools.pairwise(bounds.tolist()):
        own = order[a:b]
        yield int(bucket[own[0]]), _pack(*(c[own] for c in (anchor, stretch, doc, tag, text, start, count)))


def _records(docs: DataFrame, buckets: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[tuple[np.ndarray, ...]] = []
        seen = 0  # texts before this batch

        def flush() -> pa.RecordBatch:
            rows = list(_dealt(records, buckets))
            records.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                ["bucket", "records"])

        for whole in batches:
            for batch in by_bytes(whole, "text"):
                ids, tags = batch.column("ord").to_numpy(), batch.column("tag").to_numpy()
                for data, ends, number, place in joined(batch.column("text").to_pylist()):
                    starts, stops, _, anchor, stretch = runs(data, ends)
                    piece = np.searchsorted(ends, starts, "right")
                    begins = np.concatenate([[0], ends[:-1]])
                    text = number[piece]
                    if len(starts):
                        records.append((anchor, stretch, ids[text], tags[text], (text + seen).astype(np.int32),
                                        starts - begins[piece] + place[piece], stops - starts))
                    if sum(len(r[0]) for r in records) >= _FLUSH:
                        yield flush()
                seen += batch.num_rows
        if records:
            yield flush()

    return docs.select("ord", "tag", "text").mapInArrow(emit, "bucket int, records binary")


def repeats(data: list[bytes]) -> list[np.ndarray]:
    """All records of a bucket: intervals to remove, and (``probe``) strings to look at one by one."""
    columns = [np.concatenate(c) for c in zip(*map(_unpack, data), strict=True)]
    known = (columns[5] & _KNOWN) > 0
    sure = [c[known] for c in columns]
    anchor, stretch, doc, tag, start, count = (c[~known] for c in columns)
    order = np.lexsort((stretch, anchor))
    anchor, stretch, doc, tag, start, count = (c[order] for c in (anchor, stretch, doc, tag, start, count))
    new_anchor = np.concatenate([[True], np.diff(anchor) != 0]) if len(anchor) else np.zeros(0, dtype=bool)
    new = new_anchor | np.concatenate([[True], np.diff(stretch) != 0]) if len(anchor) else new_anchor
    groups = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(doc, groups), np.diff(np.append(groups, len(doc)))) if len(doc) else doc
    again = doc > least
    # An anchor with several stretches in several documents.
    bounds = np.flatnonzero(new_anchor)
    sizes = np.diff(np.append(bounds, len(doc)))
    several = np.add.reduceat(new.astype(np.int64), bounds) > 1 if len(doc) else new
    if len(doc):
        several &= np.minimum.reduceat(doc, bounds) < np.maximum.reduceat(doc, bounds)
    probe = np.repeat(several, sizes) & ~again
    out = []
    for own in (again, probe):
        last = start + count + (STRING - 1 if own is again else 0)
        out.append((doc[own], tag[own], np.full(int(own.sum()), own is probe), start[own], last[own]))
    known_stop = sure[4] + (sure[5] & ~_KNOWN) + STRING - 1
    out.append((sure[2], sure[3], np.zeros(len(sure[2]), dtype=bool), sure[4], known_stop))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _sorted_buckets(records: DataFrame, buckets: int) -> DataFrame:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, data = None, []
        for batch in itertools.chain(batches, [None]):
            rows = zip(batch.column("bucket").to_pylist(), batch.column("records").to_pylist(), strict=True) if batch else [(None, b"")]
            for own, some in rows:
                if own != bucket:
                    if data:
                        yield _interval_batch(repeats(data))
                    bucket, data = own, []
                if some:
                    data.append(some)

    return records.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, INTERVALS)


def _interval_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
    arrays = [pa.array(c, k) if k == pa.bool_() else pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["ord", "tag", "probe", "start", "stop"])


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that touch or overlap as one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.append(new[1:] - 1, len(starts) - 1)]


def _by_document(intervals: DataFrame) -> DataFrame:
    """Merged intervals of each document; a document bounds them."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops = [], []
            for some in batch.column("all"):
                flat = some.values
                a, b = merged(flat.field("start").to_numpy(), flat.field("stop").to_numpy())
                starts.append(a)
                stops.append(b)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("tag"), pa.array(starts, kind), pa.array(stops, kind)],
                                             ["ord", "tag", "starts", "stops"])

    grouped = intervals.groupBy("ord", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("all"))
    return grouped.mapInArrow(merge, "ord bigint, tag bigint, starts array<int>, stops array<int>")


def _least_documents(rows: DataFrame, again: bool) -> DataFrame:
    """Rows whose hash occurs in several documents; with ``again`` only those after the least one.

    A partition is sorted by hash; it holds no more of one hash than runs that differ around it.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=pa.schema([
            ("h", pa.int64()), ("ord", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))
        if not len(table):
            return
        h, doc = table["h"].to_numpy(), table["ord"].to_numpy()
        order = np.argsort(h)
        groups = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        sizes = np.diff(np.append(groups, len(h)))
        least = np.repeat(np.minimum.reduceat(doc[order], groups), sizes)
        most = np.repeat(np.maximum.reduceat(doc[order], groups), sizes)
        own = order[(doc[order] > least) if again else (least < most)]
        yield from table.select(["ord", "tag", "start", "stop"]).take(pa.array(own)).to_batches(max_chunksize=1 << 20)

    return rows.repartition("h").mapInArrow(find, "ord bigint, tag bigint, start int, stop int")


HASHED = "h bigint, ord bigint, tag bigint, start int, stop int"


def _hashed(docs: DataFrame, lists: DataFrame, hashes: Callable) -> DataFrame:
    """Hashes that ``hashes`` makes of each piece of a document and its listed intervals."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", _PIECE):
                ids, tags = batch.column("ord").to_pylist(), batch.column("tag").to_pylist()
                starts, stops = batch.column("starts").to_pylist(), batch.column("stops").to_pylist()
                found = []
                for n, at, data in pieces(batch.column("text").to_pylist()):
                    own = np.zeros(max(0, len(data) - STRING + 1), dtype=bool)
                    for a, b in zip(starts[n], stops[n], strict=True):
                        own[max(a - at, 0) : max(b - at, 0)] = True
                    if own.any():
                        h, first, last = hashes(np.frombuffer(data, dtype=np.uint8), own)
                        same = np.ones(len(h), dtype=np.int64)
                        found.append((h.view(np.int64), same * ids[n], same * tags[n], first + at, last + at))
                if found:
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)],
                                                     ["h", "ord", "tag", "start", "stop"])

    # These lists grow with the table: no broadcast is asked for.
    listed = docs.join(lists, ["ord", "tag"]).select("ord", "tag", "text", "starts", "stops")
    return listed.mapInArrow(emit, HASHED)


def side_hashes(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchor with what lies on either side of it, for runs that start where ``own`` is set."""
    starts, stops, anchors, _, _ = runs(data, np.array([len(data)]))
    chosen = own[starts]
    starts, stops, anchors = starts[chosen], stops[chosen], anchors[chosen]
    # Only sides that a string of the run reaches.
    before, behind = starts <= anchors - SIDE, stops > anchors - SIDE
    rolling = Rolling(data)
    left = mix(rolling.stretches(anchors[before] - SIDE, anchors[before] + GRAM) ^ _MIX2)
    right = mix(rolling.stretches(anchors[behind], anchors[behind] + GRAM + SIDE) ^ _MIX3)
    return (np.concatenate([left, right]), np.concatenate([starts[before], starts[behind]]),
            np.concatenate([stops[before], stops[behind]]))


def string_hashes(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each string that starts where ``own`` is set."""
    first = np.flatnonzero(own)
    return mix(Rolling(data).stretches(first, first + STRING)), first, first + STRING


def remove(text: bytes, starts: list[int], stops: list[int]) -> tuple[int, int, str]:
    """Bytes and runs removed, and the hash of what is left."""
    left, at = hashlib.sha256(), 0
    for a, b in zip(starts, stops, strict=True):
        left.update(text[at:a])
        at = b
    left.update(text[at:])
    return sum(b - a for a, b in zip(starts, stops, strict=True)), len(starts), left.hexdigest()


def removed_intervals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id and text (as bytes) with the merged intervals to remove."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    order = F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    tag: Column = F.xxhash64(text)
    rows = docs.select(F.col(id_column).alias("id"), order.alias("ord"), tag.alias("tag"), text.cast("binary").alias("text"),
                       F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    long_rows = rows.where(F.octet_length("text") >= STRING)
    same = long_rows.groupBy("h", "g").agg(F.min("ord").alias("least"), F.max("ord").alias("most"),
                                           F.max(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("c"))
    texts = cut_lineage(same, "texts")
    totals = texts.agg(F.sum("size"), F.count_if(F.col("least") < F.col("most"))).first()
    buckets = max(1, -(-(totals[0] or 0) // BUCKET_BYTES))
    copied = texts.where("least < most").select("h", "g", "least")
    copied = F.broadcast(copied) if (totals[1] or 0) * 64 <= BROADCAST_BYTES else copied
    marked = long_rows.join(copied, ["h", "g"], "left")
    copy = F.coalesce(F.col("ord") > F.col("least"), F.lit(False))
    firsts = marked.where(~copy).select("ord", "tag", "text")
    intervals = cut_lineage(_sorted_buckets(_records(firsts, buckets), buckets), "intervals")
    probes = cut_lineage(_by_document(intervals.where("probe").drop("probe")), "probes")
    near = cut_lineage(_by_document(_least_documents(_hashed(firsts, probes, side_hashes), again=False)), "near")
    repeated = _least_documents(_hashed(firsts, near, string_hashes), again=True)
    found = intervals.where("NOT probe").drop("probe").unionByName(repeated)
    whole = marked.where(copy).select("ord", "tag", F.array(F.lit(0)).alias("starts"),
                                      F.array(F.octet_length("text")).alias("stops")).distinct()
    lists = cut_lineage(_by_document(found).unionByName(whole), "removed")
    size = lists.agg(F.sum(F.size("starts") * 8 + 64)).first()[0] or 0
    lists = F.broadcast(lists) if size <= BROADCAST_BYTES else lists
    return rows.drop("h", "g").join(lists, ["ord", "tag"], "left").select("id", "text", "starts", "stops")


def dedup_strings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                texts, starts, stops = (batch.column(c).to_pylist() for c in ("text", "starts", "stops"))
                found = [remove(t, a or [], b or []) for t, a, b in zip(texts, starts, stops, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = removed_intervals(docs, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return found.withColumnRenamed("id", id_column)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
