"""Removal of passages that a document with a smaller id also holds, by merging Burrows-Wheeler transforms.

Every byte covered by a ``LENGTH``-byte string that also starts in a document
with a smaller ``doc_id`` goes. Two steps bring the strings that may be equal
into one task without moving whole texts around:

1. Anchors. The lowest-hashed ``GRAM``-byte substring of each ``LENGTH``-byte
   window is its anchor, so equal windows have equal anchors. Successive
   windows with one anchor form a stretch of text. Only (anchor hash, stretch
   hash, doc_id) is dealt out by anchor. A stretch that a smaller document
   also holds goes whole; an anchor found in one stretch only needs nothing
   more. What is left are anchors with several different stretches: the edges
   of repeated passages.
2. Merge. The different stretches of an anchor are strings. They are dealt to
   shards; each shard's Burrows-Wheeler transform is built, and all are merged
   by interleave refinement: the interleave sorted by the first r symbols
   gives, by one stable sort on the transform's symbols, the one sorted by
   r + 1. Block borders carried along tell where common prefixes shorter than
   r end, so after ``LENGTH`` rounds a block is the interval of one repeated
   string, and the smallest doc_id of a block decides about its windows.

Stretches are compared by 48-bit hashes within equal anchors of 32 bits and
more; the strings of the merge are compared byte by byte.

Defined results for odd input: null text counts as empty; a null ``doc_id``
is larger than every other; rows that share a ``doc_id`` do not remove from
each other; texts shorter than ``LENGTH`` bytes lose nothing. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.taskcontext import TaskContext

from ..sources.tables import table
from .registry import query
from .words import Texts, slices

LENGTH, GRAM = 50, 20
#: Window starts handled at once; texts of any length are cut into such chunks.
CHUNK = 900_000
#: Symbols of one merge, and the shards that they are dealt to.
MERGE_SYMBOLS, SHARDS = 1 << 18, 4
LAST = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 20) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def stretches(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, anchor hash) of each stretch: successive windows of one text whose anchor is the same place.

    ``start`` and ``end`` are byte places in the buffer; the leftmost of equal anchors counts.
    """
    parts: list[tuple] = []
    grams = length - gram + 1
    reads = [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]
    windows = np.maximum(np.diff(texts.offsets) - length + 1, 0)
    total = np.cumsum(windows)
    at = 0
    while at < (int(total[-1]) if len(total) else 0):
        # windows at..stop of all windows, numbered over the texts
        stop = min(at + CHUNK, int(total[-1]))
        first_row, last_row = np.searchsorted(total, [at, stop - 1], side="right")
        begin = int(texts.offsets[first_row] + at - (total[first_row] - windows[first_row]))
        end = int(texts.offsets[last_row] + stop - 1 - (total[last_row] - windows[last_row]) + length)
        if end - begin > 1 << 20:  # short texts in between take room too
            stop = max(at + 1, at + int(CHUNK * 0.5 * CHUNK / (end - begin)))
            first_row, last_row = np.searchsorted(total, [at, stop - 1], side="right")
            end = int(texts.offsets[last_row] + stop - 1 - (total[last_row] - windows[last_row]) + length)
            if end - begin > 1 << 20:
                stop = at + 1
                end, last_row = begin + length, first_row
        n = end - begin
        raw = np.zeros(n + 16, dtype=np.uint8)
        raw[:n] = texts.data[begin:end]
        words = np.ndarray(shape=(n + 8,), dtype="<u8", buffer=raw, strides=(1,))
        h = np.zeros(n, dtype=np.uint64)
        for o in reads:
            part = words[o:o + n]
            h[:len(part)] = _mix(h[:len(part)] ^ (part * np.uint64(0x9E3779B97F4A7C15)))
        low = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            low[:n - span] = np.minimum(low[:n - span], low[span:])
            span *= 2
        if grams > span:
            low[:n - (grams - span)] = np.minimum(low[:n - (grams - span)], low[grams - span:])
        rows = np.arange(first_row, last_row + 1)
        lo = np.maximum(at - (total[rows] - windows[rows]), 0)
        hi = np.minimum(stop - (total[rows] - windows[rows]), windows[rows])
        count = np.maximum(hi - lo, 0)
        starts = np.arange(int(count.sum())) + np.repeat(texts.offsets[rows] + lo - begin - (np.cumsum(count) - count), count)
        row = np.repeat(rows, count)
        place = (low[starts] & _LOW).astype(np.int64)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(starts)))
        parts.append((row[first], starts[first] + begin, place[first] + begin, size, h[place[first]]))
        at = stop
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    row, start, place, size, h = (np.concatenate([p[k] for p in parts]) for k in range(5))
    new = np.ones(len(row), dtype=bool)  # a stretch may go on in the next chunk
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(size, first)
    return row[first], start[first], start[first] + size - 1 + length, h[first]


def _marks(anchor: np.ndarray, stretch: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """0: nothing to do; 1: a smaller document has the whole stretch; 2: other stretches of the anchor may
    share some of its windows; 3: only others need this one, to compare with."""
    out = np.zeros(len(anchor), dtype=np.uint8)
    if not len(anchor):
        return out
    order = np.lexsort((doc, stretch, anchor))
    a, s, d = anchor[order], stretch[order], doc[order]
    new_anchor = np.append(True, a[1:] != a[:-1])
    first = np.flatnonzero(new_anchor | np.append(True, s[1:] != s[:-1]))
    least = d[first]
    of_anchor = np.flatnonzero(new_anchor[first])
    kinds = np.diff(np.append(of_anchor, len(first)))
    lowest = np.repeat(np.minimum.reduceat(least, of_anchor), kinds)
    highest = np.repeat(np.maximum.reduceat(least, of_anchor), kinds)
    code = np.where(lowest < least, 2, np.where(highest > least, 3, 0)).astype(np.uint8)
    each = np.diff(np.append(first, len(a)))
    out[order] = np.where(d > np.repeat(least, each), 1, np.repeat(code, each))
    return out


def _sorted_suffixes(strings: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's suffixes in order: (transform symbol, place of the suffix one longer, string, offset)."""
    sizes = np.array([len(s) + 1 for s in strings])
    n = int(sizes.sum())
    text = np.zeros(n, dtype=np.int64)
    last = np.cumsum(sizes) - 1
    solid = np.ones(n, dtype=bool)
    solid[last] = False
    text[solid] = code[np.frombuffer(b"".join(strings), dtype=np.uint8)]
    string = np.repeat(np.arange(len(strings)), sizes)
    left = last[string] - np.arange(n)  # symbols before the string's end
    rank, step = text, 1
    while step < int(sizes.max()):
        ahead = np.zeros(n, dtype=np.int64)
        inside = left >= step
        ahead[inside] = rank[np.flatnonzero(inside) + step] + 1
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1]
        step *= 2
    order = np.argsort(rank, kind="stable")
    where = np.empty(n, dtype=np.int32)
    where[order] = np.arange(n, dtype=np.int32)
    offset = np.arange(n) - (last - sizes + 1)[string]
    begins = offset[order] == 0
    symbol = np.where(begins, 0, text[order - 1]).astype(np.uint8)
    longer = np.where(begins, 0, where[order - 1]).astype(np.int32)
    return symbol, longer, string[order], offset[order]


def repeated_windows(strings: list[bytes], docs: np.ndarray, length: int = LENGTH, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, smallest doc) of every window of ``length`` bytes, by merging the shards' transforms."""
    present = np.zeros(256, dtype=bool)
    for s in strings:
        present[np.frombuffer(s, dtype=np.uint8)] = True
    code = np.cumsum(present)  # 0 ends a string; UTF-8 uses fewer than 255 byte values
    shards = max(1, min(shards, len(strings)))
    cuts = np.linspace(0, len(strings), shards + 1).astype(int)
    symbol, longer, string, offset, ends = [], [], [], [], []
    base = 0
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        b, up, s, o = _sorted_suffixes(strings[low:high], code)
        symbol.append(b)
        longer.append(up + base)
        string.append(s + low)
        offset.append(o)
        ends.append(np.arange(base, base + high - low))
        base += len(b)
    symbol, longer, string, offset, ends = (np.concatenate(x) for x in (symbol, longer, string, offset, ends))
    m = len(strings)
    merged = np.arange(base)  # the interleave: shards one after the other, sorted by no symbol yet
    block = np.zeros(base, dtype=np.int32)
    for _ in range(length):
        key = symbol[merged]
        order = np.argsort(key, kind="stable")
        key, was = key[order], block[order]
        merged = longer[merged[order]]
        merged[:m] = ends
        new = np.empty(base, dtype=bool)
        new[0] = False
        new[1:] = (key[1:] != key[:-1]) | (was[1:] != was[:-1])
        new[1:m] = False
        block = np.cumsum(new, dtype=np.int32)
    string, offset = string[merged], offset[merged]
    whole = np.array([len(s) for s in strings])[string] - offset >= length
    doc = np.where(whole, docs[string], LAST)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, base)))
    return string[whole], offset[whole], least[whole]


def _removed(diff: np.ndarray, low: int, high: int) -> np.ndarray:
    return np.cumsum(diff[low:high + 1])[:high - low] > 0


def _result(raw: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256."""
    edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and gone[0])
    return len(raw), int(gone.sum()), int(edges), hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _gaps(numbers: np.ndarray, kind: str = "<u4") -> np.ndarray:
    """Numbers as differences, low bytes first, then the (mostly zero) higher ones: ascending ones compress well."""
    width = np.dtype(kind).itemsize
    return np.diff(numbers, prepend=numbers.dtype.type(0)).astype(kind).view(np.uint8).reshape(-1, width).T.copy()


def _from_gaps(planes: np.ndarray, kind: str = "<u4") -> np.ndarray:
    return np.cumsum(planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel(), dtype=kind)


def _marks_blob(numbers: np.ndarray, marks: np.ndarray) -> bytes:
    """Ascending numbers of stretches (u32), then their marks (u8)."""
    return _pack(_gaps(numbers), marks)


def _from_marks_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 5
    return _from_gaps(np.frombuffer(blob, np.uint8, 4 * n)), np.frombuffer(blob, np.uint8, n, 4 * n)


def _dealt_blob(ids: np.ndarray, anchor: np.ndarray, own: np.ndarray, numbers: np.ndarray) -> bytes:
    """Stretches as they are dealt out: neighbours share a document, so each run of equal ids is written once."""
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    runs = np.diff(np.append(first, len(ids))).astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    return _pack(np.array([len(ids)], dtype="<u4"), anchor.astype("<u4"), own.astype("<u4"), (own >> np.uint64(32)).astype("<u2"),
                 _gaps(numbers), runs, _gaps(ids[first], "<i8"))


def _from_dealt_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, anchor, stretch hash, numbers)."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    low, high = np.frombuffer(blob, "<u4", n, 4 + 4 * n), np.frombuffer(blob, "<u2", n, 4 + 8 * n)
    numbers = _from_gaps(np.frombuffer(blob, np.uint8, 4 * n, 4 + 10 * n))
    rest = np.frombuffer(blob, np.uint8, -1, 4 + 14 * n)
    r = len(rest) // 12
    runs = rest[:4 * r].reshape(4, -1).T.copy().view("<u4").ravel()
    ids = np.repeat(_from_gaps(rest[4 * r:], "<i8"), runs)
    return ids, np.frombuffer(blob, "<u4", n, 4), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), numbers


def _runs(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """First and last of each run of overlapping ranges of one owner (all ascending)."""
    first = np.flatnonzero(np.append(True, (starts[1:] > ends[:-1]) | (owner[1:] != owner[:-1]))[:len(starts)])
    return np.stack([first, np.append(first[1:], len(starts))[:len(first)] - 1])


_RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_RESULT_SQL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row_key, id, marks) of the rows with marked stretches; marks: see ``_marks_blob``."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("meta", pa.bool_()), ("blob", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = Texts(piece.column("text"))
                row, start, end, h = stretches(texts, length, gram)
                own = texts.hashes(start, end)
                ids = piece.column("id").to_numpy()
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(number % buckets, number, True, _pack(np.bincount(row, minlength=texts.count).astype("<i8"),
                                                               piece.column("row_key").to_numpy(), ids))]
                for b in range(buckets):
                    at = order[bounds[b]:bounds[b + 1]]
                    if len(at):
                        rows.append((b, number, False, _dealt_blob(ids[row[at]], h[at], own[at], at)))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settle() -> pa.RecordBatch:
            parts = [_from_dealt_blob(blob) for _, blob in held]
            sizes = [len(p[0]) for p in parts]
            ids, anchor, stretch, numbers = (np.concatenate([p[k] for p in parts]) for k in range(4))
            parts.clear()
            marks = _marks(anchor, stretch, ids)
            blobs, at = [], 0
            for n in sizes:
                some = np.flatnonzero(marks[at:at + n]) + at
                blobs.append(_marks_blob(numbers[some], marks[some]))
                at += n
            return pa.RecordBatch.from_arrays([pa.array([0] * len(held), pa.int32()), pa.array([s for s, _ in held], pa.int64()),
                                               pa.array([False] * len(held)), pa.array(blobs, pa.binary())], schema=out)

        for batch in batches:
            passed = batch.filter(batch.column("meta"))
            if passed.num_rows:
                yield passed
            own = batch.column("bucket").to_pylist()
            numbers, meta, blob = batch.column("slice").to_pylist(), batch.column("meta").to_pylist(), batch.column("blob")
            for k in range(batch.num_rows):
                if meta[k]:
                    continue
                if own[k] != now and held:
                    yield settle()
                    held.clear()
                now = own[k]
                held.append((numbers[k], blob[k].as_py()))
        if held:
            yield settle()

    found = pa.schema([("row_key", pa.int64()), ("id", pa.int64()), ("marks", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meta, held = None, None, []

        def settle() -> pa.RecordBatch:
            n = len(meta) // 24
            counts, keys, ids = (np.frombuffer(meta, "<i8", n, 8 * k * n) for k in range(3))
            number, mark = (np.concatenate(x) for x in zip(*(_from_marks_blob(b) for b in held), strict=True))
            order = np.argsort(number)
            number, mark = number[order].astype(np.int64), mark[order]
            ends = np.cumsum(counts)
            bounds = np.searchsorted(number, np.append(0, ends))
            rows = [(int(keys[r]), int(ids[r]), _marks_blob(number[a:b] - (ends[r] - counts[r]), mark[a:b]))
                    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(found)], schema=found)

        for batch in batches:
            numbers, metas, blob = batch.column("slice").to_pylist(), batch.column("meta").to_pylist(), batch.column("blob")
            for k in range(batch.num_rows):
                if numbers[k] != now:
                    if held:
                        yield settle()
                    now, meta, held = numbers[k], None, []
                if metas[k]:
                    meta = blob[k].as_py()
                elif len(own := blob[k].as_py()):
                    held.append(own)
        if held:
            yield settle()

    sql = "bucket int, slice long, meta boolean, blob binary"
    blobs = docs.mapInArrow(cut, sql).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    marks = blobs.mapInArrow(meet, sql).repartition(buckets, "slice").sortWithinPartitions("slice")
    return marks.mapInArrow(deal, "row_key long, id long, marks binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts move once: the join with the marks and the one with the removed ranges read the same exchange, and nothing
    but pieces of stretches and byte ranges goes from one to the other.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(int(LAST))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("id", "text"))
    same_row = (F.col("row_key") == F.col("_k")) & (F.col("id") == F.col("_i"))
    marks = _marked(docs.select("row_key", "id", "text"), length, gram)
    marks = marks.select(F.col("row_key").alias("_k"), F.col("id").alias("_i"), "marks").dropDuplicates(["_k", "_i"])
    # both joins are left joins over the same columns: filters or fewer columns on one side would move the texts again
    marked = docs.join(marks, same_row, "left").select("doc_id", "id", "row_key", "text", "marks")
    # a piece (a stretch to compare), or with a negative start the byte ranges that go without comparing
    piece = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("need", pa.bool_()), ("string", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("marks").is_valid())
            for part in slices(batch, "text") if batch.num_rows else ():
                texts = Texts(part.column("text"))
                row, start, end, h = stretches(texts, length, gram)
                first = np.searchsorted(row, np.arange(texts.count))
                found = [_from_marks_blob(m) for m in part.column("marks").to_pylist()]
                number = np.concatenate([n.astype(np.int64) + f for (n, _), f in zip(found, first, strict=True)])
                mark = np.concatenate([m for _, m in found])
                keys, ids = part.column("row_key").to_numpy(), part.column("id").to_numpy()
                whole, some = number[mark == 1], number[mark > 1]
                a, b = _runs(start[whole], end[whole], row[whole])
                owner = row[whole][a]
                ranges = np.column_stack([start[whole][a], end[whole][b]]) - texts.offsets[owner][:, None]
                rows, at = np.unique(owner, return_index=True)
                at = np.append(at, len(owner))
                columns = [np.concatenate([keys[rows], h[some].view(np.int64)]), np.concatenate([ids[rows], ids[row[some]]]),
                           np.concatenate([keys[rows], keys[row[some]]]), np.concatenate([np.full(len(rows), -1), start[some] - texts.offsets[row[some]]]),
                           np.concatenate([np.zeros(len(rows), dtype=bool), mark[mark > 1] == 2])]
                strings = [ranges[x:y].astype("<i8").tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                strings += [texts.data[x:y].tobytes() for x, y in zip(start[some].tolist(), end[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, strings], piece, strict=True)], schema=piece)

    hit = pa.schema([("row_key", pa.int64()), ("id", pa.int64()), ("ranges", pa.binary())])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        symbols = 0

        def records(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(hit)], schema=hit)

        def settle() -> pa.RecordBatch:
            index: dict[tuple[int, bytes], int] = {}
            own = [index.setdefault((r[0], r[4]), len(index)) for r in rows]
            docs_ = np.full(len(index), LAST, dtype=np.int64)
            np.minimum.at(docs_, own, np.array([r[1] for r in rows], dtype=np.int64))
            string, offset, least = repeated_windows([s for _, s in index], docs_, length)
            order = np.lexsort((offset, string))
            string, offset, least = string[order], offset[order], least[order]
            first = np.searchsorted(string, np.arange(len(index) + 1))
            out = []
            for k, (_, doc, key, start, _, need) in zip(own, rows, strict=True):
                if need:
                    a, b = first[k], first[k + 1]
                    found = offset[a:b][least[a:b] < doc] + start
                    if len(found):
                        x, y = _runs(found, found + length, np.zeros_like(found))
                        out.append((key, doc, np.column_stack([found[x], found[y] + length]).astype("<i8").tobytes()))
            return records(out)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "id", "row_key", "start", "string", "need")]
            settled: list[tuple] = []
            for row in zip(*columns, strict=True):
                if row[3] < 0:
                    settled.append((row[2], row[1], row[4]))
                    continue
                if symbols > MERGE_SYMBOLS and row[0] != rows[-1][0]:
                    yield settle()
                    rows.clear()
                    symbols = 0
                rows.append(row)
                symbols += len(row[4]) + 1
            if settled:
                yield records(settled)
        if rows:
            yield settle()

    pieces = marked.mapInArrow(apply, "h long, id long, row_key long, start long, need boolean, string binary")
    hits = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(refine, "row_key long, id long, ranges binary")
    # copies of a row bring the same ranges
    hits = hits.groupBy(F.col("row_key").alias("_k"), F.col("id").alias("_i")).agg(F.collect_set("ranges").alias("ranges"))
    ranged = docs.join(hits, same_row, "left").select("doc_id", "text", "ranges")
    done_schema = pa.schema([("doc_id", pa.int64()), *_RESULT])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = Texts(batch.column("text"))
            for r, ranges in enumerate(batch.column("ranges")):
                raw = texts.data[texts.offsets[r]:texts.offsets[r + 1]]
                diff = np.zeros(len(raw) + 1, dtype=np.int32)
                edges = np.frombuffer(b"".join(ranges.as_py() or ()), "<i8")
                np.add.at(diff, edges[::2], 1)
                np.add.at(diff, edges[1::2], -1)
                out.append(_result(raw, _removed(diff, 0, len(raw))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array([o[k] for o in out], t) for k, (_, t) in enumerate(_RESULT)], schema=done_schema)

    return ranged.mapInArrow(finish, f"doc_id long, {_RESULT_SQL}")


@query("op8_bwt_merge")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
