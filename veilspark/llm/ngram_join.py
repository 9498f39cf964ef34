"""Jaccard similarity join of documents on word n-grams, by MinHash banding.

1. Every text becomes the set of its five-word shingles (64-bit hashes; a text
   of one to four words is one shingle). Texts with equal sets are one class of
   copies and go on as one row.
2. MinHash signatures are cut into bands; band and row counts follow from the
   target recall at the threshold. Band hashes are the shuffle key.
3. Sets that share a bucket belong to one candidate group: the connected
   components of "set and first set of its bucket", as many pairs as bucket
   entries.
4. Within a candidate group, tasks compare blocks of at most 2 x BLOCK sets in
   full. They return, for each set, how many it is linked to, and a spanning
   forest of the links; the pairs themselves are never rows. So every pair of
   a bucket is verified and every link between different texts counts, while a
   group of n near copies makes about n * n / BLOCK rows, not n * n.
5. Connected components of the forests are the classes.

Result: one row per document. Defined results for odd input: null and text
without words have no shingles and link to nothing (a class of their own, id
the row's own); white space is ASCII white space, words are compared as they
stand; a null ``doc_id`` gets the class id of its group, null if all its ids
are; repeated rows are copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .registry import query
from .store import keyed, written
from .words import Texts, slices

N, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 128
#: Sets of one component that a task takes from either side when it counts links.
BLOCK = 256


def bands_for(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, that reach the recall within the hash count."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)) if threshold < 1 else 1
        if rows * bands <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: Texts, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of the texts, sorted within each text, and how many each text has."""
    starts, ends, rows = texts.words()
    words = texts.hashes(starts, ends)
    per_row = np.bincount(rows, minlength=texts.count)
    odd = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    first = np.cumsum(per_row) - per_row
    spot = np.arange(len(words)) - first[rows]
    long = np.flatnonzero(spot + n <= per_row[rows])
    h = np.zeros(len(long), dtype=np.uint64)
    for j in range(n):
        h += _mix(words[long + j] * odd[j])
    short = np.flatnonzero((spot == 0) & (per_row[rows] < n))  # texts of fewer words: all of them as one shingle
    g = np.zeros(len(short), dtype=np.uint64)
    for j in range(n - 1):
        has = per_row[rows[short]] > j
        g[has] += _mix(words[short[has] + j] * odd[j])
    g = _mix(g ^ np.uint64(0x5851F42D4C957F2D))
    h, owner = np.concatenate([_mix(h), g]), np.concatenate([rows[long], rows[short]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=texts.count)


def _set_keys(flat: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(counts).tolist()
    return [xxhash.xxh128_digest(flat[e - c:e].tobytes()) if c else None for e, c in zip(ends, counts.tolist(), strict=True)]


def band_hashes(flat: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each text with shingles."""
    begin = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(begin), bands), dtype=np.uint64)
    if not len(begin):
        return out
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for b in range(bands):
        for r in range(rows):
            low = np.minimum.reduceat(flat * seeds[b * rows + r], begin)
            out[:, b] = _mix(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + low)
    return out


def sketches(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """Per row: doc_id, set_key (null without shingles), n_shingles, bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n_shingles", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                flat, counts = shingles(Texts(piece.column("text")), n)
                some = counts > 0
                own = band_hashes(flat, counts, bands, rows).view(np.int64).ravel()
                offsets = np.append(0, np.cumsum(some * bands)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_set_keys(flat, counts), pa.binary()),
                                                  pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(own))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, n_shingles int, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(set_no, shingles) of the ``wanted`` sets (set_no, set_key, doc_id of one row that has it)."""
    schema = pa.schema([("set_no", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                flat, counts = shingles(Texts(piece.column("text")), n)
                same = [a == b for a, b in zip(_set_keys(flat, counts), piece.column("set_key").to_pylist(), strict=True)]
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                out = pa.RecordBatch.from_arrays([piece.column("set_no"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], schema=schema)
                yield out.filter(pa.array(same, pa.bool_()))

    # the same join at every size: the wanted sets grow with the corpus
    ids = wanted.select("set_no", "set_key", F.col("doc_id").alias("_id")).hint("merge")
    joined = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("set_no", "set_key", "text")
    return joined.mapInArrow(run, "set_no long, shingles array<long>").dropDuplicates(["set_no"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component; large-star and small-star rounds."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        edges = written(met.select("u", F.col("m").alias("v")).union(met.where("v <> m").select("v", "m")).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        seen = state


def _link_matrix(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of the two lists are similar."""
    if len(left) * len(right) <= 16:
        out = np.zeros((len(left), len(right)), dtype=bool)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out[i, j] = both >= threshold * (len(x) + len(y) - both)
        return out
    nx, ny = np.array([len(x) for x in left]), np.array([len(y) for y in right])
    values, column = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate([nx, ny]))
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, len(values), 4096):  # a dense slice of the incidence matrix at a time
        a, b = np.searchsorted(column, (low, low + 4096))
        dense = np.zeros((len(left) + len(right), 4096), dtype=np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        both += dense[:len(left)] @ dense[len(left):].T
    return both >= threshold * (nx[:, None] + ny[None, :] - both)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric adjacency matrix."""
    left, out = near.any(axis=1), []
    while left.any():
        todo = [int(left.argmax())]
        left[todo[0]] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            out += [(at, int(k)) for k in new]
            todo += new.tolist()
    return out


def _linked(groups: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (set_no, sets, docs, other): how many sets a set is linked to and how many documents have them
    (to be summed), or with ``other`` a link of the spanning forests.

    ``groups``: set_no, label, n_rows, for candidate groups.
    """
    sizes = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = groups.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("set_no"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("set_no", "n_rows", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # deal block pairs, not components, to tasks
    rows = rows.join(sets, "set_no").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    schema = pa.schema([("set_no", pa.int64()), ("sets", pa.int64()), ("docs", pa.int64()), ("other", pa.int64())])

    def count(members: list[dict], i: int, j: int) -> pa.RecordBatch:
        at = [m for m in members if m["own"] == i]
        to = at if i == j else [m for m in members if m["own"] == j]
        arrays = [m["shingles"] for m in at], [m["shingles"] for m in to]
        linked = _link_matrix(*arrays, threshold) if at and to else np.zeros((len(at), len(to)), dtype=bool)
        out = []
        if i == j:
            np.fill_diagonal(linked, False)
            sides, near = [(at, to, linked)], linked
        else:
            sides = [(at, to, linked), (to, at, linked.T)]
            near = np.block([[np.zeros((len(at), len(at)), dtype=bool), linked], [linked.T, np.zeros((len(to), len(to)), dtype=bool)]])
        for own, other, links in sides:
            weight = np.array([m["n_rows"] for m in other], dtype=np.int64)
            out += [(m["set_no"], int(row.sum()), int(weight[row].sum()), None) for m, row in zip(own, links, strict=True) if row.any()]
        nodes = [m["set_no"] for m in (at if i == j else at + to)]
        out += [(nodes[a], 0, 0, nodes[b]) for a, b in _forest(near)]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            lists = batch.column("shingles")
            flat, bounds = lists.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
            plain = {c: batch.column(c).to_pylist() for c in ("set_no", "n_rows", "label", "own", "i", "j")}
            for k in range(batch.num_rows):
                key = (plain["label"][k], plain["i"][k], plain["j"][k])
                if key != now and members:
                    yield count(members, *now[1:])
                    members = []
                now = key
                members.append({"set_no": plain["set_no"][k], "n_rows": plain["n_rows"][k], "own": plain["own"][k], "shingles": flat[bounds[k]:bounds[k + 1]]})
        if members:
            yield count(members, *now[1:])

    return rows.mapInArrow(run, "set_no long, sets long, docs long, other long")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, max_hashes: int = MAX_HASHES,
         block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, class_id (smallest doc_id of its group of linked documents), n_links (other documents
    with a similarity of ``threshold`` or more), n_text_links (different texts among them), n_copies (rows with
    the same shingles, itself included)."""
    bands, rows = bands_for(threshold, recall, max_hashes)
    sketch = written(sketches(docs, bands, rows, n), "sketches")
    sets = written(sketch.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("set_no", F.monotonically_increasing_id()), "sets")

    # sets that share a bucket, through the first set of the bucket
    members = sets.select("set_no", F.posexplode("bands").alias("band", "h"))
    buckets = members.groupBy("band", "h").agg(F.min("set_no").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = members.join(buckets, ["band", "h"]).where("set_no <> first").select(F.col("first").alias("a"), F.col("set_no").alias("b"))
    candidates = written(components(star).join(sets.select(F.col("set_no").alias("node"), "set_key", "doc_id", "n_rows"), "node")
                         .withColumnRenamed("node", "set_no"), "candidates")
    full = _sets(docs, candidates.select("set_no", "set_key", "doc_id"), n)
    found = written(_linked(candidates.select("set_no", "label", "n_rows"), full, threshold, block), "links")
    counts = found.where("other IS NULL").groupBy("set_no").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    labels = components(found.where("other IS NOT NULL").select(F.col("set_no").alias("a"), F.col("other").alias("b")))
    groups = written(labels.select(F.col("node").alias("set_no"), "label"), "labels")
    heads = groups.select("set_no", "label").join(sets.select("set_no", "doc_id"), "set_no").groupBy("label").agg(F.min("doc_id").alias("head"))
    info = sets.select("set_no", "set_key", "n_rows", F.col("doc_id").alias("own")).join(groups.select("set_no", "label"), "set_no", "left")
    info = info.join(heads, "label", "left").join(counts, "set_no", "left").select(
        "set_key", F.when(F.col("label").isNull(), F.col("own")).otherwise(F.col("head")).alias("class_id"), "n_rows",
        F.coalesce("sets", F.lit(0)).alias("sets"), F.coalesce("docs", F.lit(0)).alias("docs"))
    info = written(info, "classes")
    return sketch.join(info, "set_key", "left").select(
        "doc_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce(F.col("n_rows"), F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("sets", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("n_rows", F.lit(1)).cast("long").alias("n_copies"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each group (one with the smallest doc_id, a null id being the largest) and every row that links to none; all columns.

    The join runs on row numbers, so rows that share a ``doc_id`` or have none are told apart.
    """
    rows, key = keyed(docs, "rows")
    found = join(rows.select(F.col(key).alias("doc_id"), "text"), **options)
    linked = written(found.where("n_links > 0").select(F.col("doc_id").alias(key), "class_id").join(rows.select(key, "doc_id"), key), "linked")
    heads = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("head"))
    gone = linked.join(heads.select(F.col("head")[key].alias(key)), key, "left_anti").select(key)
    return rows.join(gone, key, "left_anti").select(docs.columns)


@query("op6_ngram_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
