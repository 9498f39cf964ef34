"""Approximate nearest neighbours over balanced posting lists.

Inner products are turned into distances: with the largest norm M of the
corpus, a vector x becomes (x, sqrt(M^2 - |x|^2)) / M and a query (q / |q|, 0),
so that the nearest vector has the largest inner product. A bounded sample
gives the centroids (k-means with a penalty on large clusters), the kNN graph
over them and the pruning ratio. Then every vector of the corpus goes to the
list of its nearest centroid and, if it lies near a border, also to those of
other centroids nearly as close (a centroid closer to one already chosen than
to the vector is skipped). A query walks the centroid graph and searches the
lists whose distance is at most ``ratio`` times the nearest one's; the ratio is
the smallest that finds ``RECALL`` of the sample's true neighbours. If those
lists hold too few other vectors, the query goes on to the next nearest until
they hold as many as it asks for (all lists, if the table has no more). The
number of lists grows with the table, and with it the part of the centroids
that a walk leaves out.

Lists are split into blocks of about ``BLOCK_ROWS`` vectors, so that a list
that holds many copies of one vector is many tasks; queries stream past a
block. All scores are inner products of the original vectors in double
precision; ties go to the smaller id.

Defined results for odd input: rows with a null id take no part, nor do
vectors that are null, empty, zero or hold null or non-finite components, nor
those whose length differs from the sample's most frequent one. Rows that
share an id are one candidate (its best score counts) and never their own
neighbour. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import table
from .registry import query
from .store import written

#: Rows of the sample that the index is fitted on, the fewest and the most lists, replicas of a border vector.
SAMPLE, LISTS, MOST_LISTS, REPLICAS = 8192, 64, 1024, 3
#: Vectors that a list holds, about, while there may be more lists.
LIST_ROWS = 20_000
#: Centroids that a walk keeps in view, and their share of all.
BEAM, BEAM_SHARE = 64, 4
#: How much farther than the nearest centroid another one may be to get a replica.
BORDER = 0.05
#: Share of the sample's true neighbours that the pruning ratio must reach.
RECALL = 0.97
BLOCK_ROWS = 16384
QUERY_ROWS = 512
K = 20


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T, 0))


class Index:
    """Centroids, their neighbour graph and the pruning ratio, fitted on a sample."""

    def __init__(self, sample: np.ndarray, largest: float, lists: int = LISTS, replicas: int = REPLICAS, recall: float = RECALL, seed: int = 7):
        self.ident = uuid.uuid4().hex
        self.largest, self.width, self.replicas = max(largest, 1e-300), sample.shape[1], replicas
        x = self.placed(sample)
        k = max(1, min(lists, len(x) // 8))
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), k, replace=False)]
        sizes = np.full(k, len(x) / k)
        for _ in range(15):
            # squared distance plus a price for what a cluster holds beyond its even part
            d = _distances(x, centres) ** 2
            own = (d + 0.3 * d.min(axis=1).mean() * np.maximum(sizes * k / len(x) - 1, 0)[None, :]).argmin(axis=1)
            sizes = 0.5 * sizes + 0.5 * np.bincount(own, minlength=k)
            for c in range(k):
                if (own == c).any():
                    centres[c] = x[own == c].mean(axis=0)
        self.centres = centres
        between = _distances(centres, centres)
        self.between = between
        order = np.argsort(between, axis=1, kind="stable")
        near = order[:, 1:min(k, 13)] if k > 1 else order[:, :1]
        # besides its nearest, each centroid gets one link along a ring, so the graph is connected
        self.graph = np.concatenate([near, ((np.arange(k) + 1) % k)[:, None]], axis=1)
        self.ratio = self._calibrated(sample, x, recall, rng)

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.largest ** 2 - (vectors ** 2).sum(axis=1), 0)
        return np.column_stack([vectors, np.sqrt(rest)]) / self.largest

    def aimed(self, queries: np.ndarray) -> np.ndarray:
        return np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))])

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every placement."""
        d = _distances(self.placed(vectors), self.centres)
        order = np.argsort(d, axis=1, kind="stable")[:, :2 * self.replicas]
        spot = np.arange(len(vectors))
        rows, lists = [spot], [order[:, 0]]
        taken = [order[:, 0]]
        count = np.ones(len(vectors), dtype=np.int64)
        for j in range(1, order.shape[1]):
            c = order[:, j]
            good = (d[spot, c] <= (1 + BORDER) * d[spot, order[:, 0]]) & (count < self.replicas)
            for t in taken:
                good &= (t < 0) | (self.between[c, np.maximum(t, 0)] >= d[spot, c])
            rows.append(spot[good])
            lists.append(c[good])
            count += good
            taken.append(np.where(good, c, -1))
        return np.concatenate(rows), np.concatenate(lists)

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids that a walk over the graph finds nearest to each (aimed) query, nearest first, with their distances."""
        n, k = len(queries), len(self.centres)
        beam = min(beam, k)
        spot = np.arange(n)[:, None]
        begin = np.unique(np.linspace(0, k - 1, min(k, 4)).astype(int))
        seen = np.zeros((n, k), dtype=bool)
        seen[:, begin] = True
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        spread = np.zeros((n, k), dtype=bool)  # whose links have been followed

        def take(ids: np.ndarray, dist: np.ndarray, more: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, dist = np.concatenate([ids, more], axis=1), np.concatenate([dist, far], axis=1)
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            return ids[spot, order], dist[spot, order]

        starts = np.tile(begin, (n, 1))
        ids, dist = take(ids, dist, starts, _distances(queries, self.centres[begin]))
        while True:
            open_ = (ids >= 0) & ~spread[spot, np.maximum(ids, 0)]
            live = open_.any(axis=1)
            if not live.any():
                return ids, dist
            pick = ids[np.arange(n), open_.argmax(axis=1)]
            spread[np.flatnonzero(live), pick[live]] = True
            links = self.graph[np.maximum(pick, 0)]
            new = live[:, None] & ~seen[spot, links]
            seen[spot, links] |= new
            far = np.sqrt(np.maximum(((self.centres[links] - queries[:, None, :]) ** 2).sum(axis=2), 0))
            # a link may repeat within a row; only its first place counts
            first = np.ones_like(new)
            for j in range(1, links.shape[1]):
                first[:, j] = ~(links[:, :j] == links[:, j:j + 1]).any(axis=1)
            ids, dist = take(ids, dist, links, np.where(new & first, far, np.inf))
            ids[np.isinf(dist)] = -1

    def _calibrated(self, sample: np.ndarray, placed: np.ndarray, recall: float, rng: np.random.Generator) -> float:
        at = rng.choice(len(sample), min(256, len(sample)), replace=False)
        score = sample[at] @ sample.T
        score[np.arange(len(at)), at] = -np.inf
        true = np.argsort(-score, axis=1, kind="stable")[:, :min(K, len(sample) - 1)]
        if not true.size:
            return 1.0
        d = _distances(self.aimed(sample[at]), self.centres)
        d /= np.maximum(d.min(axis=1, keepdims=True), 1e-12)
        rows, lists = self.lists_of(sample)
        inside = np.zeros((len(sample), len(self.centres)), dtype=bool)
        inside[rows, lists] = True
        need = np.where(inside[true], d[:, None, :], np.inf).min(axis=2)
        return float(np.quantile(need, recall)) * (1 + 1e-9)

    def probes(self, queries: np.ndarray, homes: np.ndarray | None = None, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that a query searches.

        ``homes`` counts the different vectors whose nearest centroid each list belongs to.
        """
        count = len(self.centres)
        homes = np.zeros(count) if homes is None else homes
        aimed = self.aimed(queries)
        ids, dist = self.nearest(aimed, max(BEAM, count // BEAM_SHARE))
        row, j = np.nonzero(self._taken(ids, dist, homes, k))
        short = np.flatnonzero(np.where(ids >= 0, homes[np.maximum(ids, 0)], 0).sum(axis=1) < min(k + 1, homes.sum()))
        if not len(short) or ids.shape[1] == count:
            return row, ids[row, j]
        # what the walk has in view holds too few vectors: all lists by distance
        all_dist = _distances(aimed[short], self.centres)
        order = np.argsort(all_dist, axis=1, kind="stable")
        more, at = np.nonzero(self._taken(order, np.take_along_axis(all_dist, order, axis=1), homes, k))
        rest = ~np.isin(row, short)
        return np.concatenate([row[rest], short[more]]), np.concatenate([ids[row[rest], j[rest]], order[more, at]])

    def _taken(self, ids: np.ndarray, dist: np.ndarray, homes: np.ndarray, k: int) -> np.ndarray:
        own = np.where(ids >= 0, homes[np.maximum(ids, 0)], 0)
        before = np.cumsum(own, axis=1) - own
        # the query itself may be one of the vectors counted
        return (ids >= 0) & ((dist <= self.ratio * np.maximum(dist[:, :1], 1e-12)) | (before < k + 1))


def fit(vectors: DataFrame, sample: int = SAMPLE, **options) -> Index | None:
    """Fit on about ``sample`` rows; ``vectors`` are usable rows (vec_id, embedding)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).first()
    if not total.n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("index"), "vec_id"), F.lit(1 << 30)) / (1 << 30)
    rows = [r.embedding for r in vectors.where(draw < min(1.0, sample / total.n)).orderBy("vec_id").select("embedding").collect()]
    if not rows:
        rows = [r.embedding for r in vectors.orderBy("vec_id").select("embedding").limit(64).collect()]
    width = Counter(len(r) for r in rows).most_common(1)[0][0]
    options.setdefault("lists", min(MOST_LISTS, max(LISTS, total.n // LIST_ROWS)))
    return Index(np.array([r for r in rows if len(r) == width], dtype=np.float64), total.norm, **options)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _best(ids: np.ndarray, block: np.ndarray, small: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple:
    """The k best of a block for each query: (query row, vec_id, score), by score, then id."""
    own = query_ids[:, None] == ids[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries.astype(np.float32) @ small
    if rough.shape[1] > k:
        # single precision only narrows the choice; its error is far below the slack
        odd = ~np.isfinite(rough)
        rough[own | odd] = -np.inf
        edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k].astype(np.float64)
        slack = 1e-4 * np.linalg.norm(queries, axis=1) * np.sqrt((small.astype(np.float64) ** 2).sum(axis=0).max())
        wide = odd.any(axis=1)  # where single precision overflows, double precision decides among all
        row, at = np.nonzero(((rough >= np.nan_to_num(edge - slack, nan=-np.inf)[:, None]) | wide[:, None]) & ~own)
    else:
        row, at = np.nonzero(~own)
    score = np.empty(len(row))
    for low in range(0, len(row), 65536):
        part = slice(low, low + 65536)
        score[part] = (queries[row[part]] * block[at[part]]).sum(axis=1)
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[at[keep]], score[keep]


def search(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """Per query and neighbour found: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull()).where(usable(F.col("embedding")))
    index = fit(rows, **options)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == index.width)
    kind = pa.list_(pa.float32() if dict(vectors.dtypes)["embedding"] == "array<float>" else pa.float64())
    schema = pa.schema([("list", pa.int32()), ("home", pa.bool_()), ("id", pa.int64()), ("embedding", kind)])
    text = "list int, home boolean, id long, embedding " + dict(vectors.dtypes)["embedding"]

    def placing(of) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, QUERY_ROWS):
                    part = batch.slice(low, QUERY_ROWS)
                    row, lists = of(_matrix(part.column("embedding"), index.width))
                    at = pa.array(row)
                    home = np.arange(len(row)) < part.num_rows  # of a vector's lists the nearest comes first
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(home), part.column("vec_id").cast(pa.int64()).take(at),
                                                      part.column("embedding").cast(kind).take(at)], schema=schema)
        return run

    posted = written(rows.mapInArrow(placing(index.lists_of), text), "postings")
    sizes = {r.list: r.n for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per list
    held = posted.where("home").select("list", "id").distinct().groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    homes = np.zeros(len(index.centres))
    homes[[r.list for r in held]] = [r.n for r in held]
    blocks = F.element_at(F.create_map(*[F.lit(x) for c, n in sorted(sizes.items()) for x in (c, -(-n // block_rows))]), F.col("list"))
    asked = rows.where(is_query).mapInArrow(placing(lambda q: index.probes(q, homes, k)), text).where(F.col("list").isin(list(sizes)))
    both = posted.select("list", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.lit(0).alias("role"), "id", "embedding").unionByName(
        asked.select("list", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"), F.lit(1).alias("role"), "id", "embedding"))
    # vectors of a block come first, then its queries stream past
    both = both.repartition("list", "block").sortWithinPartitions("list", "block", "role")
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, block, small = None, [], [], None, None
        for batch in batches:
            lists, blocks_, roles = (batch.column(c).to_numpy() for c in ("list", "block", "role"))
            own = batch.column("id").to_numpy()
            matrix = _matrix(batch.column("embedding"), index.width)
            cut = np.flatnonzero((np.diff(lists) != 0) | (np.diff(blocks_) != 0) | (np.diff(roles) != 0)) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                key = (int(lists[low]), int(blocks_[low]))
                if key != now:
                    now, ids, parts, block = key, [], [], None
                if roles[low] == 0:
                    ids.append(own[low:high])
                    parts.append(matrix[low:high])
                    continue
                if not ids:
                    continue
                if block is None:
                    block, names = np.concatenate(parts), np.concatenate(ids)
                    small = np.ascontiguousarray(block.T.astype(np.float32))
                for q in range(low, high, QUERY_ROWS):
                    stop = min(q + QUERY_ROWS, high)
                    row, vec, score = _best(names, block, small, own[q:stop], matrix[q:stop], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q:stop][row]), pa.array(vec), pa.array(score)], schema=found)

    pairs = both.mapInArrow(compare, "query_id long, vec_id long, score double")
    # replicas of a vector may be found in several lists
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # the k best of a task's rows go on, so a query's rows stay few in number
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op5_posting_lists")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
