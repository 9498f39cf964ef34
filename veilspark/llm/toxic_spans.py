"""Toxicity by a linear-chain conditional random field that tags toxic spans.

Only documents carry labels, so training tokens are labelled first: in a toxic
training document a word is toxic if the word itself or one of its prefixes
occurs in toxic documents far more often than chance allows (a binomial
likelihood-ratio test over document counts, corrected for the number of
features); every other word, and every word of a clean document, is clean. The
field learns emissions (word and prefix features) and transitions from these
tokens. Forward-backward marginals are turned into a document score by a
logistic curve over the expected number of toxic words, its share of all words
and the largest marginal, fitted on the same sample; words with a marginal of
one half or more form the offending spans (byte offsets).

The fit sees a bounded sample of the labelled training rows
(``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` documents, chosen by a hash of the id);
scoring reads every whole text.

Defined results for odd input: null and empty texts are scored like a text
without words (a low score); with no training row of one of the two classes
every score is 0.0. Rows sharing a ``doc_id`` are scored each; a label row
without a document, with a null id or a null label is ignored, and of
contradicting labels of one document the toxic one counts. A null ``doc_id``
is never held out, and has no label to learn from. Words, sentences and texts
of any length are taken whole. Extra columns of either table are ignored.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .chain_crf import ChainCRF, chains, hashed, letters
from .registry import query
from .words import Texts, WordTable, gather, per_worker, slices

#: Labelled documents that the fit sees, about, whole.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2400
#: Labelled sequences (sentences of those documents) of either kind that the field learns from.
SAMPLE_CHAINS = 20_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)


def word_features(word: str) -> list[str]:
    return ["bias", f"w{word}"] + [f"p{word[:i]}" for i in PREFIXES if len(word) > i]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _ragged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words' features, one after the other, and how many each has."""
    flat, sizes = array("q"), array("q")
    for w in words:
        own = hashed(word_features(w), 1 << 32)
        flat.extend(own)
        sizes.append(len(own))
    return np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)


def _copies(hashes: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each document and label of each group: documents of one label with nearly the same words are one
    group (two of three MinHash values agree), so that copies do not make their rare words look toxic."""
    count = len(toxic)
    low = np.full((count, 3), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)):
        np.minimum.at(low[:, k], owner, hashes * np.uint64(seed))
    group = np.arange(count)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a, b in ((0, 1), (0, 2), (1, 2)):
        seen: dict[tuple, int] = {}
        for i, key in enumerate(zip(low[:, a].tolist(), low[:, b].tolist(), toxic.tolist(), strict=True)):
            group[root(i)] = root(seen.setdefault(key, i))
    names, group = np.unique([root(i) for i in range(count)], return_inverse=True)
    return group, toxic[names]


def marked_features(docs: np.ndarray, word: np.ndarray, part: tuple, toxic: np.ndarray, size: int) -> np.ndarray:
    """Which features occur in toxic documents beyond chance, and mostly there.

    ``docs`` and ``word`` are the different (document, word) pairs in document order, ``part`` the words' features
    (numbers below ``size``).
    """
    with_toxic, total = np.zeros(size), np.zeros(size)
    for low in range(0, len(toxic), 250):  # a few documents at a time
        at = slice(*np.searchsorted(docs, (low, low + 250)))
        flat, n = gather(part, word[at])
        pairs = np.unique(np.repeat(docs[at], n) * size + flat)
        total += np.bincount(pairs % size, minlength=size)
        bad = pairs[toxic[pairs // size] == 1]
        with_toxic += np.bincount(bad % size, minlength=size)
    base = toxic.mean()
    need = math.log(max(2, int((total > 2).sum()))) + 2
    share = with_toxic / np.maximum(total, 1)
    rest = total - with_toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = with_toxic * np.log(share / base) + np.where(rest > 0, rest * np.log((1 - share) / (1 - base)), 0.0)
    return (share > max(0.5, base)) & (gain > need)


class ToxicModel:
    def __init__(self, rows: list[tuple[int, str]]):
        """Fit on (label, text) rows."""
        self.ident = uuid.uuid4().hex
        self.usable = {label for label, _ in rows} == {0, 1}
        if not self.usable:
            return
        toxic = np.array([label for label, _ in rows])
        texts = Texts(pa.array([t for _, t in rows], pa.large_string()))
        starts, ends, owner = texts.words()
        _, where, word = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
        names, sizes = _ragged([letters(texts.data[a:b].tobytes()) for a, b in zip(starts[where], ends[where], strict=True)])
        ids, flat = np.unique(names, return_inverse=True)
        part = (flat, np.cumsum(sizes) - sizes, sizes)
        group, group_toxic = _copies(texts.hashes(starts, ends), owner, toxic)
        pairs = np.unique(group[owner] * len(where) + word)
        marked = marked_features(pairs // len(where), pairs % len(where), part, group_toxic, len(ids))
        marked[np.isin(ids, hashed(["bias"], 1 << 32))] = False
        evident = np.bincount(np.repeat(np.arange(len(where)), sizes), weights=marked[flat], minlength=len(where)) > 0
        labels = (evident[word] & (toxic[owner] == 1)).astype(np.int64)
        first, size = chains(texts, ends, owner)
        # the field learns from every chain with a toxic word and from a bounded draw of the others
        with_toxic = np.add.reduceat(labels, first) > 0 if len(first) else np.zeros(0, dtype=bool)
        others = np.flatnonzero(~with_toxic)
        drawn = np.random.default_rng(11).permutation(others)[:SAMPLE_CHAINS]
        bad = np.random.default_rng(12).permutation(np.flatnonzero(with_toxic))[:SAMPLE_CHAINS]
        use = np.sort(np.concatenate([bad, drawn]))
        token = np.concatenate([np.arange(first[c], first[c] + size[c]) for c in use]) if len(use) else np.zeros(0, dtype=np.int64)
        own, n = gather(part, word[token])
        self.crf = ChainCRF(2, len(ids)).fit(own, n, labels[token], np.cumsum(size[use]) - size[use], size[use], rounds=20, rate=1.0, counted=True)
        # only the difference of the two states' weights counts, and most features have none
        lean = self.crf.weights[:, 1] - self.crf.weights[:, 0]
        self.ids, self.lean = ids[np.abs(lean) > 1e-3], lean[np.abs(lean) > 1e-3]
        self.crf.weights = None
        scores = self._scores(names, sizes)
        p = self.crf.marginals(scores[word], first, size)[0][:, 1]
        self._fit_curve(self._evidence(p, owner, texts.count), toxic.astype(np.float64))

    def _scores(self, names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, names), max(0, len(self.ids) - 1))
        own = np.where(self.ids[at] == names, self.lean[at], 0.0) if len(self.ids) else np.zeros(len(names))
        toxic = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=own, minlength=len(sizes))
        return np.column_stack([np.zeros(len(sizes)), toxic])

    @staticmethod
    def _evidence(p: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Per text: expected toxic words, their share of all words, the largest marginal (all on log scales)."""
        most = np.zeros(count)
        np.maximum.at(most, rows, p)
        # the faint probabilities of the many clean words of a long text are no evidence
        expected = np.bincount(rows, weights=np.where(p > 0.3, p, 0.0), minlength=count)
        n = np.maximum(np.bincount(rows, minlength=count), 1)
        most = np.clip(most, 1e-6, 1 - 1e-6)
        return np.stack([np.log(expected + 0.05), np.log(expected / n + 1e-3), np.log(most / (1 - most)) / 4], axis=1)

    def _fit_curve(self, x: np.ndarray, y: np.ndarray, rounds: int = 500) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        b = np.zeros(z.shape[1])
        for _ in range(rounds):  # damped Newton steps on the penalised likelihood
            q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            grad = z.T @ (y - q) - 0.5 * np.append(0, b[1:])
            hess = (z * (q * (1 - q))[:, None]).T @ z + np.diag([1e-3, *[0.5] * x.shape[1]])
            step = np.linalg.solve(hess, grad)
            b += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = b

    def word_table(self) -> WordTable:
        def build(words: list[bytes]) -> list:
            return [self._scores(*_ragged([letters(w) for w in words]))]
        return WordTable(build)

    def score(self, texts: Texts, known: WordTable) -> tuple[np.ndarray, list[list[dict]]]:
        """Document scores and the offending spans (byte offsets in the UTF-8 text)."""
        starts, ends, rows = texts.words()
        p = np.zeros(0)
        if len(starts):
            first, size = chains(texts, ends, rows)
            entries = known.find(texts, starts, ends)
            p = self.crf.marginals(known.parts[0][entries], first, size)[0][:, 1]
        x = (self._evidence(p, rows, texts.count) - self.mean) / self.scale
        score = 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))
        spans: list[list[dict]] = [[] for _ in range(texts.count)]
        last = -2
        for i in np.flatnonzero(p >= 0.5).tolist():
            r, base = int(rows[i]), int(texts.offsets[rows[i]])
            if i == last + 1 and spans[r]:
                spans[r][-1]["stop"] = int(ends[i]) - base
            else:
                spans[r].append({"start": int(starts[i]) - base, "stop": int(ends[i]) - base})
            last = i
        return score, spans


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> ToxicModel:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    marks = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return ToxicModel([])
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    rate = F.when(F.col("toxic") == 1, min(1.0, toxic / sizes[1])).otherwise(min(1.0, clean / sizes[0]))
    # the drawn ids are bounded by the sample sizes, so they go to the texts, not the texts to them
    drawn = F.broadcast(marks.where(draw < rate))
    sample = docs.select("doc_id", "text").join(drawn, "doc_id").select(
        "toxic", F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    return ToxicModel([(r.toxic, r.text) for r in sorted(sample.collect(), key=lambda r: (r.doc_id, r.text))])


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Per row: doc_id, score, spans (array of start and stop, byte offsets)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("toxic", model.ident, model.word_table) if model.usable else None
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = Texts(piece.column("text"))
                score, spans = model.score(texts, known) if known else (np.zeros(texts.count), [[]] * texts.count)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score), pa.array(spans, span)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,stop:long>>")


@query("op2_toxic_spans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
