"""Language identification by a linear-chain conditional random field.

Every word of a text gets a language label; emissions come from affixes,
character n-grams and a lexicon of each language's common words, transitions
are learned, and forward-backward gives each word's language probabilities. A
text's language is the one with the largest mean probability over its words
with letters, and that mean is its score; so code-switched texts are judged by
all their words.

Training words take the language of their document. The fit uses a bounded
sample of the training rows: ``SAMPLE_PER_LANGUAGE`` documents of each language,
chosen by a hash of the id, and of their whole texts stretches of
``STRETCH_WORDS`` words, chosen by a hash of the text and the place, so that
``SAMPLE_WORDS`` words come together, evenly from all languages. Scoring reads every
whole text.

Defined results for odd input: ``und`` with score 0.0 for texts that are null
or hold no letter, and for every text when no training row exists. Ties go to
the language that sorts first. A null ``doc_id`` is never held out and never
trained on. Words, sentences and texts of any length are taken whole. Only ``doc_id``, ``text`` and, in training,
``lang`` are read; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .chain_crf import ChainCRF, chains, hashed, letters
from .registry import query
from .words import TABLE_WORDS, Texts, WordTable, gather, per_worker, slices

UNKNOWN = "und"
#: Documents of each language that the fit sees, about.
SAMPLE_PER_LANGUAGE = 200
#: Words that the fit sees, about, evenly from all languages, and words of one stretch of them.
SAMPLE_WORDS, STRETCH_WORDS = 160_000, 50
FEATURES = 1 << 16
#: A word belongs to a language's lexicon if it makes up this share of the language's training words.
LEXICON_SHARE = 2e-3


def word_features(word: str, lexicon: dict[str, str]) -> list[str]:
    if not word:
        return ["empty"]
    edged = f"^{word}$"
    out = ["bias", f"w{word}"]
    out += [f"p{word[:i]}" for i in (1, 2, 3) if len(word) >= i] + [f"s{word[-i:]}" for i in (1, 2, 3, 4) if len(word) >= i]
    out += [f"g{edged[i:i + 2]}" for i in range(len(edged) - 1)] + [f"g{edged[i:i + 3]}" for i in range(len(edged) - 2)]
    if word in lexicon:
        out.append(f"l{lexicon[word]}")
    return out


def training_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


class LanguageModel:
    def __init__(self, rows: list[tuple[str, str]]):
        """Fit on (language, text) rows."""
        self.ident = uuid.uuid4().hex
        self.languages = sorted({lang for lang, _ in rows})
        if not self.languages:
            return
        texts = Texts(pa.array([t for _, t in rows], pa.large_string()))
        starts, ends, owner = texts.words()
        words = [letters(texts.data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
        labels = np.array([self.languages.index(lang) for lang, _ in rows], dtype=np.int64)[owner]
        totals = np.bincount(labels, minlength=len(self.languages))
        counts: dict[tuple[str, int], int] = {}
        for w, k in zip(words, labels.tolist(), strict=True):
            counts[w, k] = counts.get((w, k), 0) + 1
        self.lexicon: dict[str, str] = {}
        share: dict[str, float] = {}
        for (w, k), n in counts.items():
            part = n / totals[k]
            if w and part >= LEXICON_SHARE and part > share.get(w, 0):
                share[w], self.lexicon[w] = part, self.languages[k]
        numbers: dict[str, int] = {}
        entry = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
        feats = [np.array(hashed(word_features(w, self.lexicon), FEATURES), dtype=np.int64) for w in numbers]
        own = np.array([len(f) for f in feats], dtype=np.int64)
        flat, sizes = gather((np.concatenate(feats), np.cumsum(own) - own, own), entry) if len(feats) else (entry, entry)
        del feats, words
        first, size = chains(texts, ends, owner)
        self.crf = ChainCRF(len(self.languages), FEATURES)
        self.crf.fit(flat, sizes, labels, first, size)

    def word_table(self, limit: int = TABLE_WORDS) -> WordTable:
        def build(words: list[bytes]) -> list:
            own = [letters(w) for w in words]
            feats = [hashed(word_features(w, self.lexicon), FEATURES) for w in own]
            sizes = np.array([len(f) for f in feats])
            flat = np.array([f for fs in feats for f in fs], dtype=np.int64)
            word = np.repeat(np.arange(len(words)), sizes)
            scores = np.stack([np.bincount(word, weights=self.crf.weights[flat, j], minlength=len(words))
                               for j in range(len(self.languages))], axis=1)
            return [scores, np.array([bool(w) for w in own])]
        return WordTable(build, limit)

    def predict(self, texts: Texts, known: WordTable) -> tuple[list[str], np.ndarray]:
        starts, ends, rows = texts.words()
        if not len(starts):
            return [UNKNOWN] * texts.count, np.zeros(texts.count)
        entries = known.find(texts, starts, ends)
        first, size = chains(texts, ends, rows)
        post, _, _ = self.crf.marginals(known.parts[0][entries], first, size)
        lettered = known.parts[1][entries].astype(np.float64)
        n = np.bincount(rows, weights=lettered, minlength=texts.count)
        mean = np.stack([np.bincount(rows, weights=post[:, j] * lettered, minlength=texts.count)
                         for j in range(post.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
        return names, np.clip(np.where(n > 0, mean.max(axis=1), 0.0), 0.0, 1.0)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, words: int = SAMPLE_WORDS, stretch: int = STRETCH_WORDS) -> LanguageModel:
    """Fit on a bounded sample of the training rows of ``docs``: drawn documents, and drawn stretches of their whole texts."""
    train = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(training_rows(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([])

    def rates(wanted: int, have: dict[str, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(have.items()) for x in (lang, min(1.0, wanted / max(1, n)))]), F.col("lang"))

    def draw(*parts: str | Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("language"), *parts), F.lit(1_000_000)) / 1_000_000

    # repeated ids differ in their texts' hash
    drawn = train.where(draw("doc_id", F.xxhash64("text")) < rates(per_language, sizes)).select("lang", "doc_id", "text", F.split("text", r"\s+").alias("split"))
    held = {r.lang: r.n for r in drawn.groupBy("lang").agg(F.sum(F.size("split")).alias("n")).collect()}
    if not held:
        return LanguageModel([])
    places = drawn.select("lang", "doc_id", "text", "split", F.explode(F.sequence(F.lit(0), F.floor((F.size("split") - 1) / stretch).cast("int"))).alias("place"))
    sample = places.where(draw("doc_id", F.xxhash64("text"), "place") < rates(words // len(held), held)).select(
        "lang", "doc_id", "place", F.array_join(F.slice("split", F.col("place") * stretch + 1, F.lit(stretch)), " ").alias("part"))
    return LanguageModel([(r.lang, r.part) for r in sorted(sample.collect(), key=lambda r: (r.lang, r.doc_id, r.place, r.part))])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("language", model.ident, model.word_table) if model.languages else None
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = Texts(piece.column("text"))
                names, score = model.predict(texts, known) if known else ([UNKNOWN] * texts.count, np.zeros(texts.count))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, table_words: int = TABLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose language is known, whatever its score (a mixed text's is low); all columns stay.

    A worker's table holds ``table_words`` words before it starts afresh.
    """
    model = fit(docs)

    @F.arrow_udf("boolean")
    def named(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = per_worker("language", f"{model.ident} {table_words}", lambda: model.word_table(table_words)) if model.languages else None
        for column in columns:
            names: list[str] = []
            for piece in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
                texts = Texts(piece.column("text"))
                names += model.predict(texts, known)[0] if known else [UNKNOWN] * texts.count
            yield pa.array([n != UNKNOWN for n in names], pa.bool_())

    # only the text goes to Python, and one flag comes back
    return docs.where(named("text"))


@query("op9_language_tags")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = ~training_rows(F.col("doc_id"))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
