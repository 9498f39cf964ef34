"""Token files against the tokenizers library on whole texts."""
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from veilspark.llm import token_files as F
from veilspark.llm import words as W

FILE = public_tokenizers.path("byte_bpe_50k.json")


def strange_texts(n=400, seed=5):
    rnd = random.Random(seed)
    bits = ["a", "Zug", "it's", "  ", " ", "\n", "\t", " ", " ", "　", "\x1c", "\x85", "é", "漢字", "🙂", "12", "'LL", "...",
            "<|endoftext|>", "<|startoftext|>", "é", "ﬁ", "İ", "Σας", " ", "x" * 40, "don't", "#!", "\r\n", "ß"]
    return ["", " ", "\n\n a"] + ["".join(rnd.choices(bits, k=rnd.randint(1, 14))) for _ in range(n)]


def test_pieces_equal_the_library():
    texts = strange_texts()
    enc = F.PieceEncoder(FILE)
    ids, counts = enc.encode(W.Texts(pa.array(texts)))
    own = np.split(ids, np.cumsum(counts)[:-1])
    tok = Tokenizer.from_file(FILE)
    assert [x.tolist() for x in own] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_hash_clash_and_full_table():
    texts = W.Texts(pa.array(["a b c", "b c d", None, "longer words here", "a a a"]))
    table = W.WordTable(lambda words: [(np.frombuffer(b"".join(words), np.uint8), [len(w) for w in words])], limit=3)
    for clash in (False, True):
        if clash:
            normal = W.Texts.hashes
            W.Texts.hashes = lambda self, s, e, which=0: (e - s).astype(np.uint64) if which == 0 else normal(self, s, e, which)
        try:
            for _ in range(2):
                s, e, rows = texts.words()
                found = table.find(texts, s, e)
                flat, _ = W.gather(table.parts[0], found)
                assert flat.tobytes() == b"abcbcdlongerwordshereaaa" and rows.tolist() == [0] * 3 + [1] * 3 + [3] * 3 + [4] * 3
        finally:
            if clash:
                W.Texts.hashes = normal


def test_files_round_trip(spark, tmp_path):
    texts = strange_texts(60)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id"), (6, None), (6, "twin"), (6, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS n_tokens").repartition(5)
    parts = F.write(df, FILE, str(tmp_path / "t"))
    got = F.read(spark, str(tmp_path / "t"), parts).collect()
    tok = Tokenizer.from_file(FILE)
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want
    corpus = F.Corpus(str(tmp_path / "t"))
    assert len(corpus) == len(rows) and [len(corpus[i]) for i in range(len(rows))] == [w[2] for w in want]
    empty = F.write(df.limit(0), FILE, str(tmp_path / "e"))
    assert empty == [] and F.read(spark, str(tmp_path / "e"), empty).count() == 0
