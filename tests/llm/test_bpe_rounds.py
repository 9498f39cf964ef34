"""Merge rounds against the tokenizers library on whole texts."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from test_token_files import strange_texts
from veilspark.llm import bpe_rounds as B
from veilspark.llm.words import Texts

FILE = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    tok = Tokenizer.from_file(FILE)
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return ids, [tok.decode(i, skip_special_tokens=False) for i in ids]


def test_equal_to_the_library():
    rnd = random.Random(3)
    texts = strange_texts() + ["aaaaaaa aaaa aa", "Hello, World's 'S'Re 1234 ½ x²", "ǅ Ǆ ẞ İstanbul ΟΔΟΣ Ὀ", "ｆｕｌｌ　ｗｉｄｅ"]
    texts += ["".join(rnd.choices("abcdeinorst'!.,012 \n", k=rnd.randint(1, 300))) for _ in range(200)]
    ids, decoded = library(texts)
    got = list(B.BatchBPE(FILE).encode(Texts(pa.array(texts))))
    assert [g[0].tolist() for g in got] == ids
    assert [g[1].decode() for g in got] == decoded


def test_query_over_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (4, "very long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS ids", "1 AS n_tokens")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode_documents(df.repartition(2), FILE).collect()}
    ids, decoded = library([t or "" for _, t in rows])
    assert got == {(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
                   for (d, _), i, x in zip(rows, ids, decoded)}
    assert B.encode_documents(df.limit(0), FILE).count() == 0
