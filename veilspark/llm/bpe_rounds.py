"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word's
lowest-rank adjacent pair is found (a binary search over the sorted pair keys
gives the ranks) and all its occurrences are merged, left to right; words
without a mergeable pair leave. The files of the tokenizers library are the
input: vocabulary, merges and added tokens are read from its JSON.

Supported: a BPE model with an optional end-of-word suffix, no byte fallback;
the normaliser NFC + white space + lower case, or none; a Split pre-tokenizer
whose pieces hold no white space, followed by byte-level symbols. No decoder:
decoding joins the tokens by one space, as the library does.

Defined results for odd input: null and empty texts give no ids and an empty
decoded text; a text that spells out an added token yields that token's id at
its place; every other column is passed by untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .registry import query
from .words import TABLE_WORDS, Texts, WordTable, gather, per_worker, slices

_FREE = np.iinfo(np.int32).max


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies:
    visible Latin-1 characters for themselves, the others as 256, 257, ... in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks as sorted numpy tables."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("a BPE model without byte fallback, unknown token and prefixes is needed")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        symbols = _byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], dtype=np.int64)
        self.last = np.array([vocab.get(s + self.suffix, -1) for s in symbols], dtype=np.int64)
        self.token = {i: t.encode() for t, i in vocab.items()}
        self.token.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces (each merged on its own), flat, and the number of ids per piece."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        word = np.repeat(np.arange(len(pieces)), sizes)
        symbol = self.inner[data]
        tail = np.cumsum(sizes)[sizes > 0] - 1
        symbol[tail] = self.last[data[tail]]
        known = symbol >= 0  # the library leaves out what the vocabulary lacks
        symbol, word = symbol[known], word[known]
        done_symbols, done_words = [], []
        while len(symbol):
            pair = symbol[:-1] * self.width + symbol[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], _FREE)
            rank = np.append(rank, _FREE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(word)))
            best = np.repeat(lowest, lengths)
            active = best < _FREE
            done_symbols.append(symbol[~active])
            done_words.append(word[~active])
            hit = (rank == best) & active
            # of overlapping occurrences (a a a), every second one, counted from the left of its run
            chained = np.flatnonzero(hit[1:] & hit[:-1])
            if len(chained):
                spot = np.arange(len(hit))
                begin = hit & ~np.append(False, hit[:-1])
                run = np.maximum.accumulate(np.where(begin, spot, 0))
                hit &= (spot - run) % 2 == 0
            left = np.flatnonzero(hit)
            symbol = symbol.copy()
            symbol[left] = self.made[at[left]]
            stay = active.copy()
            stay[left + 1] = False
            symbol, word = symbol[stay], word[stay]
        if done_symbols:
            symbols, words = np.concatenate(done_symbols), np.concatenate(done_words)
            order = np.argsort(words, kind="stable")
            return symbols[order].astype(np.uint32), np.bincount(words, minlength=len(pieces)).astype(np.int64)
        return np.zeros(0, dtype=np.uint32), np.zeros(len(pieces), dtype=np.int64)

    def decode(self, ids) -> bytes:
        return b" ".join(self.token[i] for i in ids)


class BatchBPE:
    """Encoder and decoder over whole batches; new words are merged together, once."""

    def __init__(self, tokenizer_file: str, table_words: int = TABLE_WORDS):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec)
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        if [s["type"] for s in steps] not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError("unknown normaliser")
        self.normalise = bool(steps)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("unknown pre-tokenizer")
        if spec["decoder"] is not None:
            raise ValueError("a tokenizer without decoder is needed")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")")
        self.table = WordTable(self._build, table_words)

    def _pieces(self, word: bytes) -> list[bytes]:
        text = word.decode()
        if self.normalise:
            if not text.isascii():
                # per character, so that a final sigma is treated like any other
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
        return [p.encode() for p in self.pattern.findall(text)]

    def _build(self, words: list[bytes]) -> list:
        index: dict[bytes, int] = {}
        own = [[index.setdefault(p, len(index)) for p in self._pieces(w)] for w in words]
        ids, n = self.merges.encode(list(index))
        starts = np.cumsum(n) - n
        flat = np.array([p for ps in own for p in ps], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), [len(ps) for ps in own])
        ids, lengths = gather((ids, starts, n), flat)
        counts = np.bincount(word, weights=lengths, minlength=len(words)).astype(np.int64)
        ends = np.cumsum(counts).tolist()
        listed = ids.tolist()
        # each word's decoded form, with the space that joins it to the next token
        decoded = [self.merges.decode(listed[e - c:e]) + b" " if c else b"" for e, c in zip(ends, counts.tolist(), strict=True)]
        return [(ids, counts), (np.frombuffer(b"".join(decoded), dtype=np.uint8), [len(d) for d in decoded])]

    def _plain(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(texts.count, dtype=np.int64)
        starts, ends, rows = texts.words(wide=True)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), none, np.zeros(0, dtype=np.uint8), none
        entries = self.table.find(texts, starts, ends)
        ids, n = gather(self.table.parts[0], entries)
        decoded, m = gather(self.table.parts[1], entries)
        return (ids, np.bincount(rows, weights=n, minlength=texts.count).astype(np.int64),
                decoded, np.bincount(rows, weights=m, minlength=texts.count).astype(np.int64))

    def encode(self, texts: Texts) -> Iterator[tuple[np.ndarray, bytes]]:
        """(ids, decoded text) of each text."""
        raw = texts.data.tobytes()
        if any(a.encode() in raw for a in self.added):
            # an added token splits its text; what lies between is encoded like any text
            rows = [self.added_split.split(texts.text(r)) for r in range(texts.count)]
            parts = [p for row in rows for p in row]
            plain = list(self.encode(Texts(pa.array([None if p in self.added else p for p in parts], pa.large_string()))))
            at = 0
            for row in rows:
                ids, decoded = [], []
                for p in row:
                    own, text = (np.array([self.added[p]], dtype=np.uint32), p.encode()) if p in self.added else plain[at]
                    at += 1
                    ids.append(own)
                    if len(own):
                        decoded.append(text)
                yield np.concatenate(ids), b" ".join(decoded)
            return
        ids, n, decoded, m = self._plain(texts)
        i = j = 0
        for k, size in zip(n.tolist(), m.tolist(), strict=True):
            yield ids[i:i + k], decoded[j:j + size - 1].tobytes() if size else b""
            i, j = i + k, j + size


def encode_documents(docs: DataFrame, tokenizer_file: str, with_ids: bool = False, table_words: int = TABLE_WORDS) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, little-endian 32-bit, if asked for)."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker("rounds", f"{tokenizer_file} {table_words}", lambda: BatchBPE(tokenizer_file, table_words))
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = [(len(ids), packed := ids.astype("<u4").tobytes(), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text).hexdigest())
                        for ids, text in bpe.encode(Texts(piece.column("text")))]
                out = [piece.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                       pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(out + ([pa.array([r[1] for r in rows], pa.binary())] if with_ids else []), schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""))


@query("op4_bpe_rounds")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
