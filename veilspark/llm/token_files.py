"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned by ``doc_id`` and sorted, so partition ``p``
holds the ``p``-th stretch of the corpus. Each task encodes its stretch and
writes three files into a shared folder:

- ``part-NNNNN.ids``: the ids, back to back, unsigned 16 or 32 bit little-endian;
- ``part-NNNNN.offsets``: n+1 signed 64-bit offsets (in ids) of its n documents;
- ``part-NNNNN.docs``: n signed 64-bit document ids (a null id as -2**63).

A file gets its name by a rename once complete, so a repeated or second
attempt of a task only replaces equal content. The driver receives one small
row per partition (its counts); their prefix sums are the partitions' bases,
written to ``index.json``. Readers map the files into memory.

Defined results for odd input: null text counts as empty (only the end id is
written); a null ``doc_id`` sorts first; rows that share a ``doc_id`` each get
their own entry, ordered by text; an empty table gives an index without parts.
The folder must be reachable for Python on the executors (a mounted folder,
or a store that pyarrow opens).
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.taskcontext import TaskContext

from ..sources.tables import table
from .registry import query
from .store import folder
from .words import Texts, WordTable, gather, per_worker, slices

NO_ID = -(1 << 63)
END_ID = 2


class PieceEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    For a byte-level tokenizer without normaliser, a run of white space always
    starts a new piece, so each stretch "white space, then text" is encoded on
    its own and once only; texts that spell out an added token go to the
    library whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normaliser and prefix space is needed")
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = WordTable(self._build)

    def _build(self, words: list[bytes]) -> list:
        flat, lengths = array("I"), []
        for at in range(0, len(words), 4000):  # the library's result objects are large
            for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[at:at + 4000]], add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                lengths.append(len(ids))
        return [(np.array(flat, dtype=np.uint32), lengths)]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each text."""
        starts, ends, rows = texts.words(wide=True, lead_space=True)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(texts.count, dtype=np.int64)
        entries = self.table.find(texts, starts, ends)
        flat, n = gather(self.table.parts[0], entries)
        counts = np.bincount(rows, weights=n, minlength=texts.count).astype(np.int64)
        raw = texts.data.tobytes()
        if not any(a in raw for a in self.added):
            return flat, counts
        parts, at = [], np.cumsum(counts) - counts
        for r in range(texts.count):
            own = raw[texts.offsets[r]:texts.offsets[r + 1]]
            if any(a in own for a in self.added):
                ids = np.array(self.tokenizer.encode(own.decode(), add_special_tokens=False).ids, dtype=np.uint32)
                counts[r] = len(ids)
            else:
                ids = flat[at[r]:at[r] + counts[r]]
            parts.append(ids)
        return np.concatenate(parts) if parts else flat, counts


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID) -> list[dict]:
    """Write the ids of ``docs`` into ``path`` in ascending doc_id order; returns the index's parts."""
    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = per_worker("pieces", tokenizer_file, lambda: PieceEncoder(tokenizer_file))
        kind = np.dtype("<u2" if max(encoder.size - 1, end_id) < 1 << 16 else "<u4")
        store, root = _open(path)
        store.create_dir(root, recursive=True)
        names = {k: f"{root}/part-{part:05d}.{k}" for k in ("ids", "offsets", "docs")}
        drafts = {k: f"{v}.{uuid.uuid4().hex}" for k, v in names.items()}
        out = {k: store.open_output_stream(v) for k, v in drafts.items()}
        n_docs = n_tokens = 0
        out["offsets"].write(np.zeros(1, dtype="<i8").tobytes())
        for batch in batches:
            for piece in slices(batch, "text"):
                flat, counts = encoder.encode(Texts(piece.column("text")))
                ends = np.cumsum(counts)
                ids = np.insert(flat.astype(kind), ends, kind.type(end_id))
                out["ids"].write(ids.tobytes())
                out["offsets"].write((n_tokens + ends + np.arange(1, len(ends) + 1)).astype("<i8").tobytes())
                out["docs"].write(piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs += len(counts)
                n_tokens += len(ids)
        for k, stream in out.items():
            stream.close()
            if n_docs:
                store.move(drafts[k], names[k])
            else:
                store.delete_file(drafts[k])
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": [kind.itemsize]},
                                         schema=pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int64())]))

    ordered = (docs.selectExpr("doc_id", "coalesce(text, '') AS text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", "text"))
    counts = ordered.mapInArrow(stretch, "part long, n_docs long, n_tokens long, width long").where("n_docs > 0").collect()
    parts, base, first = [], 0, 0
    for row in sorted(counts, key=lambda r: r.part):  # prefix sums over one row per partition
        parts.append(row.asDict() | {"base": base, "first": first})
        base, first = base + row.n_tokens, first + row.n_docs
    store, root = _open(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"parts": parts, "n_docs": first, "n_tokens": base}).encode())
    return parts


class Part:
    """One partition's files, mapped into memory where they are local files."""

    def __init__(self, path: str, part: dict):
        store, root = _open(path)
        load = (lambda f, kind: np.memmap(f, dtype=kind, mode="r")) if isinstance(store, fs.LocalFileSystem) else (
            lambda f, kind: np.frombuffer(store.open_input_file(f).readall(), dtype=kind))
        name = f"{root}/part-{part['part']:05d}"
        self.base, self.first = part["base"], part["first"]
        self.ids = load(f"{name}.ids", f"<u{part['width']}")
        self.offsets = load(f"{name}.offsets", "<i8")
        self.docs = load(f"{name}.docs", "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


class Corpus:
    """Random access to the i-th document of all parts."""

    def __init__(self, path: str):
        store, root = _open(path)
        self.path, self.index = path, json.loads(store.open_input_file(f"{root}/index.json").readall())
        self.firsts = [p["first"] for p in self.index["parts"]]

    def __len__(self) -> int:
        return self.index["n_docs"]

    def __getitem__(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self.firsts, i, side="right")) - 1
        part = Part(self.path, self.index["parts"][k])
        return part[i - part.first]


def read(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    """One row per stored document: doc_id, start (ids before it), n_tokens, ids_crc32; one task per part."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part = Part(path, parts[k])
                for low in range(0, len(part), 5000):
                    high = min(low + 5000, len(part))
                    ids = part.docs[low:high]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids, mask=ids == NO_ID), pa.array(part.base + part.offsets[low:high]),
                        pa.array(np.diff(part.offsets[low:high + 1])),
                        pa.array([zlib.crc32(part[i].astype("<u4").tobytes()) for i in range(low, high)], pa.int64())], schema=schema)

    if not parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = folder(spark, "tokens")
    return read(spark, path, write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path))
