"""Token ids of a whole corpus by a public byte-level BPE (problem 6).

Global distinct-word shuffle. Texts are split into pre-tokens; a block of documents
keeps its pre-tokens as positions into the block's own list of distinct words. Only
those lists are exploded and shuffled: each distinct word of the corpus is encoded
once, the ids are joined back to (block, position in the block's list), and each
block is put together again by position. A word that a third of all documents hold
is one row per block, so no group grows with the corpus.

Null and empty texts give an empty list; every row in gives one row out, repeated
or null document ids included.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import written

#: Fixed value: the pre-token pattern that the byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of text in a block, and documents: a block's dictionary and positions stay within a few MB.
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 8192
#: Ids put into bytes at once.
DECODED_IDS = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a public vocabulary lies; the folder is a parameter, QUILL_TOKENIZERS or the installed one."""
    folder = folder or os.environ.get("QUILL_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def _read(path: str) -> bytes:
    """The vocabulary file, read by the driver; under 1 MB, and sent with the job, so executors need no file."""
    with open(path, "rb") as f:
        return f.read()


def _ranks(path: str | bytes) -> dict[bytes, int]:
    data = path if isinstance(path, bytes) else _read(path)
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


_encoders: dict[tuple[int, str], object] = {}


def _encoder(data: bytes, pattern: str):
    import tiktoken

    key = (hash(data), pattern)
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=_ranks(data), special_tokens={})
    return _encoders[key]


BLOCK_SCHEMA = "block long, docs binary, lens binary, seq binary, words array<string>"


def _blocks(id_name: str, text_name: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        split, part, made = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        docs: list = []
        lens: list[int] = []
        seq: list[int] = []
        index: dict[str, int] = {}
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal docs, lens, seq, index, size, made
            ids = pa.RecordBatch.from_arrays([pa.array(docs, type=id_type)], ["id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            kind = np.uint16 if len(index) < 65536 else np.uint32
            row = {
                "block": [(part << 32) + made],
                "docs": [sink.getvalue().to_pybytes()],
                "lens": [np.asarray(lens, dtype=np.uint32).tobytes()],
                "seq": [np.asarray(seq, dtype=kind).tobytes()],
                "words": [list(index)],
            }
            made += 1
            docs, lens, seq, index, size = [], [], [], {}, 0
            return pa.RecordBatch.from_pydict(row, schema=out)

        id_type = None
        out = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("lens", pa.binary()), ("seq", pa.binary()), ("words", pa.list_(pa.string()))])
        for b in batches:
            id_type = b.schema.field(id_name).type
            for doc, text in zip(b.column(id_name).to_pylist(), b.column(text_name).to_pylist()):
                words = split(text) if text else []
                docs.append(doc)
                lens.append(len(words))
                seq += [index.setdefault(w, len(index)) for w in words]
                size += len(text or "")
                if size >= BLOCK_CHARS or len(docs) >= BLOCK_DOCS:
                    yield block()
        if docs:
            yield block()

    return run


def _encode_words(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, pattern).encode_ordinary
        for b in batches:
            ids = [np.asarray(encode(w), dtype=np.int32).tobytes() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.binary())], ["word", "ids"])

    return run


def _assemble(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                docs = pa.ipc.open_stream(b.column("docs")[r].as_buffer()).read_all().column(0).combine_chunks()
                lens = np.frombuffer(b.column("lens")[r].as_buffer(), dtype=np.uint32).astype(np.int64)
                n = b.column("n_words")[r].as_py()
                raw = b.column("seq")[r].as_buffer()
                seq = np.frombuffer(raw, dtype=np.uint16 if n < 65536 else np.uint32).astype(np.int64)
                pairs = b.column("pairs")[r].values
                counts, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
                if n:
                    at = pairs.field("at").to_numpy()
                    parts = pairs.field("ids")
                    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64) // 4
                    data = np.frombuffer(parts.buffers()[2], dtype=np.int32)
                    starts, counts = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
                    starts[at], counts[at] = offsets[:-1], np.diff(offsets)
                    per = counts[seq]
                    ends = np.cumsum(per)
                    values = data[np.repeat(starts[seq] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)]
                    total = np.concatenate(([0], ends))
                else:
                    total = np.zeros(1, dtype=np.int64)
                bounds = total[np.concatenate(([0], np.cumsum(lens)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, type=pa.int32()))], [id_name, "ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row of df, without special tokens."""
    shared = df.sparkSession.sparkContext.broadcast(_read(vocabulary or vocabulary_path()))
    kind = df.schema[id_col].dataType.simpleString()
    blocks = written(df.select(id_col, text_col).mapInArrow(_blocks(id_col, text_col, pattern), BLOCK_SCHEMA))
    listed = blocks.select("block", F.posexplode("words").alias("at", "word"))
    codes = listed.select("word").distinct().mapInArrow(_encode_words(shared, pattern), "word string, ids binary")
    back = listed.join(codes, "word").groupBy("block").agg(F.collect_list(F.struct("at", "ids")).alias("pairs"))
    whole = blocks.select("block", "docs", "lens", "seq", F.size("words").alias("n_words")).join(back, "block", "left")
    whole = whole.select("docs", "lens", "seq", "n_words", F.coalesce("pairs", F.array().cast("array<struct<at:int,ids:binary>>")).alias("pairs"))
    return whole.mapInArrow(_assemble(id_col), f"`{id_col}` {kind}, ids array<int>")


def token_bytes(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """The token-byte table (id INT, bytes BINARY): one row per id of the vocabulary, a fixed size."""
    rows = [(i, bytearray(b)) for b, i in _ranks(vocabulary or vocabulary_path()).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def _byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of the bytes of each id, and all bytes; an id that the vocabulary doesn't have, as the last one, has none."""
    sizes = np.zeros(max(ranks.values(), default=-1) + 2, dtype=np.int64)
    for b, i in ranks.items():
        sizes[i] = len(b)
    data = b"".join(sorted(ranks, key=ranks.get))
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(data, dtype=np.uint8)


def _decode(shared, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes, data = shared.value
        none = len(sizes) - 1
        for b in batches:
            lists = b.column(1)
            ids = lists.flatten().fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
            ids[(ids < 0) | (ids > none)] = none
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
            k = 0
            while k < len(b):
                m = max(k + 1, int(np.searchsorted(ends, ends[k] + DECODED_IDS, side="right")) - 1)
                part = ids[ends[k] : ends[m]]
                per = sizes[part]
                upto = np.concatenate(([0], np.cumsum(per)))
                values = data[np.repeat(starts[part] - upto[:-1], per) + np.arange(upto[-1])]
                bounds = upto[ends[k : m + 1] - ends[k]].astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), m - k, [None, pa.py_buffer(bounds), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, m - k), texts], [id_name, "_bytes"])
                k = m

    return run


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(id_col, text) from (id_col, ids): each id is looked up in the token-byte table where its list lies, and
    the bytes stay in their order, so nothing is exploded or shuffled. An empty or null list gives an empty text;
    a null or unknown id gives no bytes; bytes that are no UTF-8 are treated as Spark's decode treats them.

    The table (50 256 rows, under 1 MB) is broadcast: its size does not depend on the corpus.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_byte_table(_ranks(vocabulary or vocabulary_path())))
    kind = encoded.schema[id_col].dataType.simpleString()
    whole = encoded.select(id_col, "ids").mapInArrow(_decode(shared, id_col), f"`{id_col}` {kind}, _bytes binary")
    return whole.select(id_col, F.decode("_bytes", "UTF-8").alias("text"))
