"""Token ids in files, each document compressed by itself with a shared dictionary (operator 5).

The format is a folder of Parquet tables:

- ``dictionary``: one row (hash, id_bytes, data); ``data`` is a zstandard dictionary trained on the
  serialised ids of a bounded sample, ``hash`` its SHA-256, ``id_bytes`` the width of a serialised id.
- ``blocks``: (part, block, dictionary_hash, payload, entries); ``payload`` is the zstandard frames of some
  documents end to end, ``entries`` says for each doc_id, start (ids of the documents before it in its
  part), n_tokens, offset and size of the frame.
- ``parts``: (part, start): ids of all documents in the parts before.
- ``index``: (doc_id, start, n_tokens, part, block, offset, size), start over all documents.

Documents are in ascending order of doc_id over parts, blocks and entries, so a document is found by a
filter on the index that reaches the files, and is decompressed without its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxoffice.llm.pretokenized import Pieces
from boxoffice.llm.staging import drop, staged

END_ID = 0
BLOCK_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SAMPLE_ROWS = 1000  # documents that the dictionary is trained on
SAMPLE_CHARS = 20_000  # longer ones are not used for it

ENTRY = "struct<doc_id: long, start: long, n_tokens: long, offset: long, size: long>"
BLOCK = f"part int, block int, dictionary_hash string, payload binary, entries array<{ENTRY}>"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + n) for n, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def splits_alike(tokenizer_file: str) -> bool:
    """Whether the file asks for the byte-level split and nothing else before its model."""
    spec = json.loads(tokenizer_file)
    before = spec.get("pre_tokenizer") or {}
    byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(byte_level and spec.get("normalizer") is None and spec["model"].get("type") == "BPE")


def added_tokens(tokenizer_file: str) -> re.Pattern | None:
    """Finds the tokens that the library cuts out of a text before it splits it; normalized ones in any case."""
    contents = [t["content"] for t in json.loads(tokenizer_file).get("added_tokens") or [] if t["content"]]
    return re.compile("|".join(map(re.escape, contents)), re.IGNORECASE) if contents else None


class Encoder:
    """Ids by the tokenizers library, from the text of a tokenizer file.

    With ``added``, strings of added tokens in a text have the ids of these, as by the library's default;
    without, they are ordinary text.
    """

    def __init__(self, tokenizer_file: str, added: bool = False):
        self.tokenizer = Tokenizer.from_str(tokenizer_file)
        self.tokenizer.encode_special_tokens = not added
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.id_bytes == 2 else "I"  # as wide on all platforms that Spark runs on, little-endian
        by_model = splits_alike(tokenizer_file)
        self.pieces = Pieces(self.split_pieces if by_model else lambda raw: self.texts([r.decode() for r in raw]), self.id_bytes, self.texts, added_tokens(tokenizer_file) if added else None)
        self.end = np.array([END_ID], f"<u{self.id_bytes}").tobytes()

    def texts(self, strings: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def split_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces that the split leaves whole go straight to the library's model, which sees bytes as letters."""
        tokenize, code = self.tokenizer.model.tokenize, self.code
        return [array(code, [x.id for x in tokenize(p.decode("latin-1").translate(BYTE_LETTERS))]).tobytes() for p in pieces]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Serialised ids of texts, with the end id."""
        return [ids + self.end for ids in self.pieces.encode(texts)]


ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(tokenizer_file: str, added: bool) -> Encoder:
    """That of this Python process, built once."""
    if (tokenizer_file, added) not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[tokenizer_file, added] = Encoder(tokenizer_file, added)
    return ENCODERS[tokenizer_file, added]


def trained(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if len(s) > 8]).as_bytes()
    except zstandard.ZstdError:  # too little to choose from: take it as it is
        return b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\0")


def sample(docs: DataFrame) -> list[str]:
    """Texts of the documents whose ids have the smallest hashes."""
    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS))
    ids = short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def frames(docs: DataFrame, tokenizer_file: str, dictionary: bytes, added: bool) -> DataFrame:
    """``(doc_id, n_tokens, frame)``."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_file, dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, data = shared.value
        encode = encoder(file, added)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_dict_id=False)
        for batch in batches:
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            counts = [len(x) // encode.id_bytes for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([compressor.compress(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "frame"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def packed(rows: DataFrame, dictionary_hash: str) -> DataFrame:
    """Blocks of the sorted rows of each partition; a part is a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        entries: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            names = ["doc_id", "start", "n_tokens", "offset", "size"]
            listed = pa.array([[dict(zip(names, e, strict=True)) for e in entries]], pa.list_(pa.struct([(n, pa.int64()) for n in names])))
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([dictionary_hash]), pa.array([b"".join(held)], pa.binary()), listed]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "dictionary_hash", "payload", "entries"])

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True):
                if held and size + len(frame) > BLOCK_BYTES:
                    yield made()
                    held, entries, size, block = [], [], 0, block + 1
                entries.append((doc_id, start, n, size, len(frame)))
                held.append(frame)
                size += len(frame)
                start += n
        if held:
            yield made()

    return rows.mapInArrow(run, BLOCK)


def write(docs: DataFrame, tokenizer_path: str, path: str, added: bool = False) -> None:
    """Writes ``docs(doc_id, text, ..)`` to the new folder ``path``, in ascending order of doc_id.

    ``tokenizer_path`` is read by the driver; for ``added`` see `Encoder`. Null texts are empty and hold the end id only. A null doc_id
    comes first; rows with the same doc_id each have an entry, in the order of their length. Other columns
    are ignored; no rows give empty tables.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_file = file.read()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encode = encoder(tokenizer_file, added)
    dictionary = trained(encode(sample(docs)))
    dictionary_hash = hashlib.sha256(dictionary).hexdigest()
    header = spark.createDataFrame([(dictionary_hash, encode.id_bytes, bytearray(dictionary))], "hash string, id_bytes int, data binary")
    header.coalesce(1).write.parquet(f"{path}/dictionary")
    # encoded once: dealing by range reads its input twice
    rows = staged(frames(docs, tokenizer_file, dictionary, added), "frames")
    order = ["doc_id", "n_tokens", F.xxhash64("frame"), F.rand(1)]  # equal rows may lie in several parts
    packed(rows.repartitionByRange(*order).sortWithinPartitions("doc_id", "n_tokens", F.xxhash64("frame")), dictionary_hash).write.parquet(f"{path}/blocks")
    drop(rows)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # a row for each part, of which there are as many as shuffle partitions
    last = F.element_at("entries", -1)
    ends = blocks.groupBy("part").agg(F.max(last["start"] + last["n_tokens"]).alias("n")).collect()
    total, starts = 0, []
    for r in sorted(ends):
        starts.append((r.part, total))
        total += r.n
    parts = spark.createDataFrame(starts, "part int, start long")
    parts.coalesce(1).write.parquet(f"{path}/parts")
    entry = blocks.select("part", "block", F.explode("entries").alias("e")).join(F.broadcast(parts.withColumnRenamed("start", "before")), "part")
    entry.select("e.doc_id", (F.col("e.start") + F.col("before")).alias("start"), "e.n_tokens", "part", "block", "e.offset", "e.size").write.parquet(f"{path}/index")


def unpacked(blocks: DataFrame, path: str, ids: bool) -> DataFrame:
    """``(part, doc_id, start, n_tokens, ids, ids_crc32)`` of the entries of blocks."""
    spark = blocks.sparkSession
    header = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((bytes(header.data), header.hash, header.id_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, name, id_bytes = shared.value
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        for batch in batches:
            for part, used, payload, entries in zip(*(batch.column(c).to_pylist() for c in ("part", "dictionary_hash", "payload", "entries")), strict=True):
                if used != name:
                    raise ValueError(f"a block was written with dictionary {used}, this one is {name}")
                whole = [np.frombuffer(reader.decompress(payload[e["offset"] : e["offset"] + e["size"]]), f"<u{id_bytes}").astype("<u4").tobytes() for e in entries]
                columns = [[part] * len(entries), *([e[c] for e in entries] for c in ("doc_id", "start")), [len(x) // 4 for x in whole], whole if ids else [None] * len(whole), [zlib.crc32(x) for x in whole]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return blocks.select("part", "dictionary_hash", "payload", "entries").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids, ids_crc32)`` of all documents; ids as little-endian unsigned 32-bit
    numbers with the end id, null without ``ids``; ``ids_crc32`` is their CRC."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts").withColumnRenamed("start", "before")
    rows = unpacked(blocks, path, ids).join(F.broadcast(parts), "part")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """As `read`, for the given documents: their entries by the index, and no other frame is decompressed."""
    wanted = spark.read.parquet(f"{path}/index").filter(F.col("doc_id").isin(doc_ids))
    entry = F.struct("doc_id", "start", "n_tokens", "offset", "size").cast(ENTRY)
    by_block = wanted.groupBy("part", "block").agg(F.collect_list(entry).alias("wanted"))
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks").drop("entries")
    found = blocks.join(by_block, ["part", "block"]).withColumnRenamed("wanted", "entries")
    return unpacked(found, path, True).drop("part")
