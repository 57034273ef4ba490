"""Token-ID output: shard files of concatenated ids with Elias-Fano coded document boundaries.

Texts are range-partitioned by document id, encoded where they land and written as one shard file per partition; a
shard holds one concatenated id array (16 bits an id where the vocabulary allows) and the ends of its documents as an
Elias-Fano sequence: the low bits packed, the high bits in unary, with one 32-bit sample per ``SAMPLE`` ones for
select. About 2 + log2(ids/documents) bits a document replace a 64-bit table. Shard files are written under a
temporary name and renamed, so a task that runs again writes the same file again. A small manifest (one row a shard)
gives each shard's first global offset through a running sum.

A reader gets a document's place by two selects; no table of offsets is kept or built from the file.

Cases: null or empty text -> only the end id; very long texts are encoded piece by piece and never cut; null ids come first; equal ids keep all their rows, ordered by text; an empty table
gives no document; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicework.llm.common import give_back, scratch_dir, text_array
from sluicework.llm.tokens import default_tokenizer, encoder, ids_crc32

MAGIC, SAMPLE = b"SLTK0001", 256
SHARD_BYTES = 16 << 20


class EliasFano:
    """A non-decreasing sequence below ``universe`` in about 2 + log2(universe / n) bits a value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(math.log2(universe / n))) if n and universe > n else 0
        values = values.astype(np.uint64)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8), bitorder="little")
        return cls(n, bits, pack(low.ravel()), pack(unary), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values ``i``: each starts at the sample before it and skips whole bytes by their count of ones."""
        i = np.asarray(i, np.int64)
        at = self.samples[i // SAMPLE].astype(np.int64)
        # The sampled one itself and what follows it in its byte count; the ones before it don't.
        byte, left = at // 8, i % SAMPLE
        left = left + np.bitwise_count(self.high[byte] & ((1 << (at % 8)) - 1).astype(np.uint8))
        go = np.arange(len(i))
        while len(go := go[left[go] >= np.bitwise_count(self.high[byte[go]])]):
            left[go] -= np.bitwise_count(self.high[byte[go]])
            byte[go] += 1
        ones = np.unpackbits(self.high[byte][:, None], axis=1, bitorder="little")
        one = 8 * byte + (np.cumsum(ones, axis=1) > left[:, None]).argmax(1)
        value = (one - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= ((self.low[bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(np.int64) << k
        return value

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        low, high = (np.frombuffer(raw, np.uint8, k, o) for k, o in ((a, at), (b, at + a)))
        return cls(n, bits, low, high, np.frombuffer(raw, np.uint32, c, at + a + b)), at + a + b + 4 * c


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, wide: bool) -> bytes:
    boundaries = EliasFano.build(ends, int(ends[-1]) + 1 if len(ends) else 1).to_bytes()
    null = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], np.int64)
    head = MAGIC + struct.pack("<BQQQ", 4 if wide else 2, len(doc_ids), len(ids), len(boundaries))
    return head + boundaries + keys.tobytes() + null.tobytes() + ids.astype("<u4" if wide else "<u2").tobytes()


def read_shard(raw: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    if raw[:8] != MAGIC:
        raise ValueError("not a token shard")
    view = memoryview(raw)
    width, n, n_ids, length = struct.unpack_from("<BQQQ", view, 8)
    at = 8 + struct.calcsize("<BQQQ")
    boundaries, _ = EliasFano.from_bytes(view[at : at + length])
    keys = np.frombuffer(view, np.int64, n, at + length).tolist()
    null = np.frombuffer(view, np.uint8, n, at + length + 8 * n)
    ids = np.frombuffer(view, "<u4" if width == 4 else "<u2", n_ids, at + length + 9 * n)
    return [None if z else k for k, z in zip(keys, null, strict=True)], boundaries, ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes ``path/shard-*.tok`` and the manifest ``path/manifest``; returns the manifest (shard, n_docs, n_ids)."""
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, ends, last = [], [], [], 0
        give_back(keep=encoder)
        enc = encoder(tokenizer)
        for batch in batches:
            ids, offsets = enc.encode(text_array(batch.column(1)), end_id)
            keys += batch.column(0).to_pylist()
            parts.append(ids if enc.wide else ids.astype(np.uint16))
            ends.append(offsets[1:] + last)
            last += len(ids)
        if not keys:
            return
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        raw = shard_bytes(keys, np.concatenate(parts), np.concatenate(ends), enc.wide)
        with store.open_output_stream(f"{root}/_{shard}-{attempt}.part") as out:
            out.write(raw)
        store.move(f"{root}/_{shard}-{attempt}.part", f"{root}/shard-{shard:08d}.tok")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(keys)], "n_ids": [last]}, pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    placed = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(n, key, F.xxhash64(text)).sortWithinPartitions(key, text)
    placed.mapInArrow(write, "shard int, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema("shard int, n_docs long, n_ids long").parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, wanted=None) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32; ``wanted(ids) -> value`` replaces the last."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = wanted or ids_crc32
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                keys, boundaries, ids = read_shard(raw)
                at = np.arange(boundaries.n)
                ends = boundaries.select(at)
                starts = np.where(at > 0, boundaries.select(np.maximum(at - 1, 0)), 0)
                ids = ids.astype(np.uint32)
                yield pd.DataFrame(
                    {
                        "shard": int(name.rpartition("shard-")[2][:8]), "doc_id": pd.array(keys, "Int64"), "local": starts, "n_tokens": ends - starts,
                        "ids_crc32": [digest(ids[a:b]) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    manifest = spark.read.schema("shard int, n_docs long, n_ids long").parquet(f"{path}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tok").load(path).select("path", "content")
    rows = files.mapInPandas(read, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, length and digest of every document, read back from the files that hold all of ``documents``."""
    path = scratch_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_tokenizer(), 2)
    return read_tokens(spark, path)
