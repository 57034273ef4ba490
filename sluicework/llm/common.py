"""Helpers shared by the training-data operators: scratch space, word splitting, hashing, grouping of texts into chunks."""

from __future__ import annotations

import ctypes
import functools
import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share.

    The folder comes from ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder; on a cluster that
    is an error, since a folder of the driver's own machine would not reach the executors.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(base)
    # With its scheme, so that every reader takes it to be in the same store as Spark does.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    whole = re.sub(r"^file:/(?=[^/])", "file:///", whole)
    return f"{whole.rstrip('/')}/sluicework-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def in_chunks(docs: DataFrame, chunk_bytes: int, floor: int = 1) -> tuple[DataFrame, int, int]:
    """``(doc_id, text, chunk)`` with texts dealt at random to chunks of about ``chunk_bytes``; number of chunks; bytes.

    The chunk hashes id, text and the row's place in ``docs``, so neither one id, one source nor a row that is repeated any
    number of times can fill a chunk on its own. ``docs`` should be a stored table: a task that runs again then finds
    every row at its place. A partition holds one chunk on average, whatever the size of the table.
    """
    total, n = docs.select(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    chunks = max(floor, math.ceil((total or 0) / chunk_bytes), math.ceil(n / 20_000), 1)
    key = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    return docs.select("doc_id", "text", key.alias("chunk")), chunks, int(total or 0)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def pieces(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes in all, so that a task's arrays stay small whatever a batch holds."""
    at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and the offsets of each text's words."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        flat = flat.filter(pa.array(real))
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    return flat, offsets


def dictionary(words: pa.Array) -> tuple[list, np.ndarray]:
    """Distinct words as str, and the index of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)


def hash64(words: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the public murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i+1]]`` for each i; empty segments give 0."""
    out = np.zeros(len(offsets) - 1, dtype=np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.float64)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


#: What worker processes remember from one task to the next.
_REMEMBERED: list = []


def remembered(function):
    """``functools.cache`` for a worker process, until a task begins that has no use for it."""
    cached = functools.cache(function)
    _REMEMBERED.append(cached)
    return cached


def give_back(keep=None) -> None:
    """Forget what earlier stages remembered, but for ``keep``, and return what is free to the system: a reused worker
    otherwise holds the peak of every stage before, beside what its next task takes."""
    for cached in _REMEMBERED:
        if cached is not keep:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def round_trip(chunks: DataFrame, n_chunks: int, n_buckets: int, emit, merge, finish, schema: str) -> DataFrame:
    """Each chunk asks something of all the others: chunk -> buckets -> the same chunk again.

    ``emit(chunk, table)`` yields (bucket, bytes), and nothing for a bucket that it has no question for, so messages never
    outnumber what is asked; ``merge(bucket, [(chunk, bytes)])`` yields (chunk, bytes);
    ``finish(chunk, table, {bucket: bytes})`` gives the resulting pa.Table. The texts are shuffled once: both readers of
    ``chunks`` share one exchange. ``emit`` and ``finish`` must order a chunk's rows alike.
    """
    blob = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])

    def out(key, table):
        give_back()
        chunk = key[0].as_py()
        found = list(emit(chunk, table))
        return pa.Table.from_arrays(
            [pa.array([b for b, _ in found], pa.int64()), pa.array([chunk] * len(found), pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=blob
        )

    def met(key, table):
        give_back()
        bucket = key[0].as_py()
        table = table.sort_by("chunk")
        found = list(merge(bucket, list(zip(table["chunk"].to_pylist(), table["data"].to_pylist(), strict=True))))
        return pa.Table.from_arrays(
            [pa.array([bucket] * len(found), pa.int64()), pa.array([c for c, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=blob
        )

    def back(key, table, answers):
        give_back()
        return finish(key[0].as_py(), table, dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True)))

    text = "bucket long, chunk int, data binary"
    chunks = chunks.repartition(n_chunks, "chunk")
    asked = chunks.groupBy("chunk").applyInArrow(out, text).repartition(n_buckets, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(met, text).withColumnRenamed("chunk", "of_chunk").repartition(n_chunks, "of_chunk")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(back, schema)


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows by id (null last), then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
