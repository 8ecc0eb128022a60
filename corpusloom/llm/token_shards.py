"""Training-order materialisation of token ids into fixed-stride binary shards.

1. Documents are tokenised, each followed by an end token, and cut into sequences of ``seq_len``
   ids per input partition (the last one padded); the sequences are a durable table.
2. A keyed Feistel network over the smallest even-bit domain that holds all N sequences, walked
   along its cycle until it falls below N, is a permutation: sequence i gets global slot perm(i).
3. Slots are range-partitioned into shards of ``shard_sequences`` sequences; a shard holds exactly
   its slots in order, each in seq_len * 2 bytes (little-endian unsigned 16-bit), so the byte offset
   of a slot is known without an index and reading resumes anywhere.

Null or empty text is its end token alone. Repeated rows and null ids are written like any others;
extra columns are ignored; an empty table writes no shard. Ids must be under 65,536.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ._bytes import mix64
from ._common import Scratch, column
from ._files import open_read, open_write
from ._wordbpe import encode_many, word_bpe_path

SEQ_LEN = 2048
END_ID, PAD_ID = 49407, 0
SHARD_SEQUENCES = 2048
FEISTEL_ROUNDS = 6
KEY = 20240229


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Permutation of range(n) under ``key``, applied to ``index``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for r in range(FEISTEL_ROUNDS):
            left, right = right, left ^ (mix64(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))) & mask)
        out[walking] = x = (left << shift) | right
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, end_id: int) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    rest = np.zeros(0, np.uint32)
    docs: list[tuple] = []  # (doc_id, ids of it in rest, those before them in the document)

    def take(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest, docs, made
        rows: list[list] = [[], [], [], []]
        while len(rest) >= seq_len or final and len(rest):
            n = min(seq_len, len(rest))
            ids = np.full(seq_len, PAD_ID, np.uint32)
            ids[:n] = rest[:n]
            rest = rest[n:]
            inside, left = [], n
            while left:
                doc_id, held, start = docs[0]
                use = min(held, left)
                inside.append({"doc_id": doc_id, "start": start, "length": use})
                left -= use
                docs = docs[1:] if use == held else [(doc_id, held - use, start + use), *docs[1:]]
            for c, x in zip(rows, (part, made, inside, zlib.compress(ids.astype("<u2").tobytes(), 1)), strict=True):
                c.append(x)
            made += 1
        inner = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
        kinds = [pa.int32(), pa.int64(), inner, pa.binary()]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["part", "place", "docs", "body"])

    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            some = batch.slice(low, 512)
            new = [rest]
            for doc_id, ids in zip(some.column(0).to_pylist(), encode_many(some.column(1), path), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                if ids.max() > 0xFFFF:
                    raise ValueError("token ids over 65,535 do not fit a 16-bit shard")
                new.append(ids)
                docs.append((doc_id, len(ids), 0))
            rest = np.concatenate(new)
            yield from take(False)
    yield from take(True)


def _slots(batches: Iterator[pa.RecordBatch], before: dict[int, int], n: int, key: int, shard_sequences: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        index = np.array([before[p] for p in batch.column(0).to_pylist()], np.int64) + np.asarray(batch.column(1))
        slot = feistel(index, n, key)
        yield pa.RecordBatch.from_arrays([pa.array(slot // shard_sequences), pa.array(slot), batch.column(2), batch.column(3)], ["shard", "slot", "docs", "body"])


def _write(batches: Iterator[pa.RecordBatch], folder: str, seq_len: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot -> one file per shard and a row per sequence for its sidecar index."""
    out, current = None, None
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for shard, slot, docs, body in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if shard != current:
                if out is not None:
                    out.close()
                out, current = open_write(f"{folder}/shard-{shard:010d}.bin"), shard
                first = slot
            data = zlib.decompress(body)
            out.write(data)
            for c, x in zip(rows, (shard, slot, (slot - first) * seq_len * 2, docs, zlib.crc32(data)), strict=True):
                c.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), batch.schema.field(2).type, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["shard", "slot", "byte_offset", "docs", "crc32"])
    if out is not None:
        out.close()


def write_shards(docs: DataFrame, folder: str | None = None, *, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY) -> tuple[DataFrame, str]:
    """Write the shards below ``folder`` (a shared folder) and return their index and the folder.

    Index: shard, slot, byte_offset, docs (array of doc_id, start, length of the ids in the sequence),
    crc32 of the sequence's bytes. It is also written as Parquet in ``folder``/index.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    folder = folder or scratch.path("out")
    path = tokenizer_path or word_bpe_path()
    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    inner = "docs array<struct<doc_id:long,start:long,length:long>>"
    sequences = scratch.table(source.mapInArrow(lambda it: _cut(it, path, seq_len, end_id), f"part int, place long, {inner}, body binary"), "sequences")
    counts = sorted((r["part"], r["n"]) for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per input partition
    before, n = {}, 0
    for part, count in counts:
        before[part] = n
        n += count
    placed = sequences.mapInArrow(lambda it: _slots(it, before, n, key, shard_sequences), f"shard long, slot long, {inner}, body binary")
    files = max(1, -(-n // shard_sequences))
    # A partition is one range of slots and holds one shard.
    dealt = placed.repartitionById(files, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
    index = dealt.mapInArrow(lambda it: _write(it, folder, seq_len), f"shard long, slot long, byte_offset long, {inner}, crc32 long")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    scratch.drop("sequences")
    return spark.read.schema(index.schema).parquet(f"{folder}/index"), folder


def _read(batches: Iterator[pa.RecordBatch], folder: str, seq_len: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file, current, rows = None, None, []
        for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("byte_offset").to_pylist(), strict=True):
            if shard != current:
                if file is not None:
                    file.close()
                file, current = open_read(f"{folder}/shard-{shard:010d}.bin"), shard
            file.seek(offset)
            rows.append(np.frombuffer(file.read(seq_len * 2), "<u2").astype(np.int32))
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], [*batch.schema.names, "input_ids"])


def read_shards(index: DataFrame, folder: str, *, seq_len: int = SEQ_LEN) -> DataFrame:
    """``index`` plus ``input_ids``, read from the shards at the byte offsets."""
    schema = StructType([*index.schema.fields, StructField("input_ids", ArrayType(IntegerType()))])
    return index.mapInArrow(lambda it: _read(it, folder, seq_len), schema)


def sequence_digest(index: DataFrame, folder: str, *, seq_len: int = SEQ_LEN) -> DataFrame:
    """Read the shards back: slot, shard, byte_offset, docs, ids_crc32 of the bytes read, n_tokens, intact."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _read(batches, folder, seq_len):
            crc = [zlib.crc32(np.asarray(x, "<u2")) for x in batch.column("input_ids").to_numpy(zero_copy_only=False)]
            columns = [batch.column("slot"), batch.column("shard"), batch.column("byte_offset"), batch.column("docs"), pa.array(crc, pa.int64()), batch.column("crc32")]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "docs", "ids_crc32", "crc32"])

    inner = "docs array<struct<doc_id:long,start:long,length:long>>"
    out = index.mapInArrow(digest, f"slot long, shard long, byte_offset long, {inner}, ids_crc32 long, crc32 long")
    tokens: Column = F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["length"])
    return out.select("slot", "shard", "byte_offset", "docs", "ids_crc32", tokens.alias("n_tokens"), (F.col("ids_crc32") == F.col("crc32")).alias("intact"))
