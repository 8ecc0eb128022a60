"""Packing by power-of-two decomposition: no sequence crosses a document and none is padded.

A document of n tokens becomes n // max_length pieces of max_length and one piece for each bit of
the remainder, longest first. Each piece is a sequence of its own; sequences of equal length form a
bucket, so a training batch is taken from one bucket and has one shape.

A null or empty text is the end-of-document token alone. Rows may share a ``doc_id``; each row is
packed on its own and its sequences have their own ids. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column
from ._wordbpe import encode_many, word_bpe_path

MAX_LENGTH = 2048
END_ID = 1


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Binary decomposition of ``n``: whole max_length pieces, then the remainder's bits from the highest."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, max_length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 40, 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["input_ids"] * with_ids
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            rows: list[tuple] = []
            ids_out: list[np.ndarray] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode_many(part.column(1), path), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start = 0
                for length in piece_lengths(len(ids), max_length):
                    piece = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(piece), len(ids), base + made, 0, length.bit_length() - 1))
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    made += 1
                    start += length
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            columns[-1] = columns[-1].cast(pa.int32())
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)


def pack_documents(docs: DataFrame, *, tokenizer_path: str | None = None, end_id: int = END_ID, max_length: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and input_ids).

    ``sequence_id`` joins the input partition and the piece's place in it, so a task that runs again
    gives the same ids; ``bucket`` is the power of the length. No shuffle is needed.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    path = tokenizer_path or word_bpe_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", input_ids array<int>" * with_ids
    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return source.mapInArrow(lambda it: _pack(it, path, end_id, max_length, with_ids), schema)


def write_buckets(packed: DataFrame, path: str, *, bucket_partitions: int = 64) -> None:
    """Sequences in one folder per length; each bucket is dealt over up to ``bucket_partitions`` files."""
    spread = packed.repartition(bucket_partitions, F.col("bucket"), F.pmod(F.xxhash64("sequence_id"), F.lit(bucket_partitions)))
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)
