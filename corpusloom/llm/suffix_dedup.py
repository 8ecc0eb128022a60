"""Exact substring deduplication with two-stage suffix sorting.

Every 100-byte string that also starts earlier is removed. Suffixes that can match are brought
together before they are sorted: each 100-byte window is named by its least 32-byte substring (its
anchor), so equal windows share an anchor, and only anchors that occur twice are followed. Equal
stretches around an anchor are folded to their first occurrence by aggregation; the different
stretches of one anchor go to one task, which builds their suffix array in two stages (only
suffixes smaller than their successors are sorted, the rest are induced by bucket scans), computes
adjacent common prefixes, and finds windows with an earlier equal. Anchors with more than
``HOT_REGIONS`` different stretches are settled by an aggregation over exact window hashes instead,
so no task gathers an unbounded group.

Null text is empty. Texts under 100 bytes lose nothing. Where ids are null or repeated, rows are put
in order of (doc_id with nulls last, text hash) and an equal row counts as a later document. Every
input row gives one output row; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import hash_spans, text_slices
from ._common import Scratch, column

LENGTH = 100
ANCHOR = 32
HOT_REGIONS = 20_000
#: Bytes of stretches sorted at once; whole anchors are added until it is passed.
SORT_BYTES = 1 << 20
#: Longest part of a text whose anchors are taken at once.
SEGMENT = 4 << 20


def anchor_ranges(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: (first start, last start, hash of the anchor)."""
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(data) - anchor + 1)
    grams = hash_spans(data, at, at + anchor, lower=False)
    low = np.uint64((1 << 24) - 1)
    value = (grams & ~low) | at.astype(np.uint64)  # ties fall to the leftmost
    span, width = length - anchor + 1, 1
    while width * 2 <= span:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    if width < span:
        value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
    where = (value & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return first, last, grams[where[first]]


def text_ranges(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for base in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        first, last, value = anchor_ranges(data[base : base + SEGMENT + LENGTH - 1])
        yield first + base, last + base, value


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(1)):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for r in range(high - low):
                doc = batch.column(0)[low + r].as_py()
                for first, last, value in text_ranges(data[offsets[r] : offsets[r + 1]]):
                    for c, x in zip(columns, (value.astype(np.int64), np.full(len(first), doc, np.int64), first.astype(np.int32), (last - first).astype(np.int32)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["anchor", "doc", "start", "more"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the stretches listed for each document out of its text."""
    names = ["anchor", "stretch", "doc", "start", "more", "body"]
    for batch in batches:
        lists = batch.column(2)
        for low, high, data, offsets in text_slices(batch.column(1)):
            part = lists.slice(low, high - low)
            spots, count = part.flatten(), np.asarray(part.value_lengths())
            start, more = np.asarray(spots.field("start")).astype(np.int64), np.asarray(spots.field("more")).astype(np.int64)
            at = np.repeat(offsets[:-1], count) + start
            size = more + LENGTH
            hashes = hash_spans(data, at, at + size, lower=False)
            ends = np.cumsum(size)
            for i, j in _runs(ends, SORT_BYTES):
                bound = np.concatenate(([0], ends[i:j] - (ends[i - 1] if i else 0)))
                body = data[np.repeat(at[i:j] - bound[:-1], size[i:j]) + np.arange(bound[-1])]
                bodies = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(body)])
                own = np.repeat(np.asarray(batch.column(0).slice(low, high - low)), count)[i:j]
                columns = [spots.field("anchor").slice(i, j - i), pa.array(hashes[i:j].astype(np.int64)), pa.array(own), pa.array(start[i:j].astype(np.int32)), pa.array(more[i:j].astype(np.int32)), bodies]
                yield pa.RecordBatch.from_arrays(columns, names)


def _runs(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes, given by their running sums, add up to about ``limit``."""
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def suffix_array(text: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (small non-negative integers) in order of their first ``depth`` symbols.

    Stage one sorts only the suffixes smaller than their successors. Stage two scans the buckets of
    first symbols in ascending order and puts the predecessor of each suffix met, where it is larger
    than its successor, next in its own bucket. The end of the text is smaller than any symbol.
    ``wanted`` (a mask) leaves out suffixes that are neither wanted nor needed to induce a wanted one.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # Type of a run of equal symbols is decided where it ends.
    change = np.flatnonzero(np.concatenate((text[:-1] != text[1:], [True])))
    end = np.repeat(change, np.diff(change, prepend=-1))
    after = np.where(end + 1 < n, text[np.minimum(end + 1, n - 1)].astype(np.int64), -1)
    small = text < after
    top = int(text.max()) + 1
    if wanted is None:
        used = np.ones(n, bool)
    else:  # a larger suffix is induced from its successor, up to the next smaller one
        place = np.arange(n)
        asked = np.maximum.accumulate(np.where(wanted, place, -1))
        stop = np.concatenate(([-1], np.maximum.accumulate(np.where(small, place, -1))[:-1]))
        used = (asked >= 0) & (stop < asked)
    kind = np.dtype(np.uint8 if top < 255 else ">u2")
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(depth, np.int64))).astype(kind)
    starts = np.flatnonzero(small & used)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[starts]).view(f"S{depth * padded.dtype.itemsize}").ravel()
    starts = starts[np.argsort(keys, kind="stable")]
    larger = used & ~small
    bounds = np.searchsorted(text[starts], np.arange(top + 1))
    pending: list[list[np.ndarray]] = [[] for _ in range(top)]
    if larger[n - 1]:
        pending[int(text[n - 1])].append(np.array([n - 1]))
    out = []
    for c in range(top):
        found = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        parts = []
        while len(found):  # the bucket feeds itself while a run of c goes on
            parts.append(found)
            back = found[found > 0] - 1
            found = back[(text[back] == c) & larger[back]]
        pending[c] = []
        bucket = np.concatenate((*parts, starts[bounds[c] : bounds[c + 1]]))
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        back = back[(text[back] > c) & larger[back]]
        if len(back):
            symbols = text[back]
            group = np.argsort(symbols, kind="stable")
            back, symbols = back[group], symbols[group]
            cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            for part in np.split(back, cuts):
                pending[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order``, up to ``depth``.

    Texts of small symbols are compared eight at a time.
    """
    n = len(text)
    room = np.minimum(n - np.maximum(order[1:], order[:-1]), depth)
    if text.dtype == np.uint8:
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(depth + 16, np.uint8))), 8)
        words = np.ascontiguousarray(words).view("<u8").ravel()
    else:
        words = np.concatenate((text.astype(np.uint64), np.zeros(depth, np.uint64)))
    step = 8 if text.dtype == np.uint8 else 1
    depth8 = -(-depth // step) * step
    out = np.full(len(order), depth8, np.int64)
    out[:1] = 0
    alive = np.arange(1, len(order))
    for j in range(0, depth8, step):
        x = words[order[alive] + j] ^ words[order[alive - 1] + j]
        differ = x != 0
        if step == 8:
            low = x[differ] & (~x[differ] + np.uint64(1))
            out[alive[differ]] = j + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        else:
            out[alive[differ]] = j
        alive = alive[~differ]
        if not len(alive):
            break
    out[1:] = np.minimum(out[1:], room)
    return out


def later_windows(bodies: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(doc, first byte, end byte) of the windows of the stretches that have an earlier equal window here."""
    sizes = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8) + np.uint8(1)  # 0xff is in no UTF-8 text and turns to 0
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    edge = np.zeros(len(text) + 1, np.int8)
    edge[begin] += 1
    edge[begin + sizes - LENGTH + 1] -= 1
    order = suffix_array(text, wanted=np.cumsum(edge[:-1]) > 0)
    same = common_prefixes(text, order) >= LENGTH
    owner = np.searchsorted(begin, order, "right") - 1
    valid = order - begin[owner] + LENGTH <= sizes[owner]
    group = np.cumsum(~same)
    order, owner, group = order[valid], owner[valid], group[valid]
    place = start[owner] + order - begin[owner]
    ranked = np.lexsort((place, doc[owner], group))
    group, where, owner, place = group[ranked], order[ranked], owner[ranked], place[ranked]
    head = np.concatenate(([True], group[1:] != group[:-1]))
    head_at = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    late = (doc[owner] != doc[owner[head_at]]) | (place != place[head_at])
    where = np.sort(where[late])
    if not len(where):
        return []
    own = np.searchsorted(begin, where, "right") - 1
    cut = np.concatenate(([True], (where[1:] != where[:-1] + 1) | (own[1:] != own[:-1])))
    first, last = where[cut], where[np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(where) - 1]))]
    own = own[cut]
    low = start[own] + first - begin[own]
    return list(zip(doc[own].tolist(), low.tolist(), (low + last - first + LENGTH).tolist(), strict=True))


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by anchor -> ranges; whole anchors are sorted together, about SORT_BYTES at once."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ranges = later_windows([h[3] for h in held], np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ranges, strict=True)] if ranges else [pa.array([], pa.int64())] * 3, ["doc", "low", "high"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if size > SORT_BYTES and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot anchors: (two hashes of the window, doc, start) for every window of a stretch."""
    for batch in batches:
        for doc, start, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            data = np.frombuffer(body, np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            one, two = hash_spans(data, at, at + LENGTH, lower=False), hash_spans(data, at, at + LENGTH // 2, lower=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64)), pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int64) + start)], ["one", "two", "doc", "start"]
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        texts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            edge = np.zeros(len(raw) + 1, np.int32)
            for s in spans or ():
                edge[s["low"]] += 1
                edge[s["high"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum()))
            rows.append((len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
            texts.append(left)
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, doc (a unique long in document order) and text."""
    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    if not source.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        return source.withColumn("doc", F.col("doc_id"))
    ranked = source.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return scratch.table(ranked.withColumn("doc", F.monotonically_increasing_id()), "keyed")


def duplicate_ranges(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, low, high): byte ranges covered by strings of LENGTH bytes that also start earlier."""
    anchors = scratch.table(keyed.select("doc", "text").mapInArrow(_anchors, "anchor long, doc long, start int, more int"), "anchors")
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    spots = anchors.join(twice, "anchor", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "more")).alias("spots"))
    spots = scratch.table(spots, "spots")
    scratch.drop("anchors")
    cut = keyed.select("doc", "text").join(spots, "doc").select("doc", "text", "spots")
    found = scratch.table(cut.mapInArrow(_stretches, "anchor long, stretch long, doc long, start int, more int, body binary"), "stretches")
    scratch.drop("spots")
    firsts = found.groupBy("anchor", "stretch", "more").agg(F.min(F.struct("doc", "start")).alias("first"))
    firsts = scratch.table(firsts, "firsts")
    at = ["anchor", "stretch", "more"]
    repeats = found.select(*at, "doc", "start").join(firsts, at).filter(F.struct("doc", "start") != F.col("first"))
    repeats = repeats.select("doc", F.col("start").cast("bigint").alias("low"), (F.col("start") + F.col("more") + F.lit(LENGTH)).cast("bigint").alias("high"))
    rivals = firsts.groupBy("anchor").agg(F.count("*").alias("rivals")).filter("rivals > 1")
    rivals = firsts.join(rivals, "anchor").select(*at, "first.doc", "first.start", "rivals")
    bodies = scratch.table(found.select(*at, "doc", "start", "body").join(rivals, [*at, "doc", "start"]).select("anchor", "doc", "start", "body", "rivals"), "bodies")
    cool = bodies.filter(F.col("rivals") <= HOT_REGIONS).select("anchor", "doc", "start", "body")
    cool = cool.repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    ranges = cool.mapInArrow(_sort_groups, "doc long, low long, high long")
    hot = bodies.filter(F.col("rivals") > HOT_REGIONS).select("doc", "start", "body").mapInArrow(_windows, "one long, two long, doc long, start long")
    heads = hot.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = hot.join(heads, ["one", "two"]).filter(F.struct("doc", "start") != F.col("first")).select("doc", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))
    return repeats.union(ranges).union(late)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    ``kept_bytes`` is what is left of the UTF-8 bytes; a cut may fall inside a character.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    keyed = _keyed(docs, scratch)
    spans = duplicate_ranges(keyed, scratch).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = scratch.table(spans, "spans")
    whole = keyed.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
