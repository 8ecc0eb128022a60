"""Benchmark decontamination: CGK walks and bit sampling find windows, exact edit distance decides.

Items and documents are read as lower-cased words of letters and digits. A document leaks an item
of m words when some run of its words lies within floor(max_edit * m) word edits of the item.
1. The CGK random walk reads a string into an embedding, staying on a word or moving on by a bit of
   the word's hash, so that edits become few differing symbols. A walk needs no end: the first
   ``STEPS`` symbols of a window's embedding are the same for windows of every length, so one walk
   from each word of a document serves all items. Each item is embedded from every one of its words.
2. Bit sampling: a table keeps ``SAMPLE`` of the symbols, of ``DISTINCT`` words at least. Where a
   document's word and an item's word s agree in a table, the item-sized window that starts s words
   earlier is a candidate.
3. ``calibrate`` raises the number of walks for each item length until simulated occurrences at the
   full edit distance are found at ``target_recall``. A length that does not reach it within
   ``MAX_WALKS`` (short items above all) has its windows found by exact blocks instead: of edits + 1
   blocks one is intact in every occurrence. So has every length at a target of 1.
4. Each candidate, widened by the allowed edits, is verified by exact edit distance.

Items go to the executors in blocks of a bounded size, one pass over the documents for each block.
Null texts have no words; items under ``min_words`` words, and those without any, match nothing.
Up to 4 words allow no edit at 20 % and are matched exactly. Repeated items and ids are all reported
once each; rows with a null ``doc_id`` are reported under null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_ALNUM, find_words, hash_spans, mix64, shingle_hashes, text_slices
from ._common import Scratch, column

MAX_EDIT = 0.2
MIN_WORDS = 1
#: Share of the occurrences at the full edit distance to be found; 1 asks for exact blocks.
TARGET_RECALL = 0.995
#: Walks after which calibration gives up.
MAX_WALKS = 8
#: Symbols of an embedding that are made, symbols in a table's sample (the first one always), tables of a walk.
STEPS, SAMPLE, TABLES = 8, 4, 4
#: Different words that a sample must hold; walks that stand still tell too little.
DISTINCT = 3
#: Simulated occurrences for one item length, and items they are made of.
TRIALS, ITEMS = 800, 40
#: Words of window text compared at once.
CHECK_WORDS = 1 << 18
#: Bytes of item text sent to the executors at once.
BLOCK_BYTES = 4 << 20
#: What stands past the end of a text; a sample that reaches it is no match.
_PAD = np.uint64(0)
_ODD = mix64(np.arange(1, MAX_WALKS * STEPS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(MAX_WALKS, STEPS) | np.uint64(1)
_WEIGHTS = mix64(np.arange(1, SAMPLE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def walk_symbols(words: np.ndarray, at: np.ndarray, stop: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """The first symbols of the CGK embedding of the texts that run from ``at`` to ``stop``, and the word
    each was read from, counted from ``at``: STEPS x n both."""
    out, read = np.empty((STEPS, len(at)), np.uint64), np.empty((STEPS, len(at)), np.int8)
    moved, last = np.zeros(len(at), np.int8), max(0, len(words) - 1)
    for j in range(STEPS):
        place = at + moved
        read[j] = moved
        out[j] = symbol = np.where(place < stop, words[np.minimum(place, last)], _PAD)
        moved += (symbol * _ODD[walk, j] >> np.uint64(63)).astype(np.int8)
    return out, read


def sample_tables(walk: int) -> np.ndarray:
    """TABLES x SAMPLE positions of the embedding, ascending, the first of each 0."""
    rng = np.random.default_rng([walk, 11])
    return np.array([[0, *sorted(rng.choice(np.arange(1, STEPS), SAMPLE - 1, replace=False))] for _ in range(TABLES)])


def table_keys(symbols: np.ndarray, read: np.ndarray, walk: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table of the walk: (key of each embedding, whether its sample lies within the text and holds enough words)."""
    out = []
    for sample in sample_tables(walk):
        steps = sum((read[b] != read[a]).astype(np.int8) for a, b in zip(sample[:-1], sample[1:], strict=True))
        out.append((sum(symbols[j] * w for j, w in zip(sample, _WEIGHTS, strict=True)), (symbols[sample[-1]] != _PAD) & (steps >= DISTINCT - 1)))
    return out


def lsh_equal(windows: np.ndarray, item: np.ndarray, walks: int) -> np.ndarray:
    """Whether each window agrees with the item in any table of any walk, from whatever words."""
    n, m = windows.shape
    flat, hit = windows.ravel(), np.zeros(n, bool)
    for walk in range(walks):
        left = np.flatnonzero(~hit)
        at = (left[:, None] * m + np.arange(m)).ravel()
        stop = np.repeat((left + 1) * m, m)
        k = len(item)
        own = table_keys(*walk_symbols(item, np.arange(k), np.full(k, k), walk), walk)
        for (key, good), (want, sure) in zip(table_keys(*walk_symbols(flat, at, stop, walk), walk), own, strict=True):
            hit[left] |= (np.isin(key, want[sure]) & good).reshape(-1, m).any(axis=1)
    return hit


def calibrate(m: int, edits: int, target: float = 1.0, trials: int = TRIALS) -> int:
    """Walks needed so that a text at exactly ``edits`` edits is a candidate with chance ``target``.

    The edits are spread as evenly as can be, one in each of so many parts of the item, which leaves
    the shortest runs intact; 0 where ``MAX_WALKS`` walks do not reach it, or none can (a target of 1).
    """
    if target >= 1:
        return 0
    rng = np.random.default_rng([m, edits, 7])
    left = []
    for _ in range(ITEMS):
        item = rng.integers(1, 1 << 62, m).astype(np.uint64)
        texts = np.zeros((trials // ITEMS, m + edits), np.uint64)
        for text in texts:
            row = list(item)
            for e in range(edits - 1, -1, -1):
                kind, at = rng.integers(0, 3), int(rng.integers(e * m // edits, (e + 1) * m // edits))
                row[at : at + (kind < 2)] = [] if kind == 1 else [np.uint64(rng.integers(1, 1 << 62))]
            text[: len(row)] = row
        left.append((item, texts))
    for walks in range(1, MAX_WALKS + 1):
        left = [(item, texts[~lsh_equal(texts, item, walks)]) for item, texts in left]
        if sum(len(texts) for _, texts in left) <= (1 - target) * trials:
            return walks
    return 0


def best_distances(texts: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Least number of word edits between ``item`` and any run of each row of ``texts``; padding changes nothing."""
    steps = np.arange(texts.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(texts), len(steps)), np.int32)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1)


def best_distance(text: np.ndarray, item: np.ndarray) -> int:
    """Least number of word edits between ``item`` and any run of ``text``."""
    return int(best_distances(text[None, :], item)[0])


class _Lookup:
    """Rows found by 64-bit key; a bitmap turns most other keys away."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        bits = max(16, int(len(keys)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[keys >> self.shift] = True

    def find(self, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``have``, row) of every match."""
        at = np.flatnonzero(self.seen[have >> self.shift])
        low, high = np.searchsorted(self.keys, have[at], "left"), np.searchsorted(self.keys, have[at], "right")
        count = high - low
        row = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), self.rows[row]


class _Items:
    """One block of items: table keys of those that walks can find, exact blocks of the others."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edit: float, walks: dict[int, int]):
        self.items, self.walks = items, walks
        self.edits = [int(max_edit * len(w) + 1e-9) for _, w in items]
        walked = [k for k, (_, w) in enumerate(items) if walks[len(w)]]
        vocabulary = np.unique(np.concatenate([items[k][1] for k in walked])) if walked else np.zeros(0, np.uint64)
        self.starts = _Lookup(vocabulary, vocabulary) if walked else None
        self.tables: list[list[_Lookup]] = []
        for walk in range(max(walks.values(), default=0)):
            keys, rows = [[] for _ in range(TABLES)], [[] for _ in range(TABLES)]
            for k in (k for k in walked if walks[len(items[k][1])] > walk):
                words = items[k][1]
                at = np.arange(len(words))
                for t, (key, sure) in enumerate(table_keys(*walk_symbols(words, at, np.full(len(at), len(at)), walk), walk)):
                    keys[t].append(key[sure])
                    rows[t].append(np.stack((np.full(sure.sum(), k), at[sure]), axis=1))
            self.tables.append([_Lookup(np.concatenate(x), np.concatenate(y)) for x, y in zip(keys, rows, strict=True)])
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, words) in enumerate(items):
            if walks[len(words)]:
                continue
            bounds = np.linspace(0, len(words), self.edits[k] + 2).astype(int)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                value = int(shingle_hashes(words[low:high], high - low)[0])
                seeds.setdefault(high - low, []).append((value, k, int(low)))
        self.seeds = {q: _Lookup(np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64)) for q, rows in seeds.items()}

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hit position, window start, item) of every candidate; ``first``: where each row begins."""
        if self.starts is not None:
            at = np.flatnonzero(self.starts.seen[words >> self.starts.shift])
            stop = first[np.searchsorted(first, at, "right")]
            for walk, lookups in enumerate(self.tables):
                for (key, sure), lookup in zip(table_keys(*walk_symbols(words, at, stop, walk), walk), lookups, strict=True):
                    own = np.flatnonzero(sure)
                    spot, found = lookup.find(key[own])
                    spot = at[own[spot]]
                    yield spot, spot - found[:, 1], found[:, 0]
        for q, lookup in self.seeds.items():
            have = shingle_hashes(words, q)
            if len(have):
                spot, found = lookup.find(have)
                yield spot, spot - found[:, 1], found[:, 0]


def _matches(words: np.ndarray, first: np.ndarray, row: np.ndarray, start: np.ndarray, items: _Items, k: int) -> Iterator[tuple[int, int]]:
    """(row, least distance) of the rows whose windows at ``start`` hold item ``k``."""
    target, edits = items.items[k][1], items.edits[k]
    m = len(target)
    at = start[:, None] + np.arange(m)
    windows = np.where(at < first[row + 1][:, None], words[np.minimum(at, len(words) - 1)], _PAD)
    exact = np.unique(row[(windows == target).all(axis=1)])
    best = dict.fromkeys(exact.tolist(), 0)
    rest = ~np.isin(row, exact)
    # Candidates that start within ``edits`` words of each other are verified as one.
    row, cell = np.unique(np.stack((row[rest], start[rest] // (edits + 1))), axis=1)
    step = max(1, CHECK_WORDS // (m + 3 * edits))
    for low in range(0, len(row), step):
        own = row[low : low + step]
        at = cell[low : low + step, None] * (edits + 1) + np.arange(-edits, m + 2 * edits)
        inside = (at >= first[own][:, None]) & (at < first[own + 1][:, None])
        texts = np.where(inside, words[np.clip(at, 0, len(words) - 1)], _PAD)
        # Within ``edits`` edits all but that many words of the item stand in the text.
        enough = np.isin(texts, target).sum(axis=1) >= m - edits
        for r, distance in zip(own[enough].tolist(), best_distances(texts[enough], target).tolist(), strict=True):
            if distance <= edits:
                best[r] = min(best.get(r, distance), distance)
    yield from best.items()


def _scan(batches: Iterator[pa.RecordBatch], items: _Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple] = []
        ids = batch.column(0).to_pylist()
        for low, high, data, offsets in text_slices(batch.column(1)):
            starts, ends, first = find_words(data, offsets, NOT_ALNUM)
            words = hash_spans(data, starts, ends)
            parts = list(items.hits(words, first)) if len(words) else []
            if not parts:
                continue
            spot, start, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = np.searchsorted(first, spot, "right") - 1
            start = np.maximum(start, first[row])
            for k in np.unique(item):
                found.extend((ids[low + r], items.items[k][0], len(items.items[k][1]), d) for r, d in _matches(words, first, *np.unique(np.stack((row[item == k], start[item == k])), axis=1), items, k))
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_words", "distance"])


def _item_blocks(benchmark: DataFrame, min_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Hashed items in blocks of bounded size, streamed to the driver one partition at a time."""
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    rows = benchmark.select(column(benchmark, "item_id", "bigint").alias("i"), F.lower(column(benchmark, "text", "string")).alias("t")).distinct()
    for row in rows.orderBy("i", "t").toLocalIterator():
        for _, _, data, offsets in text_slices(pa.array([row["t"]], pa.string())):
            starts, ends, _ = find_words(data, offsets, NOT_ALNUM)
            words = hash_spans(data, starts, ends)
            if len(words) < max(1, min_words):
                continue
            block.append((row["i"], words))
            held += len(data)
        if held > BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, *, max_edit: float = MAX_EDIT, target_recall: float = TARGET_RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per leaking (doc_id, item_id): n_words of the item, least distance, similarity.

    At the default target about 5 in 1,000 occurrences at the full edit distance are missed, nearer
    ones less often and verbatim ones never; a target of 1 is complete.
    """
    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.lower(column(docs, "text", "string")).alias("text"))
    schema = "doc_id long, item_id long, n_words long, distance long"
    walks: dict[int, int] = {}
    parts = []
    for block in _item_blocks(benchmark, min_words):
        for _, words in block:
            m = len(words)
            if m not in walks:
                enough = calibrate(m, int(max_edit * m + 1e-9), target_recall)
                walks[m] = min(MAX_WALKS, enough + 1) if enough else 0  # one to spare
        items = docs.sparkSession.sparkContext.broadcast(_Items(block, max_edit, walks))
        parts.append(source.mapInArrow(lambda it, items=items: _scan(it, items.value), schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema + ", similarity double")
    found = reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(F.min("n_words").alias("n_words"), F.min("distance").alias("distance"))
    return found.withColumn("similarity", F.round(1 - F.col("distance") / F.col("n_words"), 6))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, max_edit: float = MAX_EDIT, target_recall: float = TARGET_RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that leak no item, columns as given.

    A row is judged by its own text, whatever its id; the text's hash carries the verdict.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    text = column(docs, "text", "string")
    told = leaks(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), benchmark, max_edit=max_edit, target_recall=target_recall, min_words=min_words)
    bad = scratch.table(told.select(F.col("doc_id").alias("__bad")).distinct(), "bad")
    given = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("__text", F.xxhash64(text)).join(bad, F.col("__text") == F.col("__bad"), "left_anti").select(*given)
