"""Vocabularies, token streams, packing and tokenizer statistics."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .ranking import ensure_checkpoint_dir, with_rank

PAD, UNK, BOS, EOS = 0, 1, 2, 3
MASK = -100


def vocabulary(docs: DataFrame, min_freq: int = 2) -> DataFrame:
    """token, n, idx: tokens seen at least ``min_freq`` times, numbered from 4 by falling count, then token."""
    counts = docs.select(F.explode(T.simple_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_freq)
    return with_rank(counts, F.desc("n"), F.col("token"), name="idx").withColumn("idx", (F.col("idx") + 3).cast("int"))


def _localized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, tokens) -> a row (chunk, doc_id, ids) per document and a row (chunk, words) per batch: ids stand
    in the chunk's own list of distinct words, so a word leaves the chunk once."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        tokens = batch.column(1)
        coded = tokens.flatten().dictionary_encode()
        n = len(batch)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)), coded.indices)
        chunk = pa.array(np.full(n + 1, (part << 32) + k, np.int64))
        docs = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
        words = pa.concat_arrays([pa.nulls(n, pa.list_(pa.string())), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string()))])
        yield pa.RecordBatch.from_arrays([chunk, docs, pa.concat_arrays([ids, pa.nulls(1, ids.type)]), words], ["chunk", "doc_id", "ids", "words"])


def _globalized(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Documents of one chunk with their ids taken from the chunk's list."""
    if not len(rows):
        return pd.DataFrame({"doc_id": [], "ids": []})
    table = np.full(1 + max(int(x.max()) if len(x) else 0 for x in rows["ids"]), UNK, np.int32)
    table[words["at"].to_numpy(np.int64)] = words["idx"].to_numpy(np.int32)
    return pd.DataFrame({"doc_id": rows["doc_id"], "ids": [table[x] for x in rows["ids"]]})


def encode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, ids: token indices in order, UNK where the vocabulary lacks one; empty text, empty ids.

    Documents are coded by a word list per Arrow batch; the lists meet the vocabulary, so its join moves a
    row per distinct word of a batch, and the documents move once, as integers.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    toks = docs.select("doc_id", T.simple_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    local = toks.mapInArrow(_localized, f"chunk long, doc_id {kind}, ids array<int>, words array<string>").checkpoint()
    lists = local.filter("words is not null").select(F.col("chunk").alias("list"), F.posexplode("words").alias("at", "token"))
    known = lists.join(vocab.select("token", "idx"), "token").select("list", "at", F.col("idx").cast("int").alias("idx"))
    rows = local.filter("words is null").select("chunk", "doc_id", "ids")
    return rows.groupBy("chunk").cogroup(known.groupBy("list")).applyInPandas(_globalized, f"doc_id {kind}, ids array<int>")


def stream_positions(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequences (id, ids) plus ``start``: ids before them in id order.

    Sizes are summed per range of ids, so only a row per range meets in one task.
    """
    df = sequences.withColumn("__n", F.size("ids").cast("bigint")).withColumn("__range", F.floor(F.col(id_col) / 4096))
    ranges = df.groupBy("__range").agg(F.sum("__n").alias("s"))
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("__range").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__in", inner).join(ranges, "__range").withColumn("start", F.col("__before") + F.col("__in")).drop("__n", "__range", "__in", "__before")


def pack_blocks(sequences: DataFrame, seq_len: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """block, input_ids, labels: the ids of all sequences in id order, cut every ``seq_len``; the remainder goes.

    A sequence is cut where blocks meet, so a row moves per piece, not per id.
    """
    df = stream_positions(sequences, id_col).filter(F.size("ids") > 0)
    last = F.floor((F.col("start") + F.size("ids") - 1) / seq_len)
    df = df.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / seq_len), last)))
    low = F.greatest(F.lit(0), F.col("block") * seq_len - F.col("start"))
    high = F.least(F.size("ids").cast("bigint"), (F.col("block") + 1) * seq_len - F.col("start"))
    df = df.select("block", F.struct((F.col("start") + low).alias("at"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("part")).alias("p"))
    out = df.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("input_ids"))
    return out.filter(F.size("input_ids") == seq_len).withColumn("labels", F.col("input_ids"))


def mask_prompt(rows: DataFrame, *, max_len: int = 1536) -> DataFrame:
    """prompt_ids, response_ids -> input_ids cut at ``max_len``, labels with the prompt masked, attention_mask.

    ``trainable`` tells whether any label is left.
    """
    ids = F.slice(F.concat("prompt_ids", "response_ids"), 1, max_len)
    df = rows.withColumn("input_ids", ids).withColumn("__k", F.least(F.size("prompt_ids"), F.size("input_ids")))
    df = df.withColumn("labels", F.concat(F.array_repeat(F.lit(MASK), F.col("__k")), F.slice("input_ids", F.col("__k") + 1, F.lit(max_len))))
    df = df.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    return df.withColumn("trainable", F.exists("labels", lambda x: x != MASK)).drop("__k")


def pad_batches(rows: DataFrame, *, batch: int, id_col: str = "doc_id", pad_id: int = PAD) -> DataFrame:
    """input_ids, labels and attention_mask padded to the longest of each ``batch`` consecutive ids."""
    df = rows.withColumn("batch", F.floor(F.col(id_col) / batch))
    longest = df.groupBy("batch").agg(F.max(F.size("input_ids")).alias("__m"))
    df = df.join(longest, "batch")
    for name, value in (("input_ids", pad_id), ("labels", MASK), ("attention_mask", 0)):
        df = df.withColumn(name, F.concat(name, F.array_repeat(F.lit(value), F.col("__m") - F.size(name))))
    return df.drop("__m")


def stream_with_separator(sequences: DataFrame, separator: int) -> DataFrame:
    """Each sequence led by a separator; the stream's end has one more after its last sequence."""
    last = sequences.agg(F.max("doc_id").alias("__last"))
    df = sequences.join(F.broadcast(last))  # one row
    ids = F.concat(F.array(F.lit(separator)), F.col("ids"))
    return df.withColumn("ids", F.when(F.col("doc_id") == F.col("__last"), F.concat(ids, F.array(F.lit(separator)))).otherwise(ids)).drop("__last")


def block_streams(messages: DataFrame, split: DataFrame, separator: int) -> DataFrame:
    """split, doc_id, ids, n_messages: the separated stream of each split's messages (doc_id, ids).

    ``split``: doc_id, split, as ``block_split`` gives. Messages keep their order; ``n_messages`` counts those of the split.
    """
    df = messages.join(split.select("doc_id", "split"), "doc_id")
    ends = df.groupBy("split").agg(F.max("doc_id").alias("__last"), F.count("*").alias("n_messages"))
    ids = F.concat(F.array(F.lit(separator)), F.col("ids"))
    df = df.join(F.broadcast(ends), "split")  # a row per split
    return df.select("split", "doc_id", F.when(F.col("doc_id") == F.col("__last"), F.concat(ids, F.array(F.lit(separator)))).otherwise(ids).alias("ids"), "n_messages")


def shifted_windows(stream: DataFrame, length: int) -> DataFrame:
    """window, x, y: consecutive windows of the stream (doc_id, ids), y one id later; n = (total - 1) // length."""
    df = stream_positions(stream).filter(F.size("ids") > 0)
    total = df.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("__total"))
    df = df.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - 1) / length)), F.floor((F.col("start") + F.size("ids") - 1) / length))))
    low = F.greatest(F.lit(0), F.col("window") * length - F.col("start"))
    high = F.least(F.size("ids").cast("bigint"), (F.col("window") + 1) * length + 1 - F.col("start"))
    df = df.filter(high > low).select("window", F.struct((F.col("start") + low).alias("at"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("part")).alias("p"))
    whole = df.groupBy("window").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("z")).join(F.broadcast(total))
    whole = whole.filter(F.col("window") < F.floor((F.col("__total") - 1) / length))
    return whole.select("window", F.slice("z", 1, length).alias("x"), F.slice("z", 2, length).alias("y"))


def random_windows(stream: DataFrame, length: int, n: int, *, seed: int = 1337) -> DataFrame:
    """draw, start, x, y: n windows at hash-chosen starts of the stream (doc_id, ids)."""
    spark = stream.sparkSession
    df = stream_positions(stream).filter(F.size("ids") > 0)
    total = df.agg(F.sum(F.size("ids")).alias("__total"))
    draws = spark.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total)).filter(F.col("__total") > length)
    draws = draws.select("draw", F.pmod(T.hash_int(F.lit(seed), F.col("draw")), F.col("__total") - length).alias("at"))
    step = 4096
    wanted = draws.withColumn("cell", F.explode(F.sequence(F.floor(F.col("at") / step), F.floor((F.col("at") + length) / step))))
    held = df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + F.size("ids") - 1) / step))))
    low = F.greatest(F.col("at"), F.col("start"), F.col("cell") * step)
    high = F.least(F.col("at") + length + 1, F.col("start") + F.size("ids"), (F.col("cell") + 1) * step)
    both = wanted.join(held, "cell").filter(high > low)
    both = both.select("draw", "at", F.struct(low.alias("p"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("part")).alias("s"))
    out = both.groupBy("draw", "at").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"])).alias("z"))
    return out.select("draw", F.col("at").alias("start"), F.slice("z", 1, length).alias("x"), F.slice("z", 2, length).alias("y"))


def replay_batch(chat: DataFrame, corpus: DataFrame, *, batch: int, length: int, step: int, share: float = 0.2, seed: int = 1337) -> DataFrame:
    """A training batch: round(batch * share) corpus windows, the rest from chat; ``stream`` names the origin."""
    n = int(np.round(batch * share))
    a = random_windows(corpus, length, n, seed=seed + 2 * step).withColumn("stream", F.lit("corpus"))
    b = random_windows(chat, length, batch - n, seed=seed + 2 * step + 1).withColumn("stream", F.lit("chat"))
    return a.unionByName(b)


def fertility(words: DataFrame, *, special: str, first: int = 20_000) -> DataFrame:
    """One row of tokenizer statistics from (pos, word, n_tokens, n_unk).

    ``diacritic_penalty`` is mean tokens per character of words with special letters over that of the
    rest, among the first words; 1 where either side is empty.
    """
    rate = F.try_divide(F.col("n_tokens").cast("double"), F.length("word"))
    has = F.col("word").rlike(T.class_of(special))
    early = F.col("pos") < first
    out = words.agg(
        F.sum("n_tokens").alias("tokens"),
        F.count("*").alias("words"),
        F.sum(F.length("word")).alias("chars"),
        F.sum("n_unk").alias("unk"),
        F.avg(F.when(early & has, rate)).alias("a"),
        F.avg(F.when(early & ~has, rate)).alias("b"),
    )
    return out.select(
        F.coalesce(F.try_divide("tokens", "words"), F.lit(0.0)).alias("tokens_per_word"),
        F.coalesce(F.try_divide("tokens", "chars"), F.lit(0.0)).alias("tokens_per_char"),
        F.coalesce(F.try_divide("unk", "tokens"), F.lit(0.0)).alias("unk_rate"),
        F.coalesce(F.try_divide("a", "b"), F.lit(1.0)).alias("diacritic_penalty"),
    )


def fertility_report(results: DataFrame, *, reference_only: tuple[str, ...] = (), baseline: float = 1.3) -> DataFrame:
    """results (name, tokens_per_word, ...) in order of fertility, with usability, cost against ``baseline`` and the best usable one."""
    df = results.withColumn("usable", ~F.col("name").isin(*reference_only) if reference_only else F.lit(True))
    best = df.filter("usable").agg(F.min_by("name", F.struct("tokens_per_word", "name")).alias("best"))
    return df.join(F.broadcast(best), how="left").withColumn("cost", F.col("tokens_per_word") / baseline).withColumn("is_best", F.col("name") == F.col("best")).drop("best").orderBy("tokens_per_word", "name")


def select_new_tokens(pieces: DataFrame, base: DataFrame, *, n: int = 8_000, min_len: int = 2) -> DataFrame:
    """First n pieces (id, piece) in merge order that the base vocabulary lacks and that hold min_len characters."""
    bare = F.regexp_replace("piece", "^[Ġ▁]+", "")
    return pieces.filter(F.length(bare) >= min_len).join(base.select("piece"), "piece", "left_anti").orderBy("id").limit(n)


def weighted_text(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Texts of each part repeated its number of times."""
    out = None
    for df, times in parts:
        part = df.select(F.explode(F.array_repeat("text", times)).alias("text"))
        out = part if out is None else out.union(part)
    return out


def train_bpe(docs: DataFrame, vocab_size: int, *, min_frequency: int = 2) -> tuple[list[str], list[tuple[str, str]]]:
    """Byte-level BPE: (vocabulary, merges). Pre-tokens are counted by Spark; the distinct ones meet in one
    task, which merges them with running pair counts. The driver gets one small row a merge.

    A step takes the most frequent pair (ties: smallest pair) until the size is reached or no pair
    occurs ``min_frequency`` times. Two merges that spell the same bytes share one entry.
    """
    types = docs.select(F.explode(T.bpe_pretokens(F.coalesce("text", F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    found = types.repartition(1).mapInArrow(lambda it: _merge_types(it, vocab_size, min_frequency), "rank long, a string, b string")
    merges = [(r["a"], r["b"]) for r in sorted(found.collect())]
    return list(dict.fromkeys([*_BYTES, *(a + b for a, b in merges)])), merges


_BYTES = [f"{i:02X}" for i in range(256)]


#: Symbols indexed at once.
INDEX_SYMBOLS = 1 << 22


def _merge_types(batches: Iterator[pa.RecordBatch], vocab_size: int, min_frequency: int) -> Iterator[pa.RecordBatch]:
    """(rank, a, b) of the merges over all pre-tokens (w, n).

    The words lie end to end in one array, each behind a mark; a symbol has its id at its first and its
    last byte. A pair's places are all known once its younger symbol is made and only fall from then on,
    so pairs below ``min_frequency`` are forgotten.
    """
    small = np.int16 if vocab_size < 1 << 15 else np.int32
    parts, freq = [np.full(1, -1, small)], [np.zeros(0, np.int64)]
    for batch in batches:
        data = np.frombuffer(b"".join(w.encode() + b"\xff" for w in batch.column(0).to_pylist()), np.uint8)  # no UTF-8 text holds FF
        parts.append(np.where(data == 255, small(-1), data.astype(small)))
        freq.append(batch.column(1).to_numpy(zero_copy_only=False))
    sym, freq = np.concatenate(parts), np.concatenate(freq)
    del parts
    place = np.int32 if len(sym) < 1 << 31 else np.int64
    alive = sym >= 0  # a symbol starts here
    marks = np.flatnonzero(~alive).astype(place)
    names, ids, size = list(_BYTES), {x: i for i, x in enumerate(_BYTES)}, np.ones(max(vocab_size, 256), np.int64)
    shift = 32
    counts: dict[int, int] = {}
    where: dict[int, list[np.ndarray]] = defaultdict(list)

    def weights(at: np.ndarray) -> np.ndarray:
        return freq[np.searchsorted(marks, at) - 1]

    def grouped(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(pair key, count, places) of each distinct pair."""
        order = np.argsort(keys := (x.astype(np.int64) << shift) | y, kind="stable")
        keys, at = keys[order], at[order].astype(place)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        sums = np.add.reduceat(weights(at), first) if len(first) else first
        yield from zip(keys[first].tolist(), sums.tolist(), np.split(at, first[1:]), strict=False)

    for low in range(0, len(sym) - 1, INDEX_SYMBOLS):
        a, b = sym[low : low + INDEX_SYMBOLS], sym[low + 1 : low + INDEX_SYMBOLS + 1]
        at = np.flatnonzero((a[: len(b)] >= 0) & (b >= 0))
        for key, n, places in grouped(a[at], b[at], at + low):
            counts[key] = counts.get(key, 0) + n
            where[key].append(places)
    heap = [(-n, names[key >> shift], names[key & 0xFFFFFFFF]) for key, n in counts.items()]
    heapify(heap)
    merges: list[tuple[str, str]] = []
    while len(names) < vocab_size and heap:
        negative, x, y = heappop(heap)
        a, b = ids[x], ids[y]
        key = a << shift | b
        now = counts.get(key, 0)
        if now != -negative:  # fallen since it was pushed
            if 0 < now < -negative:
                heappush(heap, (-now, x, y))
            continue
        if now < min_frequency:
            break
        merges.append((x, y))
        new = ids.setdefault(x + y, len(names))
        known = new < len(names)
        if not known:
            names.append(x + y)
            size[new] = size[a] + size[b]
        at = np.sort(np.concatenate(where.pop(key))).astype(np.int64)
        del counts[key]
        at = at[alive[at] & (sym[at] == a) & (sym[at + size[a]] == b)]
        if a == b:  # of a run of equal symbols, every second pair from the left
            head = np.r_[True, np.diff(at) != size[a]]
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        end = at + size[new]
        # Pairs that vanish beside the merged ones; what two neighbouring merges share counts once.
        left, right = sym[at - 1], sym[end]
        apart = np.r_[True, end[:-1] != at[1:]][: len(at)]
        gone = [(left[k := (left >= 0) & apart], np.full(k.sum(), a), at[k]), (np.full((k := right >= 0).sum(), b), right[k], at[k])]
        for old, n, _ in grouped(*(np.concatenate(c) for c in zip(*gone, strict=True))):
            if old in counts:
                counts[old] -= n
                if counts[old] < min_frequency:
                    del counts[old], where[old]
        sym[at + size[a] - 1] = -1
        sym[at + size[a]] = -1
        alive[at + size[a]] = False
        sym[at] = sym[end - 1] = new
        if known:  # spelled by an earlier merge too: all places of the symbol
            at = np.flatnonzero(alive & (sym == new))
            end = at + size[new]
        left, right = sym[at - 1], sym[end]
        k = (left >= 0) & np.r_[True, end[:-1] != at[1:]][: len(at)]
        made = [(left[k], np.full(k.sum(), new), at[k] - size[left[k]]), (np.full((k := right >= 0).sum(), new), right[k], at[k])]
        for fresh, n, places in grouped(*(np.concatenate(c) for c in zip(*made, strict=True))):
            if n >= min_frequency:
                counts[fresh], where[fresh] = n, [places.copy()]
                heappush(heap, (-n, names[fresh >> shift], names[fresh & 0xFFFFFFFF]))
    columns = [pa.array(range(len(merges)), pa.int64()), *(pa.array([m[i] for m in merges], pa.string()) for i in range(2))]
    yield pa.RecordBatch.from_arrays(columns, ["rank", "a", "b"])


def count_tokens(docs: DataFrame, tokenizer_path: str, *, name: str = "tokenizer") -> DataFrame:
    """pos, word, n_tokens, n_unk of the words of the documents under a tokenizer file.

    Distinct words are encoded once each; ``n_unk`` counts the tokenizer's unknown token, if it has one.
    """

    @F.pandas_udf("n_tokens int, n_unk int")
    def size(words: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        mark = getattr(tok.model, "unk_token", None)
        unknown = tok.token_to_id(mark) if mark else None
        for w in words:
            ids = [e.ids for e in tok.encode_batch(w.tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"n_tokens": [len(x) for x in ids], "n_unk": [x.count(unknown) if unknown is not None else 0 for x in ids]}, dtype="int32")

    df = docs.select(F.posexplode(T.words(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    sized = df.select("word").distinct().select("word", size("word").alias("s"))
    return df.join(sized, "word").select("pos", "word", "s.n_tokens", "s.n_unk", F.lit(name).alias("name"))
