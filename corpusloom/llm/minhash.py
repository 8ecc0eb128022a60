"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with equal shingle sets form one class, so exact copies never meet in a join. Class
signatures are banded; a bucket's members are compared with its centre, never all pairs. A pair is
compared in batches of signature slots and dropped as soon as the posterior probability that its
similarity reaches the threshold falls below ``MISS``; survivors are verified on the full shingle
sets. The first ``FIRST_BANDS`` bands join most of a group, the others look only at buckets that
still hold several components. What is then left is looked at beside what its whole group has in
common (``_consensus``): two classes link over shingles outside that, or both hold nearly all of each
other inside it (``_residual``), so they meet again in the small buckets of such shingles and sizes;
what is ruled out this way is ruled out exactly.

Nulls: a null or wordless text has an empty set and links with nothing. Rows that share a
``doc_id`` are all reported, each with the component of its own text. Null ids never name a
component unless all its ids are null, and then the component is null.
Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import find_words, hash_spans, mix64, shingle_set, text_slices
from ._common import Scratch, column

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
BATCH = 32
#: Bands whose buckets are compared first.
FIRST_BANDS = 8
#: Members whose sets tell what a group has in common.
VOTERS = 65
#: Members of a bucket that meet all others in the first turn; the next turn takes the square of it.
CHOSEN = 256
#: Relative width of the size classes in which members without rare shingles meet.
SIZE_STEP = 1.02
#: Stands for a null id in joins.
NO_ID = -(1 << 63)
#: Chosen posterior probability below which a pair is dropped.
MISS = 1e-7

_SEEDS = mix64(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_MULTIPLY = (_SEEDS[:SLOTS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_KEY_SALTS = (np.uint64(0), np.uint64(0xA24BAED4963EE407))
_ADD = (_SEEDS[SLOTS:] >> np.uint64(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a shingle set, as two signed halves."""
    n = np.uint64(len(shingles))
    return tuple(int((mix64(shingles ^ salt).sum(dtype=np.uint64) + n).astype(np.int64)) for salt in _KEY_SALTS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of the SLOTS linear permutations of the 32-bit shingle hashes."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(values), 2048):
        block = values[i : i + 2048, None] * _MULTIPLY
        block += _ADD
        np.minimum(best, block.min(axis=0), out=best)
    return best


def least_matches(threshold: float = THRESHOLD_PERCENT / 100, miss: float = MISS) -> dict[int, int]:
    """For each number of compared slots, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) is the probability that a binomial
    variable of n + 1 trials with chance t is at most m.
    """
    out = {}
    for n in range(BATCH, SLOTS + 1, BATCH):
        chance, total = (1 - threshold) ** (n + 1), 0.0
        for m in range(n + 1):
            total += chance
            chance *= threshold / (1 - threshold) * (n + 1 - m) / (m + 1)
            if total >= miss:
                out[n] = m
                break
    return out


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "h1", "h2", "sig"]
    for batch in batches:
        ids = batch.column(0)
        for low, high, sets in _shingles(batch.column(1), k):
            h1, h2 = zip(*map(set_key, sets), strict=True)
            columns = [ids.slice(low, high - low), *(pa.array(x, pa.int64()) for x in (map(len, sets), h1, h2)), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)


def _shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Shingle sets of runs of rows: (first row, end row, sets)."""
    for low, high, data, offsets in text_slices(texts):
        starts, ends, first = find_words(data, offsets)
        words = hash_spans(data, starts, ends)
        yield low, high, [shingle_set(words[first[r] : first[r + 1]], k) for r in range(high - low)]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        band = np.broadcast_to(np.arange(BANDS, dtype=np.int32), sig.shape[:2])
        key = (band.astype(np.uint64) + np.uint64(1)) << np.uint64(40)
        for j in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
        ids = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(band.ravel()), pa.array(key.ravel().astype(np.int64)), pa.array(ids, pa.int64())], ["band", "bucket", "cls"])


def _compare(batches: Iterator[pa.RecordBatch], least: dict[int, int], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with signatures and shingle sets -> linked pairs.

    Signatures are compared batch after batch of slots, dropping pairs whose posterior is too low; what
    is left is verified on the full sets.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            n = part.num_rows
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(n, SLOTS) for c in (2, 3))
            alive, matched = np.arange(n), np.zeros(n, np.int64)
            for done in range(0, SLOTS, BATCH):
                matched[alive] += (a[alive, done : done + BATCH] == b[alive, done : done + BATCH]).sum(axis=1)
                alive = alive[matched[alive] >= least[done + BATCH]]
            rest = part.take(pa.array(alive))
            linked = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(rest.column(4).to_pylist(), rest.column(5).to_pylist(), strict=True)]
            keep = rest.filter(pa.array(linked, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], ["a", "b"])


def _linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Exact test on two sets."""
    if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
        return False
    both = np.concatenate((u, v))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sets in _shingles(batch.column(0), k):
            h1, h2 = zip(*map(set_key, sets), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "shingles"])


#: Roles of a row in a bucket of ``_residual``, as bits.
PARTNER, SEEKER, TOKEN = 1, 2, 4


def _size_class(n: np.ndarray) -> np.ndarray:
    return (np.log(n) / np.log(SIZE_STEP)).astype(np.int64)


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, at most VOTERS shingle sets) -> the shingles that more than an eighth of them hold, but three of them
    at least and two of three or four. Any set is right; this one leaves few frequent shingles outside."""
    for batch in batches:
        out = []
        for voters in batch.column(1).to_pylist():
            held = [np.frombuffer(v, np.uint64) for v in voters]
            if len(held) > 2:
                token, n = np.unique(np.concatenate(held), return_counts=True)
                held = [token[(8 * n > len(held)) & (n >= (3 if len(held) > 4 else 2))]]
            out.append(held[0].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["grp", "common"])


def _residual(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Buckets in which the members of a group may still link with each other.

    Let c be the shingles the group has in common and x, A two members with a link. Then |x & A| is at
    least T = 0.8 / 1.8 (|x| + |A|), which is 0.8 |x| or more. If they share shingles outside c, those
    are at least need = 0.8 |x| - |x & c|, and of a fixed order of them one of the first
    |x - c| - need + 1 is in both (prefix filter); members of the group's main component are only
    partners and list all of theirs. If they share none, both hold T shingles of c: so |A| is at most
    1.8 / 0.8 |x & c| - |x|, and x seeks partners in buckets of the sizes from 0.8 |x| to there.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
            counts, rows = [0], [(0, 0, 0, 0)]
            for grp, cls, x, y, is_open in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True):
                c, own = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                outside = own[c[np.minimum(np.searchsorted(c, own), len(c) - 1)] != own] if len(c) else own
                n, shared = len(own), len(own) - len(outside)
                seed = np.uint64(grp * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                need = max(1, -(-percent * n // 100) - shared) if is_open else 1
                found = [(TOKEN, mix64(outside[: max(0, len(outside) - need + 1)] ^ seed))]
                least, most = -(-percent * n // 100), (100 + percent) * shared // percent - n
                if least <= most:
                    found.append((PARTNER, _size_bucket(seed, _size_class(np.array([n])))))
                    if is_open:
                        first, last = _size_class(np.array([least, most]))
                        found.append((SEEKER, _size_bucket(seed, np.arange(first, last + 1))))
                for role, key in found:
                    keys.append(key)
                    counts.append(len(key))
                    rows.append((cls, role, n, shared))
            bucket = np.concatenate(keys).astype(np.int64)
            columns = [pa.array(np.repeat(np.array(v, k), counts)) for v, k in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int64, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *columns], ["bucket", "cls", "role", "size", "shared"])


def _size_bucket(seed: np.uint64, size_class: np.ndarray) -> np.ndarray:
    return mix64(mix64(size_class.astype(np.uint64) + np.uint64(1)) ^ ~seed)


def _first_labels(both: DataFrame) -> DataFrame:
    return both.groupBy("cls").agg(F.min("other").alias("low")).select("cls", F.least("cls", "low").alias("label"))


def _relabel(both: DataFrame, labels: DataFrame) -> DataFrame:
    """One round: the least label among the neighbours, then the label of that label."""
    near = both.join(labels.toDF("other", "seen"), "other").groupBy("cls").agg(F.min("seen").alias("seen"))
    step = labels.join(near, "cls").select("cls", F.least("label", "seen").alias("next"))
    return step.join(labels.toDF("next", "far"), "next", "left").select("cls", F.least("next", "far").alias("label"))


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(cls, label): the smallest id reachable over ``edges`` (a, b); ids without an edge are absent.

    Labels only fall, so an unchanged sum ends the rounds; their number follows the logarithm of the
    diameter. Every second round's labels are a durable table.
    """
    both = scratch.table(edges.union(edges.select("b", "a")).toDF("cls", "other").distinct(), f"{name}-both")
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    labels = scratch.table(_relabel(both, _first_labels(both)), f"{name}-0")
    turn, before = 0, total(labels)
    while True:
        turn += 1
        labels = scratch.table(_relabel(both, _relabel(both, labels)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = total(labels)
        if now == before:
            scratch.drop(f"{name}-both")
            return labels
        before = now


def _pairs_with_centre(members: DataFrame) -> DataFrame:
    """Distinct (a, b): centre of a bucket and another member; ``members``: bucket, cls, rank.

    The member that shares most buckets with others stands nearest to the middle of its group.
    """
    centre = members.groupBy("bucket").agg(F.max(F.struct("rank", "cls")).alias("m")).select("bucket", F.col("m.cls").alias("a"))
    return members.join(centre, "bucket").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct()


def _several(members: DataFrame) -> DataFrame:
    """Buckets that hold more than one component."""
    return members.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("bucket")


class _Links:
    """Verified links so far and a label of each class over them.

    Equal labels mean one component. Until the end they come from two rounds only, so parts of one
    component may still differ; that costs comparisons, not links.
    """

    def __init__(self, scratch: Scratch, sets: DataFrame, percent: int):
        self.scratch, self.sets, self.percent = scratch, sets, percent
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def compare(self, pairs: DataFrame, name: str) -> None:
        """Link the pairs (a, b) that stand the sequential test and the exact one, and renew the labels."""
        least, percent = least_matches(self.percent / 100), self.percent
        held = self.sets.select("cls", "sig", "shingles")
        full = pairs.join(held.toDF("a", "sig_a", "set_a"), "a").join(held.toDF("b", "sig_b", "set_b"), "b").select("a", "b", "sig_a", "sig_b", "set_a", "set_b")
        found = self.scratch.table(full.mapInArrow(lambda it: _compare(it, least, percent), "a long, b long"), f"links-{name}")
        if self.edges is None or found.limit(1).count():
            self.edges = found if self.edges is None else self.edges.union(found)
            both = self.edges.union(self.edges.select("b", "a")).toDF("cls", "other").distinct()
            self.labels = self.scratch.table(_relabel(both, _relabel(both, _first_labels(both))), f"labels-{name}")

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _settle(links: _Links, members: DataFrame) -> None:
    """Compare what the centres left open: classes of several components in one bucket.

    Buckets whose leading component (the one with the member of highest rank) is the same make a group.
    """
    scratch, percent = links.scratch, links.percent
    live = links.named(members)
    open_rows = scratch.table(live.join(_several(live), "bucket", "left_semi"), "open")
    if not open_rows.limit(1).count():
        return
    leads = open_rows.groupBy("label").agg(F.max("rank").alias("lead"))
    grp = open_rows.join(leads, "label").groupBy("bucket").agg(F.max(F.struct("lead", "label")).alias("m")).select("bucket", F.col("m.label").alias("grp"))
    group = scratch.table(open_rows.join(grp, "bucket").select("grp", "cls", (F.col("label") != F.col("grp")).alias("open")).distinct(), "group")
    # A group's voters: the member of least hash in each of VOTERS cells.
    cell = F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(VOTERS))
    voters = group.groupBy("grp", cell.alias("cell")).agg(F.min_by("cls", F.xxhash64("cls")).alias("cls"))
    held = links.sets.select("cls", "shingles")
    common = voters.join(held, "cls").groupBy("grp").agg(F.collect_list("shingles").alias("sets"))  # at most VOTERS
    common = scratch.table(common.mapInArrow(_consensus, "grp long, common binary"), "common")
    around = group.join(common, "grp").join(held, "cls").select("grp", "cls", "common", "shingles", "open")
    spread = scratch.table(around.mapInArrow(lambda it: _residual(it, percent), "bucket long, cls long, role int, size long, shared long"), "spread")
    met = spread.groupBy("bucket", "cls").agg(F.bit_or("role").alias("role"), F.max("size").alias("size"), F.max("shared").alias("shared"))

    def alive(rows: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components and, where sizes meet, a seeker and a partner."""
        rows = links.named(rows.select("bucket", "cls", "role", "size", "shared"))
        groups = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.bit_or("role").alias("roles"))
        return rows.join(groups.filter((F.col("x") < F.col("y")) & (F.col("roles") >= (PARTNER | SEEKER))).select("bucket"), "bucket", "left_semi")

    live = scratch.table(alive(met), "live-1")
    turn = 1
    while live.limit(1).count():
        # Every pair of two components has a member outside the bucket's largest one: those meet all others.
        major = live.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("total"))
        major = major.select("bucket", F.col("m.label").alias("major"), (F.col("total") - F.col("m.n")).alias("minor"))
        minor = live.join(major, "bucket").filter("label <> major")
        chosen = minor.filter(F.pmod(F.xxhash64("cls", F.lit(turn)), F.col("minor")) < CHOSEN**turn)
        chosen = scratch.table(chosen.select("bucket", *(F.col(c).alias(f"{c}_a") for c in ("cls", "label", "role", "size", "shared"))), f"chosen-{turn}")
        # A token row meets any other, by size a seeker meets a partner; both must hold enough for a link.
        outside = f"if(role >= {TOKEN}, least(size - shared, size_a - shared_a), 0)"
        fits = f"(role >= {TOKEN} or (role & {SEEKER} > 0 and role_a & {PARTNER} > 0) or (role & {PARTNER} > 0 and role_a & {SEEKER} > 0)) and 100 * least(size, size_a) >= {percent} * greatest(size, size_a)"
        fits += f" and {100 + percent} * (least(shared, shared_a) + {outside}) >= {percent} * (size + size_a)"
        pairs = live.join(chosen, "bucket").filter(F.expr(f"label <> label_a and {fits}"))
        links.compare(pairs.select(F.least("cls_a", "cls").alias("a"), F.greatest("cls_a", "cls").alias("b")).distinct(), f"{turn}")
        # A chosen member has met its whole bucket and leaves it; a bucket of one component is done.
        rest = live.join(chosen.select("bucket", F.col("cls_a").alias("cls")), ["bucket", "cls"], "left_anti")
        turn += 1
        live = scratch.table(alive(rest), f"live-{turn}")


def _components_of(docs: DataFrame, scratch: Scratch, shingle_words: int, percent: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, h1, h2, component, class_size."""
    signed = docs.mapInArrow(lambda it: _sign(it, shingle_words), "doc_id long, n_shingles long, h1 long, h2 long, sig binary")
    signed = scratch.table(signed, "signed")
    # A class holds all documents of one shingle set.
    classes = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # Signatures stay only where they are still needed.
    heads = scratch.table(classes.select("h1", "h2", "cls", "low", "class_size"), "heads")
    rows = scratch.table(signed.select("doc_id", "n_shingles", "h1", "h2"), "rows")
    scratch.drop("signed")

    bands = classes.select("cls", "sig").mapInArrow(_bands, "band int, bucket long, cls long")
    crowded = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = scratch.table(bands.join(crowded, "bucket"), "met")
    members = scratch.table(met.join(met.groupBy("cls").agg(F.sum("n").alias("rank")), "cls").select("band", "bucket", "cls", "rank"), "members")
    scratch.drop("met")
    # The shingle sets of classes that meet others, taken from one text each and stored once.
    wanted = classes.join(members.select("cls").distinct(), "cls", "left_semi").withColumn("at", F.coalesce("low", F.lit(NO_ID)))
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("at"), "text").join(wanted.select("at").distinct().hint("merge"), "at", "left_semi")
    sets = texts.select("text").mapInArrow(lambda it: _sets(it, shingle_words), "h1 long, h2 long, shingles binary")
    sets = sets.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles")).join(wanted.select("h1", "h2", "cls", "size", "sig"), ["h1", "h2"])
    sets = scratch.table(sets.select("cls", "size", "sig", "shingles"), "sets")
    scratch.drop("classes")

    links = _Links(scratch, sets, percent)
    first = scratch.table(_pairs_with_centre(members.filter(F.col("band") < FIRST_BANDS)), "pairs")
    links.compare(first, "first")
    live = links.named(members)
    live = scratch.table(live.join(_several(live), "bucket", "left_semi"), "left-open")
    again = _pairs_with_centre(live).join(first, ["a", "b"], "left_anti")
    labels = links.labels
    again = again.join(labels.toDF("a", "label_a"), "a", "left").join(labels.toDF("b", "label_b"), "b", "left").filter("coalesce(label_a, a) <> coalesce(label_b, b)")
    links.compare(again.select("a", "b"), "others")
    _settle(links, live.select("bucket", "cls", "rank"))

    links.labels = components(scratch, links.edges, "components")
    named = links.named(heads)
    lowest = named.groupBy("label").agg(F.min("low").alias("component"))
    placed = named.join(lowest, "label").select("h1", "h2", "component", "class_size")
    return rows.join(placed, ["h1", "h2"], "left")


def near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, threshold_percent: int = THRESHOLD_PERCENT, id_col: str = "doc_id", text_col: str = "text", with_class: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_size (``with_class``: h1, h2 too).

    Two documents are linked when 100 * |intersection| >= threshold_percent * |union| of their
    distinct ``shingle_words``-word shingles. Banding misses a link at exactly the threshold with
    probability (1 - 0.8**5)**32, about 3e-6 (less above it), and the sequential test drops it with
    at most 1e-7 a look. Buckets have no size cap.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(column(docs, id_col, "bigint").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    out = _components_of(source, scratch, shingle_words, threshold_percent)
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), *(["h1", "h2"] if with_class else []))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The documents whose id represents their component; columns as given.

    Repeated rows of one id and text leave one row; different texts of one id are judged apart. A null
    id is an id like others, but represents a component only if all its ids are null.
    """
    verdict = near_duplicates(docs, shingle_words=shingle_words, threshold_percent=threshold_percent, with_class=True)
    scratch = Scratch(docs.sparkSession, "near-kept")
    verdict = scratch.table(verdict.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "kept"), "verdict")
    ids = verdict.groupBy("__id").agg(F.min("kept").alias("whole"), F.max("kept").alias("part"), F.count("*").alias("n"))
    # Ids with one kept row pass; of the others those with a kept row are looked at text by text.
    ids = scratch.table(ids.filter("n > 1 or not whole").select("__id", "part"), "ids")
    given = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__id", F.coalesce(column(docs, "doc_id", "bigint"), F.lit(NO_ID)))
    whole = keyed.join(ids.hint("merge"), "__id", "left_anti").select(*given)
    mixed = ids.filter("part")
    if not mixed.limit(1).count():
        return whole
    text = column(docs, "text", "string")
    mixed = keyed.join(mixed, "__id", "left_semi").withColumn("__key", _class_column(shingle_words)(text)).withColumns({"__h1": F.col("__key.h1"), "__h2": F.col("__key.h2"), "__t": text})
    mixed = mixed.join(verdict.filter("kept").select("__id", "__h1", "__h2").distinct(), ["__id", "__h1", "__h2"], "left_semi")
    return whole.unionByName(mixed.dropDuplicates(["__id", "__t"]).select(*given))


def _class_column(shingle_words: int) -> Callable[[Column], Column]:
    """The class key of a text, as ``_sign`` names it."""

    @F.pandas_udf("h1 long, h2 long")
    def classes(texts: pd.Series) -> pd.DataFrame:
        keys = [set_key(s) for _, _, sets in _shingles(pa.array(texts, pa.string(), from_pandas=True), shingle_words) for s in sets]
        return pd.DataFrame(keys, columns=["h1", "h2"], dtype="int64")

    return classes
