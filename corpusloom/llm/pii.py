"""Personal data: fixed patterns as seeds, bootstrapped contextual patterns for what they miss.

All on the JVM. Base entities (e-mail, IPv4, payment card, international phone) are found by
regular expression, leftmost and non-overlapping per kind; long hexadecimal strings of letters and
digits are seeds of a fifth kind, secrets. Seeds start the bootstrap: a run of identifier-like tokens
(each holding a digit or an at sign) is a slot, and the two words before it, the word before it, and
the words on both sides are its lexical patterns. Patterns and instances form a bipartite graph that
is scored in rounds: a pattern's score for a kind is the share of its distinct instances known to be
of that kind, shrunk by ``PRIOR`` unknown ones; patterns scoring ``MIN_SCORE`` with at least
``MIN_SUPPORT`` known distinct instances are trusted, and what stands in their slot becomes a known
instance of that kind. Trusted patterns then mark the instances in their slots that no seed touches;
where several are trusted, the first of the order above decides.

Null text reads as empty. Offsets are code points, ends exclusive. Each input row gives one output
row, repeated or null ids included; extra columns are ignored, an empty table gives an empty result.
A very long text is one row of work; matches are placed in it in blocks, so their number is no issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans; those after KINDS are no base entities.
ALL_KINDS = (*KINDS, "secret")
#: Base patterns; loops are possessive where the next character cannot belong to the loop.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A secret: 32 hexadecimal digits or more, letters and decimal digits among them.
_SECRET = r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WS = r" \t\n\x0B\f\r"
_TOKEN = rf"(?=[^{_WS}0-9@]*+[0-9@])[^{_WS}]++"
_RUN = rf"(?<![^{_WS}]){_TOKEN}(?: {_TOKEN})*+"
_BEFORE = rf"(?<![^{_WS}])([^{_WS}]++)[{_WS}]*+$"
_BEFORE_2 = rf"(?<![^{_WS}])([^{_WS}]++)[{_WS}]++([^{_WS}]++)[{_WS}]*+$"
_AFTER = rf"^[{_WS}]*+([^{_WS}]++)(?![^{_WS}])"
#: Longest parts of the text on both sides of a slot that are read for words.
CONTEXT_CHARS = 90
#: Matches placed by one inner loop; the lists of a text grow by whole blocks.
BLOCK = 256
#: What is trimmed off a slot.
_LEADING, _TRAILING = "([{<\"'", ")]}>\"'.,;:!?#*$%&|"
ROUNDS = 3
MIN_SUPPORT = 5
MIN_SCORE = 0.6
PRIOR = 2


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, m, g, f>> of the matches: start, end, match, text before and after it.

    U+0001 marks the matches before a split; in the text it is read as U+0002, which no pattern
    tells from it, so offsets hold. The pieces are bound to a lambda variable, so they are cut once.
    """
    marked = f"split(regexp_replace({text}, {_sql('(' + pattern + ')')}, '\\u0001$1\\u0001'), '\\u0001', -1)"
    step = "(b, x) -> named_struct('p', b.p + length(x), 'a', concat(b.a, array(b.p)))"
    block = f"aggregate(slice(p, k * {BLOCK} + 1, {BLOCK}), named_struct('p', acc.p, 'a', cast(array() as array<int>)), {step})"
    grown = f"transform(array({block}), b -> named_struct('p', b.p, 'a', concat(acc.a, array(b.a))))[0]"
    starts = f"flatten(aggregate(sequence(0, (size(p) - 1) div {BLOCK}), named_struct('p', 0, 'a', cast(array() as array<array<int>>)), (acc, k) -> {grown}).a)"
    match = f"named_struct('s', at[j], 'e', at[j] + length(p[j]), 'm', p[j], 'g', right(p[j - 1], {CONTEXT_CHARS}), 'f', left(p[j + 1], {CONTEXT_CHARS}))"
    found = f"transform(array({starts}), at -> transform(sequence(1, size(p) - 2, 2), j -> {match}))[0]"
    none = "cast(array() as array<struct<s:int,e:int,m:string,g:string,f:string>>)"
    return f"transform(array({marked}), p -> if(size(p) < 3, {none}, {found}))[0]"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and secrets of each kind, and the slots of each row with their patterns."""
    text = F.translate(F.coalesce(column(docs, "text", "string"), F.lit("")), "\x01", "\x02")
    df = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), text.alias("text"))

    def found(pattern: str, guard: str, keep: str) -> Column:
        return F.expr(f"if({guard}, transform(filter({_spans('text', pattern)}, m -> {keep}), m -> named_struct('s', m.s, 'e', m.e)), cast(array() as array<struct<s:int,e:int>>))")

    octets = _sql(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    one, two, after = (f"lower({x})" for x in (f"regexp_extract(m.g, {_sql(_BEFORE)}, 1)", f"concat_ws(' ', regexp_extract(m.g, {_sql(_BEFORE_2)}, 1), regexp_extract(m.g, {_sql(_BEFORE_2)}, 2))", f"regexp_extract(m.f, {_sql(_AFTER)}, 1)"))
    lead = f"length(m.m) - length(ltrim({_sql(_LEADING)}, m.m))"
    kept = f"rtrim({_sql(_TRAILING)}, ltrim({_sql(_LEADING)}, m.m))"
    return df.select(
        "doc_id",
        found(_EMAIL, "contains(text, '@')", "true").alias("email"),
        found(_IP, "text rlike '[0-9][.][0-9]'", f"m.m rlike {octets}").alias("ip"),
        found(_CARD, "text rlike '[0-9][ -]?[0-9]'", f"length({_digits('m.m')}) between 13 and 19 and luhn_check({_digits('m.m')})").alias("card"),
        found(_PHONE, "contains(text, '+')", f"length({_digits('m.m')}) between 9 and 15").alias("phone"),
        found(_SECRET, "text rlike '[0-9A-Fa-f]{32}'", "true").alias("secret"),
        F.expr(
            f"if(text rlike '[0-9@]', filter(transform({_spans('text', _RUN)}, m -> named_struct("
            f"'s', m.s + {lead}, 'e', m.s + {lead} + length({kept}), 'm', lower({kept}), "
            f"'two', {two}, 'one', {one}, 'after', {after})), m -> m.e > m.s), "
            "cast(array() as array<struct<s:int,e:int,m:string,two:string,one:string,after:string>>))"
        ).alias("slots"),
    )


def _overlap(kind: str) -> str:
    return f"exists({kind}, b -> b.s < slot.e and slot.s < b.e)"


def trusted_patterns(slots: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, kind) of the patterns trusted after ROUNDS rounds on the pattern-instance graph.

    ``slots``: pattern, instance, kind (of the base entity there, or null). Only distinct edges are
    kept, so a pattern or instance on many rows weighs once for each partner.
    """
    edges = scratch.table(slots.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    known = scratch.table(edges.filter("kind is not null").groupBy("instance").agg(F.min("kind").alias("known")), "known-0")
    trusted = None
    for turn in range(ROUNDS):
        scored = edges.select("pattern", "instance").join(known, "instance", "left").groupBy("pattern", "known").agg(F.count("*").alias("n"))
        totals = scored.groupBy("pattern").agg(F.sum("n").alias("total"), F.max(F.when(F.col("known").isNotNull(), F.struct("n", F.negative("known").alias("low")))).alias("best"))
        trusted = totals.filter((F.col("best.n") >= MIN_SUPPORT) & (F.col("best.n") >= MIN_SCORE * (F.col("total") + PRIOR)))
        trusted = scratch.table(trusted.select("pattern", F.negative("best.low").alias("kind")), f"trusted-{turn}")
        if turn + 1 < ROUNDS:
            fresh = edges.select("pattern", "instance").join(trusted, "pattern").groupBy("instance").agg(F.min("kind").alias("known"))
            known = scratch.table(known.union(fresh).groupBy("instance").agg(F.min("known").alias("known")), f"known-{turn + 1}")
    return trusted


def _patterns(slot: str) -> Column:
    """The patterns of a slot, most telling first; a side without a word gives none."""
    return F.expr(
        f"filter(array(if(length(trim({slot}.two)) > 2, concat('two ', {slot}.two), null), if({slot}.one <> '' and {slot}.after <> '', concat('both ', {slot}.one, ' ', {slot}.after), null), "
        f"if({slot}.one <> '', concat('one ', {slot}.one), null)), x -> x is not null)"
    )


def find_personal_data(docs: DataFrame, *, bootstrap: bool = True) -> DataFrame:
    """One row per input row: doc_id, base counts, base_sha256, spans, n_found, n_secret, n_spans.

    ``n_found`` spans were added by patterns (none without ``bootstrap``), ``n_spans`` counts all.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.table(find_base(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    exploded = rows.select("row", *ALL_KINDS, F.explode("slots").alias("slot"))
    kind = F.expr("case " + " ".join(f"when {_overlap(k)} then {i}" for i, k in enumerate(ALL_KINDS)) + " end")
    slots = exploded.select("row", F.col("slot.s").alias("s"), F.col("slot.e").alias("e"), F.posexplode(_patterns("slot")).alias("place", "pattern"), F.col("slot.m").alias("instance"), kind.alias("kind"))
    if not bootstrap:
        slots = slots.limit(0)
    slots = scratch.table(slots, "slots")
    trusted = trusted_patterns(slots.select("pattern", "instance", "kind"), scratch)
    fresh = slots.filter("kind is null").select("row", "s", "e", "place", "pattern").join(trusted, "pattern")
    fresh = fresh.groupBy("row", "s", "e").agg(F.min(F.struct("place", "kind")).alias("best"))
    fresh = fresh.groupBy("row").agg(F.collect_list(F.struct(F.col("best.kind").alias("k"), "s", "e")).alias("fresh"))
    spans = ["transform(%s, b -> named_struct('k', %d, 's', b.s, 'e', b.e))" % (k, i) for i, k in enumerate(ALL_KINDS)]
    names = ", ".join(f"'{k}'" for k in ALL_KINDS)
    told = f"array_join(transform(%s, b -> concat(element_at(array({names}), b.k + 1), ':', b.s, ':', b.e)), ',')"
    out = rows.drop("slots").join(fresh, "row", "left").withColumn("fresh", F.expr("coalesce(fresh, cast(array() as array<struct<k:int,s:int,e:int>>))"))
    everything = f"array_sort(concat({', '.join(spans)}, fresh))"
    return out.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(told % f"concat({', '.join(spans[: len(KINDS)])})"), 256).alias("base_sha256"),
        F.expr(told % everything).alias("spans"),
        F.size("fresh").cast("bigint").alias("n_found"),
        F.size("secret").cast("bigint").alias("n_secret"),
        F.expr(f"cast({' + '.join(f'size({k})' for k in ALL_KINDS)} + size(fresh) as bigint)").alias("n_spans"),
    )
