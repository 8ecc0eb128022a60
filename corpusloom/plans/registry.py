"""Queries of the engine over the fixture tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profile import ADHOC_MARKERS, CLITICS, DEFAULT, EMPHATIC_FOLD, FIXTURE, LIGATURES, LOOK_ALIKES, PUNCTUATION_EXPAND, LanguageProfile
from ..operators import chat, dedup, evaluation, fonts, lexicon, parallel, quality, sft, splits, tokens
from ..operators.ranking import ensure_checkpoint_dir
from ..sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "quality_report_by_source"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; integers are widened so that types agree across engines."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("bigint") for c, k in df.dtypes if k in ("int", "smallint", "tinyint")})

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments ------------------------------------------------------------------------------

W = r"[\p{L}\p{Nl}\p{No}]"
#: Word list of a text expression.
WORDS = rf"regexp_extract_all({{}}, '{W}+(?:[-'']{W}+)*')"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_sql(t: str) -> str:
    return WORDS.replace("{}", t)


def strip_sql(t: str) -> str:
    return STRIP.format(t)


def count_sql(t: str, cls: str) -> str:
    """Characters of ``t`` in a class."""
    return f"cast(length(regexp_replace({t}, {q('[^' + cls[1:] if not cls.startswith('[^') else '[' + cls[2:])}, '', 'g')) as bigint)"


def hash_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast(('0x' || substr(md5({joined}), 1, 8)) as bigint)"


def order_sql(seed: int, key: str) -> str:
    return f"md5('{seed}|' || cast({key} as varchar))"


def metrics_sql(profile: LanguageProfile) -> str:
    """CTEs m (metrics) and verdict (reject_reason) over a CTE d(doc_id, source, text)."""
    special = T.class_of(profile.special)
    markers = "|".join(profile.markers)
    lang = {"kab": "kabyle", "en": "target"}[profile.code]
    return rf"""
w as (select *, {words_sql('text')} as words, {words_sql('lower(text)')} as low,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') as lines from d),
m as (select doc_id, source, text, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_letters,
  cast(length(text) as bigint) as n_length, {count_sql('text', '[\\p{L}]'.replace(chr(92) * 2, chr(92)))} as n_alpha, {count_sql('text', '[' + chr(92) + 'p{Nd}]')} as n_digit,
  cast(length(regexp_replace(text, '[\p{{L}}\p{{N}}\s\p{{Z}}]', '', 'g')) as bigint) as n_punct, {count_sql('text', special)} as n_special,
  case when len(low) = 0 then 0.0 else len(list_filter(low, lambda x: regexp_matches(x, {q(markers)})))::double / len(low) end as adhoc,
  len(lines) as n_lines, len(list_distinct(lines)) as n_distinct from w),
runs as (select doc_id, max(c) as longest from (select doc_id, count(*) as c from (select doc_id, ch, i - row_number() over (partition by doc_id, ch order by i) as g
  from (select doc_id, unnest(string_split(text, '')) as ch, unnest(range(length(text))) as i from d)) group by doc_id, ch, g) group by doc_id),
verdict as (select m.*, case when not regexp_matches(text, '[^\s\p{{Z}}]') then 'empty' when n_words < {profile.min_words} then 'too_short' when n_words > {profile.max_words} then 'too_long'
  when word_letters::double / n_words < {profile.min_mean_word} then 'words_too_short' when word_letters::double / n_words > {profile.max_mean_word} then 'words_too_long'
  when n_alpha::double / n_length < {profile.min_alpha} then 'low_alpha' when n_digit::double / n_length > {profile.max_digits} then 'digit_heavy'
  when n_punct::double / n_length > {profile.max_punctuation} then 'punct_heavy' when longest >= {profile.char_run} then 'char_run'
  when n_lines > 4 and 1 - n_distinct::double / n_lines > {profile.max_repeated_lines} then 'repeated_lines'
  when case when n_alpha = 0 then 0.0 else n_special::double / n_alpha end < {profile.min_special} then 'not_{lang}_charset'
  when adhoc > {profile.max_adhoc} then 'adhoc_orthography' end as reject_reason from m left join runs using (doc_id))"""


D = "d as (select doc_id, source, lang, coalesce(text, '') as text from documents)"
JUDGED = {p.name: f"with {D}, {metrics_sql(p)}" for p in (DEFAULT, FIXTURE)}


def _judged(spark: SparkSession, sf_dir: str, profile: LanguageProfile = FIXTURE) -> DataFrame:
    return quality.with_reason(table(spark, sf_dir, "documents"), profile)


# --- Text functions -----------------------------------------------------------------------------


@query(f"with {D}, w as (select doc_id, {words_sql('text')} as w from d) select doc_id, cast(len(w) as bigint) as n_words, cast(len(list_distinct(w)) as bigint) as n_types, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as letters from w")
def word_tokenize_stats(spark, sf_dir):
    w = T.words(F.coalesce("text", F.lit("")))
    df = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return df.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_types"), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).alias("letters"))


@query(JUDGED["fixture"] + " select doc_id, n_words, word_letters, n_length, n_alpha, n_digit, n_punct, n_special, adhoc from m")
def char_class_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.withColumns(quality.metrics(F.coalesce("text", F.lit("")), FIXTURE)).select("doc_id", "n_words", "word_letters", "n_length", "n_alpha", "n_digit", "n_punct", "n_special", "adhoc")


@query(JUDGED["fixture"] + " select doc_id, reject_reason, reject_reason is null as ok from verdict")
def quality_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "reject_reason", F.col("reject_reason").isNull().alias("ok"))


_REPORT = """ , r as (select source, reject_reason, count(*) as n, row_number() over (partition by source order by count(*) desc, reject_reason) as k from verdict where reject_reason is not null group by 1, 2)
select t.*, r.reject_reason as top_reason from (select source, count(*) as seen, count(*) filter (where reject_reason is null) as kept, cast(coalesce(sum(n_words) filter (where reject_reason is null), 0) as bigint) as kept_words from verdict group by source) t
left join r on r.source = t.source and r.k = 1"""


@query(JUDGED["fixture"] + _REPORT)
def quality_report_by_source(spark, sf_dir):
    return quality.report_by_source(_judged(spark, sf_dir))


@query(JUDGED["default"] + _REPORT)
def quality_report_default_profile(spark, sf_dir):
    return quality.report_by_source(_judged(spark, sf_dir, DEFAULT))


@query(JUDGED["fixture"] + " select reject_reason, count(*) as n from verdict where reject_reason is not null group by 1 order by n desc, 1 limit 5")
def reject_reason_topk(spark, sf_dir):
    return quality.top_reasons(_judged(spark, sf_dir))


@query(JUDGED["fixture"] + " select doc_id, coalesce(reject_reason, case when case when n_alpha = 0 then 0.0 else n_special::double / n_alpha end > 0.02 then null else 'lang_unk' end) as reject_reason from verdict")
def language_verdicts(spark, sf_dir):
    return quality.with_language_reason(_judged(spark, sf_dir), FIXTURE).select("doc_id", "reject_reason")


@query(JUDGED["fixture"] + " select cast(sum(n) as bigint) as seen, cast(coalesce(sum(n) filter (where reject_reason is null), 0) as bigint) as kept, string_agg(reject_reason || '=' || n, ',' order by reject_reason) as rejected from (select reject_reason, count(*) as n from verdict group by 1)")
def reject_reason_counts(spark, sf_dir):
    out = quality.reason_counts(_judged(spark, sf_dir))
    told = F.transform(F.map_entries("rejected"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("seen", "kept", F.array_join(told, ",").alias("rejected"))


@query(JUDGED["fixture"] + " select coalesce(source, 'TOTAL') as source, count(*) as documents, cast(sum(n_words) as bigint) as words from m group by rollup(source)")
def union_sources_rollup(spark, sf_dir):
    return quality.totals_rollup(_judged(spark, sf_dir))


def _normal_sql(t: str, nfc: bool = True) -> str:
    """Normalisation for texts without words broken over lines."""
    fold = T.fold_table()
    one = {k: v for k, v in fold.items() if v}
    gone = [k for k, v in fold.items() if not v]
    for k, v in LIGATURES.items():
        t = f"replace({t}, {q(k)}, {q(v)})" if t != "nfc" else t
    t = f"translate({t}, {q(''.join([*one, *gone]))}, {q(''.join(one.values()))})"
    for k, v in PUNCTUATION_EXPAND.items():
        t = f"replace({t}, {q(k)}, {q(v)})"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]', '', 'g')"
    clitics = "|".join(sorted(CLITICS, key=lambda x: (-len(x), x)))
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_])[\s\p{{Z}}]*-[\s\p{{Z}}]+({clitics})([^\p{{L}}\p{{N}}_]|$)', '\1-\2\3', 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(f"nfc_normalize({t})" if nfc else t)


_CLEAN = f"d as (select doc_id, source, lang, {_normal_sql('nfc_normalize(raw)')} as text from (select *, coalesce(text, '') as raw from documents))"


@query(f"with {_CLEAN}, {metrics_sql(DEFAULT)} select doc_id, md5(text) as digest, reject_reason from verdict")
def clean_documents(spark, sf_dir):
    """Normalisation and ladder in one pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return quality.clean_documents(docs).select("doc_id", F.md5("text").alias("digest"), "reject_reason")


@query(f"with {D} select doc_id, {_normal_sql('nfc_normalize(text)')} as text from d")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.coalesce("text", F.lit(""))).alias("text"))


_CANON = T.class_of(DEFAULT.canonical)


@query(f"with {D}, c as (select unnest(string_split(text, '')) as character from d) select character, count(*) as n from c where not regexp_matches(character, {q('^' + _CANON + '$')}) and character <> '' group by 1")
def residual_char_audit(spark, sf_dir):
    return quality.residual_audit(table(spark, sf_dir, "documents"))


@query(f"with {D} select doc_id, regexp_replace(text, {q('[^' + _CANON[1:])}, '', 'g') as text from d")
def strip_residual(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_residual(F.coalesce("text", F.lit(""))).alias("text"))


@query(f"with {D}, n as (select text as raw, {_normal_sql('nfc_normalize(text)')} as out from d) select cast(sum(length(raw)) as bigint) as chars_in, cast(sum(length(out)) as bigint) as chars_out, cast(sum({count_sql('raw', T.class_of(''.join(LOOK_ALIKES.values())))}) as bigint) as folded, cast(sum({count_sql('out', '[^' + _CANON[1:])}) as bigint) as residual, sum({count_sql('out', '[^' + _CANON[1:])}) = 0 as is_clean from n")
def normalization_report(spark, sf_dir):
    return quality.normalization_report(table(spark, sf_dir, "documents"))


@query(f"with {D} select lang, round(avg(case when a = 0 then 0.0 else s::double / a end), 9) as rate from (select lang, {count_sql('text', '[' + chr(92) + 'p{L}]')} as a, {count_sql('text', T.class_of(FIXTURE.special))} as s from d) group by lang")
def diacritic_rate_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(T.special_rate(F.coalesce("text", F.lit("")), FIXTURE)), 9).alias("rate"))


@query(f"with {D}, w as (select lang, {words_sql('lower(text)')} as w from d) select lang, round(avg(case when len(w) = 0 then 0.0 else len(list_filter(w, lambda x: regexp_matches(x, {q('|'.join(ADHOC_MARKERS))})))::double / len(w) end), 9) as score from w group by lang")
def adhoc_score_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(T.adhoc_score(F.coalesce("text", F.lit("")))), 9).alias("score"))


_KEY = r"trim(regexp_replace(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"with {D} select doc_id, {_KEY.format('text')} as key from d")
def canonical_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical_key(F.coalesce("text", F.lit(""))).alias("key"))


@query(f"with {D} select doc_id, translate(text, {q(''.join(EMPHATIC_FOLD))}, {q(''.join(EMPHATIC_FOLD.values()))}) as text from d")
def fold_emphatics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_emphatics(F.coalesce("text", F.lit(""))).alias("text"))


_SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\p{{Z}}]+', '\1' || chr(30), 'g'), chr(30)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query(f"with {D} select doc_id, cast(len({_SENT}) as bigint) as n_sentences, md5(array_to_string({_SENT}, chr(30))) as digest from d")
def sentence_split(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return df.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\x1e")).alias("digest"))


def _chat_sql(t: str) -> str:
    from ..functions.profile import CHAT_SPELLING

    t = f"regexp_replace({t}, '</?[a-zA-Z][^<>]{{0,40}}>|[\\x{{E000}}-\\x{{F8FF}}]', '', 'g')"
    for k in "cC":
        t = f"replace({t}, {q(k)}, {q(CHAT_SPELLING[k])})"
    for k, v in CHAT_SPELLING.items():
        if k not in "cC":
            t = f"replace({t}, {q(k)}, {q(v)})"
    for _ in range(2):  # hyphens that share a letter need a second pass
        t = rf"regexp_replace({t}, '([\p{{L}}\p{{Nl}}\p{{No}}])-([\p{{L}}\p{{Nl}}\p{{No}}])', '\1\2', 'g')"
    return strip_sql(rf"regexp_replace({t}, '[\s\p{{Z}}]+', ' ', 'g')")


@query(f"with {D} select doc_id, {_chat_sql('text')} as text from d")
def to_chat_spelling(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.to_chat_spelling(F.coalesce("text", F.lit(""))).alias("text"))


@query(f"select page_id, {_chat_sql('html')} as text from pages")
def strip_page_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.to_chat_spelling("html").alias("text"))


@query()
def chat_clean(spark, sf_dir):
    """Needs back references, which the oracle's regular expressions lack."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return chat.clean_messages(lines)


@query()
def chat_cleaning_stats(spark, sf_dir):
    return chat.cleaning_stats(chat.clean_messages(table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))))


@query(rf"with {D} select doc_id, cast(len(regexp_extract_all(text, ' ?[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*| ?[^\s\p{{L}}\p{{N}}]+|\s+')) as bigint) as n_pretokens from d")
def bpe_pretokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.bpe_pretokens(F.coalesce("text", F.lit("")))).alias("n_pretokens"))


@query(f"with {D}, h as (select doc_id, string_split(text, chr(10)) as l from d), s as (select doc_id, l, list_transform(l, lambda x: {strip_sql('x')}) as st from h), c as (select doc_id, key, count(*) as n from (select doc_id, unnest(st) as key from s) group by 1, 2), heads as (select doc_id, list(key) as k from c where n >= 5 and length(key) between 1 and 59 group by 1) select s.doc_id, array_to_string(list_filter(l, lambda x: not regexp_matches(x, '^\\s*\\p{{Nd}}{{1,4}}\\s*$') and not list_contains(coalesce(heads.k, []), {strip_sql('x')})), chr(10)) as text from s left join heads on heads.doc_id = s.doc_id")
def running_header_strip(spark, sf_dir):
    return quality.strip_running_heads(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


_PARTS = rf"a as (select doc_id as key, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\p{{Z}}]*\n'), lambda x: {strip_sql('x')}), lambda x: x <> '') as paras, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') as lines from d), c as (select key, case when len(paras) < greatest(2, len(lines) // 20) then lines else paras end as p from a), e as (select key, unnest(p) as p, unnest(range(len(p))) as part from c), cw as (select *, regexp_split_to_array(p, '[\s\p{{Z}}]+') as w from e), ck as (select *, unnest(range(case when len(w) > 400 then (len(w) + 399) // 400 else 1 end)) as chunk from cw)"


@query(f"with {D}, {_PARTS} select key, part, chunk, case when len(w) > 400 then array_to_string(w[chunk * 400 + 1:chunk * 400 + 400], ' ') else p end as text from ck")
def chunk_local_text(spark, sf_dir):
    return readers.chunk_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))


@query(f"select {count_sql('t', T.class_of(FIXTURE.special))}::double / {count_sql('t', '[' + chr(92) + 'p{L}]')} as share from (select string_agg(text, '') as t from (select coalesce(text, '') as text from documents order by doc_id limit 300))")
def language_share_of_column(spark, sf_dir):
    return readers.special_share(table(spark, sf_dir, "documents").orderBy("doc_id"), "text", FIXTURE)


# --- Lexicon ------------------------------------------------------------------------------------

_TOK = f"tok as (select doc_id, source, lang, unnest({words_sql('lower(text)')}) as word from d)"
_LEX = "lex as (select word, count(*) as n from tok group by word having count(*) >= 2)"
_BENCH = f"lex as (select distinct unnest({words_sql('lower(text)')}) as word from benchmark)"


def _benchmark_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.tokens(table(spark, sf_dir, "benchmark")).distinct()


@query(f"with {D}, {_TOK}, {_LEX} select word, n from lex")
def corpus_lexicon(spark, sf_dir):
    return lexicon.from_corpus(table(spark, sf_dir, "documents"))


_OOV = "select {k}, cast(coalesce(sum(case when word is null then 0 else 1 end), 0) as bigint) as n_tokens, cast(coalesce(sum(case when word is not null and l is null then 1 else 0 end), 0) as bigint) as n_oov, round(case when count(word) = 0 then 1.0 else sum(case when word is not null and l is null then 1 else 0 end)::double / count(word) end, 9) as oov from (select d.{k}, tok.word, lex.word as l from d left join tok on d.doc_id = tok.doc_id left join lex on lex.word = tok.word) group by {k}"


@query(f"with {D}, {_TOK}, {_BENCH} " + _OOV.format(k="doc_id"))
def oov_rate_by_doc(spark, sf_dir):
    return lexicon.oov_rates(table(spark, sf_dir, "documents"), _benchmark_lexicon(spark, sf_dir), "doc_id").withColumn("oov", F.round("oov", 9))


@query(f"with {D}, {_TOK}, {_BENCH} " + _OOV.format(k="source"))
def oov_rate_by_source(spark, sf_dir):
    return lexicon.oov_rates(table(spark, sf_dir, "documents"), _benchmark_lexicon(spark, sf_dir), "source").withColumn("oov", F.round("oov", 9))


@query(JUDGED["fixture"] + f", {_TOK}, {_LEX}, rate as (" + _OOV.format(k="doc_id") + f") select verdict.doc_id, coalesce(reject_reason, case when rate.oov > {FIXTURE.max_oov} then 'high_oov' end) as reject_reason from verdict join rate on rate.doc_id = verdict.doc_id")
def quality_verdicts_with_lexicon(spark, sf_dir):
    """The ladder with its last rung, the share of words outside the corpus lexicon."""
    d = table(spark, sf_dir, "documents")
    rates = lexicon.oov_rates(d, lexicon.from_corpus(d), "doc_id").select("doc_id", "oov")
    return quality.with_lexicon_reason(_judged(spark, sf_dir), rates, FIXTURE)


@query(f"with {D}, {_TOK}, {_BENCH} select word, count(*) as n from tok where word not in (select word from lex) group by word")
def missing_words(spark, sf_dir):
    return lexicon.missing_words(table(spark, sf_dir, "documents"), _benchmark_lexicon(spark, sf_dir))


@query(f"with {D}, {_TOK}, {_LEX}, c as (select word, count(*) as n from (select unnest({words_sql('lower(text)')}) as word from conversations) group by word) select count(*) as types, count(lex.word) as known_types, cast(sum(c.n) as bigint) as tokens, cast(coalesce(sum(case when lex.word is not null then c.n end), 0) as bigint) as known_tokens, round(count(lex.word)::double / count(*), 9) as type_coverage, round(coalesce(sum(case when lex.word is not null then c.n end), 0)::double / sum(c.n), 9) as token_coverage from c left join lex on lex.word = c.word")
def vocab_coverage_conversations(spark, sf_dir):
    out = lexicon.coverage(table(spark, sf_dir, "conversations"), lexicon.from_corpus(table(spark, sf_dir, "documents")))
    return out.withColumns({c: F.round(c, 9) for c in ("type_coverage", "token_coverage")})


@query(f"with {D}, {_TOK}, {_LEX} select distinct word from (select word from lex union select unnest({words_sql('lower(text)')}) as word from benchmark)")
def lexicon_union(spark, sf_dir):
    return lexicon.union(_benchmark_lexicon(spark, sf_dir), lexicon.from_corpus(table(spark, sf_dir, "documents")))


# --- Pairs and conversations --------------------------------------------------------------------

_TURNS = "t as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as tgt, lead(role) over (partition by conv_id order by turn) as nr from conversations), p as (select conv_id, turn, coalesce(text, '') as s, coalesce(tgt, '') as t from t where role = 'user' and nr = 'assistant')"
_PAIR = f"pw as (select *, {words_sql('s')} as sw, {words_sql('t')} as tw from p), pr as (select conv_id, turn, s, t, case when not regexp_matches(s, '[^\\s\\p{{Z}}]') or not regexp_matches(t, '[^\\s\\p{{Z}}]') then 'empty_side' when len(tw) < 3 or len(tw) > 200 then 'target_length' when greatest(len(sw), len(tw))::double / greatest(least(len(sw), len(tw)), 1) > 2.5 then 'length_mismatch' when len(list_intersect(list_distinct(list_transform(sw, lambda x: lower(x))), list_distinct(list_transform(tw, lambda x: lower(x)))))::double / greatest(len(list_distinct(tw)), 1) > 0.6 then 'untranslated' end as reason from pw)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parallel.adjacent_turns(table(spark, sf_dir, "conversations"))
    return df.withColumn("reason", parallel.pair_reason(F.col("src"), F.col("tgt"), FIXTURE, min_special=0.0))


@query(f"with {_TURNS}, {_PAIR} select conv_id, turn, reason from pr")
def pair_quality_adjacent_turns(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", "reason")


_RUNG_5 = f"coalesce(reason, case when coalesce({count_sql('t', T.class_of(FIXTURE.special))}::double / nullif({count_sql('t', '[' + chr(92) + 'p{L}]')}, 0), 0.0) < 0.01 then 'target_not_kabyle' end)"


@query(f"with {_TURNS}, {_PAIR} select conv_id, turn, {_RUNG_5} as reason from pr")
def pair_quality_all_rungs(spark, sf_dir):
    df = parallel.adjacent_turns(table(spark, sf_dir, "conversations"))
    return df.select("conv_id", "turn", parallel.pair_reason(F.col("src"), F.col("tgt"), FIXTURE).alias("reason"))


@query("select coalesce(reason, 'ok') as reason, count(*) as n from pr group by 1".join([f"with {_TURNS}, {_PAIR} ", ""]))
def pair_reason_counts(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select role, count(*) as turns, count(*) filter (where b) as blank, count(*) filter (where not b and o) as off_language, count(*) filter (where not b and not o) as kept from (select role, not regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}]') as b, coalesce({count_sql('text', T.class_of(FIXTURE.special))}::double / nullif({count_sql('text', '[' + chr(92) + 'p{L}]')}, 0), 0.0) < 0.01 as o from conversations) group by role")
def conversation_turn_filter(spark, sf_dir):
    return parallel.turn_filter(table(spark, sf_dir, "conversations"), FIXTURE)


@query("with a as (select * from embeddings), p as (select x.vec_id, list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])) as c from a x join a y on y.vec_id = x.vec_id + 1) select vec_id, round(c, 6) as cosine, coalesce(c >= 0.75, false) as keep from p")
def embedding_roundtrip_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    df = e.select("vec_id", F.col("embedding").alias("emb_a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("emb_b")), "vec_id")
    return parallel.round_trip_filter(df).select("vec_id", F.round("cosine", 6).alias("cosine"), "keep")


# --- Deduplication ------------------------------------------------------------------------------

_KEYED = f"k as (select doc_id, {_KEY.format('text')} as key from d), f as (select key, min(doc_id) as first_id from k group by key)"


@query(f"with {D}, {_KEYED} select doc_id, first_id, doc_id = first_id as is_first from k join f using (key)")
def exact_dedup(spark, sf_dir):
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query(f"with {D}, l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from d), c as (select doc_id, pos, {_chat_sql('raw')} as line from l) select line, count(*) as n, min(doc_id) as first_doc, cast(arg_min(pos, doc_id * 1000000 + pos) as bigint) as first_pos from c where line <> '' group by line")
def line_dedup_exact(spark, sf_dir):
    return dedup.line_duplicates(table(spark, sf_dir, "documents"))


_SHINGLES = f"sw as (select doc_id, list_filter(string_split({_KEY.format('text')}, ' '), lambda x: x <> '') as w from d), sg as (select doc_id, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from sw), sh as (select doc_id, list_distinct(list_transform(g, lambda x: cast(('0x' || substr(md5(x), 1, 8)) as bigint) & 2147483647)) as s from sg)"


@query(f"with {D}, {_SHINGLES} select doc_id, cast(len(s) as bigint) as n_shingles, cast(coalesce(list_sum(s), 0) as bigint) as total from sh")
def shingle_counts(spark, sf_dir):
    df = dedup.shingle_sets(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.size("s").alias("n_shingles"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


_A, _B = dedup.permutations()
_SIG = f"perm as (select unnest({_A}) as a, unnest({_B}) as b, unnest(range(1, 129)) as k), sx as (select doc_id, unnest(s) as x from sh), ms as (select doc_id, k, min((a * x + b) % {dedup.MERSENNE}) as v from sx, perm group by doc_id, k)"


@query(f"with {D}, {_SHINGLES}, {_SIG} select sh.doc_id, md5(coalesce(string_agg(cast(v as varchar), ',' order by k), array_to_string(list_transform(range(128), lambda i: '0'), ','))) as digest from sh left join ms on ms.doc_id = sh.doc_id group by sh.doc_id")
def minhash_signatures(spark, sf_dir):
    return dedup.signatures(table(spark, sf_dir, "documents")).select("doc_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("digest"))


_PAIRS = "bk as (select doc_id, (k - 1) // 8 as band, string_agg(cast(v as varchar), ',' order by k) as key from ms group by 1, 2), hd as (select band, key, min(doc_id) as head from bk group by 1, 2 having count(*) > 1), cp as (select distinct hd.head, bk.doc_id from bk join hd using (band, key) where bk.doc_id <> hd.head), sim as (select cp.head, cp.doc_id, count(*) filter (where x.v = y.v)::double / 128 as similarity from cp join ms x on x.doc_id = cp.head join ms y on y.doc_id = cp.doc_id and y.k = x.k group by 1, 2)"


@query(f"with {D}, {_SHINGLES}, {_SIG}, {_PAIRS} select head, doc_id, similarity from sim")
def lsh_candidate_pairs(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return dedup.candidate_pairs(dedup.signatures(table(spark, sf_dir, "documents")).checkpoint())


_UNIQUE = f"k as (select doc_id, {_KEY.format('text')} as key from documents), f as (select key, min(doc_id) as first_id from k group by key), d as (select doc_id, source, coalesce(text, '') as text from documents where doc_id in (select first_id from f))"
_COMP = "edge as (select head as u, doc_id as v from sim where similarity >= 0.8 union select doc_id, head from sim where similarity >= 0.8), reach(u, v) as (select doc_id, doc_id from d union select r.u, e.v from reach r join edge e on e.u = r.v), comp as (select u as first_id, min(v) as component_id from reach group by u), cc as (select k.doc_id, f.first_id, comp.component_id, k.doc_id = comp.component_id as kept from k join f using (key) join comp using (first_id))"


@query(f"with recursive {_UNIQUE}, {_SHINGLES}, {_SIG}, {_PAIRS}, {_COMP} select doc_id, first_id, component_id, kept from cc")
def near_dup_components(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return dedup.near_duplicate_components(table(spark, sf_dir, "documents"))


@query(f"with recursive {_UNIQUE}, {_SHINGLES}, {_SIG}, {_PAIRS}, {_COMP} select count(*) as total, count(*) filter (where doc_id <> first_id) as exact_removed, count(*) filter (where not kept) - count(*) filter (where doc_id <> first_id) as near_removed, count(*) filter (where kept) as kept from cc")
def dedup_report(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return dedup.dedup_report(dedup.near_duplicate_components(table(spark, sf_dir, "documents")))


# --- Splits and mixes ---------------------------------------------------------------------------

_SPLIT = f"sp as (select doc_id, source, count(*) over (partition by source) as n, row_number() over (partition by source order by {order_sql(1337, 'doc_id')}, doc_id) as k from documents), sq as (select *, greatest(least(50, n // 10), cast(floor(n * 0.01) as bigint)) as v from sp), ss as (select doc_id, source, case when 2 * v >= n then 'train' when k <= v then 'val' when k <= 2 * v then 'test' else 'train' end as split from sq)"


@query(f"with {_SPLIT} select doc_id, source, split from ss")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "documents"))


@query(f"with {_SPLIT} select split, count(*) as n from ss group by split")
def split_counts(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "documents")).groupBy("split").agg(F.count("*").alias("n"))


_WEIGHTS = [("src0", 0.5), ("src1", 1.0), ("src2", 1.5), ("src3", 3.25), ("src4", 0.0)]


@query(f"with wt(source, weight) as (values {', '.join(str(x) for x in _WEIGHTS)}), x as (select d.doc_id, d.source, coalesce(cast(weight as double), 1.0) as w from documents d left join wt using (source)), y as (select doc_id, source, cast(floor(w) + case when {hash_sql('1337', 'doc_id')} / 4294967296.0 < w - floor(w) then 1 else 0 end as bigint) as reps from x) select doc_id, source, unnest(range(1, reps + 1)) as copy from y where reps > 0")
def weighted_mix(spark, sf_dir):
    weights = spark.createDataFrame(_WEIGHTS, "source string, weight double")
    return splits.weighted_copies(table(spark, sf_dir, "documents").select("doc_id", "source"), weights).select("doc_id", "source", "copy")


@query(f"with b as (select distinct doc_id // 10 as b from documents), r as (select b, row_number() over (order by {order_sql(1337, 'b')}, b) as k from b), n as (select greatest(1, round_even(count(*) * 0.05, 0)) as n from b) select doc_id, case when r.k <= n.n then 'val' else 'train' end as split from documents d join r on r.b = d.doc_id // 10, n")
def block_split(spark, sf_dir):
    return splits.block_split(table(spark, sf_dir, "documents").select("doc_id"), block=10, fraction=0.05)


@query("select doc_id, case when row_number() over (order by doc_id) <= floor(0.9 * count(*) over ()) then 'train' else 'val' end as split from documents")
def sequential_split(spark, sf_dir):
    return splits.sequential_split(table(spark, sf_dir, "documents").select("doc_id"))


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents) where k <= 200")
def topk_docs_per_source(spark, sf_dir):
    return splits.first_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), 200)


@query(f"with h as (select doc_id, source, text, row_number() over (partition by source order by doc_id) as k from documents), s as (select *, row_number() over (partition by source order by {order_sql(0, 'doc_id')}, doc_id) as j from h where k <= 500) select doc_id, source, substr(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'), 1, 280) as snippet from s where j <= 5")
def source_audit_sample(spark, sf_dir):
    df = splits.sample_per_group(table(spark, sf_dir, "documents"), 5)
    return df.select("doc_id", "source", F.substring(F.regexp_replace("text", r"[\s\p{Z}]+", " "), 1, 280).alias("snippet"))


@query("select doc_id from (select doc_id, coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as s from documents) where s < 400000")
def sample_prefix_by_chars(spark, sf_dir):
    return splits.prefix_by_chars(table(spark, sf_dir, "documents")).select("doc_id")


@query("with p(lang, need) as (values ('en', 800), ('fr', 120), ('de', 80)), h as (select lang, count(*) as n from documents group by lang), x as (select d.doc_id, d.lang, p.need, unnest(range(1, cast(ceil(p.need / h.n) as bigint) + 1)) as copy from documents d join p using (lang) join h using (lang)), r as (select *, row_number() over (partition by lang order by copy, md5('1337|' || copy || '|' || doc_id)) as k from x) select doc_id, lang, copy, lang as stream from r where k <= need")
def interleaved_mix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = {lang: (d.filter(F.col("lang") == lang).select("doc_id", "lang"), share) for lang, share in (("en", 0.8), ("fr", 0.12), ("de", 0.08))}
    return splits.interleave(parts, 1000)


# --- Instruction data ---------------------------------------------------------------------------


def _ask_sql(task: str, key: str, **values: str) -> str:
    import re

    forms = []
    for t in sft.TEMPLATES[task]:
        parts = [values[p[1:-1]] if p.startswith("{") else q(p) for p in re.split(r"(\{\w+\})", t) if p]
        forms.append(" || ".join(parts))
    pick = f"{hash_sql('1337', q(task), key)} % {len(forms)}"
    return "case " + " ".join(f"when {pick} = {k} then {f}" for k, f in enumerate(forms)) + " end"


_S = f"s as (select doc_id, source, text, {_SENT} as s from d)"
_LAST = "'{task}' as task, {source} as source, 'kab' as lang"
_QA = f"qa as (select doc_id, {_ask_sql('qa', 'doc_id', topic='topic')} as instruction, lead as response, 'qa' as task, source, 'kab' as lang from (select doc_id, source, array_to_string(s[1:3], ' ') as lead, array_to_string({words_sql('s[1]')}[1:2], ' ') as topic, len(s) as n from s) where n >= 2 and len({words_sql('lead')}) >= 15 and length(topic) >= 4 order by doc_id limit 20000)"
_SUM = f"su as (select doc_id, {_ask_sql('summarize', 'doc_id', text='body')} as instruction, lead as response, 'summarize' as task, source, 'kab' as lang from (select doc_id, source, array_to_string(s[1:2], ' ') as lead, array_to_string(s[3:14], ' ') as body, len(s) as n from s) where n >= 8 and len({words_sql('body')}) >= 60 order by doc_id limit 10000)"
_CON = f"co as (select doc_id, {_ask_sql('continue', 'doc_id', text='head')} as instruction, array_to_string(tail, ' ') as response, 'continue' as task, source, 'kab' as lang from (select doc_id, source, array_to_string(t[1:c], ' ') as head, t[c+1:c+150] as tail from (select doc_id, source, len({words_sql('text')}) // 3 as c, len({words_sql('text')}) as n, regexp_split_to_array({strip_sql('text')}, '[\\s\\p{{Z}}]+') as t from d) where n >= 80) where len(tail) >= 30 order by doc_id limit 10000)"
_EX = "doc_id, instruction, response, task, source, lang"


@query(f"with {D}, {_S}, {_QA} select {_EX} from qa")
def sft_qa(spark, sf_dir):
    return sft.qa(table(spark, sf_dir, "documents"))


@query(f"with {D}, {_S}, {_SUM} select {_EX} from su")
def sft_summarize(spark, sf_dir):
    return sft.summarize(table(spark, sf_dir, "documents"))


@query(f"with {D}, {_CON} select {_EX} from co")
def sft_continue(spark, sf_dir):
    return sft.continuation(table(spark, sf_dir, "documents"))


_ERR = "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in FIXTURE.spelling_errors.items()) + "}"
_SPELL = rf"""fit as (select doc_id, list_filter(s, lambda x: len({words_sql('x')}) between 8 and 40) as f from s),
ft as (select doc_id, unnest(f) as good, unnest(range(len(f))) as j from fit),
ch as (select doc_id, j, good, unnest(string_split(good, '')) as c, unnest(range(length(good))) as i from ft),
bad as (select doc_id, j, any_value(good) as good, string_agg(case when map_contains({_ERR}, c) and {hash_sql('1337', 'doc_id', 'i')} < {int(0.6 * 4294967296)} then {_ERR}[c] else c end, '' order by i) as bad from ch group by doc_id, j),
fb as (select doc_id, min(j) as j from bad where bad <> good group by doc_id)"""


@query(f"with {D}, {_S}, {_SPELL} select doc_id, {_ask_sql('correct', 'doc_id', text='bad')} as instruction, good as response, 'correct' as task, 'spelling' as source, 'kab' as lang from bad join fb using (doc_id, j) order by doc_id limit 6000")
def sft_spelling(spark, sf_dir):
    return sft.spelling(table(spark, sf_dir, "documents"), FIXTURE)


_TR = f"tp as (select conv_id * 1000 + turn as doc_id, s as src, t as tgt from pr where reason is null), tr as (select doc_id, {_ask_sql('translate_to_kab', 'doc_id', text='src')} as instruction, tgt as response, 'translate_to_kab' as task, 'parallel' as source, 'kab' as lang from tp union all select doc_id, {_ask_sql('translate_from_kab', 'doc_id', text='tgt', lang=q('taglizit'))}, src, 'translate_from_kab', 'parallel', 'kab' from tp)"


@query(f"with {_TURNS}, {_PAIR}, {_TR} select {_EX} from tr")
def sft_translation(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).filter("reason is null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "src", "tgt")
    return sft.translation(pairs, limit=None)


def _verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verb tables made of the benchmark's words: some without an aorist, some with a blank participle."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words("text").alias("w")).filter(F.size("w") >= 5)
    w = [F.col("w")[k] for k in range(5)]
    odd = lambda n: F.pmod("item_id", F.lit(n)) != 0
    return b.select(
        F.col("item_id").alias("doc_id"), w[0].alias("lemma"), F.when(odd(3), F.array(w[1], F.lit(None), w[2])).otherwise(F.array().cast("array<string>")).alias("aorist"), F.array(w[3]).alias("preterite"),
        F.lit(None).cast("string").alias("imperative"), F.when(odd(2), w[4]).otherwise(" ").alias("participle"),
    )


@query(f"with v as (select item_id as doc_id, {words_sql('text')} as w from benchmark), u as (select * from v where len(w) >= 5), f as (select doc_id, w, 'urmir' as tense, 0 as k, '- ' || w[2] || chr(10) || '- ' || w[3] as body from u where doc_id % 3 <> 0 union all select doc_id, w, 'izri', 1, '- ' || w[4] from u union all select doc_id, w, 'amerna', 3, w[5] from u where doc_id % 2 = 1) select doc_id, {_ask_sql('conjugate', chr(34) + 'key' + chr(34), verb='verb', tense='tense')} as instruction, body as response, 'conjugate' as task, 'verbs' as source, 'kab' as lang from (select *, w[1] as verb, doc_id || '|' || k as key from f)")
def sft_conjugate(spark, sf_dir):
    return sft.conjugation(_verbs(spark, sf_dir))


@query(f"select item_id as doc_id, {_ask_sql('define', 'item_id', word='w')} as instruction, text as response, 'define' as task, 'lexicon' as source, 'kab' as lang from (select item_id, text, coalesce({words_sql('text')}[1], '') as w from benchmark) order by item_id limit 5000")
def sft_define(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return sft.definitions(b.select(F.col("item_id").alias("doc_id"), F.coalesce(F.try_element_at(T.words("text"), F.lit(1)), F.lit("")).alias("word"), F.col("text").alias("gloss")))


def _examples(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    d = table(spark, sf_dir, "documents")
    return [sft.qa(d), sft.summarize(d), sft.continuation(d)]


_ALL = f"with {D}, {_S}, {_QA}, {_SUM}, {_CON}, ex as (select * from qa union all select * from su union all select * from co)"


@query(_ALL + " select task, lang, count(*) as n, count(*)::double / (select count(*) from ex) as share from ex group by 1, 2")
def sft_mix_report(spark, sf_dir):
    a, b, c = _examples(spark, sf_dir)
    return sft.mix_report(a.unionByName(b).unionByName(c))


@query(_ALL + ", o as (select *, row_number() over (order by md5('1337|' || task || '|' || doc_id || '|' || instruction)) as k, (select least(2000, count(*) // 20) from ex) as nv from ex) select doc_id, task, case when k <= nv then 'val' else 'train' end as split from o")
def sft_assemble(spark, sf_dir):
    return sft.assemble(_examples(spark, sf_dir)).select("doc_id", "task", "split")


@query(_ALL + ", p as (select *, row_number() over (partition by task order by doc_id) as k from ex) select task, doc_id, instruction, response from p where k = 1 order by task limit 6")
def sft_preview(spark, sf_dir):
    a, b, c = _examples(spark, sf_dir)
    return sft.preview(a.unionByName(b).unionByName(c))


@query(f"with {D}, {_S}, {_QA} select doc_id, '<|im_start|>system' || chr(10) || {q(sft.SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10) as chat from qa")
def chat_messages_format(spark, sf_dir):
    return sft.messages(sft.qa(table(spark, sf_dir, "documents"))).select("doc_id", T.chatml(F.col("messages")).alias("chat"))


# --- Tokens -------------------------------------------------------------------------------------

_ST = rf"st as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]') as t from d), tk as (select doc_id, unnest(t) as token, unnest(range(len(t))) as pos from st), vo as (select token, count(*) as n, row_number() over (order by count(*) desc, token) + 3 as idx from tk group by token having count(*) >= 2)"
_ENC = "en as (select tk.doc_id, pos, coalesce(idx, 1) as id from tk left join vo on vo.token = tk.token)"


@query(f"with {D}, {_ST} select token, n, idx from vo")
def v0_vocabulary(spark, sf_dir):
    return tokens.vocabulary(table(spark, sf_dir, "documents"))


@query(f"with {D}, {_ST}, {_ENC} select d.doc_id, md5(coalesce(string_agg(cast(id as varchar), ',' order by pos), '')) as digest, count(id) as n from d left join en on en.doc_id = d.doc_id group by d.doc_id")
def encode_with_unk(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ids = tokens.encode(d, tokens.vocabulary(d))
    return ids.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"), F.size("ids").alias("n"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return tokens.encode(d, tokens.vocabulary(d))


@query(f"with {D}, {_ST}, {_ENC}, x as (select id, row_number() over (order by doc_id, pos) - 1 as p from en) select p // 2048 as block, md5(string_agg(cast(id as varchar), ',' order by p)) as digest from x group by 1 having count(*) = 2048")
def pack_blocks(spark, sf_dir):
    return tokens.pack_blocks(_encoded(spark, sf_dir)).select("block", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("digest"))


@query(f"with {D}, {_ST}, {_ENC}, x as (select id, row_number() over (order by doc_id, pos) - 1 as p from en), n as (select (count(*) - 1) // 512 as n from x), w as (select unnest(range((select n from n))) as w) select w as \"window\", md5((select string_agg(cast(id as varchar), ',' order by p) from x where p >= w * 512 and p < w * 512 + 512)) as x, md5((select string_agg(cast(id as varchar), ',' order by p) from x where p >= w * 512 + 1 and p < w * 512 + 513)) as y from w")
def shifted_windows(spark, sf_dir):
    out = tokens.shifted_windows(_encoded(spark, sf_dir), 512)
    return out.select("window", *(F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c) for c in "xy"))


@query(f"with {D}, {_ST}, {_ENC}, x as (select id, row_number() over (order by doc_id, pos) - 1 as p from en), n as (select count(*) as n from x), w as (select draw, {hash_sql('1337', 'draw')} % (n - 128) as low from (select unnest(range(64)) as draw), n where n > 128) select draw, low as start, md5(string_agg(cast(id as varchar), ',' order by p) filter (where p < low + 128)) as x, md5(string_agg(cast(id as varchar), ',' order by p) filter (where p > low)) as y from w join x on p between low and low + 128 group by draw, low")
def random_windows(spark, sf_dir):
    out = tokens.random_windows(_encoded(spark, sf_dir), 128, 64)
    return out.select("draw", "start", *(F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c) for c in "xy"))


@query(f"with {D}, {_ST}, {_ENC}, b as (select distinct doc_id // 10 as b from documents), r as (select b, row_number() over (order by {order_sql(1337, 'b')}, b) as k from b), nb as (select greatest(1, round_even(count(*) * 0.05, 0)) as n from b), sp as (select doc_id, case when r.k <= nb.n then 'val' else 'train' end as split from documents d join r on r.b = d.doc_id // 10, nb), c as (select doc_id, count(*) as n from en group by doc_id) select sp.split, count(*) as n_messages, cast(sum(coalesce(c.n, 0)) + count(*) + 1 as bigint) as stream_ids from sp left join c using (doc_id) group by sp.split")
def block_streams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    out = tokens.block_streams(_encoded(spark, sf_dir), splits.block_split(d, block=10, fraction=0.05), 3)
    return out.groupBy("split").agg(F.max("n_messages").alias("n_messages"), F.sum(F.size("ids")).alias("stream_ids"))


@query(f"with {D}, {_ST}, {_ENC}, i as (select d.doc_id, coalesce(list(id order by pos) filter (where id is not null), []) as ids from d left join en on en.doc_id = d.doc_id group by d.doc_id), z as (select doc_id, ids[1:256] as input, least(len(ids) // 2, 256) as k from i) select doc_id, cast(len(input) as bigint) as n, cast(least(k, len(input)) as bigint) as masked, len(input) > k as trainable from z")
def mask_prompt_labels(spark, sf_dir):
    half = F.floor(F.size("ids") / 2).cast("int")
    rows = _encoded(spark, sf_dir).select("doc_id", F.slice("ids", F.lit(1), half).alias("prompt_ids"), F.slice("ids", half + 1, F.size("ids") + 1).alias("response_ids"))
    out = tokens.mask_prompt(rows, max_len=256)
    return out.select("doc_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x == tokens.MASK)).alias("masked"), "trainable")


@query(f"with {D}, {_ST}, {_ENC}, i as (select doc_id, list(id order by pos) as ids from en group by doc_id), m as (select doc_id // 8 as b, max(least(len(ids), 256)) as m from i group by 1) select i.doc_id, cast(m as bigint) as padded, cast(m - least(len(ids), 256) as bigint) as pads from i join m on m.b = i.doc_id // 8")
def pad_batches(spark, sf_dir):
    rows = _encoded(spark, sf_dir).filter(F.size("ids") > 0).select("doc_id", F.slice("ids", 1, 1).alias("prompt_ids"), F.slice("ids", F.lit(2), F.size("ids")).alias("response_ids"))
    out = tokens.pad_batches(tokens.mask_prompt(rows, max_len=256), batch=8)
    return out.select("doc_id", F.size("input_ids").alias("padded"), F.size(F.filter("attention_mask", lambda x: x == 0)).alias("pads"))


_FERT = rf"fw as (select doc_id, unnest({words_sql('text')}) as word, unnest(range(len({words_sql('text')}))) as pos from d), fx as (select *, len(regexp_extract_all(word, '[aeiou]|[^aeiou]+')) as nt from fw)"


@query(f"with {D}, {_FERT} select round(sum(nt)::double / count(*), 9) as tokens_per_word, round(sum(nt)::double / sum(length(word)), 9) as tokens_per_char, 0.0::double as unk_rate, round(avg(nt::double / length(word)) filter (where pos < 20000 and regexp_matches(word, {q(T.class_of(FIXTURE.special))})) / avg(nt::double / length(word)) filter (where pos < 20000 and not regexp_matches(word, {q(T.class_of(FIXTURE.special))})), 9) as diacritic_penalty from fx")
def fertility_stats(spark, sf_dir):
    """A vowel-cutting stand-in tokenizer keeps the aggregate comparable across engines."""
    df = table(spark, sf_dir, "documents").select(F.posexplode(T.words(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    df = df.withColumn("n_tokens", F.size(F.regexp_extract_all("word", F.lit("[aeiou]|[^aeiou]+"), F.lit(0)))).withColumn("n_unk", F.lit(0))
    out = tokens.fertility(df, special=FIXTURE.special)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query()
def tokenizer_fertility(spark, sf_dir):
    """Under a real public tokenizer; no SQL engine has one, so tests hold it against the tokenizer itself."""
    import public_tokenizers

    words = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.fertility(words, special=FIXTURE.special)


@query(f"with {D}, {_ST} select piece from (select token as piece, idx from vo where length(token) >= 2 and token not in (select distinct unnest({words_sql('lower(text)')}) from benchmark) order by idx limit 500)")
def select_new_tokens(spark, sf_dir):
    pieces = tokens.vocabulary(table(spark, sf_dir, "documents")).select(F.col("idx").alias("id"), F.col("token").alias("piece"))
    return tokens.select_new_tokens(pieces, _benchmark_lexicon(spark, sf_dir).withColumnRenamed("word", "piece"), n=500).select("piece")


@query()
def bpe_merges(spark, sf_dir):
    """The byte-pair merges of all documents under the reference's largest setting, 12,000 entries from pairs
    seen five times. An iterative algorithm, checked by tests."""
    _, merges = tokens.train_bpe(table(spark, sf_dir, "documents"), 12_000, min_frequency=5)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, a string, b string")


# --- Fonts --------------------------------------------------------------------------------------


def _map_sql(t: str, table: dict[str, str]) -> str:
    single = {k: v for k, v in table.items() if len(v) == 1}
    t = f"translate({t}, {q(''.join(single))}, {q(''.join(single.values()))})"
    for k, v in table.items():
        if len(v) > 1:
            t = f"replace({t}, {q(k)}, {q(v)})"
    return t


@query(f"with {D} select doc_id, md5({_map_sql('text', fonts.MAP_A)}) as map_a, md5({_map_sql('text', fonts.MAP_B)}) as map_b from d")
def font_map_decode(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fonts.apply_map(t, fonts.MAP_A)).alias("map_a"), F.md5(fonts.apply_map(t, fonts.MAP_B)).alias("map_b"))


_LETTERS = rf"lt as (select letter, count(*) as n from (select unnest(regexp_extract_all(lower(text), '\p{{L}}')) as letter from d) group by letter)"


@query(f"with {D}, {_LETTERS} select letter, n, n::double / (select sum(n) from lt) as freq from lt")
def letter_profile(spark, sf_dir):
    return fonts.letter_profile(table(spark, sf_dir, "documents"))


_IMMUNE = "".join(chr(92) + c if c.isascii() else c for c in fonts.IMMUNE)
_SUSPECT = rf"ch as (select doc_id, lang, unnest(string_split(text, '')) as c, unnest(range(length(text))) as i from d), nb as (select c, lag(c) over (partition by doc_id order by i) as a, lead(c) over (partition by doc_id order by i) as b from ch), gl as (select c as glyph, count(*) as n from nb where regexp_matches(c, '^[^\s\p{{Z}}\p{{Nd}}{_IMMUNE.replace(chr(39), chr(39) * 2)}]$') and (regexp_matches(coalesce(a, ''), '\p{{L}}') or regexp_matches(coalesce(b, ''), '\p{{L}}')) group by 1), tl as (select count(*) as letters from ch where regexp_matches(c, '\p{{L}}')), pl as (select lower(c) as letter, count(*) as k from ch where lang = 'en' and regexp_matches(lower(c), '^\p{{L}}$') group by 1), pf as (select letter, k::double / (select sum(k) from pl) as freq from pl), su as (select glyph, n, n::double / greatest(letters, 1) as rate from gl, tl)"


@query(f"with {D}, {_SUSPECT} select glyph, n, rate from su left join pf on pf.letter = lower(glyph) where rate >= 0.001 and (not regexp_matches(glyph, {q('^' + _CANON + '$')}) or (rate > 4.0 * coalesce(freq, 0.0) and rate > 0.002 and not regexp_matches(lower(glyph), '^[a-z]$')))")
def suspect_glyphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return fonts.suspects(d, fonts.letter_profile(d.filter("lang = 'en'")))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of spans in one of four fonts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    font = F.element_at(F.array(*(F.lit(x) for x in ("AB+AmazighBangle", "CD+Tayma-X", "EF+Times", "GH+BerberNew"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    pair = F.array(F.struct((F.col("i") * 2).alias("seq"), font.alias("font"), F.col("line").alias("text")), F.struct((F.col("i") * 2 + 1).alias("seq"), F.lit("").alias("font"), F.lit("\n").alias("text")))
    return d.select("doc_id", F.explode(pair).alias("s"), (F.floor(F.col("i") / 40)).alias("page")).select("doc_id", "s.seq", "page", "s.font", "s.text")


@query("with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) select ['AB+AmazighBangle', 'CD+Tayma-X', 'EF+Times', 'GH+BerberNew'][cast(doc_id % 4 + 1 as int)] as font, cast(sum(length(line)) as bigint) as chars, case cast(doc_id % 4 as int) when 0 then 'map_a' when 1 then 'map_b' when 3 then 'map_a' end as map from l group by doc_id % 4")
def font_usage(spark, sf_dir):
    return fonts.font_usage(_spans(spark, sf_dir), fonts.Registry())


_HEADS = f"h as (select doc_id, string_split(text, chr(10)) as l from d), s as (select doc_id, l, list_transform(l, lambda x: {strip_sql('x')}) as st from h), c as (select doc_id, key, count(*) as n from (select doc_id, unnest(st) as key from s) group by 1, 2), heads as (select doc_id, list(key) as k from c where n >= 5 and length(key) between 1 and 59 group by 1), bare as (select s.doc_id, array_to_string(list_filter(l, lambda x: not regexp_matches(x, '^\\s*\\p{{Nd}}{{1,4}}\\s*$') and not list_contains(coalesce(heads.k, []), {strip_sql('x')})), chr(10)) as text from s left join heads on heads.doc_id = s.doc_id)"
_DECODED = f"d as (select doc_id, {_normal_sql('nfc_normalize(t)')} as text from (select doc_id, case doc_id % 4 when 1 then {_map_sql('raw', fonts.MAP_B)} when 2 then raw else {_map_sql('raw', fonts.MAP_A)} end as t from (select doc_id, coalesce(text, '') || chr(10) as raw from documents)))"


@query(f"with {_DECODED}, {_HEADS} select doc_id, text from bare")
def decode_spans(spark, sf_dir):
    return fonts.decode_spans(_spans(spark, sf_dir), profile=FIXTURE)


def _tried_sql(source: str) -> str:
    """CTEs best(font, map, oov) over a CTE sample(font, text): each candidate map against the benchmark's words."""
    tries = " union all ".join(f"select font, {k} as rank, '{name}' as map, {_normal_sql(_map_sql('text', table) if table else 'text', nfc=False)} as t from {source}" for k, (name, table) in enumerate(fonts.MAPS.items()))
    return f"tr as ({tries}), tw as (select font, rank, map, unnest({words_sql('lower(t)')}) as word from tr), tc as (select font, rank, map, count(*) as n, count(*) filter (where word not in (select word from lex)) as bad from tw group by 1, 2, 3), ta as (select distinct tr.font, tr.rank, tr.map, coalesce(bad::double / n, 1.0) as oov from tr left join tc using (font, rank, map)), best as (select font, map, oov from (select *, row_number() over (partition by font order by oov, rank) as k from ta) where k = 1)"


_FONT_SAMPLE = "ls as (select ['AB+AmazighBangle', 'CD+Tayma-X', 'EF+Times', 'GH+BerberNew'][cast(doc_id % 4 + 1 as int)] as font, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d), lc as (select *, coalesce(sum(length(line)) over (partition by font order by doc_id, i rows between unbounded preceding and 1 preceding), 0) as c from ls), sample as (select font, substr(line, 1, cast(40000 - c as int)) as text from lc where c < 40000)"


@query(f"with {D}, {_BENCH}, {_FONT_SAMPLE}, {_tried_sql('sample')} select font, map, oov from best")
def discover_font_maps(spark, sf_dir):
    return fonts.discover_maps(_spans(spark, sf_dir), _benchmark_lexicon(spark, sf_dir))


@query(f"with {D}, {_BENCH}, sample as (select doc_id as font, substr(text, 1, 50000) as text from d), {_tried_sql('sample')} select font as doc_id, map, oov from best")
def decode_text_only(spark, sf_dir):
    return fonts.decode_text(table(spark, sf_dir, "documents").select("doc_id", "text"), _benchmark_lexicon(spark, sf_dir)).select("doc_id", "map", "oov")


#: The search reads whole texts here; its sample is a feature of the operator.
_WHOLE = (1 << 31) - 1


def _enciphered(spark: SparkSession, sf_dir: str, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted tokens (by ``keys``, then with blanks) of English documents, of two fonts, with some letters to be drawn as glyphs; lexicon and letter profile.

    The texts are read once, and letters are exchanged in the tokens.
    """
    ensure_checkpoint_dir(spark)
    font = F.concat(F.lit("XY+Odd-"), F.pmod("doc_id", F.lit(2)).cast("string"))
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select(font.alias("font"), "text")
    counted = fonts.token_counts(d, *keys, blanks=bool(keys)).withColumn("text", F.translate("text", "aeo", "ɣɛč")).checkpoint()
    return counted, lexicon.from_corpus(counted, weight="n"), fonts.letter_profile(counted, weight="n")


def _drawn(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", fonts.apply_map(F.col("text"), {"ɣ": "$", "ɛ": "ε", "č": "ç"}))


@query()
def solve_cipher(spark, sf_dir):
    """The glyphs of a known substitution found again; a greedy search, checked by tests."""
    counted, words, profile = _enciphered(spark, sf_dir)
    found, before, after = fonts.solve_cipher(_drawn(counted), words, profile, sample_chars=_WHOLE, weight="n")
    return spark.createDataFrame([(g, t, before, after) for g, t in sorted(found.items())], "glyph string, letter string, before double, after double")


@query()
def solve_fonts(spark, sf_dir):
    """The same search for each unknown font of a span table."""
    counted, words, profile = _enciphered(spark, sf_dir, "font")
    found = fonts.solve_fonts(_drawn(counted), words, profile, sample_chars=_WHOLE, weight="n")
    return spark.createDataFrame([(f, g, t) for f, m in sorted(found.items()) for g, t in sorted(m.items())], "font string, glyph string, letter string")


# --- Evaluation ---------------------------------------------------------------------------------

_NLL = "select d.doc_id, d.source, l.quality + l.toxic + 1.0 as nll, d.n_chars % 97 as n_tokens from documents d join labels l on l.doc_id = d.doc_id"


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "source", (F.col("quality") + F.col("toxic") + 1.0).alias("nll"), (F.col("n_chars") % 97).alias("n_tokens"))


_PPL = f"ppl as (select source, round(coalesce(exp(sum(nll * (n_tokens - 1)) filter (where n_tokens >= 2) / nullif(sum(n_tokens - 1) filter (where n_tokens >= 2), 0)), 'infinity'::double), 9) as perplexity from ({_NLL}) group by source)"


@query(f"with {_PPL} select * from ppl")
def weighted_perplexity(spark, sf_dir):
    return evaluation.perplexity(_losses(spark, sf_dir), "source").withColumn("perplexity", F.round("perplexity", 9))


@query(f"with {_PPL} select round(max(perplexity) / min(perplexity), 6) as spread, max(perplexity) / min(perplexity) < 3 as balanced from ppl")
def perplexity_spread(spark, sf_dir):
    by = evaluation.perplexity(_losses(spark, sf_dir), "source")
    return evaluation.perplexity_spread(by).withColumn("spread", F.round("spread", 6))


@query(f"with {D} select avg(case when coalesce({count_sql('text', T.class_of(DEFAULT.special))}::double / nullif({count_sql('text', '[' + chr(92) + 'p{L}]')}, 0), 0.0) > 0.02 then 1.0 else 0.0 end)::double as purity from d")
def language_purity(spark, sf_dir):
    return evaluation.language_purity(evaluation.with_label(table(spark, sf_dir, "documents")))


@query("with x as (select vec_id, label, list_position(cast(embedding[1:4] as double[]), list_max(cast(embedding[1:4] as double[]))) - 1 as pick from embeddings) select avg(case when pick = label % 4 then 1.0 else 0.0 end)::double as accuracy, count(*) as n from x")
def multiple_choice_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return evaluation.accuracy(e.select(F.slice("embedding", 1, 4).cast("array<double>").alias("scores"), (F.col("label") % 4).alias("answer")))


@query()
def chrf_adjacent_turns(spark, sf_dir):
    pairs = parallel.adjacent_turns(table(spark, sf_dir, "conversations"))
    rows = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("src").alias("hypothesis"), F.col("tgt").alias("reference"))
    return evaluation.chrf(rows).withColumn("chrf", F.round("chrf", 6))


@query(f"select source, round(sum(nll * n_tokens) / nullif(sum(n_tokens), 0), 9) as loss from ({_NLL}) group by source")
def mean_loss_by_source(spark, sf_dir):
    out = evaluation.mean_loss(_losses(spark, sf_dir).select("source", F.col("nll").alias("loss"), F.col("n_tokens").alias("n")), "source")
    return out.withColumn("loss", F.round("loss", 9))


@query("with g as (select unnest([0.6e9, 1.7e9, 4e9]) as p, unnest([60e6, 60e6, 60e6]) as t), h as (select p, 6 * p * t / (35.0 * 1e12) / 3600 as hours from g) select p as n_params, round(hours, 9) as hours, cast(ceil(hours / 11) as bigint) as sessions, round(hours / 30, 9) as week_share from h")
def budget_hours(spark, sf_dir):
    df = spark.createDataFrame([(0.6e9, 60e6), (1.7e9, 60e6), (4e9, 60e6)], "p double, t double")
    df = df.select("p", evaluation.budget(F.col("p"), F.col("t")).alias("b"))
    return df.select(F.col("p").alias("n_params"), F.round("b.hours", 9).alias("hours"), F.col("b.sessions").alias("sessions"), F.round("b.week_share", 9).alias("week_share"))


@query("select s as step, round(case when s < 100 then 3e-4 * (s + 1) / 100 else 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * least(1.0, (s - 100) / 900.0))) end, 12) as lr from (select unnest(range(1000)) as s)")
def lr_schedule(spark, sf_dir):
    df = spark.range(1000).withColumnRenamed("id", "step")
    return df.select("step", F.round(evaluation.learning_rate(F.col("step"), peak=3e-4, floor=3e-5, warmup=100, total=1000), 12).alias("lr"))


@query("select arg_min(e, ((v * 1000) % 97) * 1e9 + e) as step, min((v * 1000) % 97) as val_loss from (select event_id as e, value as v from events)")
def best_checkpoint(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), ((F.col("value") * 1000) % 97).alias("val_loss"))
    return evaluation.best_checkpoint(e)


@query(JUDGED["fixture"] + " select count(*) as documents, cast(sum(n_words) as bigint) as words, round(sum(n_words) * 2.75, 6) as tokens_before, round(sum(n_words) * 1.9, 6) as tokens_after from verdict where reject_reason is null")
def corpus_summary(spark, sf_dir):
    df = _judged(spark, sf_dir).filter("reject_reason is null").agg(F.count("*").alias("documents"), F.sum(F.col("n_words").cast("bigint")).alias("words"))
    df = df.withColumn("e", evaluation.corpus_token_estimate(F.col("words")))
    return df.select("documents", "words", F.round(F.col("e.tokens_before").cast("double"), 6).alias("tokens_before"), F.round(F.col("e.tokens_after").cast("double"), 6).alias("tokens_after"))


@query()
def evaluation_report(spark, sf_dir):
    """All scores of a model in one row, from tables that stand for its output; the parts have SQL of their own."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    losses = _losses(spark, sf_dir).withColumnRenamed("source", "domain")
    words = d.select(F.posexplode(T.words(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    words = words.withColumn("n_tokens", F.size(F.regexp_extract_all("word", F.lit("[aeiou]|[^aeiou]+"), F.lit(0)))).withColumn("n_unk", F.lit(0))
    choices = e.select(F.slice("embedding", 1, 4).cast("array<double>").alias("scores"), (F.col("label") % 4).alias("answer"))
    base = e.select(F.slice("embedding", 5, 4).cast("array<double>").alias("scores"), (F.col("label") % 4).alias("answer"))
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("text")
    out = evaluation.evaluate(losses, said, d.select("text"), words, choices, _benchmark_lexicon(spark, sf_dir), special=FIXTURE.special, base_choices=base)
    return out.select(F.to_json("perplexity").alias("perplexity"), *(c for c in out.columns if c not in ("perplexity", "forgetting")), "forgetting.drop", "forgetting.verdict")


# --- Sources and sinks --------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of this run below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


@query("select doc_id, source, md5(text) as digest, cast(n_chars as bigint) as n_words from documents where text is not null")
def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read again."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", "source", F.col("n_chars").alias("n_words"))
    path = _folder(spark, "jsonl")
    writers.write_json(docs, path)
    return readers.read_documents(spark, path).select("doc_id", "source", F.md5("text").alias("digest"), "n_words")


@query(f"with {_SPLIT} select split, count(*) as n, md5(string_agg(cast(ss.doc_id as varchar), ',' order by ss.doc_id)) as ids from ss group by split")
def split_files_round_trip(spark, sf_dir):
    """The stratified split written as one JSON-lines folder per split and read again."""
    docs = table(spark, sf_dir, "documents")
    path = _folder(spark, "splits")
    writers.write_splits(docs.select("doc_id", "text", "source"), splits.stratified_split(docs), path)
    back = spark.read.schema("doc_id long, text string, source string, split string").json(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")).alias("ids"))


@query("select case when lang = 'en' then 'english' else 'other' end as source, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents where regexp_matches(coalesce(text, ''), '[^\\s\\p{Z}]') group by 1")
def registry_sources(spark, sf_dir):
    """All documents written as two sources of different columns and loaded through the registry; a missing one is skipped."""
    docs, path = table(spark, sf_dir, "documents"), _folder(spark, "registry")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for name, rows, column in (("english", english, "sentence"), ("other", ~english, "content")):
        docs.filter(rows).select(F.col("text").alias(column), "n_chars").write.mode("overwrite").parquet(f"{path}/{name}")
    sources = [readers.Source(n, "mono", f"{path}/{n}") for n in ("english", "other", "absent")]
    pool = readers.load_pool(spark, readers.build_pool(sources), check_language=False)
    return pool.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"with {_TURNS}, {_PAIR}, kept as (select conv_id * 1000 + turn as pair_id, s, t from pr where reason is null) select 'talk' as source, s as src, {_normal_sql('nfc_normalize(t)')} as tgt from (select * from kept where {_RUNG_5.replace('reason', 'null')} is null order by pair_id limit 100)")
def load_pairs(spark, sf_dir):
    """Verified pairs of two sources, the noisy one left out, at most 100 of a source in id order."""
    pairs = parallel.adjacent_turns(table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("src").alias("en"), F.col("tgt").alias("kab"))
    return parallel.load_pairs([("talk", "normal", pairs), ("crawl", "noisy", pairs)], cap=100, profile=FIXTURE)
