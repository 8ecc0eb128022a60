"""Instruction data: one example or several from a document, pair or verb row.

Template choice and corruption hash (seed, task, id), so a table gives the same examples at any
parallelism. ``limit`` counts emitted examples in id order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.profile import DEFAULT, LanguageProfile
from .parallel import round_trip_filter
from .ranking import ensure_checkpoint_dir

# Instruction templates, system prompt and tense names of the target language.
SYSTEM = "Kečč d amɛiwen aseklan i yessawalen taqbaylit."
TEMPLATES = {
    "qa": ["D acu-t {topic}?", "Ini-yi-d ɣef {topic}.", "Sefhem-iyi-d ɣef {topic}.", "Acu i tessneḍ ɣef {topic}?"],
    "summarize": ["Ggez-d aḍris-agi:\n\n{text}", "Fk-iyi-d agzul n uḍris-agi:\n\n{text}", "Acu i d-yenna uḍris-agi s wudem uzzil?\n\n{text}"],
    "continue": ["Kemmel aḍris-agi:\n\n{text}", "Kemmel tira n wayen i d-yeddan:\n\n{text}"],
    "translate_to_kab": ["Suqel ɣer teqbaylit: {text}", "Amek i d-nniɣ ayagi s teqbaylit? {text}"],
    "translate_from_kab": ["Suqel ɣer {lang}: {text}", "Acu i d lmeɛna n wayagi s {lang}? {text}"],
    "conjugate": ["Sizreg amyag «{verb}» deg {tense}.", "Amek i nesseqdac amyag «{verb}» deg {tense}?"],
    "define": ["D acu i d lmeɛna n wawal «{word}»?", "Sefhem-iyi-d awal «{word}»."],
    "correct": ["Ṣeggem tira n uḍris-agi:\n\n{text}", "Sefru tuccḍiwin n tira deg uḍris-agi:\n\n{text}"],
}
TENSES = {"aorist": "urmir", "preterite": "izri", "imperative": "anab", "participle": "amerna"}
SEED = 1337


def instruction(task: str, key: Column, seed: int = SEED, **values: Column) -> Column:
    """A template of ``task`` chosen by hash of (seed, task, key), filled with ``values``."""
    pick = F.pmod(T.hash_int(F.lit(seed), F.lit(task), key), F.lit(len(TEMPLATES[task])))
    filled = []
    for t in TEMPLATES[task]:
        parts: list[Column] = []
        rest = t
        while rest:
            head, brace, rest = rest.partition("{")
            if head:
                parts.append(F.lit(head))
            if brace:
                name, _, rest = rest.partition("}")
                parts.append(values[name])
        filled.append(F.concat(*parts))
    return reduce(lambda c, k: F.when(pick == k, filled[k]).otherwise(c), range(1, len(filled)), filled[0])


def _first(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` examples in id order (a sort with a bound, not a global window)."""
    return df.orderBy("doc_id").limit(limit)


def _example(task: str, ask: Column, answer: Column, source: Column) -> list[Column]:
    return [F.col("doc_id"), ask.alias("instruction"), answer.alias("response"), F.lit(task).alias("task"), source.alias("source"), F.lit("kab").alias("lang")]


def qa(docs: DataFrame, limit: int = 20_000) -> DataFrame:
    """The opening sentences answer a question about the first words."""
    df = docs.withColumn("s", T.sentences(F.coalesce("text", F.lit("")))).filter(F.size("s") >= 2)
    df = df.withColumn("lead", F.array_join(F.slice("s", 1, 3), " ")).withColumn("topic", F.array_join(F.slice(T.words(F.col("s")[0]), 1, 2), " "))
    df = df.filter((F.size(T.words("lead")) >= 15) & (F.length("topic") >= 4))
    return _first(df.select(*_example("qa", instruction("qa", F.col("doc_id"), topic=F.col("topic")), F.col("lead"), F.col("source"))), limit)


def summarize(docs: DataFrame, limit: int = 10_000) -> DataFrame:
    """The two opening sentences sum up the next twelve."""
    df = docs.withColumn("s", T.sentences(F.coalesce("text", F.lit("")))).filter(F.size("s") >= 8)
    df = df.withColumn("lead", F.array_join(F.slice("s", 1, 2), " ")).withColumn("body", F.array_join(F.slice("s", 3, 12), " "))
    df = df.filter(F.size(T.words("body")) >= 60)
    return _first(df.select(*_example("summarize", instruction("summarize", F.col("doc_id"), text=F.col("body")), F.col("lead"), F.col("source"))), limit)


def continuation(docs: DataFrame, limit: int = 10_000) -> DataFrame:
    """A third of the text (counted in words, cut in white-space tokens) asks for the next 150 tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("n", F.size(T.words(text))).filter("n >= 80").withColumn("t", F.split(T.strip(text), r"[\s\p{Z}]+")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    df = df.withColumn("head", F.array_join(F.slice("t", F.lit(1), F.col("cut")), " ")).withColumn("tail", F.slice("t", F.col("cut") + 1, F.lit(150)))
    df = df.filter(F.size("tail") >= 30)
    return _first(df.select(*_example("continue", instruction("continue", F.col("doc_id"), text=F.col("head")), F.array_join("tail", " "), F.col("source"))), limit)


def translation(pairs: DataFrame, *, other: str = "taglizit", limit: int | None = 30_000) -> DataFrame:
    """Both directions of each pair (doc_id, src, tgt), interleaved; without ``limit``, of all pairs in no order."""
    there = F.struct(F.lit(0).alias("k"), instruction("translate_to_kab", F.col("doc_id"), text=F.col("src")).alias("i"), F.col("tgt").alias("r"), F.lit("translate_to_kab").alias("t"))
    back = F.struct(F.lit(1).alias("k"), instruction("translate_from_kab", F.col("doc_id"), text=F.col("tgt"), lang=F.lit(other)).alias("i"), F.col("src").alias("r"), F.lit("translate_from_kab").alias("t"))
    df = pairs.select("doc_id", F.explode(F.array(there, back)).alias("e"))
    df = df if limit is None else df.orderBy("doc_id", "e.k").limit(limit)
    return df.select("doc_id", F.col("e.i").alias("instruction"), F.col("e.r").alias("response"), F.col("e.t").alias("task"), F.lit("parallel").alias("source"), F.lit("kab").alias("lang"))


def conjugation(verbs: DataFrame, limit: int = 8_000) -> DataFrame:
    """Up to four tenses of each verb; the limit is checked before a verb, so three more may pass."""
    kinds = dict(verbs.dtypes)
    lemma = T.strip(F.coalesce(*(F.col(c) for c in ("lemma", "verb") if c in kinds), F.lit("")))

    def body(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.array_join(F.transform(F.filter(c, lambda f: f.isNotNull() & (f != "")), lambda f: F.concat(F.lit("- "), f)), "\n")
        return F.col(c).cast("string")

    forms = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("tense"), body(c).alias("body")) for k, (c, name) in enumerate(TENSES.items()) if c in kinds]
    df = verbs.select(F.col("doc_id"), lemma.alias("verb"), F.filter(F.array(*forms), lambda f: ~T.is_blank(f["body"])).alias("forms")).filter("verb <> ''")
    # Each verb left gives a form or more, so the first ``limit`` of them hold all that can pass.
    before = F.coalesce(F.sum(F.size("forms")).over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.filter(F.size("forms") > 0).orderBy("doc_id").limit(limit)
    df = df.withColumn("before", before).filter(F.col("before") < limit).select("doc_id", "verb", F.explode("forms").alias("f"))
    return df.select(*_example("conjugate", instruction("conjugate", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("f.k").cast("string")), verb=F.col("verb"), tense=F.col("f.tense")), F.col("f.body"), F.lit("verbs")))


def corrupt(sentence: Column, key: Column, profile: LanguageProfile = DEFAULT, *, chance: float = 0.6, seed: int = SEED) -> Column:
    """Each letter with a common misspelling takes it with ``chance``, by hash of (seed, key, position)."""
    table = F.create_map(*(F.lit(x) for kv in profile.spelling_errors.items() for x in kv))
    below = int(chance * 4294967296)
    chars = F.split(sentence, "")
    bad = F.transform(chars, lambda c, i: F.when(c.isin(*profile.spelling_errors) & (T.hash_int(F.lit(seed), key, i) < below), F.try_element_at(table, c)).otherwise(c))
    return F.array_join(bad, "")


def spelling(docs: DataFrame, profile: LanguageProfile = DEFAULT, limit: int = 6_000) -> DataFrame:
    """The first sentence of 8 to 40 words that corruption changes, to be corrected."""
    fit = F.filter(T.sentences(F.coalesce("text", F.lit(""))), lambda s: F.size(T.words(s)).between(8, 40))
    tried = F.transform(fit, lambda s: F.struct(s.alias("good"), corrupt(s, F.col("doc_id"), profile).alias("bad")))
    df = docs.withColumn("e", F.try_element_at(F.filter(tried, lambda e: e["good"] != e["bad"]), F.lit(1))).filter("e is not null")
    return _first(df.select(*_example("correct", instruction("correct", F.col("doc_id"), text=F.col("e.bad")), F.col("e.good"), F.lit("spelling"))), limit)


def definitions(entries: DataFrame, limit: int = 5_000) -> DataFrame:
    """Glosses of the first entries (doc_id, word, gloss)."""
    return _first(entries.select(*_example("define", instruction("define", F.col("doc_id"), word=F.col("word")), F.col("gloss"), F.lit("lexicon"))), limit)


def messages(examples: DataFrame, system: str | None = SYSTEM) -> DataFrame:
    """``examples`` plus ``messages``: array of (role, content)."""
    turns = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []
    turns += [F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("user", "instruction"), ("assistant", "response"))]
    return examples.withColumn("messages", F.array(*turns))


def assemble(parts: list[DataFrame], *, seed: int = SEED, max_val: int = 2_000) -> DataFrame:
    """All examples in hash order; the first min(max_val, n // 20) validate."""
    ensure_checkpoint_dir(parts[0].sparkSession)
    df = reduce(DataFrame.unionByName, parts).withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), "task", "doc_id", "instruction")))
    df = df.checkpoint()  # three reads of what the parts' limits left
    bound = df.agg(F.least(F.lit(max_val), F.floor(F.count("*") / 20)).alias("n_val"))
    head = df.select("order").orderBy("order").limit(max_val).withColumn("k", F.row_number().over(Window.orderBy("order")))
    last = head.join(F.broadcast(bound)).filter("k <= n_val").agg(F.coalesce(F.max("order"), F.lit("")).alias("last"))
    return df.join(F.broadcast(last)).withColumn("split", F.when(F.col("order") <= F.col("last"), "val").otherwise("train")).drop("last")


def translated(rows: DataFrame, *, source: str = "dolly", **filters) -> DataFrame:
    """Examples of machine-translated instructions that survive the round trip.

    ``rows``: doc_id, prompt and answer in the target language, embeddings emb_a of the original and
    emb_b of the back-translated answer, maybe an out-of-lexicon rate (``oov_col``). The translations
    and embeddings are input: no model runs here.
    """
    kept = round_trip_filter(rows, **filters).filter("keep")
    return kept.select(*_example("translated", F.col("prompt"), F.col("answer"), F.lit(source)))


def replay_rows(n_examples: int, fraction: float = 0.2) -> int:
    """Replay rows that make up ``fraction`` of the mix."""
    return int(n_examples * fraction / (1 - fraction))


def replay(repos: list[DataFrame], n: int) -> DataFrame:
    """First n (instruction, response) rows over the repositories, each in its own order; one may use the whole budget."""
    out = None
    for k, df in enumerate(repos):
        cols = set(df.columns)
        ask = [F.col(c) for c in ("prompt", "inputs", "instruction") if c in cols] + ([F.try_element_at("messages", F.lit(1))["content"]] if "messages" in cols else [])
        answer = [F.col(c) for c in ("completion", "targets", "response", "output") if c in cols] + ([F.try_element_at("messages", F.lit(2))["content"]] if "messages" in cols else [])
        part = df.select(F.lit(k).alias("repo"), F.monotonically_increasing_id().alias("__at"), F.coalesce(*ask).alias("instruction"), F.coalesce(*answer).alias("response")).filter(~T.is_blank(F.col("instruction")) & ~T.is_blank(F.col("response")))
        out = part if out is None else out.union(part)
    return out.orderBy("repo", "__at").limit(n).drop("__at")


def mix_report(examples: DataFrame) -> DataFrame:
    """task, lang, n, share of all."""
    by = examples.groupBy("task", "lang").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("task", "lang", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def preview(examples: DataFrame, tasks: int = 6) -> DataFrame:
    """The first example of each of the first ``tasks`` tasks."""
    first = examples.groupBy("task").agg(F.min(F.struct("doc_id", "instruction", "response")).alias("e"))
    return first.orderBy("task").limit(tasks).select("task", "e.doc_id", "e.instruction", "e.response")
