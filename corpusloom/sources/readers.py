"""Sources: registry-driven loading, text column resolution, local text, lines, spans."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as D

from ..functions import text as T
from ..functions.profile import DEFAULT, LanguageProfile

log = logging.getLogger(__name__)
#: Names tried for the text column, in order.
TEXT_COLUMNS = ("text", "sentence", "content", "document", "kab", "kabyle", "target")


@dataclass(frozen=True)
class Source:
    """One row of the source registry."""

    key: str
    kind: str  # mono, parallel, lexical, dialog or pdf
    path: str
    text_col: str | None = None
    pair_cols: tuple[str, str] | None = None
    data_files: tuple[str, ...] = ()
    weight: float = 1.0
    trust: str = "normal"


def registry_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The registry as a table."""
    rows = [(s.key, s.kind, s.path, s.text_col, s.pair_cols, list(s.data_files), s.weight, s.trust) for s in sources]
    return spark.createDataFrame(rows, "key string, kind string, path string, text_col string, pair_cols struct<other:string,target:string>, data_files array<string>, weight double, trust string")


def of_kind(sources: list[Source], kind: str) -> list[Source]:
    return [s for s in sources if s.kind == kind]


def build_pool(sources: list[Source], only: set[str] | None = None) -> list[Source]:
    """What a corpus build reads: monolingual and parallel sources, or those named in ``only``."""
    return [s for s in sources if s.kind in ("mono", "parallel") and (not only or s.key in only)]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines, CSV or text by extension."""
    base = path.removesuffix(".gz").rstrip("/")
    if base.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if base.endswith(".csv"):
        return spark.read.csv(path, header=True)
    if base.endswith(".txt"):
        return spark.read.text(path).withColumnRenamed("value", "text")
    return spark.read.parquet(path)


def text_column(df: DataFrame, declared: str | None = None, *, sample: int = 200) -> str:
    """The declared column, a usual name, or the string column with most characters in the first rows."""
    if declared and declared in df.columns:
        return declared
    for name in TEXT_COLUMNS:
        if name in df.columns:
            return name
    strings = [c for c, k in df.dtypes if k == "string"]
    if not strings:
        raise ValueError(f"no text column among {df.columns}")
    sizes = df.select(*strings).limit(sample).agg(*(F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c) for c in strings)).first().asDict()
    return max(strings, key=lambda c: sizes[c])


def special_share(df: DataFrame, column: str, profile: LanguageProfile = DEFAULT, *, sample: int = 300) -> DataFrame:
    """One row: share of special letters in the first ``sample`` values, as a ratio of sums."""
    c = F.coalesce(F.col(column), F.lit(""))
    head = df.select(F.regexp_count(c, F.lit(T.class_of(profile.special))).alias("s"), T.letter_count(c).alias("n")).limit(sample)
    return head.agg(F.coalesce(F.try_divide(F.sum("s").cast("double"), F.sum("n")), F.lit(0.0)).alias("share"))


def _place() -> list[Column]:
    """Where a row of a file scan stands: file, block of the file, row."""
    return [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s"), F.monotonically_increasing_id().alias("__r")]


def _first_rows(placed: DataFrame, n: int, *before: str) -> DataFrame:
    """The first ``n`` rows by ``_place``."""
    return placed.orderBy(*before, "__f", "__s", "__r").limit(n)


def load_source(spark: SparkSession, source: Source, *, limit: int | None = None, profile: LanguageProfile = DEFAULT, check_language: bool = True) -> DataFrame | None:
    """(source, text) of one source; None, with a warning, where it can't be read or is off-language.

    Several files are read one by one, since their schemas may differ. Blank texts are dropped.
    ``limit`` takes the first rows in order of files and of places in them, the same in every run.
    """
    try:
        out = None
        for k, path in enumerate(source.data_files or (source.path,)):
            df = read_any(spark, path)
            if source.pair_cols and "translation" in df.columns:
                text = F.coalesce(*(F.col(f"translation.{k}") for k in (source.pair_cols[1], "kab") if k in df.schema["translation"].dataType.names))
            else:
                text = F.col(text_column(df, source.pair_cols[1] if source.pair_cols else source.text_col))
            part = df.select(F.lit(source.key).alias("source"), text.alias("text"), F.lit(k).alias("__k"), *_place())
            out = part if out is None else out.unionByName(part)
        out = out.filter(~T.is_blank(F.col("text")))
        out = (_first_rows(out, limit, "__k") if limit else out).select("source", "text")
        if check_language and special_share(out, "text", profile).first()["share"] < 0.01:
            log.warning("%s skipped: its text column is not in the language", source.key)
            return None
        return out
    except (AnalysisException, Py4JJavaError, ValueError) as e:  # an unreadable source or one without text must not end a build
        log.warning("%s skipped: %s", source.key, str(e)[:200])
        return None


def load_pool(spark: SparkSession, sources: list[Source], **options) -> DataFrame | None:
    """Union of the readable sources."""
    out = None
    for s in sources:
        part = load_source(spark, s, **options)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


def read_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON-lines documents (doc_id, text, source, n_words) with a fixed schema."""
    schema = D.StructType([D.StructField("doc_id", D.LongType()), D.StructField("text", D.StringType()), D.StructField("source", D.StringType()), D.StructField("n_words", D.LongType())])
    df = spark.read.schema(schema).json(path)
    return _first_rows(df.select("*", *_place()), limit).select(*df.columns) if limit else df


def chunk_text(files: DataFrame, *, max_words: int = 400) -> DataFrame:
    """(key, part, chunk, text) of whole texts (key, text): paragraphs, or lines where paragraphs are
    too few, and windows of ``max_words`` white-space words of long ones."""
    df = files.select("key", F.coalesce("text", F.lit("")).alias("t"))
    blank = lambda x: x != ""
    paras = F.filter(F.transform(F.split("t", r"\n[\s\p{Z}]*\n"), T.strip), blank)
    lines = F.filter(F.transform(F.split("t", "\n"), T.strip), blank)
    few = F.size(paras) < F.greatest(F.lit(2), F.floor(F.size(lines) / 20))
    df = df.select("key", F.posexplode(F.when(few, lines).otherwise(paras)).alias("part", "p")).withColumn("w", F.split("p", r"[\s\p{Z}]+"))
    starts = F.when(F.size("w") > max_words, F.sequence(F.lit(0), F.size("w") - 1, F.lit(max_words))).otherwise(F.array(F.lit(0)))
    df = df.select("key", "part", "p", "w", F.posexplode(starts).alias("chunk", "at"))
    text = F.when(F.size("w") > max_words, F.array_join(F.slice("w", F.col("at") + 1, F.lit(max_words)), " ")).otherwise(F.col("p"))
    return df.select("key", "part", "chunk", text.alias("text"))


def local_documents(spark: SparkSession, paths: list[str], *, max_words: int = 400) -> DataFrame:
    """Documents of local text files, split by ``chunk_text``; key is the path."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("text"))
    return chunk_text(files, max_words=max_words)


def read_lines(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Non-blank lines of plain or gzip text; ``limit`` counts lines read, blank ones too."""
    df = spark.read.text(path)
    if limit:
        df = _first_rows(df.select("*", *_place()), limit).select("value")
    return df.filter(~T.is_blank(F.col("value")))


def find_files(spark: SparkSession, roots: list[str], *names: str) -> str | None:
    """First match of the names under the roots, in sorted order, through the Hadoop file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        for root in roots:
            pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/{{{name},*/{name},*/*/{name}}}")
            found = pattern.getFileSystem(conf).globStatus(pattern)
            hits = sorted(f.getPath().toString() for f in found) if found else []
            if hits:
                return hits[0]
    return None


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """PDF spans (doc_id, seq, page, font, text) of ``path``/*.pdf; a document is named by its path.

    Needs a PDF library on the executors; tables of spans are the contract of the decoders.
    """

    def spans(batches: Iterator) -> Iterator:
        import fitz  # optional: PyMuPDF
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                seq = 0
                for number, page in enumerate(fitz.open(stream=content, filetype="pdf")):
                    for block in page.get_text("dict")["blocks"]:
                        for line in block.get("lines", ()) if block.get("type") == 0 else ():
                            for span in line["spans"]:
                                rows.append((name, seq, number, span["font"], span["text"]))
                                seq += 1
                            rows.append((name, seq, number, "", "\n"))
                            seq += 1
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "page", "font", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(spans, "doc_id string, seq long, page int, font string, text string")
