"""The extraction pipeline: files or bytes to results, with stages that plug-ins extend. Runs in batch and on streams."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import os
import signal
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import classify, quality, reduction, text
from foliospark.operators import chunking, elements, keywords, render
from foliospark.operators.language import detect_languages
from foliospark.session import ship_package
from foliospark.sources import formats

STAGES = ("early", "middle", "late")


@dataclass(frozen=True)
class KeywordConfig:
    """Keyword settings."""

    algorithm: str = "yake"
    max_keywords: int = 10
    min_score: float = 0.0
    language: str = "en"


@dataclass(frozen=True)
class ExtractionConfig:
    """Settings of a run; what is None or False is left out."""

    enable_quality_processing: bool = True
    chunking: chunking.ChunkConfig | None = None
    keywords: KeywordConfig | None = None
    language_detection: bool = False
    detect_multiple: bool = False
    min_confidence: float = 0.8
    token_reduction: str = "off"
    max_archive_depth: int = 3
    output_format: str = "plain"
    include_elements: bool = False
    enabled_processors: tuple[str, ...] | None = None
    disabled_processors: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> ExtractionConfig:
        """Settings from plain data; unknown names are an error."""
        data = dict(data)
        if isinstance(data.get("chunking"), dict):
            data["chunking"] = chunking.ChunkConfig(**data["chunking"])
        if isinstance(data.get("keywords"), dict):
            data["keywords"] = KeywordConfig(**data["keywords"])
        for k in ("enabled_processors", "disabled_processors"):
            if isinstance(data.get(k), list):
                data[k] = tuple(data[k])
        return cls(**data)

    @classmethod
    def from_file(cls, path: str) -> ExtractionConfig:
        """Settings from a JSON, TOML or YAML file; variables FOLIOSPARK_<NAME> go before them."""
        from foliospark.sources.structured import parse_data

        with open(path, encoding="utf-8") as f:
            kind = {"toml": "toml", "json": "json"}.get(path.rsplit(".", 1)[-1], "yaml")
            return cls.from_dict((parse_data(f.read(), kind) or {}) | _environment())

    def merged(self, override: dict[str, Any]) -> ExtractionConfig:
        """These settings with those of one file before them; None overrides nothing."""
        return ExtractionConfig.from_dict(dataclasses.asdict(self) | {k: v for k, v in override.items() if v is not None})

    def key(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True, default=str)


def _environment() -> dict[str, Any]:
    names = {f.name for f in dataclasses.fields(ExtractionConfig)}
    return {k[11:].lower(): json.loads(v) for k, v in os.environ.items() if k.startswith("FOLIOSPARK_") and k[11:].lower() in names}


@dataclass(frozen=True)
class Processor:
    """A post-processor: a function of the frame in a stage; the higher priority goes first.

    ``should_process`` looks at the settings, ``applies`` at the results so far: rows where it does not hold go past.
    """

    name: str
    function: Callable[[DataFrame, ExtractionConfig], DataFrame]
    stage: str = "middle"
    priority: int = 50
    should_process: Callable[[ExtractionConfig], bool] = lambda config: True
    applies: Callable[[], Column] | None = None
    initialize: Callable[[], None] | None = None
    shutdown: Callable[[], None] | None = None

    def run(self, df: DataFrame, config: ExtractionConfig) -> DataFrame:
        if self.applies is None:
            return self.function(df, config)
        fits = F.coalesce(self.applies(), F.lit(False))
        return self.function(df.where(fits), config).unionByName(df.where(~fits), allowMissingColumns=True)


@dataclass(frozen=True)
class Validator:
    """A check: rows that fail are an error, or go aside."""

    name: str
    condition: Callable[[], Column]
    priority: int = 50
    abort: bool = True


@dataclass
class Registry:
    """The plug-ins of a run."""

    processors: list[Processor] = field(default_factory=list)
    validators: list[Validator] = field(default_factory=list)

    def __enter__(self) -> Registry:
        """Starts the plug-ins; one whose start fails is an error."""
        for p in self.processors:
            if p.initialize:
                p.initialize()
        return self

    def __exit__(self, *error) -> None:
        for p in reversed(self.processors):
            if p.shutdown:
                p.shutdown()

    def active(self, config: ExtractionConfig) -> list[Processor]:
        """Processors in their order; an allow list goes before a deny list."""
        allowed, denied = config.enabled_processors, config.disabled_processors
        some = [p for p in self.processors if (p.name in allowed if allowed is not None else p.name not in denied) and p.should_process(config)]
        return sorted(some, key=lambda p: (STAGES.index(p.stage), -p.priority, p.name))


_EXTRACTED = "content string, metadata map<string,string>, tables array<array<array<string>>>, children array<struct<path: string, content: binary>>, error string"


@contextlib.contextmanager
def deadline(seconds: float | None):
    """Ends what runs inside after so many seconds by TimeoutError (in the main thread of a process, as in Python workers)."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"no result within {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(df: DataFrame, content_col: str = "content", mime_col: str = "mime_type", timeout: float | None = None) -> DataFrame:
    """Adds the struct ``result`` (content, metadata, tables, children, error) to rows with bytes and a media type.

    A file that cannot be read, is null, has an unknown type or takes more than ``timeout`` seconds gives an error row,
    never an exception.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf(_EXTRACTED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, mimes in batches:
            rows = []
            for d, m in zip(data, mimes, strict=True):
                try:
                    if d is None or m is None:
                        raise formats.ExtractionError("no content" if d is None else "no media type")
                    with deadline(timeout):
                        e = formats.extract_bytes(bytes(d), m)
                    rows.append((e.content, e.metadata, e.tables, [{"path": p, "content": c} for p, c in e.children], None))
                except Exception as ex:  # noqa: BLE001
                    rows.append((f"Error: {ex}", {"error": str(ex)}, [], [], str(ex)))
            yield pd.DataFrame(rows, columns=["content", "metadata", "tables", "children", "error"])

    return df.withColumn("result", run(F.col(content_col), F.col(mime_col)))


def extract_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Results of all files below a folder: path, length, modified, mime_type, result."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"), classify.mime_of_path(F.col("path")).alias("mime_type"), "content")
    return extract(files).drop("content")


def unpack(df: DataFrame, depth: int = 3) -> DataFrame:
    """Results with those of the files inside them, down to a depth: path (parts joined by ``!``), depth, mime_type, result."""
    level = df.select("path", F.lit(0).alias("depth"), "mime_type", "result")
    out = level
    for d in range(1, depth + 1):
        inner = level.select("path", F.explode("result.children").alias("c"))
        inner = inner.select(F.concat_ws("!", "path", "c.path").alias("path"), F.lit(d).alias("depth"), classify.mime_of_path(F.col("c.path")).alias("mime_type"), F.col("c.content").alias("content"))
        level = extract(inner).select("path", "depth", "mime_type", "result")
        out = out.unionByName(level)
    return out


def extract_batch(spark: SparkSession, paths: list[str], timeout: float | None = None) -> DataFrame:
    """Results of listed files: ordinal (place in the list), path, mime_type, result. Sort by ordinal for the order of the list.

    A path that does not exist gives an error row; one that is listed twice has two.
    """
    items = spark.createDataFrame(list(enumerate(paths)), "ordinal bigint, asked string")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    full = {}
    for p in dict.fromkeys(paths):  # the list is the caller's and on the driver already
        at = hadoop(p)
        at = at.getFileSystem(conf).makeQualified(at)
        if at.getFileSystem(conf).exists(at):
            full[p] = at.toString()
    if full:
        files = spark.read.format("binaryFile").load(list(full.values())).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "content")
    else:
        files = spark.createDataFrame([], "path string, content binary")
    known = spark.createDataFrame([(p, f) for p, f in full.items()], "asked string, path string").withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    rows = items.join(known, "asked", "left").join(files, "path", "left").withColumn("mime_type", classify.mime_of_path(F.col("asked")))
    return extract(rows, timeout=timeout).select("ordinal", F.col("asked").alias("path"), "mime_type", "result")


def _keywords(df: DataFrame, config: ExtractionConfig) -> DataFrame:
    k = config.keywords
    pick = {"yake": keywords.yake, "rake": keywords.rake}[k.algorithm]

    @F.pandas_udf("array<struct<keyword: string, score: double>>")
    def find(s: pd.Series) -> pd.Series:
        few = lambda t: t is None or len(t.split()) < keywords.LEAST_WORDS
        return s.map(lambda t: [] if few(t) else [{"keyword": w, "score": float(x)} for w, x in pick(t, k.language, k.max_keywords, least=k.min_score)])

    return df.withColumn("keywords", find(F.col("content")))


#: The processors that are always there.
BUILT_IN = [
    Processor("quality", lambda df, c: df.withColumn("quality_score", quality.quality_score(F.col("content"))), "early", 30, lambda c: c.enable_quality_processing),
    Processor("keywords", _keywords, "middle", 40, lambda c: c.keywords is not None),
]


def run_pipeline(df: DataFrame, config: ExtractionConfig | None = None, id_col: str = "doc_id", text_col: str = "text", registry: Registry | None = None) -> DataFrame:
    """Texts through all configured stages, in this order: normal form; processors, early, middle and late, with quality
    (early) and keywords (middle) among them; chunks; languages; reduction; validators; elements; output format.

    Columns: id, content, and by configuration quality_score, keywords, chunks, detected_languages, reduced, elements;
    ``warnings`` lists what was left out. Every stage is row-wise, so the same call works on a stream. Null texts pass with
    nulls. A validator that aborts ends the run, whichever columns are read.
    """
    ship_package(df.sparkSession)
    config, registry = config or ExtractionConfig(), registry or Registry()
    out = df.select(df[id_col].alias("id"), text.nfc(df[text_col]).alias("content"))
    for p in Registry([*BUILT_IN, *registry.processors]).active(config):
        out = p.run(out, config)
    content = F.col("content")
    warnings = [F.when(F.length(F.trim(content)) == 0, F.lit("empty content"))]
    if config.keywords is not None:
        warnings.append(F.when(text.word_count(content) < keywords.LEAST_WORDS, F.lit("too short for keywords")))
    if config.chunking is not None:
        c = config.chunking

        @F.pandas_udf("array<struct<chunk_index: int, char_start: int, char_end: int, content: string>>")
        def cut(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else [{"chunk_index": j, "char_start": a, "char_end": b, "content": t[a:b]} for j, (a, b) in enumerate(chunking.semantic_slices(t, c))])

        out = out.withColumn("chunks", cut(content))
    if config.language_detection:
        out = out.withColumn("detected_languages", detect_languages(content, config.min_confidence, config.detect_multiple))
    if reduction.level_of(config.token_reduction) != "off":
        language = config.keywords.language if config.keywords else "en"
        out = out.withColumn("reduced", reduction.reduce_text(content, config.token_reduction, language))
    for v in sorted(registry.validators, key=lambda v: -v.priority):
        ok = F.coalesce(v.condition(), F.lit(False))
        if v.abort:  # as a filter, which no pruning of columns removes
            out = out.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"validator {v.name} failed")).cast("boolean")))
        else:
            warnings.append(F.when(~ok, F.lit(f"validator {v.name} failed")))
    out = out.withColumn("warnings", F.array_compact(F.array(*warnings)))
    if config.include_elements or config.output_format != "plain":

        @F.pandas_udf("array<struct<kind: string, level: int, text: string>>")
        def split(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else [{"kind": k, "level": v, "text": x} for k, v, x in elements.split_elements(t)])

        out = out.withColumn("elements", split(content))
        if config.output_format != "plain":
            out = out.withColumn("content", render.render(F.col("elements"), config.output_format))
        if not config.include_elements:
            out = out.drop("elements")
    return out


#: Different overrides that one run may have; each is a plan of its own.
MAX_OVERRIDES = 100


def run_with_overrides(df: DataFrame, override: Column, config: ExtractionConfig | None = None, id_col: str = "doc_id", text_col: str = "text", registry: Registry | None = None) -> DataFrame:
    """The pipeline where every row may override settings: ``override`` is a JSON object of them, or null.

    Rows with the same override run together; columns that a row's settings do not make are null. More than
    MAX_OVERRIDES different ones are an error.
    """
    config = config or ExtractionConfig()
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.coalesce(override, F.lit("{}")).alias("override"))
    found = [r[0] for r in rows.select("override").distinct().limit(MAX_OVERRIDES + 1).collect()]
    if len(found) > MAX_OVERRIDES:
        raise ValueError(f"more than {MAX_OVERRIDES} different overrides")
    parts = [run_pipeline(rows.where(F.col("override") == o), config.merged(json.loads(o)), "id", "text", registry) for o in sorted(found)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else run_pipeline(rows, config, "id", "text", registry)


def cached_results(df: DataFrame, cache: DataFrame | None, config: ExtractionConfig) -> tuple[DataFrame, DataFrame]:
    """Rows with their cache key, split into those still to do (an anti-join) and the cached results of the others."""
    keyed = df.withColumn("cache_key", classify.content_key(F.col("content"), F.col("mime_type"), config.key()))
    if cache is None:
        return keyed, keyed.where(F.lit(False))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti"), keyed.select("cache_key").join(cache, "cache_key")


class ResultCache:
    """Results in a shared folder of Parquet files by day: key, size and time of the source, when they were made.

    A result is valid while it is younger than its time to live (a row's own before the cache's) and its source has the
    size and time it had. All clocks are parameters in seconds, so that runs can be repeated.
    """

    SCHEMA = "cache_key string, namespace string, result string, size bigint, modified bigint, made_at bigint, ttl bigint, day bigint"

    def __init__(self, spark: SparkSession, folder: str, ttl: int = 30 * 86_400):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], self.SCHEMA)

    def valid(self, now: int) -> DataFrame:
        age = F.lit(now) - F.col("made_at")
        rows = self.read().where(age <= F.coalesce("ttl", F.lit(self.ttl)))
        newest = F.max_by(F.struct("result", "size", "modified", "made_at"), "made_at").alias("r")
        return rows.groupBy("namespace", "cache_key").agg(newest).select("namespace", "cache_key", "r.*")

    def split(self, df: DataFrame, now: int, namespace: str = "") -> tuple[DataFrame, DataFrame]:
        """Rows (cache_key, size, modified) still to do, and those whose result is valid, with it."""
        hits = self.valid(now).where(F.col("namespace") == namespace).select("cache_key", "result", F.col("size").alias("s"), F.col("modified").alias("m"))
        same = hits.join(df, "cache_key").where(F.col("s").eqNullSafe(F.col("size")) & F.col("m").eqNullSafe(F.col("modified"))).drop("s", "m")
        return df.join(same.select("cache_key"), "cache_key", "left_anti"), same

    def write(self, results: DataFrame, now: int, namespace: str = "", ttl: int | None = None) -> None:
        """Adds results (cache_key, result, size, modified)."""
        rows = results.select("cache_key", F.lit(namespace).alias("namespace"), F.col("result").cast("string").alias("result"), "size", "modified", F.lit(now).cast("bigint").alias("made_at"), F.lit(ttl).cast("bigint").alias("ttl"))
        rows.withColumn("day", F.floor(F.col("made_at") / 86_400)).write.mode("append").partitionBy("day").parquet(self.folder)

    def cleanup(self, now: int) -> int:
        """Drops the days whose results are all too old; how many were dropped."""
        rows = self.read().groupBy("day").agg(F.max(F.col("made_at") + F.coalesce("ttl", F.lit(self.ttl))).alias("until"))
        old = [r["day"] for r in rows.where(F.col("until") < now).collect()]
        for day in old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/day={day}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(old)

    def stats(self) -> DataFrame:
        """Results and their bytes by namespace."""
        return self.read().groupBy("namespace").agg(F.count("*").alias("n"), F.sum(F.octet_length("result")).alias("bytes"), F.min("made_at").alias("oldest"))
