"""Readers and writers of manifests, logs, bench documents and reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura import schemas
from tessitura.functions.text import base_name, key_values


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a broken one ends the job with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def required(rows: DataFrame, name: str) -> DataFrame:
    """rows, if there is one; an error that names the manifest otherwise. Reads a row. Missing files are Spark's own error."""
    if rows.isEmpty():
        raise ValueError(f"manifest {name} has no rows")
    return rows


def manifest(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Alias columns folded into their names (the new name wins), rows without a path dropped."""
    for old, new in (aliases or {"sr": "sample_rate", "duration": "duration_sec"}).items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return df.filter(F.col("path").isNotNull() & (F.col("path") != ""))


def bench(spark: SparkSession, path: str) -> DataFrame:
    """(file, config, chunks, summary) of bench documents, one a file."""
    return spark.read.schema(schemas.BENCH).option("multiLine", "true").json(path).select(base_name(F.col("_metadata.file_path")).alias("file"), "config", "chunks", "summary")


def bench_chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk; older names of metrics stand in where the new ones are missing."""
    rows = docs.select("file", F.inline("chunks"))
    alias = {"centroid_hz": "centroid", "rolloff_hz": "rolloff", "active_frac": "active_frame_frac"}
    return rows.withColumns({new: F.coalesce(F.col(new), F.col(old)) for new, old in alias.items()}).drop(*alias.values())


def hypotheses(docs: DataFrame) -> DataFrame:
    """(file, idx, text) of bench documents: the transcript of each chunk, empty where it has none; -1 for no idx; of equal ones the last."""
    rows = docs.select("file", F.posexplode("chunks").alias("at", "c"))
    text = F.coalesce(F.max_by("c.transcript", "at"), F.lit(""))
    return rows.groupBy("file", F.coalesce("c.idx", F.lit(-1)).alias("idx")).agg(text.alias("text"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, fields map) of tab-separated key=value lines."""
    return spark.read.text(path).filter(F.trim("value") != "").select(base_name(F.col("_metadata.file_path")).alias("file"), key_values(F.col("value")).alias("fields"))


def log_line(fields: list[tuple[str, Column]]) -> Column:
    """One line of a log: key=value, tabs in texts become spaces."""
    return F.concat_ws("\t", *[F.concat(F.lit(f"{k}="), F.translate(c.cast("string"), "\t", " ")) for k, c in fields])


def reference_texts(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """(idx, text): `idx<TAB>text` where a line has a tab (bad numbers are dropped), else the line's number from 0."""
    tab = F.instr(F.col(line), "\t") > 0
    idx = F.when(tab, F.try_to_number(F.nullif(F.regexp_extract(F.substring_index(line, "\t", 1), r"^\s*(\d{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int")).otherwise(F.col(number).cast("int"))
    text = F.when(tab, F.substr(F.col(line), F.instr(F.col(line), "\t") + 1)).otherwise(F.col(line))
    return lines.filter(F.trim(F.col(line)) != "").select(idx.alias("idx"), F.trim(text).alias("text")).filter("idx is not null")


def transcripts(lines: DataFrame, line: str = "value") -> DataFrame:
    """(utterance_id, transcript): the first space splits them; of equal ids the last in order of text."""
    at = F.instr(F.col(line), " ")
    rows = lines.filter(at > 0).select(F.substring_index(line, " ", 1).alias("utterance_id"), F.substr(F.col(line), at + 1).alias("transcript"))
    return rows.groupBy("utterance_id").agg(F.max("transcript").alias("transcript"))


def utterance_parts(utterance: Column) -> list[Column]:
    """speaker_id, chapter_id: the first two parts between dashes, null where missing."""
    parts = F.split(utterance, "-")
    return [F.get(parts, F.lit(0)).alias("speaker_id"), F.get(parts, F.lit(1)).alias("chapter_id")]


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", "true").csv(path)


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.write.mode(mode).text(path)
