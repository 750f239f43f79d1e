"""Readers of sequence and model files. Sequences become (read_id, seq); ids follow the order of the file."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.adm import Adm

VALID = "^[ACGTU]+$"
IUPAC_VALID = "^[ACGTUWSMKRYBDHVN]+$"


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("read_id", F.monotonically_increasing_id())


def _checked(df: DataFrame, check: bool) -> DataFrame:
    if check and df.isEmpty():
        raise ValueError("no valid sequences")
    return df


def read_lines(spark: SparkSession, path: str, iupac: bool = False, check: bool = True) -> DataFrame:
    """One sequence a line; empty and other lines are skipped. Raises if none is valid."""
    lines = spark.read.text(path).select(F.upper(F.rtrim(F.regexp_replace("value", "\r$", ""))).alias("seq"))
    return _checked(_numbered(lines.where(F.col("seq").rlike(IUPAC_VALID if iupac else VALID))).select("read_id", "seq"), check)


def bad_lines(spark: SparkSession, path: str, iupac: bool = False) -> int:
    """How many lines ``read_lines`` skips."""
    good = F.upper(F.rtrim(F.regexp_replace("value", "\r$", ""))).rlike(IUPAC_VALID if iupac else VALID)
    return spark.read.text(path).where(~good).count()


def read_fasta(spark: SparkSession, path: str, iupac: bool = False, strict: bool = False, check: bool = True) -> DataFrame:
    """Records of several lines, put together. A record with an invalid line is dropped. A blank line ends a record;
    with ``strict`` it drops it, and what follows up to the next header."""
    valid = IUPAC_VALID if iupac else VALID
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    # what ends a file's last record is the end of its last line, not a blank line
    last = records.groupBy("file").agg(F.max("at").alias("last"))
    ended = F.when(F.col("at") == F.col("last"), F.regexp_replace("value", "\r?\n$", "")).otherwise(F.col("value"))
    records = records.join(last, "file").select("at", ended.alias("value"))
    lines = F.transform(F.split("value", "\r?\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r$", "")))
    records = records.select("at", F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines"))
    if not strict:
        blank = F.array_position("lines", "").cast("int")
        records = records.select("at", F.when(blank > 0, F.slice("lines", F.lit(1), blank - 1)).otherwise(F.col("lines")).alias("lines"))
    upper = F.transform("lines", F.upper)
    records = records.where(F.forall("lines", lambda x: F.upper(x).rlike(valid)) & (F.size("lines") > 0)).select(F.col("at").alias("read_id"), F.array_join(upper, "").alias("seq"))
    return _checked(records, check)


def _line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): lines numbered from 0 within each file, which may be split over tasks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))  # a row a split
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("n"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_fastq(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Strict blocks of four lines: @name, sequence, +, quality of the sequence's length. A block that isn't raises with
    its line (with ``check``); a read with ambiguous bases is skipped."""
    rows = _line_numbers(spark, path)
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    blocks = rows.groupBy("file", F.floor(F.col("n") / 4).alias("b")).agg(part(0).alias("name"), F.upper(part(1)).alias("seq"), part(2).alias("plus"), part(3).alias("quality"))
    good = F.col("name").startswith("@") & F.col("seq").rlike(IUPAC_VALID) & F.col("plus").startswith("+") & (F.length("quality") == F.length("seq"))
    if check:
        wrong = blocks.where(~F.coalesce(good, F.lit(False))).agg(F.min(F.struct("file", "b")).alias("w")).first()["w"]
        if wrong is not None:
            raise ValueError(f"{wrong['file']}: no valid block at line {4 * wrong['b'] + 1}")
    order = blocks.where(good & F.col("seq").rlike(VALID)).repartitionByRange("file", "b").sortWithinPartitions("file", "b")
    return _checked(_numbered(order).select("read_id", "seq"), check)


def read_reads(spark: SparkSession, path: str, iupac: bool = False) -> DataFrame:
    """By extension: .fasta or .fa, .fastq or .fq, .parquet (read_id, seq), else lines."""
    name = path.lower().rstrip("/")
    if name.endswith((".fasta", ".fa")):
        return read_fasta(spark, path, iupac)
    if name.endswith((".fastq", ".fq")):
        return read_fastq(spark, path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path).select("read_id", "seq")
    return read_lines(spark, path, iupac)


def check_alphabet(reads: DataFrame, rna: bool = False) -> None:
    """Raises if a read has another letter than the alphabet's."""
    bad = reads.where(~F.col("seq").rlike("^[ACGU]+$" if rna else "^[ACGT]+$")).limit(1).collect()
    if bad:
        raise ValueError(f"read {bad[0]['read_id']} is not {'RNA' if rna else 'DNA'}")


def _text(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small file, through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"].splitlines() if rows else []


def parse_matrix(lines: list[str]) -> np.ndarray:
    """Rows of numbers, after an optional line such as 4x9; ends where the number of columns changes."""
    rows: list[list[float]] = []
    for line in lines:
        fields = line.split()
        if not fields:
            if rows:
                break
            continue
        if not rows and len(fields) == 1 and "x" in fields[0]:
            continue
        try:
            values = [float(x) for x in fields]
        except ValueError:
            break
        if rows and len(values) != len(rows[0]):
            break
        rows.append(values)
    if not rows:
        raise ValueError("no matrix")
    return np.array(rows)


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return parse_matrix(_text(spark, path))


def parse_adm(lines: list[str]) -> Adm:
    """16 rows of transitions tagged ADM_DI and a pair, and 4 rows of marginals tagged ADM_MONO_ and a base."""
    pairs, singles = {}, {}
    for line in filter(str.strip, lines):
        fields = line.split()
        values = [float(x) for x in fields if _is_number(x)]
        tags = [x for x in fields if not _is_number(x)]
        if tags and tags[0].startswith("ADM_MONO_"):
            singles[tags[0][-1]] = values
        elif tags and tags[0] == "ADM_DI" and len(tags) > 1:
            pairs[tags[1]] = values
        else:
            raise ValueError(f"not a line of a model: {line!r}")
    if len(pairs) != 16 or len(singles) != 4:
        raise ValueError("a model has 20 lines")
    k = len(singles["A"])
    counts = np.zeros((4, 4, k))
    for a, x in enumerate("ACGT"):
        counts[0, a, 0] = singles[x][0]
        for b, y in enumerate("ACGT"):
            counts[a, b, 1:] = pairs[x + y]
    return Adm.from_counts(counts)


def _is_number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def read_adm(spark: SparkSession, path: str) -> Adm:
    return parse_adm(_text(spark, path))


def parse_cob(lines: list[str]) -> dict[tuple[str, int], float]:
    """Header of distances, then a row for each orientation."""
    rows = [x.split() for x in lines if x.strip()]
    distances = [int(x) for x in rows[0]]
    return {(r[0], d): float(v) for r in rows[1:] for d, v in zip(distances, r[1:], strict=True)}


def read_cob(spark: SparkSession, path: str) -> dict[tuple[str, int], float]:
    return parse_cob(_text(spark, path))
