"""Report files -> typed, deduplicated observations."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlens.operators.dedup import keep_last
from stationlens.operators.skew import lookup_join
from stationlens.schema import (
    NUMERIC_COLUMNS,
    REPORT_SCHEMA,
    TEXT_COLUMNS,
    TIME_COLUMNS,
)

# Fixed value: shape of the report time; only the start of the text must match.
VALID_PATTERN = r"^\d+-\d+-\d+ \d+:\d+"
# Fixed value: how the files spell a missing number.
MISSING = "null"
SEQ_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in ("file", "block", "row")])


def _natural(path: str) -> tuple:
    """Sort key that takes runs of digits as numbers: part-99999 before part-100000."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", path))


#: The listing writes ``file:///a`` and the rows write ``file:/a``.
_SLASHES = ":/+"


def _file_order(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Files in the order of the list, those of one entry in natural order of their paths."""
    order: dict[str, int] = {}
    for path in paths:
        for file in sorted(spark.read.text(path).inputFiles(), key=_natural):
            order.setdefault(re.sub(_SLASHES, ":/", file), len(order))
    return order


#: Lines read first of a file in search of its header, and files looked at by one job.
_HEAD_LINES, _HEAD_FILES = 64, 50


def _heads(spark: SparkSession, files: list[str], lines: int) -> DataFrame:
    """The first ``lines`` lines of each file, with the number of the file and the start of the split.

    A file longer than a split is read by one task, split by split: a limit over several
    tasks would take its lines from whichever answers first.
    """
    heads = [
        spark.read.text(unquote(f)).select(F.lit(i).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").coalesce(1).limit(lines)
        for i, f in enumerate(files)
    ]
    return reduce(DataFrame.union, heads)


def _first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that is no comment, by its place; the whole file is read."""
    placed = spark.read.text(unquote(file)).select("value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    real = placed.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return real.agg(F.min_by("value", "place")).first()[0]


def file_headers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """File -> its first line that is no comment.

    A task reads the first lines of its file and no more, so the data is not scanned for
    it; more lines are read only of files that begin with nothing but comments, the whole
    file if its first split holds nothing else. A file without any other line is left out.
    """
    found: dict[str, str] = {}
    lines = _HEAD_LINES
    while files:
        longer = []
        for at in range(0, len(files), _HEAD_FILES):
            part = files[at : at + _HEAD_FILES]
            seen: dict[int, list[str]] = {}
            for row in _heads(spark, part, lines).collect():
                texts = seen.setdefault(row["file"], [])
                if row["block"] == 0:
                    texts.append(row["value"])
            for i, texts in seen.items():
                real = next((t for t in texts if not t.startswith("#") and t.strip(" ")), None)
                if real is None and len(texts) == lines:
                    longer.append(part[i])
                    continue
                real = _first_line(spark, part[i]) if real is None else real
                if real is not None:
                    found[part[i]] = real
        files, lines = longer, lines * 16
    return found


def _read_one_header(spark: SparkSession, header: str, files: list[str], paths: list[str], missing: str) -> DataFrame:
    """Files of one header with the fields picked by name; of equal names the last one counts."""
    names = {name.strip(): i for i, name in enumerate(next(csv.reader([header.lstrip("\ufeff")])))}
    absent = [c for c in REPORT_SCHEMA.names if c not in names]
    if absent and missing != "null":
        raise ValueError(f"{files[0]}: no column {', '.join(absent)}")
    width = len(next(csv.reader([header])))
    rows = (
        spark.read.schema(T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)]))
        .option("header", True)
        .option("comment", "#")
        .option("quote", '"')
        .option("escape", '"')
        .csv(paths)
    )
    fields = [F.col(f"_c{names[c]}").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in REPORT_SCHEMA.names]
    return rows.select(
        *fields,
        F.regexp_replace("_metadata.file_path", _SLASHES, ":/").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_reports(spark: SparkSession, path: str | list[str], missing: str = "error") -> DataFrame:
    """All fields as text, plus ``_seq``: where in the files the row stands.

    Fields are found by the names in each file's header; further columns are ignored. A
    file without one of the fields is an error, or gives NULL with ``missing="null"``.

    Files of a list stand in the order of the list, files of a folder or pattern in the
    natural order of their paths. Files are split, so position is (number of the file,
    start of split, row within split); it is only compared, never turned into a global number.
    """
    paths = [path] if isinstance(path, str) else list(path)
    order = _file_order(spark, paths)
    headers: dict[str, list[str]] = {}
    for file, header in file_headers(spark, list(order)).items():
        headers.setdefault(header, []).append(file)
    rows = None
    for header, files in sorted(headers.items()):
        own = paths if len(headers) == 1 else [unquote(f) for f in sorted(files)]
        part = _read_one_header(spark, header, sorted(files), own, missing)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], T.StructType([*REPORT_SCHEMA.fields, T.StructField("_seq", SEQ_TYPE)]))
    numbers = spark.createDataFrame(list(order.items()), "_file string, _number long")
    placed = lookup_join(rows, numbers, len(order), ["_file"], ["_row"])
    position = F.struct(F.col("_number").alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row"))
    return placed.select(*REPORT_SCHEMA.names, position.alias("_seq"))


def time_parts(valid: Column) -> dict[str, Column]:
    """Year, month, day, hour and minute as integers, and the timestamp they form.

    ``ts`` is NULL when the parts are no real time; ANSI-safe.
    """
    pieces = F.split(F.regexp_extract(valid, VALID_PATTERN, 0), "[- :]")
    parts = {name: F.get(pieces, i).try_cast("int") for i, name in enumerate(TIME_COLUMNS)}
    parts["ts"] = F.try_make_timestamp_ntz(*parts.values(), F.lit(0))
    return parts


def number(text: Column) -> Column:
    """Text as a 32-bit number; anything that is not a finite number is NULL.

    The usual spelling of a missing number is sorted out first: a failing cast
    is far more expensive than a comparison.
    """
    value = F.when(text != MISSING, text).try_cast("float")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


# Names of the reasons a row is left out, in the order they are tested.
REJECT_REASONS = ("bad_time", "no_location", "no_station", "impossible_time")


def reject_reason(ts: Column) -> Column:
    """Why a raw row is left out, NULL when it is kept."""
    timed = F.coalesce(F.col("valid").rlike(VALID_PATTERN), F.lit(False))
    tests = (~timed, _empty(F.col("lon")) | _empty(F.col("lat")), _empty(F.col("station")), ts.isNull())
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in zip(tests, REJECT_REASONS)])


def parse_reports(raw: DataFrame) -> DataFrame:
    """Typed columns of every row and ``reject_reason`` (NULL when it is kept)."""
    return raw.withColumns(time_parts(F.col("valid"))).select(
        "station",
        "ts",
        F.to_date("ts").alias("day"),
        *TIME_COLUMNS,
        *[number(F.col(c)).alias(c) for c in NUMERIC_COLUMNS],
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in TEXT_COLUMNS],
        F.col("peak_wind_time").alias("peak_wind_time_raw"),
        "_seq",
        reject_reason(F.col("ts")).alias("reject_reason"),
    )


def observations(raw: DataFrame) -> DataFrame:
    """Accepted rows, one per (station, minute): the last one in file order."""
    accepted = parse_reports(raw).filter("reject_reason is null").drop("reject_reason")
    return keep_last(accepted, ["station", "ts"])


def ingest_quality(raw: DataFrame) -> DataFrame:
    """(reason, n): accepted rows, rejected rows by reason, unreadable numbers by column.

    Everything is counted in one pass over the input.
    """
    judged = raw.withColumn("_reason", reject_reason(time_parts(F.col("valid"))["ts"]))
    accepted = F.col("_reason").isNull()

    def unreadable(c):
        text = F.col(c)
        return accepted & text.isNotNull() & (text != MISSING) & (text != "") & number(text).isNull()

    counters = {
        "accepted": accepted,
        **{r: F.col("_reason") == r for r in REJECT_REASONS},
        **{f"unreadable {c}": unreadable(c) for c in NUMERIC_COLUMNS},
    }
    totals = judged.agg(*[F.count_if(cond).alias(name) for name, cond in counters.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(f"`{n}`").alias("n")) for n in counters])
    return totals.select(F.explode(pairs).alias("c")).select("c.reason", "c.n")
