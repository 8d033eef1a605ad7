"""Raw CSV exports of mixed header styles."""

from __future__ import annotations

import csv
import fnmatch
import io
import logging
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from telemill.operators.canonical import canonicalize_files
from telemill.schemas import MISSING_CELLS

log = logging.getLogger(__name__)

HEADER_BYTES, MOST_HEADER_BYTES = 16 << 10, 1 << 20  # read of a file to find its header, at first and at most
HEADERS_AT_ONCE = 16
READS = 3  # tries


def list_inputs(spark: SparkSession, inputs: Iterable[str], pattern: str = "*.csv") -> list[str]:
    """Files below the inputs: folders by pattern (sorted), files as they are, each once.

    Files are listed by Spark's binary source, which reads only their metadata here.
    """
    found: dict[str, None] = {}
    for item in inputs:
        try:
            listed = [row[0] for row in spark.read.format("binaryFile").load(item).select("path").collect()]
        except PySparkException as error:
            log.warning("input not found: %s (%s)", item, error.getCondition())
            continue
        is_file = len(listed) == 1 and listed[0].rstrip("/").endswith(item.rstrip("/"))
        kept = listed if is_file else sorted(p for p in listed if fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern))
        found.update(dict.fromkeys(kept))
    return list(found)


def _beginning(spark: SparkSession, path: str, size: int) -> str:
    """Up to ``size`` bytes of a file as text, decompressed by its name's ending; through Hadoop's file systems, as Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    place = hadoop.fs.Path(path)
    stream = place.getFileSystem(settings).open(place)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(settings).getCodec(place)
        read = stream if codec is None else codec.createInputStream(stream)
        return bytes(read.readNBytes(size)).decode("utf-8-sig", "replace")
    finally:
        stream.close()


def _tried(read, path: str) -> str:
    """The result of ``read``, tried again after a failure; the last failure is raised with the file's name."""
    for left in reversed(range(READS)):
        try:
            return read()
        except Py4JJavaError as error:
            if not left:
                raise PySparkException(f"the header of {path} can't be read: {error.java_exception}") from error
    raise AssertionError


def _first_record(text: str, whole: bool) -> tuple[str, ...] | None:
    """The first record that isn't blank, line breaks in quotes included; None if the text may end within it."""
    source = io.StringIO(text, newline="")
    for record in csv.reader(source, strict=False):
        if any(cell.strip() for cell in record):
            return tuple(record) if whole or source.tell() < len(text) else None
    return () if whole else None


def read_headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """Column names of CSV files, by path; blank lines before a header are skipped.

    The driver reads the beginning of each file only: HEADER_BYTES, and up to MOST_HEADER_BYTES where a header is longer.
    A file that can't be read raises: left out here, all its rows would be missing.
    """
    def header(path: str) -> tuple[str, ...]:
        size = HEADER_BYTES
        while True:
            text = _tried(lambda: _beginning(spark, path, size), path)
            whole = len(text.encode("utf-8", "replace")) + 3 < size or size >= MOST_HEADER_BYTES
            record = _first_record(text, whole)
            if record is not None:
                return record
            size = min(size * 8, MOST_HEADER_BYTES)

    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        return {path: found for path, found in zip(paths, pool.map(header, paths)) if found}


def read_csv_group(spark: SparkSession, paths: list[str], header: tuple[str, ...], multiline: bool = True,
                   malformed: Observation | None = None) -> DataFrame:
    """Files of one header as text columns; cells that mean "missing" become null.

    A record may span lines, which makes a file the unit of work; ``multiline=False`` lets Spark split files that are
    known to have one record per line. Surplus cells of a record are dropped, missing ones are null; ``malformed`` observes
    the number of such records, for which every cell is read.
    """
    positions = [f"_{i}" for i in range(len(header))]
    names = positions if malformed is None else [*positions, "_malformed"]
    cells = (spark.read.schema(", ".join(f"{p} STRING" for p in names))
             .csv(paths, header=True, enforceSchema=True, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE",
                  columnNameOfCorruptRecord="_malformed"))
    if malformed is not None:
        cells = cells.observe(malformed, F.count("_malformed").alias("malformed"))
    return cells.select(*[
        F.when(~F.col(p).isin(MISSING_CELLS), F.col(p)).alias(p) for p in positions]).toDF(*header)


def _plain(path: str) -> str:
    """A path as both Spark's file listing and its file metadata write it."""
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/" + unquote(rest).lstrip("/") if colon else "file:/" + unquote(path).lstrip("/")


def scan_raw(spark: SparkSession, inputs: Iterable[str], pattern: str = "*.csv", multiline: bool = True,
             malformed: list[Observation] | None = None) -> list[DataFrame]:
    """One table of text columns per distinct header among the input files; ``malformed`` gets an observation per table.

    Which alias feeds a field depends on the file's header, so files are grouped by header; no job is needed for that.
    """
    paths = list_inputs(spark, inputs, pattern)
    headers = {_plain(path): header for path, header in read_headers(spark, paths).items()}
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = headers.get(_plain(path))
        if header:
            groups.setdefault(header, []).append(path)
        else:
            log.warning("file without a header skipped: %s", path)
    observed = [None] * len(groups) if malformed is None else [Observation() for _ in groups]
    if malformed is not None:
        malformed += observed
    return [read_csv_group(spark, members, header, multiline, o) for (header, members), o in zip(groups.items(), observed)]


def canonicalize_inputs(spark: SparkSession, inputs: Iterable[str], pattern: str = "*.csv",
                        protocols: list[str] | None = None, multiline: bool = True,
                        rejects: list[Observation] | None = None) -> DataFrame:
    """Canonical rows of all input files.

    ``rejects`` gets two observations per distinct header, filled by the first action on the result: ``malformed`` of all
    tables first, then ``rows``, ``no_timestamp`` and ``protocol`` of all tables. The action should read the rows once, like
    a write; what samples them first (a global sort) counts them twice.
    """
    frames = scan_raw(spark, inputs, pattern, multiline, rejects)
    if not frames:
        raise FileNotFoundError(f"no input files match {pattern} in {list(inputs)}")
    return canonicalize_files(frames, protocols, rejects)
