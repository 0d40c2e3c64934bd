"""Raw message ingest.

Files are read with the `binaryFile` source (one row per message, no
recursion; Spark also hides `_`/`.` names).  Headers are parsed on the JVM
from the ISO-8859-1 decoding of the bytes; only the MIME body (S8) needs the
stdlib parser, as an Arrow-batched UDF of the bytes alone — no shuffle.
"""

from __future__ import annotations

import email
import email.message
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decoding import permissive
from ..operators import headers as H

RAW_SCHEMA = "path STRING, dataset STRING, label INT, raw STRING, content BINARY"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _class_folders(spark: SparkSession, root: str, datasets: list[str]) -> list[str]:
    """The class folders that are there; one that is missing is passed over with a warning."""
    paths = []
    for folder in (f"{root.rstrip('/')}/{d}/{c}" for d in datasets for c in ("spam", "ham")):
        if _exists(spark, folder):
            paths.append(folder)
        else:
            warnings.warn(f"no such folder, passed over: {folder}", stacklevel=3)
    return paths


def _dataset() -> Column:
    return F.regexp_extract("path", "/([^/]+)/(spam|ham)/[^/]+$", 1).alias("dataset")


def _labelled(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        _dataset(),
        F.when(F.regexp_extract("path", "/(spam|ham)/[^/]+$", 1) == "spam", 1).otherwise(0).alias("label"),
        F.decode("content", "ISO-8859-1").alias("raw"),
        "content",
    )


def _binary_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths)


def scan_raw(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """`<root>/<dataset>/{spam,ham}/<file>` -> path, dataset, label, raw, content.

    A class folder that is missing is passed over with a warning; datasets
    with no files simply contribute no rows.
    """
    paths = _class_folders(spark, root, datasets)
    return _labelled(_binary_files(spark, paths)) if paths else spark.createDataFrame([], RAW_SCHEMA)


LISTING_SCHEMA = "path STRING, dataset STRING, length LONG, changed TIMESTAMP"


def list_raw(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """The files scan_raw would read: path, dataset, length, changed.  No file is opened."""
    paths = _class_folders(spark, root, datasets)
    if not paths:
        return spark.createDataFrame([], LISTING_SCHEMA)
    return _binary_files(spark, paths).select("path", _dataset(), "length", F.col("modificationTime").alias("changed"))


#: Files up to which scan_files names each one to the reader.
NAMED_FILES = 10_000
_GLOB_SIGNS = re.compile(r"([{}\[\]*?\\])")


def scan_files(spark: SparkSession, root: str, datasets: list[str], listed: DataFrame) -> DataFrame:
    """scan_raw's rows of the files in `listed` (path, changed) only.

    Up to NAMED_FILES are named to the reader, so that no other file is
    opened.  Of more, files older than all of them are passed over by the
    reader, the others by a join on the path.
    """
    some = listed.select("path").limit(NAMED_FILES + 1).collect()
    if not some:
        return spark.createDataFrame([], RAW_SCHEMA)
    if len(some) <= NAMED_FILES:
        return _labelled(_binary_files(spark, [_GLOB_SIGNS.sub(r"\\\1", r.path) for r in some]))
    oldest = listed.agg(F.min("changed")).first()[0]
    files = _binary_files(spark, _class_folders(spark, root, datasets)).where(F.col("modificationTime") >= F.lit(oldest))
    return _labelled(files.join(listed.select("path"), "path", "left_semi"))


FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def _as_messages(files: DataFrame) -> DataFrame:
    return files.select("path", F.decode("content", "ISO-8859-1").alias("raw"), "content")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The files of one folder, without a label: path, raw, content."""
    return _as_messages(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder))


def stream_folder(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The same rows as a stream: every file once, as it arrives in the folder."""
    return _as_messages(spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_a_batch).load(folder))


def _text_parts(message: email.message.Message) -> Iterator[email.message.Message]:
    """A single-part message itself, or the text/plain leaves of a multipart one, in order."""
    if not message.is_multipart():
        yield message
        return
    yield from (p for p in message.walk() if p.get_content_type() == "text/plain" and not p.is_multipart())


def body_with_reason(content: bytes) -> tuple[str, int, str | None]:
    """The text of a message (parts joined by a blank), how many parts could not be decoded, and why the first one.

    A message that the parser itself can't take apart has no text and counts as
    one such part.
    """
    texts, reasons = [], []
    try:
        for part in _text_parts(email.message_from_bytes(content)):
            try:
                octets, charset = part.get_payload(decode=True), part.get_content_charset("latin-1")
            except (LookupError, ValueError) as e:
                reasons.append(type(e).__name__)
                continue
            text, reason = permissive(octets or b"", charset)
            texts.append(text)
            reasons.append(reason)
    except Exception as e:  # noqa: BLE001 - e.g. nested too deep; no message stops a job
        reasons.append(type(e).__name__)
    broken = [r for r in reasons if r]
    return " ".join(t for t in texts if t is not None), len(broken), broken[0] if broken else None


def body_of(content: bytes) -> tuple[str, int]:
    """The text of a message and how many parts could not be decoded."""
    return body_with_reason(content)[:2]


_BODY = T.StructType([T.StructField("body", T.StringType()), T.StructField("undecoded", T.IntegerType()), T.StructField("reason", T.StringType())])


@F.pandas_udf(_BODY)
def _bodies(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([body_with_reason(bytes(c) if c is not None else b"") for c in content], columns=["body", "undecoded", "reason"])


def parse_raw(raw: DataFrame, keep=("dataset", "label")) -> DataFrame:
    """Parsed messages (msg_id, keep, raw, headers, body_text, undecoded_parts, body_error).

    Everything that reads raw messages, training and scoring alike, comes
    through here, so that a model scores the text it was fitted on.
    """
    mime = raw.select(F.col("path").alias("msg_id"), *keep, "raw", _bodies("content").alias("mime"))
    parsed = H.split_message(mime)
    return (parsed.withColumn("body_text", F.col("mime.body")).withColumn("undecoded_parts", F.col("mime.undecoded"))
            .withColumn("body_error", F.col("mime.reason")).drop("mime"))


#: Transfer encodings whose body isn't its own text.
_ENCODED = ["base64", "quoted-printable", "x-uuencode", "uuencode", "uue", "x-uue"]


@F.pandas_udf(_BODY)
def _bodies_of_text(raw: pd.Series) -> pd.DataFrame:
    def octets(text: str) -> bytes:
        try:
            return text.encode("latin-1")  # as scan_raw has decoded it
        except UnicodeEncodeError:
            return text.encode("utf-8", "ignore")

    return pd.DataFrame([(None, 0, None) if r is None else body_with_reason(octets(r)) for r in raw], columns=["body", "undecoded", "reason"])


def parse_text(messages: DataFrame, raw_col: str = "raw") -> DataFrame:
    """parse_raw for messages that are given as text: the same columns, the same body.

    Only a message whose headers announce parts, a charset or a transfer
    encoding needs the MIME parser; any other body is what follows the headers.
    """
    parsed = H.split_message(messages, raw_col)
    kind = F.lower(F.coalesce(H.header_value(F.col("headers"), "content-type"), F.lit("")))
    coding = F.lower(F.trim(F.coalesce(H.header_value(F.col("headers"), "content-transfer-encoding"), F.lit(""))))
    encoded = kind.rlike("^\\s*(multipart|message)/") | kind.contains("charset") | coding.isin(_ENCODED)
    mime = parsed.withColumn("_mime", _bodies_of_text(F.when(encoded, F.col(raw_col))))
    return (mime.withColumn("body_text", F.coalesce("_mime.body", "body_text")).withColumn("undecoded_parts", F.col("_mime.undecoded"))
            .withColumn("body_error", F.col("_mime.reason")).drop("_mime"))


def quarantined(parsed: DataFrame, features: DataFrame) -> DataFrame:
    """msg_id, reason and how many parts could not be read, of messages that training would leave out or read in part."""
    why = features.select("msg_id", "extract_error")
    both = parsed.select("msg_id", "undecoded_parts", "body_error").join(why, "msg_id")
    return both.select("msg_id", F.coalesce("extract_error", "body_error").alias("reason"), "undecoded_parts").where("reason IS NOT NULL OR undecoded_parts > 0")


def _write(df: DataFrame, path: str, partition_by) -> None:
    """Overwrite only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def build_feature_table(spark: SparkSession, root: str, datasets: list[str], cache_path: str | None = None,
                        rebuild: bool = False) -> DataFrame:
    """Feature table, kept as Parquet with a partition for each dataset.

    Only datasets without a partition are built (all of those asked for, if
    rebuild is set), and only their partitions are written.
    """
    def built(some: list[str]) -> DataFrame:
        return H.feature_table(H.header_features(parse_raw(scan_raw(spark, root, some))))

    if not cache_path:
        return built(datasets)
    todo = [d for d in datasets if rebuild or not _exists(spark, f"{cache_path.rstrip('/')}/dataset={d}")]
    if todo:
        _write(built(todo), cache_path, ["dataset"])
    here = [d for d in datasets if _exists(spark, f"{cache_path.rstrip('/')}/dataset={d}")]
    if not here:  # no dataset has a message
        return built([])
    return spark.read.parquet(cache_path).where(F.col("dataset").cast("string").isin(here))


def write_results(df: DataFrame, path: str, partition_by=("dataset",)) -> None:
    """Result sink; partitions that df has no rows for stay as they are."""
    _write(df, path, partition_by)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result source; raises AnalysisException when absent."""
    return spark.read.parquet(path)
