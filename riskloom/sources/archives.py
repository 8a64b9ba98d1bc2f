"""Documents inside archives: zip (also zips within a zip), tar.gz and tar.zst. Archives are read by Spark's own reader and
opened in tasks, one archive each; entries come out one at a time."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document beyond this size is reported without its text.
LARGEST = 5 << 20
ROWS = 64
#: Bounds on what an archive may hold, checked while it is read.
MOST_ENTRIES, MOST_BYTES = 500_000, 20 << 30


class Bounded:
    """A decompressed stream that ends with an error beyond so many bytes."""

    def __init__(self, stream: io.RawIOBase, most: int):
        self.stream, self.left = stream, most

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(min(n, self.left + 1) if n >= 0 else self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise ValueError("more bytes than allowed")
        return data


def _within(found: Iterator[tuple[str, int, bytes | None]], most_entries: int, most_bytes: int) -> Iterator[tuple[str, int, bytes | None]]:
    """The entries while their number and their stated sizes are allowed."""
    total = 0
    for n, entry in enumerate(found, 1):
        total += entry[1]
        if n > most_entries or total > most_bytes:
            raise ValueError("more entries than allowed" if n > most_entries else "more bytes than allowed")
        yield entry


def _part(stream: io.RawIOBase, size: int) -> bytes | None:
    """A document's bytes, inflated up to LARGEST: what states less than it holds is cut off there and is no document."""
    if size > LARGEST:
        return None
    data = stream.read(LARGEST + 1)
    if len(data) != size:
        raise ValueError("an entry is not as long as it says")
    return data


def _zip_entries(raw: bytes, nested: bool) -> Iterator[tuple[str, int, bytes | None]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            if nested and info.filename.endswith(".zip"):
                yield from _zip_entries(z.read(info), False)
            else:
                with z.open(info) as f:
                    yield info.filename, info.file_size, _part(f, info.file_size)


def _tar_entries(raw: bytes, kind: str, most_bytes: int) -> Iterator[tuple[str, int, bytes | None]]:
    """Inflated as it is read: no more of the archive is in memory than one document."""
    if kind == "zst":
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw))
    else:
        stream = gzip.GzipFile(fileobj=io.BytesIO(raw))
    with tarfile.open(fileobj=Bounded(stream, most_bytes), mode="r|") as t:
        for info in t:
            if info.isfile():
                yield info.name, info.size, _part(t.extractfile(info), info.size)


def entries(spark: SparkSession, path: str, kind: str, pattern: str = r".*\.json$", sha256: DataFrame | None = None, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(archive, entry, size, text, error) of the entries whose name matches; ``kind``: zip, nested_zip, gz or zst.

    With ``sha256`` (archive name, sha256) an archive whose digest differs gives one row with an error and no entry, as
    does a damaged one. A null text is an entry beyond LARGEST. An archive with more entries or (inflated) bytes than allowed gives
    the rows up to there and one with an error; so does one of whose entries the size is not what it states.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("archive"), "content")
    files = files.withColumn("digest", F.sha2("content", 256))
    wanted = F.lit(None).cast("string")
    if sha256 is not None:
        files = files.join(sha256.select("archive", F.lower("sha256").alias("wanted")), "archive", "left")
        wanted = F.coalesce("wanted", F.lit("missing"))
    files = files.select("archive", F.when(wanted.isNull() | (wanted == F.col("digest")), F.col("content")).alias("content"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        name = re.compile(pattern)
        shape = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("text", pa.string()), ("error", pa.string())])
        for b in batches:
            for archive, raw in zip(b["archive"].to_pylist(), b["content"].to_pylist(), strict=True):
                out: list[tuple] = []
                try:
                    if raw is None:
                        raise ValueError("digest differs")
                    found = _zip_entries(raw, kind == "nested_zip") if kind.endswith("zip") else _tar_entries(raw, kind, most_bytes)
                    for entry, size, data in _within(found, most_entries, most_bytes):
                        if name.fullmatch(entry):
                            out.append((archive, entry, size, None if data is None else data.decode(errors="replace"), None))
                        if len(out) == ROWS:
                            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, x, strict=True)) for x in out], shape)
                            out = []
                except Exception as e:  # a damaged archive is a row, not a failed job
                    out.append((archive, None, None, None, str(e)[:200]))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(shape.names, x, strict=True)) for x in out], shape)

    return files.mapInArrow(walk, "archive string, entry string, size long, text string, error string")


def advisory_documents(rows: DataFrame, skip: tuple[str, ...] = ("GHSA-", "MAL-")) -> DataFrame:
    """Entries whose file name does not begin with one of the prefixes: those come from another source."""
    name = F.regexp_extract("entry", "([^/]+)$", 1)
    keep = F.col("error").isNull()
    for prefix in skip:
        keep = keep & ~name.startswith(prefix)
    return rows.where(keep)


def verified(documents: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Documents (name, text) with ``error``, null where the digest in the sidecar file (name, text) beside them is theirs.

    A sidecar is named as its document and ``.sha256`` or ``.sha512``, and its first word is the digest; the longer one counts where
    there are both. Documents without one, or with a damaged one, are not verified.
    """
    digest = F.lower(F.regexp_extract("text", r"^\s*([0-9A-Fa-f]+)", 1))
    kept = sidecars.select(F.regexp_extract("name", r"^(.*)\.sha(?:256|512)$", 1).alias("name"), digest.alias("digest"), F.regexp_extract("name", r"(256|512)$", 1).alias("kind")).where("name <> ''")
    one = kept.groupBy("name").agg(F.max(F.struct("kind", "digest")).alias("side"))
    raw = F.col("text").cast("binary")
    own = F.when(F.col("side.kind") == "512", F.sha2(raw, 512)).otherwise(F.sha2(raw, 256))
    error = F.when(F.col("side").isNull(), "no digest").when(~F.coalesce(own == F.col("side.digest"), F.lit(False)), "digest differs")
    return documents.join(one, "name", "left").withColumn("error", error).drop("side")
