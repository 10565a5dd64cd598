"""What the corpus operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import scratch, settled

#: The whole-text columns that every stage of the pipeline returns.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` into the shared folder."""
    return settled(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, of which later stages read the columns that they need."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_kept: dict[str, Callable[[], None]] = {}


def begin(owner: str, drop: Callable[[], None] | None = None) -> None:
    """To be called when a task's Python code begins: a worker serves many stages, and drops what other owners keep between their tasks."""
    for other in [o for o in _kept if o != owner]:
        _kept.pop(other)()
        gc.collect()
        pa.default_memory_pool().release_unused()
    if drop is not None:
        _kept[owner] = drop


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few Python strings live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs_of(batches: Iterable[pa.RecordBatch], keys: Iterable[str]) -> Iterator[pa.Table]:
    """The runs of rows that are equal in ``keys``, of batches that are sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *edges.tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def id_crc32(doc_id: int | None) -> int:
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_fold(column: str, modulus: int) -> Column:
    """The same fold in Spark; crc32 of a null id's empty text is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \t\n\v\f\r"]


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).decode("utf-8", "surrogatepass")


def ascii_words(text: str) -> list[str]:
    """Maximal runs of anything but the six ASCII white-space characters, A-Z lower-cased.

    str.split() also splits at other white space and bytes.split() at exactly these six.
    """
    lower = ascii_lower(text)
    if not any(map(lower.__contains__, _OTHER_SPACE)):  # a search for one character is far faster than a pattern's for any
        return lower.split()
    return [w.decode("utf-8", "surrogatepass") for w in lower.encode("utf-8", "surrogatepass").split()]
