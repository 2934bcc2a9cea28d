"""Documents gathered into compressed chunks of a few MB, and numpy helpers to exchange keyed values with them.

A chunk is a row (chunk, ids, offsets, data, n_bytes, rest); ``rest`` lists the
other columns of its documents.  Operators that must ask the whole corpus about
the strings of a text send each chunk's sorted distinct codes to buckets and get
an array of the same order back, so texts are read in place and hot strings are
counted once per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import stored
from placetrace.llm.textkit import text_buffer

LAST = (1 << 63) - 1


# Level for texts: they are stored once and shuffled several times.
TEXT_LEVEL = 5


def pressed(*arrays, level=1):
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def gather(chunk_bytes):
    """mapInArrow: documents as rows of about ``chunk_bytes``."""

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made():
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = text_buffer(table.column("text"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            ids = table.column("doc_id").fill_null(LAST).to_numpy()
            rest = table.column("rest").combine_chunks()
            values = [
                pa.array([number]),
                pa.array([pressed(ids)], pa.binary()),
                pa.array([pressed(offsets)], pa.binary()),
                pa.array([pressed(data, level=TEXT_LEVEL)], pa.binary()),
                pa.array([len(data)]),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), rest),
            ]
            return pa.record_batch(values, names=["chunk", "ids", "offsets", "data", "n_bytes", "rest"])

        for batch in batches:
            lengths = np.diff(text_buffer(batch.column("text"))[1])
            start = 0
            for i, n in enumerate(lengths.tolist()):
                size += n + 64
                if size >= chunk_bytes:
                    held.append(batch.slice(start, i + 1 - start))
                    yield made()
                    number, held, size, start = number + 1, [], 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield made()

    return run


def unpressed(value, dtype):
    return np.frombuffer(zstandard.decompress(value), dtype)


def rows_of(batch):
    """The rows of a batch as dicts, one at a time: a chunk is large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def bucket_of(codes, n):
    return ((codes >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def split_by(order_key, n):
    """Positions of each bucket that occurs, each in ascending order of position."""
    order = np.argsort(order_key, kind="stable")
    cuts = np.flatnonzero(np.diff(order_key[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(order_key[part[0]]), part


def packed_rows(rows, names):
    columns = list(zip(*rows, strict=True))
    kinds = [pa.binary() if isinstance(c[0], bytes) else pa.int64() for c in columns]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunk table of ``docs`` in the shared checkpoint folder; all columns but doc_id and text go into rest."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.struct(F.lit(0).alias("none"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest")
    )
    kind = rows.schema["rest"].dataType.simpleString()
    columns = "chunk long, ids binary, offsets binary, data binary, n_bytes long"
    return stored(rows.mapInArrow(gather(chunk_bytes), f"{columns}, rest array<{kind}>"))
