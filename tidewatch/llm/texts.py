"""Arrow plumbing shared by the text operators: whole texts in bounded slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.runtime import ship

SLICE_CHARS = 1_000_000

_KEPT: dict[str, object] = {}


def kept(name: str, build: Callable[[], object]) -> object:
    """A worker's one large table, kept from task to task until another operator's work needs the memory."""
    if name not in _KEPT:
        only(None)
        _KEPT[name] = build()
    return _KEPT[name]


def only(name: str | None) -> None:
    """Give back what other operators have kept in this worker."""
    if any(x != name for x in _KEPT):
        _KEPT.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it gives memory back in its own time
            pass


def slices(batch: pa.RecordBatch, column: int, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch so that each slice has about ``chars`` characters (one row at least); null texts become empty."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= chars):
            size += len(texts[to])
            to += 1
        yield batch.slice(at, to - at), texts[at:to]
        at = to


def map_texts(df: DataFrame, work: Callable[[list[str]], list], fields: list[T.StructField], id_col: str, text_col: str, id_as: str | None = None, keeps: str | None = None, chars: int = SLICE_CHARS, text_as: str | None = None) -> DataFrame:
    """``work`` gets the texts of a slice and returns one column (list or array) per field; ids pass through.

    Only the id and the text column are read, so clashing extra columns do not matter.
    ``keeps``: the name under which ``work`` keeps a table in the worker (:func:`kept`).  ``chars``: of a slice.
    ``text_as``: also return the text, under this name, behind the id.
    """
    ship(df.sparkSession)
    kept = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))
    echo = [T.StructField(text_as, T.StringType())] if text_as else []
    out = T.StructType([T.StructField(id_as or id_col, kept.schema["_id"].dataType), *echo, *fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(keeps)
        for batch in batches:
            for part, texts in slices(batch, 1, chars):
                columns = [*part.columns[: 1 + len(echo)], *work(texts)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.mapInArrow(run, out)
