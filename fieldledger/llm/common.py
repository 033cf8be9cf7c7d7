"""Helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of the documents table; operators pass further columns through where they return documents.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row: Catalyst would copy it to each place of use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows kept from learning: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out_id(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


#: What a worker process keeps between tasks, by operator.
_caches: dict[str, list] = {}
_turn = [""]


def cache(owner: str, kept):
    """Registers a container that the owner's tasks fill."""
    _caches.setdefault(owner, []).append(kept)
    return kept


def trim() -> None:
    """Gives memory that is free in this process back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def take_turn(owner: str) -> None:
    """Empties what other operators' tasks have left in this worker process, which Spark uses again for every stage."""
    if _turn[0] == owner:
        return
    _turn[0] = owner
    for name, kept in _caches.items():
        if name != owner:
            for c in kept:
                c.clear()
    gc.collect()
    trim()


def small_batches(batches, rows: int = 1000):
    """Batches in slices, so that few rows are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def crc_ids(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
