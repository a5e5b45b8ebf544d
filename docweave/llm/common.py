"""Shared helpers: scratch tables, learning splits and vectorised work on UTF-8 buffers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a single longer text is one step.
STEP_BYTES = 1 << 19


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; on a local master a temporary folder is set where that is unset, elsewhere it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "docweave-scratch")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, so lost executors cost no more than a read."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_join(rows: DataFrame, few: DataFrame, same: Column, left: str, right: str, spread: Column, bound: int = 100_000, salts: int = 32) -> DataFrame:
    """``rows`` with what ``few``, one row a key, has for theirs (left join on ``same``).

    ``few`` is counted: up to ``bound`` rows are broadcast; beyond, both sides are shuffled by the key and a salt drawn from ``spread``, with
    every row of ``few`` under each salt, so that a key of a third of all rows is dealt to many tasks.
    """
    if few.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(few), same, "left")
    salted = rows.withColumn("__salt", F.pmod(spread, F.lit(salts)))
    out = salted.join(few.withColumn("__each", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), same & (F.col("__salt") == F.col("__each")), "left")
    return out.drop("__salt", "__each")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, kept: int) -> Column:
    """True where the remainder is ``kept``; false for a null id, which is never learned from either."""
    return F.coalesce(remainder(doc_id, modulus) == kept, F.lit(False))


def hash_fraction(column: Column, fraction: float, seed: int) -> Column:
    """A repeatable uniform sample by a seeded hash of ``column``."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30)))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without copying, and its offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at


def numbers(column: pa.Array, kind: type = np.int64, seen_as: type = np.uint64) -> list[np.ndarray]:
    """The values of each list, without copying."""
    flat, at = np.asarray(column.flatten(), kind).view(seen_as), np.asarray(column.offsets, np.int64)
    return [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    body, at = utf8(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, body[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    # Workers are used again; what Arrow keeps for later would add up over the stages of a pipeline.
    pa.default_memory_pool().release_unused()


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, for hashes of byte ranges from one running sum."""

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, STEP_BYTES + 2)
            with np.errstate(over="ignore"):
                up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
                up[0] = down[0] = 1
                np.multiply.accumulate(up, out=up)
                np.multiply.accumulate(down, out=down)
            self.up, self.down = up, down
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def running(data: np.ndarray) -> np.ndarray:
    """Running sums of (byte + 1) * base**i, one longer than ``data``."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin])


def word_ranges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the maximal runs of true bytes; none crosses a text's bounds."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = at[1:-1][at[1:-1] < len(inside)]
    before[cuts] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(at, begin, side="right") - 1


#: ASCII letters A-Z to lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
