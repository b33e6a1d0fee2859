"""Minimal perfect hashes over 64-bit keys, arrays of counts by slot, and their sums over all tasks in a tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of an array that travel together, and arrays that a task of a tree sums.
CHUNK = 1 << 18
FAN_IN = 16
#: Bits of a level for each key left.
_ROOM = 2
_ZSTD = pa.Codec("zstd", compression_level=1)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well mixed 64-bit hashes of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """n different keys and a slot from 0 to n - 1 for each.

    Levels of bits: a key that is alone at its place of a level has the bit there, the others go on to the next level;
    its slot is the number of bits before its own. `keys` holds the key of each slot, so a key that isn't in the table
    is recognised for sure.
    """

    levels: list[np.ndarray]
    keys: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys, np.uint64), []
        while len(left):
            place = mixed(left, len(levels)) % np.uint64(_ROOM * len(left) + 1)
            alone = np.bincount(place.astype(np.int64), minlength=_ROOM * len(left) + 1) == 1
            levels.append(alone)
            left = left[~alone[place]]
        self = cls(levels, np.zeros(0, np.uint64))
        self._count()
        found = self._slots(np.asarray(keys, np.uint64))
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[found] = keys
        return self

    def _count(self) -> None:
        """The number of bits before each place of each level."""
        self.before, n = [], 0
        for bits in self.levels:
            ends = np.cumsum(bits, dtype=np.int32)
            self.before.append(ends - bits + n)
            n += int(ends[-1])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if no level has it; a key that isn't in the table may get any."""
        out = np.full(len(keys), -1, np.int32)
        rest = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            place = mixed(keys[rest], i) % np.uint64(len(bits))
            here = bits[place]
            out[rest[here]] = self.before[i][place[here]]
            rest = rest[~here]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those not in the table: the stored key decides."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        found = self._slots(keys)
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1)

    def to_bytes(self) -> tuple[list[bytes], list[int], bytes]:
        return [np.packbits(x).tobytes() for x in self.levels], [len(x) for x in self.levels], self.keys.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, levels: list[bytes], sizes: list[int], keys: bytes) -> PerfectHash:
        self = cls([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(levels, sizes, strict=True)], np.frombuffer(keys, "<u8"))
        self._count()
        return self


ARRAYS = "task int, chunk int, data binary"


def squeeze(numbers: np.ndarray) -> bytes:
    raw = numbers.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little")), "<i8")


def chunks_of(task: int, numbers: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The chunks of an array of 64-bit counts that aren't all zero."""
    for at in range(0, len(numbers), CHUNK):
        few = numbers[at : at + CHUNK]
        if few.any():
            yield task, at // CHUNK, squeeze(few)


def tree_sum(arrays: DataFrame) -> DataFrame:
    """(chunk, data): the sums of the arrays of all tasks (task int, chunk int, data binary), chunk by chunk, FAN_IN arrays at a time; the tree has as many levels as the number of tasks asks for. Chunks that are zero everywhere have no row."""
    tasks = (arrays.agg(F.max("task")).first()[0] or 0) + 1

    def add(group: pa.Table) -> pa.Table:
        total = sum(unsqueeze(x) for x in group["data"].to_pylist())
        return pa.table({"task": group["parent"].slice(0, 1), "chunk": group["chunk"].slice(0, 1), "data": pa.array([squeeze(total)], pa.binary())})

    while True:
        parents = arrays.select(F.floor(F.col("task") / FAN_IN).cast("int").alias("parent"), "chunk", "data")
        arrays = parents.groupBy("parent", "chunk").applyInArrow(add, ARRAYS)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return arrays.select("chunk", "data")
