"""Counts over a whole corpus for keys that texts ask about, without a row for each key.

Texts are dealt to batches of a few MB. Each batch sends its sorted distinct 64-bit keys as packed arrays to key ranges, each
range adds up what all batches say and answers every batch in the order it asked, and the batch meets its answers again. So a
key that is in every text costs one entry a batch, a task holds one batch or one range, and nothing reaches the driver.

Ranges grow with the batches. Up to FAN_OUT of them, a batch sends one row to each. Beyond, it sends a row to each of the coarse ranges, about
the square root of their number, where the rows of as many batches are turned over (not unpacked) into one row for each range; answers come
back the same way. So rows grow with the input times that root, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.textnum import U, release

BATCH_BYTES = 2 << 20
RANGE_BYTES = 4 << 20  # of text for each key range
FAN_OUT = 256  # most rows that a batch sends itself, unless the root of the ranges is larger

Stream = tuple[np.ndarray, np.ndarray]  # sorted distinct keys, and a number for each


def packed(a: np.ndarray) -> bytes:
    """Whole numbers below 2**64, byte plane by byte plane."""
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U)


def packed_keys(a: np.ndarray) -> bytes:
    return packed(np.diff(a, prepend=U(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=U)


def summed(keys: np.ndarray, more: np.ndarray | None = None) -> Stream:
    """Sorted distinct keys, and how often each is there or the sum of ``more``."""
    k, at = np.unique(keys, return_inverse=True)
    if more is None:
        return k, np.bincount(at, minlength=len(k)).astype(U)
    total = np.zeros(len(k), U)
    np.add.at(total, at, more.astype(U))
    return k, total


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a long ``key`` for each (id, text); rows that repeat both share it."""
    return docs.withColumn("key", F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text).isNull(), text))


def dealt(docs: DataFrame, n_batches: int) -> DataFrame:
    """``docs`` (with ``key``) with an int ``batch``. Rows that repeat a key are dealt apart by their place in the input, so ``docs`` must
    give its rows in the same order whenever it is read, as tables do."""
    return docs.withColumn("batch", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(n_batches)).cast("int"))


def batches_for(docs: DataFrame, text: str = "text", batch_bytes: int = BATCH_BYTES) -> int:
    """Number of batches: by the bytes of all texts, and enough to use every core."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // batch_bytes))


def released(result: pa.Table) -> pa.Table:
    """``result``, after the memory that making it took is given back: Python workers stay for later stages and would keep it."""
    release()
    return result


_PARTS = "array<array<binary>>"


def _table(columns: dict, parts: list) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()} | {"parts": pa.array(parts, pa.list_(pa.list_(pa.binary())))})


def _turned(asked: DataFrame, wide: int) -> DataFrame:
    """Rows (coarse, batch, parts by range) of ``wide`` batches as rows (range, crowd, batches, parts by batch)."""
    def turn(t: pa.Table) -> pa.Table:
        c, g, parts = t["coarse"][0].as_py(), t["crowd"][0].as_py(), t["parts"].to_pylist()
        n = len(parts[0])
        out = _table({"range": [c * wide + f for f in range(n)], "crowd": [g] * n}, [[p[f] for p in parts] for f in range(n)])
        return out.append_column("batches", pa.array([t["batch"].to_pylist()] * n, pa.list_(pa.int32())))

    return asked.groupBy("coarse", "crowd").applyInArrow(turn, f"range int, crowd int, parts {_PARTS}, batches array<int>")


def _turned_back(told: DataFrame, wide: int) -> DataFrame:
    """Rows (range, crowd, batches, parts by batch, totals) as rows (batch, coarse, parts by range, totals)."""
    def turn(t: pa.Table) -> pa.Table:
        t = t.sort_by("range")
        c, parts, batches = t["coarse"][0].as_py(), t["parts"].to_pylist(), t["batches"].to_pylist()
        at = [{b: k for k, b in enumerate(row)} for row in batches]
        out = _table({"batch": batches[0], "coarse": [c] * len(batches[0])}, [[p[a[b]] for p, a in zip(parts, at, strict=True)] for b in batches[0]])
        totals = np.sum(t["totals"].to_pylist(), axis=0).tolist()
        return out.append_column("totals", pa.array([totals] * len(batches[0]), pa.list_(pa.int64())))

    return (told.withColumn("coarse", F.expr(f"range div {wide}").cast("int")).groupBy("coarse", "crowd")
            .applyInArrow(turn, f"batch int, coarse int, parts {_PARTS}, totals array<bigint>"))


def counted(docs: DataFrame, n_batches: int, ask: Callable[[pa.Table], list[Stream]],
            answer: Callable[[list[list[Stream]]], tuple[list[list[np.ndarray]], list[int]]],
            use: Callable[[pa.Table, list[np.ndarray], list[int]], pa.Table], schema: str, fan_out: int = FAN_OUT) -> DataFrame:
    """Rows that ``use`` makes of each batch of ``docs`` (with a column ``batch``).

    ``ask`` gives the streams of a batch; ``answer`` gets the streams of all batches within one key range and returns for each
    batch and stream one number a key, and totals to be added up over the ranges; ``use`` gets the batch, the answers in the
    order of its keys, and the totals. ``ask`` must give the same keys whatever the order of the rows.
    """
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism * 2, n_batches * BATCH_BYTES // RANGE_BYTES)
    wide = 1 if ranges <= fan_out else max(fan_out, int(np.ceil(np.sqrt(ranges))))  # ranges of a coarse range, batches of a crowd
    coarse = -(-ranges // wide)
    ranges = coarse * wide
    cuts = np.array([(i << 64) // ranges for i in range(1, ranges)], U)

    def asking(t: pa.Table) -> pa.Table:
        streams = ask(t)
        at = [np.concatenate([[0], np.searchsorted(k, cuts), [len(k)]]) for k, _ in streams]
        parts = [[x for (k, m), c in zip(streams, at, strict=True) for x in (packed_keys(k[c[i]:c[i + 1]]), packed(m[c[i]:c[i + 1]]))] for i in range(ranges)]
        b = t["batch"][0].as_py()
        return _table({"coarse": range(coarse), "crowd": [b // wide] * coarse, "batch": [b] * coarse}, [parts[i * wide:(i + 1) * wide] for i in range(coarse)])

    def answering(t: pa.Table) -> pa.Table:
        sent = t["parts"].to_pylist()
        got = [[(unpacked_keys(k), unpacked(m)) for k, m in zip(p[::2], p[1::2], strict=True)] for row in sent for p in row]
        replies, totals = answer(got)
        packs = iter([[packed(x) for x in r] for r in replies])
        return (t.select(["range", "crowd", "batches"]).append_column("parts", pa.array([[next(packs) for _ in row] for row in sent], pa.list_(pa.list_(pa.binary()))))
                .append_column("totals", pa.array([totals] * len(sent), pa.list_(pa.int64()))))

    def using(t: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("coarse")
        replies = [p for row in told["parts"].to_pylist() for p in row]
        streams = [np.concatenate([unpacked(r[s]) for r in replies]) for s in range(len(replies[0]))] if replies else []
        totals = np.sum(told["totals"].to_pylist(), axis=0).tolist()
        return use(t, streams, totals)

    asked = docs.groupBy("batch").applyInArrow(lambda t: released(asking(t)), f"coarse int, crowd int, batch int, parts {_PARTS}")
    if wide > 1:
        asked = _turned(asked, wide)
    else:
        asked = asked.select(F.col("coarse").alias("range"), "crowd", "parts", F.array("batch").alias("batches"))
    told = asked.groupBy("range").applyInArrow(lambda t: released(answering(t)), f"range int, crowd int, batches array<int>, parts {_PARTS}, totals array<bigint>")
    if wide > 1:
        told = _turned_back(told, wide)
    else:
        told = told.select(F.col("batches")[0].alias("batch"), F.col("range").alias("coarse"), "parts", "totals")
    return docs.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(lambda t, told: released(using(t, told)), schema)
