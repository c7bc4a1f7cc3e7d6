"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last WINDOW bytes. A place whose hash ends in k zero bits ends a chunk at block size 2**k, so the boundaries of
a block size are among those of all smaller ones, and an edit moves only the boundaries near it. The block size of a text is the smallest
that leaves at most CHUNKS chunks; nothing is cut off. The fingerprint has the chunk signatures (12 bits a chunk, two characters) at this
block size and the next: ``k:signature:signature``. Fingerprints are compared at the block sizes that both have, by edit distance over chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.textnum import BASE, U, ddl, mixed, prefix_sums, range_hash, runs_of_rows, slices, text_bytes
from sparkfolio.session import persisted

WINDOW = 7  # bytes that decide a boundary
CHUNKS = 64  # most chunks of a signature; also the bits of the words that compare them
LEVELS = 48
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)

Fingerprint = tuple[int, np.ndarray, np.ndarray]  # k, and the chunks' 12-bit hashes at 2**k and 2**(k + 1)


def _levels(b: np.ndarray, sums: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, the zero bits its rolling hash ends in; -1 where the window does not fit into the row."""
    out = np.full(len(b), -1, np.int64)
    if len(b) >= WINDOW:
        at = np.arange(len(b) - WINDOW + 1)
        h = mixed(range_hash(sums, at, at + WINDOW) ^ U(BASE))
        low = h & (~h + U(1))
        out[WINDOW - 1:] = np.where(h > 0, np.log2(np.maximum(low, U(1)).astype(np.float64)), LEVELS - 1).astype(np.int64)
        for d in range(WINDOW - 1):
            head = offs[:-1] + d
            out[head[head < offs[1:]]] = -1
    return np.minimum(out, LEVELS - 1)


def fingerprints(col) -> list[Fingerprint]:
    """The fingerprint of each text of an Arrow column; null is empty, and an empty text has no chunks."""
    buf, offs = text_bytes(col)
    out: list[Fingerprint] = []
    for i, j in runs_of_rows(offs):
        b, at = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        sums = prefix_sums(b)
        level = _levels(b, sums, at)
        ends = np.flatnonzero(level >= 0)
        row = np.searchsorted(at, ends, side="right") - 1
        ends, level = ends + 1, level[ends]
        inner = ends < at[row + 1]  # an end of the text is a boundary at every size
        ends, level, row = ends[inner], level[inner], row[inner]
        many = np.bincount(row * LEVELS + level, minlength=(j - i) * LEVELS).reshape(j - i, LEVELS)
        many = np.cumsum(many[:, ::-1], 1)[:, ::-1] + 1  # chunks at each block size
        size = np.argmax(np.concatenate([many <= CHUNKS, np.ones((j - i, 1), bool)], 1), 1)
        signatures = []
        for step in (0, 1):
            take = level >= size[row] + step
            cut, own = np.concatenate([ends[take], at[1:]]), np.concatenate([row[take], np.arange(j - i)])
            by = np.lexsort((cut, own))
            cut, own = cut[by], own[by]
            begin = np.where(np.concatenate([[-1], own[:-1]]) == own, np.concatenate([[0], cut[:-1]]), at[own])
            h = (mixed(range_hash(sums, begin, cut) + (cut - begin).astype(U)) >> U(52)).astype(np.int64)
            h, own = h[cut > begin], own[cut > begin]
            signatures.append(np.split(h, np.searchsorted(own, np.arange(1, j - i))))
        out += zip(size.tolist(), *signatures, strict=True)
    return out


def written(f: Fingerprint) -> str:
    return ":".join([str(f[0]), *(DIGITS[np.column_stack([s >> 6, s & 63]).ravel()].tobytes().decode() for s in f[1:])])


def edit_distances(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Edit distance of each pair of sequences of at most 64 numbers, all pairs at once.

    The column of the distance table is two words of 64 bits, one of the places where it rises and one where it falls; a step
    takes one number of every ``b``.
    """
    n = len(a)
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    wide = [np.full((n, max(1, int(m.max(initial=0)))), fill, np.int64) for m, fill in ((la, -1), (lb, -2))]
    for w, s in zip(wide, (a, b), strict=True):
        for i, x in enumerate(s):
            w[i, :len(x)] = x
    bit = U(1) << np.arange(wide[0].shape[1]).astype(U)
    rises, falls, score = np.full(n, ~U(0)), np.zeros(n, U), la.copy()
    last = np.where(la > 0, U(1) << np.maximum(la - 1, 0).astype(U), U(0))
    for j in range(wide[1].shape[1]):
        here = j < lb
        same = ((wide[0] == wide[1][:, j:j + 1]) * bit).sum(1, dtype=U)
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        up, down = falls | ~(diagonal | rises), rises & diagonal
        score += here * (((up & last) > 0).astype(np.int64) - ((down & last) > 0) + (la == 0))
        up, down = (up << U(1)) | U(1), down << U(1)
        rises, falls = np.where(here, down | ~(diagonal | up), rises), np.where(here, up & diagonal, falls)
    return score


def likenesses(a: Sequence[Fingerprint], b: Sequence[Fingerprint]) -> np.ndarray:
    """0 to 1 for each pair: 1 for equal fingerprints, else 1 - edit distance / length of the longer signature, the better of the block
    sizes that both have; 0 without a common block size, and beside an empty text."""
    best = np.zeros(len(a))
    for x in (1, 2):
        for y in (1, 2):
            at = [i for i, (f, g) in enumerate(zip(a, b, strict=True)) if f[0] + x == g[0] + y and len(f[x]) and len(g[y])]
            if at:
                left, right = [a[i][x] for i in at], [b[i][y] for i in at]
                longest = np.array([max(len(p), len(q)) for p, q in zip(left, right, strict=True)])
                best[at] = np.maximum(best[at], 1 - edit_distances(left, right) / longest)
    equal = [f[0] == g[0] and np.array_equal(f[1], g[1]) and np.array_equal(f[2], g[2]) for f, g in zip(a, b, strict=True)]
    return np.where(equal, 1.0, best)


def read(written_form: str | None) -> Fingerprint | None:
    """What ``written`` wrote."""
    if written_form is None:
        return None
    k, *parts = written_form.split(":")
    value = np.zeros(256, np.int64)
    value[DIGITS] = np.arange(64)
    digits = [value[np.frombuffer(p.encode(), np.uint8)] for p in parts]
    return int(k), *(d[::2] * 64 + d[1::2] for d in digits)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with a column ``out``: the fingerprint of ``text``, of an empty text where it is null. Row-local."""
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(map(written, fingerprints(b.column(text))), pa.string())], [*names, out])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, ", ".join([*ddl(docs, names), f"`{out}` string"]))


def with_likeness(pairs: DataFrame, left: str, right: str, out: str = "likeness") -> DataFrame:
    """``pairs`` with a column ``out``: how alike two written fingerprints are, 0 to 1; null where one is null. Row-local."""
    names = [c for c in pairs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            both = list(zip(map(read, b.column(left).to_pylist()), map(read, b.column(right).to_pylist()), strict=True))
            ok = [i for i, (x, y) in enumerate(both) if x is not None and y is not None]
            value = dict(zip(ok, likenesses([both[i][0] for i in ok], [both[i][1] for i in ok]).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([value.get(i) for i in range(len(both))], pa.float64())], [*names, out])

    return pairs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, ", ".join([*ddl(pairs, names), f"`{out}` double"]))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``following``, or all it has."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _compared(texts: list[str], following: list[str], own: list[Fingerprint], after: list[Fingerprint]) -> list[pa.Array]:
    """The result columns of documents, of their fingerprints and those of the documents that follow them."""
    other = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new = fingerprints(pa.array(other, pa.string()))
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other], pa.string()),
            pa.array(map(written, own), pa.string()), pa.array(map(written, new), pa.string()), pa.array(likenesses(own, new)), pa.array(likenesses(own, after))]


RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = ("bigint", "string", "string", "string", "double", "double")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its last third from the next document, that is by descending id (nulls last; ties by a hash of the
    text, nulls first); the first follows the last, and a document alone follows itself. Null is an empty text. Texts are shuffled once, into ranges
    of this order; a task reads its range in order and holds a slice of it and the row before. The first and the last row of each range meet
    in a join of two rows for each range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                      F.xxhash64(F.col(f"`{text}`").isNotNull(), f"`{text}`").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("range"))
    schema = ", ".join([f"doc_id {kind}", *(f"{n} {t}" for n, t in zip(RESULT, _TYPES, strict=True)), "range int, head string, tail string, head_print string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the one that follows it
        spot, ids, first = None, None, True
        for b in slices(batches, 256):
            texts, prints = b.column("text").to_pylist(), fingerprints(b.column("text"))
            spot, ids = b.column("range")[0], b.column("doc_id").to_pylist()
            head = [(texts[0], written(prints[0]))] if first else []
            if held is not None:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held, first = (ids[-1], texts[-1], prints[-1]), False
            m = len(texts) - 1
            cols = _compared(texts[:-1], texts[1:], prints[:-1], prints[1:])
            empty = [pa.nulls(m, t) for t in (pa.string(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], b.schema.field("doc_id").type), *cols, pa.array([spot.as_py()] * m, pa.int32()), *empty], names)
            if head:
                yield edge(b.schema.field("doc_id").type, spot, None, head[0], None)
            kept = b.schema.field("doc_id").type
        if held is not None:
            yield edge(kept, spot, held[0], None, held[1])

    names = ["doc_id", *RESULT, "range", "head", "tail", "head_print"]

    def edge(id_type, spot, doc_id, head, tail) -> pa.RecordBatch:
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], id_type), *blank, pa.array([spot.as_py()], pa.int32()), pa.array([head and head[0]], pa.string()),
                                           pa.array([tail], pa.string()), pa.array([head and head[1]], pa.string())], names)

    parts = persisted(ranged.mapInArrow(run, schema), "ranges")
    heads = parts.filter("head is not null").select("range", "head", "head_print")
    tails = parts.filter("tail is not null").select("doc_id", "range", F.col("tail").alias("text"))
    ring = Window.orderBy("range")  # one row for each range
    following = heads.select("range").withColumn("next", F.coalesce(F.lead("range").over(ring), F.first("range").over(ring)))
    met = tails.join(following, "range").join(heads.select(F.col("range").alias("next"), "head", "head_print"), "next").select("doc_id", "text", "head", "head_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            cols = _compared(b.column("text").to_pylist(), b.column("head").to_pylist(), fingerprints(b.column("text")), [read(x) for x in b.column("head_print").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *RESULT])

    last = met.mapInArrow(close, schema.split(", range")[0])
    done = parts.filter("head is null and tail is null").select("doc_id", *RESULT).unionByName(last)
    return done.withColumnRenamed("doc_id", id_col)
