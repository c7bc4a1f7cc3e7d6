"""Exact removal of repeated byte strings by suffix arrays.

Every string of ``size`` bytes has one anchor: the piece of half its length whose hash is smallest (the leftmost of equals). Equal
strings have equal anchors at equal places, so only text around anchors that stand in more than one place can repeat. Contexts (all
strings of one anchor place) that are equal as a whole are counted first; of what is left, one of each kind goes to the shard of its
anchor. A shard sorts its suffixes by Larsson-Sadakane refinement in numpy and takes common prefixes after Kasai. An anchor with very
many different contexts is dealt to several shards; their sorted window keys are cut at the same range bounds and merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.corpus import batches_for, counted, dealt, keyed, released
from sparkfolio.llm.textnum import INVERSE, U, ddl, mixed, powers, prefix_sums, range_hash, runs_of_rows, text_bytes
from sparkfolio.session import persisted

SIZE = 400
RUN = 1 << 19
MASK = U((1 << 20) - 1)
SHARD_BYTES = 1 << 19
HOT_CONTEXTS = 3_000  # different contexts of one anchor in a shard
BASE2 = 0xD1342543DE82EF95
INVERSE2 = pow(BASE2, -1, 1 << 64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours: running minima of blocks from both sides."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, U)]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def _pieces(offs: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows [i, j) and bytes [a, b) to work on together; a long row comes in pieces that share size - 1 bytes."""
    for i, j in runs_of_rows(offs, RUN):
        a, b = int(offs[i]), int(offs[j])
        if b - a <= RUN:
            yield i, j, a, b
        else:
            for c in range(a, max(a + 1, b - size + 1), RUN - size + 1):
                yield i, j, c, min(b, c + RUN)


def contexts(col, size: int = SIZE) -> dict[str, np.ndarray]:
    """Anchor places of all rows: row, start (first string, from the row's first byte), more (further strings), anchor and
    content (hashes), and at (start in the column's bytes)."""
    buf, offs = text_bytes(col)
    q = size // 2
    w = size - q + 1
    found: list[tuple[np.ndarray, ...]] = []
    for i, j, a, b in _pieces(offs, size):
        if b - a < size:
            continue
        part = buf[a:b]
        sums = prefix_sums(part)
        at = np.arange(len(part) - q + 1)
        h = mixed((sums[q:] - sums[:-q]) * powers(INVERSE, len(sums))[at])
        low = sliding_min((h & ~MASK) | at.astype(U), w)  # for each string, its smallest piece and where that stands
        place = (low & MASK).astype(np.int64)
        start = np.arange(len(low))
        row = np.searchsorted(offs, start + a, side="right") - 1
        ok = start + a + size <= offs[row + 1]
        start, place, row = start[ok], place[ok], row[ok]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        more = np.diff(np.append(first, len(start))) - 1
        s, p = start[first], place[first]
        second = prefix_sums(part, BASE2)
        content = mixed(range_hash(second, s, s + more + size, INVERSE2) + ((p - s).astype(U) << U(32)) + more.astype(U))
        anchor = mixed(h[p] ^ U(BASE2))  # smallest hashes are near 0; mixed again, they spread over all key ranges
        found.append((row[first], s + a - offs[row[first]], more, anchor, content, s + a))
    names = ("row", "start", "more", "anchor", "content", "at")
    kinds = (np.int64, np.int64, np.int64, U, U, np.int64)
    return {n: np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}


def suffix_order(text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of the strings of ``text`` that end at ``ends`` (each at most ``longest`` bytes).

    Larsson-Sadakane: ranks of h bytes give ranks of 2 h, and only groups that are not yet single are sorted again. A shorter
    string comes before what it begins; equal suffixes keep the order of their places.
    """
    n = len(text)
    rest = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # bytes up to the string's end
    key = np.zeros(n, U)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for k in range(7):
        key = (key << U(8)) | np.where(rest > k, padded[k:k + n], 0).astype(U)
    key = (key << U(8)) | np.minimum(rest, 7).astype(U)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of the group
    rank = np.empty(n, np.int64)
    rank[order] = head
    h = 7
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_ = np.flatnonzero(np.repeat(size, size) > 1)  # places in groups of several
    while len(open_) and h < longest:
        at = order[open_]
        after = np.where(rest[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((at, after, group))
        at, after, group = at[by], after[by], group[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size, size) > 1]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the place before it in the suffix array (-1 for the first), and the bytes both share, ``most`` at most.

    Kasai: a place shares at least what the place d before it shares, less d. Places far apart are compared first, so that
    each finer step, taken for all its places at once, starts from that bound.
    """
    n = len(text)
    rest = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, U)
    for k in range(8):
        word |= padded[k:k + n].astype(U) << U(8 * k)
    shared = np.zeros(n, np.int64)
    top = np.where(before >= 0, np.minimum(np.minimum(rest, rest[before]), most), 0)
    step = 64
    at = np.arange(0, n, step)
    while True:
        low = np.zeros(len(at), np.int64)
        back = at - step if step < 64 else None
        if back is not None:
            ok = back >= 0
            ok &= rest[np.maximum(back, 0)] > step  # the same string
            low[ok] = np.maximum(0, shared[back[ok]] - step)
        low = np.minimum(low, top[at])
        todo = np.flatnonzero(low < top[at])
        while len(todo):
            i, l = at[todo], low[todo]
            x, y = i + l, before[i] + l
            diff = word[x] ^ word[y]
            same = np.full(len(todo), 8)
            bad = diff != 0
            lowest = diff[bad] & (~diff[bad] + U(1))
            same[bad] = np.floor(np.log2(lowest.astype(np.float64))).astype(np.int64) // 8
            l = np.minimum(l + same, top[i])
            low[todo] = l
            todo = todo[~bad & (l < top[i])]
        shared[at] = low
        if step == 1:
            return before, shared
        step //= 2
        at = np.arange(step, n, 2 * step)


def repeated_windows(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For each text, the places at which a string of ``size`` bytes starts that starts at another place of these texts too."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"".join(texts), np.uint8)
    if not len(text):
        return [np.zeros(0, np.int64) for _ in texts]
    order, _ = suffix_order(text, ends[lengths > 0], int(lengths.max()))
    before, shared = common_prefixes(text, ends[lengths > 0], order, size)
    hit = np.zeros(len(text), bool)
    full = shared >= size
    hit[full] = True
    hit[before[full]] = True
    return [np.flatnonzero(hit[e - n:e]) for e, n in zip(ends, lengths, strict=True)]


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans [start, end) with touching and overlapping ones made one."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], np.append(end[first[1:] - 1], end[-1])


def _spans(start: np.ndarray, end: np.ndarray) -> bytes:
    return np.column_stack(merged_spans(start, end)).astype("<i8").tobytes()


FOUND = "batch int, key bigint, spans binary, shard bigint, start bigint, more bigint, context binary"
MET = "batch int, key bigint, spans binary, piece int, window binary"
_WINDOW = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("key", "<i8"), ("start", "<i8"), ("batch", "<i4")])


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(batch, key, spans) of ``docs`` (key, text, batch): spans are packed pairs of bytes [start, end); a key may have
    several rows."""
    spark = docs.sparkSession
    n_batches = docs.agg(F.max("batch")).first()[0]
    if n_batches is None:
        return spark.createDataFrame([], "batch int, key bigint, spans binary")

    def ask(t: pa.Table):
        c = contexts(t["text"], size)
        by = np.lexsort((c["content"], c["anchor"]))
        k, m = c["anchor"][by], c["content"][by]
        third = np.zeros(len(k), bool)  # two of a kind say all
        third[2:] = (k[2:] == k[:-2]) & (m[2:] == m[:-2])
        return [(k[~third], m[~third])]

    def answer(batches):
        size_of = [len(b[0][0]) for b in batches]
        k, m = (np.concatenate([b[0][x] for b in batches]) for x in (0, 1))
        own = np.repeat(np.arange(len(batches)), size_of)
        by = np.lexsort((own, m, k))
        ks, ms = k[by], m[by]
        new_k, new_m = np.ones(len(ks), bool), np.ones(len(ks), bool)
        new_k[1:] = ks[1:] != ks[:-1]
        new_m[1:] = new_k[1:] | (ms[1:] != ms[:-1])
        kinds = np.add.reduceat(new_m, np.flatnonzero(new_k)).astype(np.int64) if len(ks) else np.zeros(0, np.int64)
        kinds = kinds[np.cumsum(new_k) - 1] if len(ks) else kinds
        copies = np.diff(np.append(np.flatnonzero(new_m), len(ks)))[np.cumsum(new_m) - 1] if len(ks) else kinds
        # 0: the anchor's only place; 1: repeated; 2: repeated, and this batch sends one; 3: to be compared
        code = np.where(copies > 1, np.where((kinds > 1) & new_m, 2, 1), np.where(kinds > 1, 3, 0))
        value = np.empty(len(ks), U)
        value[by] = (code + 4 * -(-kinds // HOT_CONTEXTS)).astype(U)
        return [[x] for x in np.split(value, np.cumsum(size_of)[:-1])], [0]

    def use(t: pa.Table, replies: list[np.ndarray], _totals: list[int]) -> pa.Table:
        c = contexts(t["text"], size)
        buf, _ = text_bytes(t["text"])
        by = np.lexsort((c["content"], c["anchor"]))
        k, m = c["anchor"][by], c["content"][by]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        third = np.zeros(len(k), bool)
        third[2:] = (k[2:] == k[:-2]) & (m[2:] == m[:-2])
        value = replies[0][np.cumsum(~third) - 1].astype(np.int64) if len(k) else np.zeros(0, np.int64)
        first = value[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else value  # of the kind's first entry
        code = np.where((first & 3) == 2, np.where(new, 2, 1), first & 3)
        key, batch = np.asarray(t["key"]), t["batch"][0].as_py()
        out: list[dict] = []
        hit = by[(code == 1) | (code == 2)]
        row = c["row"][hit]
        for r in np.unique(row):
            x = hit[row == r]
            out.append({"batch": batch, "key": int(key[r]), "spans": _spans(c["start"][x], c["start"][x] + c["more"][x] + size)})
        for x, v in zip(by[code >= 2], first[code >= 2] >> 2, strict=True):
            a = int(c["at"][x])
            salt = int(c["content"][x] % U(v))
            shard = int(mixed(c["anchor"][x:x + 1] + U(salt))[0] >> U(1))
            out.append({"batch": batch, "key": int(key[c["row"][x]]), "shard": shard if v == 1 else ~shard, "start": int(c["start"][x]),
                        "more": int(c["more"][x]), "context": buf[a:a + int(c["more"][x]) + size].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("batch", pa.int32()), ("key", pa.int64()), ("spans", pa.binary()), ("shard", pa.int64()),
                                                    ("start", pa.int64()), ("more", pa.int64()), ("context", pa.binary())]))

    found = persisted(counted(docs, n_batches + 1, ask, answer, use, FOUND), "anchors")
    total = found.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    shards = max(2 * cores, -(-total // SHARD_BYTES))
    pieces = max(cores, -(-total // SHARD_BYTES))

    def sort_shard(t: pa.Table) -> pa.Table:
        texts = t["context"].to_pylist()
        starts, keys, batches = (np.asarray(t[n]) for n in ("start", "key", "batch"))
        hot = np.asarray(t["shard"]) < 0
        out: list[dict] = []
        for i, x in enumerate(repeated_windows(texts, size)):
            if len(x):
                s = starts[i] + x
                out.append({"batch": int(batches[i]), "key": int(keys[i]), "spans": _spans(s, s + size)})
        runs = []
        for i in np.flatnonzero(hot):  # every window of split anchors, by two hashes of its bytes
            b = np.frombuffer(texts[i], np.uint8)
            n = len(b) - size + 1
            at = np.arange(n)
            run = np.zeros(n, _WINDOW)
            run["lo"] = mixed(range_hash(prefix_sums(b), at, at + size))
            run["hi"] = range_hash(prefix_sums(b, BASE2), at, at + size, INVERSE2)
            run["key"], run["start"], run["batch"] = keys[i], starts[i] + at, batches[i]
            runs.append(run)
        if runs:
            run = np.concatenate(runs)
            run = run[np.lexsort((run["hi"], run["lo"]))]
            cut = np.concatenate([[0], np.searchsorted(run["lo"], np.array([(i << 64) // pieces for i in range(1, pieces)], U)), [len(run)]])
            out += [{"piece": i, "window": run[cut[i]:cut[i + 1]].tobytes()} for i in range(pieces) if cut[i] < cut[i + 1]]
        return pa.Table.from_pylist(out, pa.schema([("batch", pa.int32()), ("key", pa.int64()), ("spans", pa.binary()), ("piece", pa.int32()),
                                                    ("window", pa.binary())]))

    sent = found.filter("context is not null").withColumn("task", F.pmod(F.when(F.col("shard") < 0, -F.col("shard") - 1).otherwise(F.col("shard")), F.lit(shards)))
    met = persisted(sent.groupBy("task").applyInArrow(lambda t: released(sort_shard(t)), MET), "shards")

    def merge(t: pa.Table) -> pa.Table:
        """Runs of one range, each sorted: a window is repeated if a binary search finds it in another run."""
        runs = [np.frombuffer(x, _WINDOW) for x in t["window"].to_pylist()]
        whole = np.sort(np.concatenate(runs)[["lo", "hi"]], order=("lo", "hi")) if runs else np.zeros(0, _WINDOW)[["lo", "hi"]]
        out: list[dict] = []
        for run in runs:
            left = np.searchsorted(whole["lo"], run["lo"], "left")
            right = np.searchsorted(whole["lo"], run["lo"], "right")
            twice = right - left > 1
            for x in np.flatnonzero(twice):  # equal first hashes: the second decides
                twice[x] = (whole["hi"][left[x]:right[x]] == run["hi"][x]).sum() > 1
            run = run[twice]
            run = run[np.lexsort((run["start"], run["key"]))]
            edge = np.flatnonzero(np.diff(run["key"], prepend=run["key"][:1] - 1)) if len(run) else []
            for part in np.split(run, edge[1:]) if len(run) else []:
                out.append({"batch": int(part["batch"][0]), "key": int(part["key"][0]), "spans": _spans(part["start"], part["start"] + size)})
        return pa.Table.from_pylist(out, pa.schema([("batch", pa.int32()), ("key", pa.int64()), ("spans", pa.binary())]))

    merged = met.filter("window is not null").groupBy("piece").applyInArrow(lambda t: released(merge(t)), "batch int, key bigint, spans binary")
    spans = [x.filter("spans is not null").select("batch", "key", "spans") for x in (found, met)]
    return spans[0].unionByName(spans[1]).unionByName(merged)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, keep: tuple[str, ...] = ("doc_id",),
                    kept_text: str | None = None) -> DataFrame:
    """``keep`` of every row, n_bytes, n_removed, n_spans, kept_sha256, and with ``kept_text`` the text that is left.

    Removed is each byte covered by a string of ``size`` bytes that starts in another place too, in this or another
    text. Null and empty texts have no bytes. Repeated rows are places of their own and so lose their repeated strings. Where a cut splits
    a character, its other bytes are left out of ``kept_text`` (not of the digest).
    """
    own = keyed(docs.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)), F.col(f"`{id_col}`").alias("_id"),
                            F.col(f"`{text}`").alias("text")), "_id")
    n = batches_for(own)
    batched = dealt(own, n).drop("_id")
    spans = repeated_spans(batched.select("key", "text", "batch"), size)
    names = [f"_k{i}" for i in range(len(keep))]

    def cut(t: pa.Table, s: pa.Table) -> pa.Table:
        of: dict[int, list[bytes]] = {}
        for k, x in zip(s["key"].to_pylist(), s["spans"].to_pylist(), strict=True):
            of.setdefault(k, []).append(x)
        buf, offs = text_bytes(t["text"])
        rows = []
        for i, k in enumerate(t["key"].to_pylist()):
            b = buf[offs[i]:offs[i + 1]]
            pairs = np.frombuffer(b"".join(of.get(k, [])), "<i8").reshape(-1, 2)
            start, end = merged_spans(pairs[:, 0], pairs[:, 1])
            left = b"".join(b[x:y].tobytes() for x, y in zip([0, *end], [*start, len(b)], strict=True)) if len(start) else b.tobytes()
            rows.append((len(b), len(b) - len(left), len(start), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if kept_text else None))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        out = {n: t[n] for n in names} | {"n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                                          "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())}
        return pa.table(out | ({"kept_text": pa.array(cols[4], pa.string())} if kept_text else {}))

    schema = ", ".join([*ddl(batched, names), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *(["kept_text string"] if kept_text else [])])
    done = batched.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(lambda t, s: released(cut(t, s)), schema)
    digest = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return done.select(*(F.col(n).alias(k) for n, k in zip(names, keep, strict=True)), *digest, *([F.col("kept_text").alias(kept_text)] if kept_text else []))
