"""SentencePiece BPE encoding and decoding by backtracking.

A sequence of tokens is the BPE encoding of a text exactly if every two neighbours re-merge to themselves. So the encoder goes from
left to right, takes the longest vocabulary match at each place (Aho-Corasick), keeps it if it stands the check with the token before,
else tries shorter matches, else steps back; places from which no way leads on are marked in a bitfield and not tried again. Results of
whole blank-to-blank segments are kept in a bounded table per task, since no piece of such vocabularies spans them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.llm.textnum import ddl, release, slices

BLANK = "▁"
CONTROL, UNKNOWN, BYTE, NORMAL = "control", "unknown", "byte", "normal"
UNKNOWN_TEXT = " ⁇ "
MAX_SEGMENTS = 300_000  # kept results per task (twice that with the older ones): these bound memory and never change a result
MAX_PARTS = 100_000
MAX_PAIRS = 300_000
FEW_SEGMENTS = 30_000  # where other stages' memory is still held: more time, less memory


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: pieces by id with score and kind. Some 1 MB, travels with the function."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[str, ...]
    dummy_prefix: bool = True

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        """Read a BPE model with identity normalisation; others are refused, since their results would differ."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, names = m.normalizer_spec, {1: NORMAL, 2: UNKNOWN, 3: CONTROL, 6: BYTE}
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models without text normalisation are supported")
        if m.trainer_spec.treat_whitespace_as_suffix or {p.type for p in m.pieces} - set(names):
            raise ValueError("user-defined or unused pieces and suffix blanks are not supported")
        return cls(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(names[p.type] for p in m.pieces),
                   norm.add_dummy_prefix)


@dataclass
class Codec:
    """Encoder and decoder over one vocabulary."""

    vocabulary: Vocabulary
    most: int = MAX_SEGMENTS
    kept: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)
    parts: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = v.kinds.index(UNKNOWN) if UNKNOWN in v.kinds else None
        self.plain = {i: p.replace(BLANK, " ") for p, i in self.ids.items()}
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        together = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        joined = {c for two in together for c in two}
        # Characters that stand alone in every encoding cut segments too.
        loose = "".join(sorted({c for p in self.ids for c in p} - joined - {BLANK}))
        alone = "\n\r\t" if not joined & set("\n\r\t") else ""
        cut = re.escape(alone + "".join(c for c in loose if c not in alone))
        # Marks that no piece holds right after a letter start a segment there, so words with and without them share one.
        letter = re.compile("[A-Za-z0-9À-ÖØ-öø-ɏ]")
        marks = {two[1] for two in together if not two[1].isalnum()} - {BLANK} - set(alone)
        marks -= {two[1] for two in together if letter.match(two[0])}
        mark, other = re.escape("".join(sorted(marks))), f"[^{BLANK}{cut}{re.escape(''.join(sorted(marks)))}]"
        rest = f"{other}*+" + (f"(?:(?<!{letter.pattern})[{mark}]{other}*+)*+" if mark else "")
        start = f"(?:[{mark}]|{other})" if mark else other
        self.segments = re.compile(".+" if inner else (f"[{cut}]|" if cut else "") + f"{BLANK}*{start}{rest}|{BLANK}+", re.DOTALL)
        self.together = together

    @cached_property
    def made(self) -> set[str]:
        """Pieces that merging makes; others cannot be tokens. Built for encoding only, as is the matcher."""
        return {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}

    @cached_property
    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p in self.made:
            if len(p) > 1:
                found.add_word(p, len(p))
        found.make_automaton()
        return found

    def merged(self, text: str) -> list[str]:
        """Plain BPE: join the neighbours of best score, the leftmost first. For the check of two tokens."""
        part: list[str | None] = list(text)
        left, right = [i - 1 for i in range(len(part))], [i + 1 for i in range(len(part))]
        right[-1:] = [-1]
        queue: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-self.vocabulary.scores[k], i, part[i] + part[j], j))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while queue:
            _, i, both, j = heapq.heappop(queue)
            if part[i] is None or part[j] is None or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Do the two neighbours re-merge to themselves?"""
        if a[-1] + b[0] not in self.together:
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def backtracked(self, text: str) -> list[str]:
        """Tokens of one segment; a character outside the vocabulary is a token of its own."""
        n = len(text)
        if not n or text in self.made:
            return [text] if n else []
        ends = [[i + 1] for i in range(n)]  # of the matches from each place, shortest first
        for last, size in self.matcher.iter(text):
            ends[last - size + 1].append(last + 1)
        failed = 0  # bit p: no encoding goes on from place p
        tokens: list[str] = []
        tried: list[int] = []  # for each token: which match of its place it is
        pos, before, k, known = 0, "", len(ends[0]) - 1, self.pairs
        while True:
            here = ends[pos]
            while k >= 0:
                end = here[k]
                if not failed >> end & 1:
                    token = text[pos:end]
                    if not before or (known[before, token] if (before, token) in known else self.compatible(before, token)):
                        break
                k -= 1
            if k >= 0:
                tokens.append(token)
                if end == n:
                    return tokens
                tried.append(k)
                before, pos = token, end
                k = len(ends[pos]) - 1
            else:
                if not tokens:
                    raise ValueError("the vocabulary cannot encode this text")
                failed |= 1 << pos
                pos -= len(tokens.pop())
                before = tokens[-1] if tokens else ""
                k = tried.pop() - 1

    def ids_of(self, token: str) -> list[int]:
        i = self.ids.get(token)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in token.encode()] if self.byte_ids else [self.unknown]

    def part(self, s: str) -> tuple[int, ...]:
        ids = self.parts.get(s)
        if ids is None:
            ids = tuple(k for t in self.backtracked(s) for k in self.ids_of(t))
            if len(s) < 40:
                if len(self.parts) >= MAX_PARTS:
                    self.parts.clear()
                self.parts[s] = ids
        return ids

    def segment(self, s: str) -> str | tuple[str, str]:
        """Ids of one segment joined by commas; with what they decode to where that is not the segment itself."""
        got = self.older.get(s)
        if got is None:
            cut = []  # where no piece holds the neighbours
            if not all(map(self.together.__contains__, map(add, s, s[1:]))):
                cut = [j for j in range(1, len(s)) if s[j - 1:j + 1] not in self.together]
            if cut:
                ids: tuple[int, ...] = ()
                for i, j in zip([0, *cut], [*cut, len(s)], strict=True):
                    ids += self.part(s[i:j])
            else:
                ids = tuple(k for t in self.backtracked(s) for k in self.ids_of(t))
            got, back = ",".join(map(str, ids)), self.joined(ids)
            if back != s.replace(BLANK, " "):
                got = got, back
        if len(s) < 100:
            if len(self.kept) >= self.most:  # what was not met since the last change is forgotten
                self.older = dict(self.kept)
                self.kept.clear()
            self.kept[s] = got
        return got

    def prepared(self, text: str) -> str:
        text = text.replace(" ", BLANK)
        return BLANK + text if text and self.vocabulary.dummy_prefix else text

    def encoded(self, text: str | None) -> tuple[str, str]:
        """Ids of a text joined by commas, and what they decode to with the blank put before it."""
        get, make, whole = self.kept.get, self.segment, self.prepared(text or "")
        found = self.segments.findall(whole)
        got = [get(s) or make(s) for s in found]
        if tuple not in set(map(type, got)):
            return ",".join(got), whole.replace(BLANK, " ")
        pairs = [g if type(g) is tuple else (g, s.replace(BLANK, " ")) for g, s in zip(got, found, strict=True)]
        return ",".join(ids for ids, _ in pairs), "".join(back for _, back in pairs)

    def encode(self, text: str | None) -> list[int]:
        """Ids without begin and end; null and empty texts have none."""
        ids, _ = self.encoded(text)
        return list(map(int, ids.split(","))) if ids else []

    def joined(self, ids: list[int] | tuple[int, ...]) -> str:
        """Text of the ids, blanks for their sign; runs of byte pieces are read as UTF-8, bytes that are none give U+FFFD each."""
        v, out, raw = self.vocabulary, [], bytearray()
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except KeyError:  # some id is no plain piece
            pass

        def flush() -> None:
            i = 0
            while i < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[i:i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            raw.clear()

        for i in ids:
            kind = v.kinds[i]
            if kind == BYTE:
                raw.append(self.bytes_of[i])
                continue
            flush()
            if kind == NORMAL:
                out.append(v.pieces[i].replace(BLANK, " "))
            elif kind == UNKNOWN:
                out.append(UNKNOWN_TEXT)
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; the blank that encoding put before a text is taken off."""
        text = self.joined(ids)
        first = next((i for i in ids if self.vocabulary.kinds[i] != CONTROL), None)
        own = first is not None and self.vocabulary.dummy_prefix and self.vocabulary.pieces[first].startswith(BLANK)
        return text[1:] if own else text


    def forget(self) -> None:
        """Drop what was kept for later texts."""
        for held in (self.kept, self.older, self.parts, self.pairs):
            held.clear()


_codecs: dict[int, Codec] = {}


def codec(vocabulary: Vocabulary, most: int = MAX_SEGMENTS) -> Codec:
    """One codec per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    _codecs[key].most = most
    return _codecs[key]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as array<int>; null and empty texts get an empty array. A column of that
    name is replaced; repeated rows, other columns and empty tables pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in slices(batches):
            kept = [(n, x) for n, x in zip(b.schema.names, b.columns, strict=True) if n != ids]
            got = pa.array([c.encode(t.as_py()) for t in b.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + [got], [n for n, _ in kept] + [ids])
        c.forget()  # the worker stays for other stages
        release()

    return docs.mapInArrow(run, ", ".join([*ddl(docs, (n for n in docs.columns if n != ids)), f"`{ids}` array<int>"]))


def decode_ids(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids; null gives null, no ids the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in slices(batches):
            kept = [(n, x) for n, x in zip(b.schema.names, b.columns, strict=True) if n != text]
            got = pa.array([None if (i := x.as_py()) is None else c.decode(i) for x in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + [got], [n for n, _ in kept] + [text])
        c.forget()
        release()

    return df.mapInArrow(run, ", ".join([*ddl(df, (n for n in df.columns if n != text)), f"`{text}` string"]))


def encode_and_compare(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", exact: str = "exact") -> DataFrame:
    """``docs`` with the ids of each whole text as array<int> and whether decoding them gives the text back; ``text`` is dropped, null is as empty.

    Both in one Python worker a core: chained, the two steps hold two each, and the texts go to the second once more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, FEW_SEGMENTS)
        for b in slices(batches, 128):
            kept = [(n, x) for n, x in zip(b.schema.names, b.columns, strict=True) if n not in (text, ids, exact)]
            got, same = [], []
            for t in b.column(text):
                whole = t.as_py() or ""
                i = c.encode(whole)
                got.append(np.array(i, np.int32))
                same.append(c.decode(i) == whole)
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + [pa.array(got, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                                             [n for n, _ in kept] + [ids, exact])
        _codecs.clear()  # with what it kept: the worker stays for other stages
        release()

    return docs.mapInArrow(run, ", ".join([*ddl(docs, (n for n in docs.columns if n not in (text, ids, exact))), f"`{ids}` array<int>, `{exact}` boolean"]))


def token_digests(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, n_tokens, and the SHA-256 of the ids joined by commas and of the decoded text, without moving either."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in slices(batches):
            n, ids, back = [], [], []
            for t in b.column(text):
                said, whole = c.encoded(t.as_py())
                n.append(said.count(",") + 1 if said else 0)
                ids.append(hashlib.sha256(said.encode()).hexdigest())
                back.append(hashlib.sha256((whole[1:] if c.vocabulary.dummy_prefix else whole).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)],
                                             [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    needed = docs.select(*(f"`{k}`" for k in dict.fromkeys([*keep, text])))
    return needed.mapInArrow(run, ", ".join([*ddl(docs, keep), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"]))
