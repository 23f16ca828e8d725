"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

Every prefix of a text has one last token in its BPE encoding. A token found by the automaton to end at a place is
that last token if it can stand next to the last token of what comes before it; ids are then read backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks whose ids a worker remembers before it starts afresh.
MEMO = 300_000
FOREVER = 1 << 60


@dataclass
class Vocabulary:
    """What encoding needs of a model: rank (of the score, 0 best; equal scores share one) and parts of each piece."""

    pieces: list[str]
    normal: dict[str, int]
    rank: dict[str, int]
    parts: dict[str, tuple[str, str]]
    bytes_at: int
    end: int
    dummy: bool
    splits: bool = False
    controls: frozenset[int] = field(default_factory=frozenset)


def load(path: str) -> Vocabulary:
    """Read a BPE model of sentencepiece with byte fallback and without a normaliser's character map."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = {pieces[i]: i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    scores = {x: r for r, x in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
    rank = {p: scores[sp.get_score(i)] for p, i in normal.items()}
    parts: dict[str, tuple[str, str]] = {}
    for piece in sorted(rank, key=lambda p: (len(p), rank[p])):
        if len(piece) > 1 and (split := _last_merge(piece, rank)):
            parts[piece] = split
    whole = all(SPACE not in p.lstrip(SPACE) for p in normal)
    controls = frozenset(i for i in range(n) if sp.is_control(i))
    dummy = sp.decode(sp.encode("x")) == "x" and sp.id_to_piece(sp.encode("x")[0]).startswith(SPACE)
    alone = [i for i in range(n) if sp.is_byte(i)]
    return Vocabulary(pieces, normal, rank, parts, alone[0], sp.eos_id(), dummy, whole, controls)


def merged(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain BPE on a short text: its symbols, and the pair merged last. The best rank goes first, then the leftmost."""
    row, last = list(text), None
    while len(row) > 1:
        best = min(range(len(row) - 1), key=lambda i: (rank.get(row[i] + row[i + 1], FOREVER), i))
        if row[best] + row[best + 1] not in rank:
            break
        last = (row[best], row[best + 1])
        row[best : best + 2] = [row[best] + row[best + 1]]
    return row, last


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    row, last = merged(piece, rank)
    return last if len(row) == 1 else None


class Codec:
    """Encoder and decoder over a Vocabulary; remembers chunks and pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece in v.normal:
            if len(piece) == 1 or piece in v.parts:  # other pieces never come out of merging
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        #: What each id gives when decoded: a byte, a piece with spaces, or nothing for a control id.
        self.texts = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for i in range(256):
            self.texts[v.bytes_at + i] = bytes([i])
        for i in v.controls:
            self.texts[i] = b""
        # without a piece across them, spaces and line ends bound the merging
        lines = not any("\n" in p for p in v.normal)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if v.splits and lines else r"(?s).+").findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[bytes, bytes]] = {}

    def together(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is a, b: undo the merges beside the boundary, latest first; no merge across
        it may have come before the one undone."""
        key = (a, b)
        rank, parts = self.v.rank, self.v.parts
        if SPACE in b or a.endswith(SPACE * 2):  # pieces of spaces share a score
            good = merged(a + b, rank)[0] == [a, b]
        else:
            limit, good = FOREVER, True
            while good:
                if rank.get(a + b, FOREVER) < limit:
                    good = False
                elif a not in parts and b not in parts:
                    break
                elif b not in parts or (a in parts and rank[a] > rank[b]):
                    limit, a = rank[a], parts[a][1]
                else:
                    limit, b = rank[b] + 1, parts[b][0]
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def tokens(self, chunk: str) -> list[str]:
        last: list[str | None] = [None] * len(chunk)
        pairs = self.pairs
        for end, (piece, size) in self.automaton.iter(chunk):
            if last[end] is None:
                start = end - size
                if start >= 0:
                    before = last[start]
                    if before is None:  # a character of no piece
                        before = last[start] = chunk[start]
                    good = pairs.get((before, piece))
                    if good is None:
                        good = self.together(before, piece)
                    if not good:
                        continue
                last[end] = piece
        out, end = [], len(chunk) - 1
        while end >= 0:
            piece = last[end] or chunk[end]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def ids(self, chunk: str) -> list[int]:
        out = []
        for token in self.tokens(chunk):
            at = self.v.normal.get(token)
            if at is not None:
                out.append(at)
            else:
                out += [self.v.bytes_at + b for b in token.encode()]
        return out

    def decode_chunk(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))

    def both(self, text: str) -> tuple[bytes, bytes]:
        """The ids as int32 bytes, with the end id, and the decoded text, read back from the ids chunk by chunk."""
        if not text:
            own = []
        else:
            own = self.chunk((SPACE if self.v.dummy else "") + text.replace(" ", SPACE))
        memo, ids, out = self.memo, [], []
        for chunk in own:
            got = memo.get(chunk)
            if got is None:
                found = self.ids(chunk)
                got = np.array(found, np.int32).tobytes(), self.decode_chunk(found)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(chunk) < 64:
                    memo[chunk] = got
            ids.append(got[0])
            out.append(got[1])
        ids.append(np.array([self.v.end], np.int32).tobytes())
        text = b"".join(out)
        return b"".join(ids), text[1:] if self.v.dummy and own else text

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.both(text)[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = self.decode_chunk(ids).decode("utf-8", "replace")
        return text[1:] if self.v.dummy and text.startswith(" ") else text


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with an end id), decoded for every row of docs(doc_id, text), as sentencepiece gives them.

    A null text is empty: its ids are the end id alone. Repeated rows stay; an empty table gives an empty one;
    other columns are not read. The vocabulary, some thousand pieces at a model's fixed size, goes with the task.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            found = [codec.both(t or "") for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([0, *(len(x) // 4 for x, _ in found)])
            values = pa.array(np.frombuffer(b"".join(x for x, _ in found), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([t for _, t in found], pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
