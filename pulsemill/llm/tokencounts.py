"""Token counts of a byte-level BPE with word ends, by a whole-token shortcut.

Before any text is read, every vocabulary string is merged alone; those that come out as one token are counted
without merging wherever they are a pre-token. Only other pre-tokens are merged.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 300_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes keep their own, the
    others get the letters from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def load(path: str) -> dict:
    """merges: pair -> rank; specials; pattern; suffix; whole: texts that are one token, as read from the file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    bpe, suffix = model["model"], model["model"]["end_of_word_suffix"] or ""
    merges = {tuple(m): r for r, m in enumerate(bpe["merges"])}
    back = {c: b for b, c in enumerate(byte_letters())}
    whole = []
    for token in bpe["vocab"]:
        word = token.removesuffix(suffix)
        if word and token.endswith(suffix) and all(c in back for c in word) and merged([*word[:-1], word[-1] + suffix], merges) == 1:
            try:
                whole.append(bytes(back[c] for c in word).decode())
            except UnicodeDecodeError:
                pass
    split = next(p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {"merges": merges, "suffix": suffix, "whole": whole, "pattern": split, "specials": [t["content"] for t in model["added_tokens"]]}


def merged(row: list[str], merges: dict[tuple[str, str], int]) -> int:
    """How many tokens remain of a row of symbols."""
    none = len(merges)
    get = merges.get
    ranks = [get(pair, none) for pair in zip(row, row[1:])]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        at = ranks.index(best)
        row[at] += row.pop(at + 1)
        del ranks[at]
        if at < len(ranks):
            ranks[at] = get((row[at], row[at + 1]), none)
        if at:
            ranks[at - 1] = get((row[at - 1], row[at]), none)
    return len(row)


class Counter(dict):
    """pre-token -> tokens. Starts with the whole tokens; a missing pre-token is merged and remembered."""

    def __init__(self, model: dict):
        super().__init__(dict.fromkeys(model["whole"], 1))
        self.m, self.letters, self.floor = model, byte_letters(), len(model["whole"])
        self.pre = regex.compile(model["pattern"]).findall
        self.special = regex.compile("|".join(map(regex.escape, model["specials"])))
        self.space = regex.compile(r"\s+")

    def __missing__(self, word: str) -> int:
        row = [self.letters[b] for b in word.encode()]
        row[-1] += self.m["suffix"]
        n = merged(row, self.m["merges"]) if len(row) < 200 else merged_long(row, self.m["merges"])
        if len(self) - self.floor >= MEMO:
            self.clear()
            self.update(dict.fromkeys(self.m["whole"], 1))
        if len(word) < 64:
            self[word] = n
        return n

    def plain(self, text: str) -> int:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # lower case goes character by character, so that a final capital sigma gets no form of its own
        return sum(map(self.__getitem__, self.pre(text.replace("Σ", "σ").lower())))

    def count(self, text: str) -> int:
        """Special strings are one token each and bound the rest, as the library does by default."""
        if not self.m["specials"] or "<|" not in text:
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def merged_long(row: list[str], merges: dict[tuple[str, str], int]) -> int:
    """As merged(), with a heap, for long rows."""
    import heapq

    after = [*range(1, len(row)), -1]
    before = [-1, *range(len(row) - 1)]
    heap = [(merges[row[i], row[i + 1]], i, row[i], row[i + 1]) for i in range(len(row) - 1) if (row[i], row[i + 1]) in merges]
    heapq.heapify(heap)
    live, n = list(row), len(row)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if live[i] != a or j < 0 or live[j] != b:
            continue
        live[i], live[j] = a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        n -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (live[x], live[y]) in merges:
                heapq.heappush(heap, (merges[live[x], live[y]], x, live[x], live[y]))
    return n


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs(doc_id, text).

    A null text is empty: no bytes, no tokens. Repeated rows stay; an empty table gives an empty one; other
    columns are not read. The vocabulary, of a model's fixed size, is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model.value)
        for batch in batches:
            counts = [counter.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_bytes")], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")))
    counted = rows.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
