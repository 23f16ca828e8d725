"""How far the words of one source are from those of its language and of the language's other sources.

Texts are tokenized as bytes and counted per language and source. Of the terms in enough documents of a language each source
has smoothed shares, in billionths. A task holds some terms of a language as a sparse matrix with a row for each source, and sums
the absolute differences of its rows; sums of tasks are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import CHUNK, bounds, cut, lowered, packed
from .common import binary, discard, materialize

#: Shares are in parts of ten to this power.
DIGITS = 9
SMOOTHING = 5
#: A task's matrix has about so many entries: the square of the number of sources, so that its sums don't outnumber what they sum up,
#: within these bounds.
LEAST, MOST = 1 << 12, 1 << 20
#: Rows of a matrix that one task compares with all others.
ROWS = 256
#: Counts that a task gathers before it hands them on.
HELD = 1 << 19


def letters() -> np.ndarray:
    """Which bytes belong to terms: A-Z, a-z, and all bytes of characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


LOWERED, LETTERS = lowered(), letters()


def _terms(raw: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each term of a buffer starts, its number, and the terms."""
    buf = LOWERED[np.frombuffer(raw, np.uint8)]
    inside = LETTERS[buf]
    s, e = bounds(inside)
    ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(buf[inside])]).dictionary_encode()
    return s, words.indices.to_numpy().astype(np.int64), words.dictionary


def _table(group: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    return pa.table({"group": pa.array(group, pa.int64()), "term": term, "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})


def _summed(tables: list[pa.Table]) -> pa.Table:
    """One row for each group and term."""
    sums = pa.concat_tables(tables).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])


def tables(texts: list[bytes], groups: np.ndarray, most: int = CHUNK) -> Iterator[pa.Table]:
    """group, term, n (occurrences), docs (texts that hold it); summed up over texts that are worked on together."""
    for own in packed(texts, most):
        if len(texts[own[0]]) > most:
            parts = []
            for a, b in cut(texts[own[0]], b"\n ", most):
                _, ids, names = _terms(texts[own[0]][a:b])
                parts.append(_table(np.full(len(names), groups[own[0]]), names, np.bincount(ids, minlength=len(names)), np.zeros(len(names))))
            whole = _summed(parts)
            yield _table(whole["group"], whole["term"], whole["n"], np.ones(len(whole)))
            continue
        starts, ids, names = _terms(b"\n".join([texts[i] for i in own]))
        text = np.searchsorted(np.cumsum([0, *(len(texts[i]) + 1 for i in own[:-1])]), starts, "right") - 1
        key, n = np.unique(text * max(len(names), 1) + ids, return_counts=True)  # a term of a text, once
        text, term = np.divmod(key, max(len(names), 1))
        yield _summed([_table(groups[own][text], names.take(pa.array(term)), n, np.ones(len(key)))])


def counted(texts: list[bytes], groups: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, bytes, int, int]]:
    """The rows of tables()."""
    for t in tables(texts, groups, most):
        yield from zip(*(c.to_pylist() for c in t.columns))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs, summed up over batches; each lang and source also has a row of the empty term."""
    number: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    rows, bar = 0, HELD

    def full(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [pa.array(c, pa.string()) for c in zip(*number)]
        columns = [*(c.take(t["group"]) for c in names), t["term"].cast(pa.string()), t["n"], t["docs"]]
        yield from pa.table(dict(zip(["lang", "source", "term", "n", "docs"], columns))).to_batches(max_chunksize=1 << 15)

    for batch in batches:
        of = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        groups = np.array([number.setdefault(g, len(number)) for g in of], np.int64)
        for t in tables(binary(batch.column("text")), groups):
            held.append(t)
            rows += len(t)
            if rows > bar:
                held = [_summed(held)]
                rows = len(held[0])
                if rows > HELD:
                    yield from full(held[0])
                    held, rows = [], 0
                bar = max(HELD, 2 * rows)
    if number:
        none = np.zeros(len(number))
        yield from full(_summed([*held, _table(np.arange(len(number)), pa.array([b""] * len(number), pa.binary()), none, none)]))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it) of docs(text, lang, source), and one more row of the empty term
    for each lang and source there is."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**DIGITS * count / total) for 0 < count <= total < 2**59, a digit at a time, so that no product passes 64 bits."""
    out, rest = np.divmod(count, total)
    for _ in range(DIGITS):
        digit, rest = np.divmod(rest * 10, total)
        out = out * 10 + digit
    return out + 1


def differences(p: np.ndarray, row: np.ndarray, col: np.ndarray, rest: np.ndarray, cols: int, at: int) -> np.ndarray:
    """The sums over columns of |x - y|, x from row `at` and y from each row, of a sparse matrix whose entries p (by row, col)
    are sorted by row; what has no entry is rest[row]."""
    own = np.full(cols, rest[at])
    mine = row == at
    own[col[mine]] = p[mine]
    # as if no other row had an entry
    up = np.sort(own)
    below = np.concatenate([[0], np.cumsum(up)])
    k = np.searchsorted(up, rest)
    out = rest * k - below[k] + (below[-1] - below[k]) - rest * (cols - k)
    if len(row):  # and what the entries change
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] += np.add.reduceat(np.abs(p - own[col]) - np.abs(rest[row] - own[col]), starts)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, part, item, value from rows (lang, shard, block, kept, whole, first, term, source, n) sorted by the first three
    and term, source: one row without a term for each source, with its total, and one for each of its terms. kept is the number
    of terms of the lang and whole its total."""
    names = ["lang", "source", "part", "item", "value"]
    key = ["lang", "shard", "block"]

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, _, block, kept, whole = (rows[c][0].as_py() for c in (*key, "kept", "whole"))
        bare = pc.is_null(rows["term"])
        heads, entries = rows.filter(bare), rows.filter(pc.invert(bare))
        sources = heads["source"].to_pylist()
        total = heads["n"].to_numpy() + SMOOTHING * kept
        place = {s: i for i, s in enumerate(sources)}
        terms = pc.dictionary_encode(entries["term"].combine_chunks())
        col, named = terms.indices.to_numpy().astype(np.int64), terms.dictionary.to_pylist()
        n = entries["n"].to_numpy()
        row = np.array([place[s] for s in entries["source"].to_pylist()], np.int64)
        order = np.lexsort((col, row))
        row, col, n = row[order], col[order], n[order]
        if kept:
            p, rest = share(n + SMOOTHING, total[row]), share(np.full(len(sources), SMOOTHING), total)
            of_lang = share(np.bincount(col, n, len(named)).astype(np.int64) + SMOOTHING, np.full(len(named), whole + SMOOTHING * kept))
        for at in range(block * ROWS, min(len(sources), (block + 1) * ROWS)):
            value = differences(p, row, col, rest, len(named), at) if kept else np.zeros(len(sources), np.int64)
            others = np.arange(len(sources)) != at
            yield made(lang, sources[at], "pair", [s for s in sources if s != sources[at]], value[others])
            if kept:
                more = p - of_lang[col]
                mine = np.flatnonzero((row == at) & (more > 0))
                yield made(lang, sources[at], "term", [named[i] for i in col[mine].tolist()], more[mine])

    def made(lang: str, source: str, part: str, items: list[str], value: np.ndarray) -> pa.RecordBatch:
        same = [pa.array([x] * len(items), pa.string()) for x in (lang, source, part)]
        return pa.RecordBatch.from_arrays([*same, pa.array(items, pa.string()), pa.array(value, pa.int64())], names)

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for c in key:
            x = batch.column(c)
            changes[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(batch.column(c)[a].as_py() for c in key)
            if held and own != now:
                yield from solve(pa.Table.from_batches(held))
                held = []
            now = own
            held.append(batch.slice(a, b - a))
    if held:
        yield from solve(pa.Table.from_batches(held))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for docs(text, lang, source); nulls are read as ''.

    A term is a run of letters of ASCII, with A-Z lower-cased, and characters beyond ASCII. A lang keeps the V terms that min_docs or
    more of its rows hold. A source of count c of a term and N of all kept ones has the share p = 1 + floor(10**9 (c + 5) / (N + 5 V)) of
    it, and so has the lang. Part 'pair': item is each other source of the lang, value the sum of |p - its p| over the kept terms, 0
    if there are none. Part 'term': item is each kept term that the source has with p above the lang's, value what it is more; only
    the first `top`. Ranks go by value, greatest first, ties by item.

    Each row is a document of its own, also if it repeats another's id or text. An empty table gives no rows; a lang of one
    source has no pairs. Other columns are not read.
    """
    counts = materialize(term_counts(docs), "divergence-counts")
    terms = counts.where("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    entries = materialize(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "divergence-kept")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    sources = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0)
    sources = materialize(sources, "divergence-sources")
    size = F.least(F.greatest(F.pow("sources", F.lit(2)).cast("long"), F.lit(LEAST)), F.lit(MOST))
    langs = sources.groupBy("lang").agg(F.sum("n").alias("whole"), F.sum("entries").alias("entries"), F.count("*").alias("sources"))
    langs = langs.join(entries.groupBy("lang").agg(F.countDistinct("term").alias("kept")), "lang", "left").na.fill(0)
    langs = langs.select("lang", "kept", "whole", F.greatest(F.lit(1), F.ceil(F.col("entries") / size)).cast("long").alias("shards"), F.ceil(F.col("sources") / ROWS).cast("long").alias("blocks"))
    langs = materialize(langs, "divergence-langs")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    columns = ["lang", "shard", "block", "kept", "whole", "term", "source", "n"]
    heads = sources.join(langs, "lang").withColumn("shard", every("shards")).withColumn("block", every("blocks")).withColumn("term", F.lit(None).cast("string"))
    rows = entries.join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).withColumn("block", every("blocks"))
    rows = heads.select(*columns).unionByName(rows.select(*columns)).repartition("lang", "shard", "block").sortWithinPartitions("lang", "shard", "block", "term", "source")
    found = materialize(rows.mapInArrow(_compare, "lang string, source string, part string, item string, value long"), "divergence-parts")
    for x in (counts, entries, sources, langs):
        discard(x)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
