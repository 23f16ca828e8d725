"""Secret scans: fixed patterns, and a randomness test battery over other dense strings. DataFrame functions only.

A dense string is read in the smallest encoding that has all its characters: digits, hexadecimal, letters, base 32, base 36 or
base 64. Three tests ask whether its characters look drawn at random: chi-squared uniformity over the alphabet, the runs of the
alphabet's lower and upper half, and the serial correlation of neighbours. A string that one of them rejects is not random.

That a string passes is no discovery yet, as short ordinary strings pass too. The null hypothesis is an ordinary string: its
characters are drawn as often as in the corpus's texts outside dense strings. Under it, how much likelier the string is when drawn evenly from its
alphabet, divided by the number of alphabets, has a mean of at most 1, whatever the length, so that this ratio, set to 0 where
the battery rejects, is an e-value; it needs no approximation for short strings and grows with length. Per band of length, the Benjamini-Hochberg rule for e-values picks
the strings that are spans of kind `random`: of these, the expected share of ordinary strings is at most RATE, however the
strings depend on each other. What the battery costs is a random string in 1 / LEVEL.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The patterns of the base kinds and the least length of what counts.
KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY_LEAST = 6
#: Dense strings: at least so many characters.
DENSE_LEAST = 20
DENSE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{DENSE_LEAST},}}"
#: Share of ordinary strings among those found random.
RATE = 0.05
#: Least p-value of a string that passes the battery.
LEVEL = 0.01
#: Share of a letter's count that also goes to its other case.
OTHER_CASE = 0.01
#: Upper ends of the length bands.
BANDS = (24, 32, 48, 64, 128, 256)
#: e-values are counted in bins of a tenth of a power of ten, up to 10**60.
BINS = 600
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ALPHABETS = (
    (DIGITS, r"^[0-9]*$"),
    (DIGITS + "abcdef", r"^[0-9a-f]*$"),
    (DIGITS + "ABCDEF", r"^[0-9A-F]*$"),
    (LOWER, r"^[a-z]*$"),
    (UPPER, r"^[A-Z]*$"),
    (UPPER + "234567", r"^[A-Z2-7]*$"),
    (DIGITS + LOWER, r"^[0-9a-z]*$"),
    (DIGITS + UPPER, r"^[0-9A-Z]*$"),
    (UPPER + LOWER, r"^[A-Za-z]*$"),
    (UPPER + LOWER + DIGITS, r"^[A-Za-z0-9]*$"),
    (UPPER + LOWER + DIGITS + "+/", r"^[^_-]*$"),
    (UPPER + LOWER + DIGITS + "-_", r"^[^+/]*$"),
    (UPPER + LOWER + DIGITS + "+/-_", r"^.*$"),
)
#: All characters that count; padding does not.
LETTERS = ALPHABETS[-1][0]
SPANS = "array<struct<start:int,end:int,kind:int>>"


def matches(text: Column, pattern: str, kind: int, value: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans in code points. value: a group of the pattern that must have at least
    `least` characters. Texts without a match pay for one search only."""
    both = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    whole = F.transform(F.regexp_extract_all(text, both, 0), F.length)
    own = F.transform(F.regexp_extract_all(text, both, 2), F.length)
    kept = F.transform(F.regexp_extract_all(text, both, 2 + value), F.length) if value else own
    rows = F.arrays_zip(whole.alias("whole"), own.alias("own"), kept.alias("kept"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["whole"]
        span = F.struct((end - x["own"]).alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when((x["own"] > 0) & (x["kept"] >= least), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(rows, first, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def _tail(z: Column) -> Column:
    """P(N > z), by the rational approximation of the error function with an error under 2e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = poly * F.exp(-x * x) / 2
    return F.when(z < 0, 1 - upper).otherwise(upper)


def alphabet_of(token: Column) -> Column:
    """Number of the smallest of ALPHABETS that has all characters of the token but for padding at its end."""
    return F.coalesce(*[F.when(token.rlike(r), F.lit(i)) for i, (_, r) in enumerate(ALPHABETS)])


def _codes(token: Column, alphabet: Column) -> Column:
    """Places of the token's characters in the alphabet, from 1."""
    letters = F.regexp_extract_all(token, F.lit("(?s)(.)"), 1)
    return F.filter(F.transform(letters, lambda c: F.instr(alphabet, c)), lambda i: i > 0)


def _once(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _poisson_tail(k: Column, mean: Column) -> Column:
    """P(N >= k) for a Poisson N."""
    start = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * mean / i).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    below = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["sum"])
    return F.greatest(F.lit(0.0), 1 - below)


def p_random(codes: Column, size: Column) -> Column:
    """p-value of the hypothesis that the codes are uniform and independent over an alphabet of so many characters: the least of
    three tests' p-values, times three.

    Chi-squared counts pairs of equal characters. With up to one character for each of the alphabet they are too few for the
    chi-squared distribution, and their number is taken as Poisson; beyond that it is Wilson and Hilferty's approximation.
    """

    def battery(x: Column) -> Column:
        n, m, codes = x["n"], x["m"], x["codes"]
        counts = F.transform(F.sequence(F.lit(1), m.cast("int")), lambda c: F.size(F.filter(codes, lambda y: y == c)).cast("double"))
        pairs_ = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1) / 2)
        chi, df = m / n * (n + 2 * pairs_) - n, m - 1
        dense_ = _tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        uniform = F.when(n <= m, _poisson_tail(pairs_, n * (n - 1) / (2 * m))).otherwise(dense_)
        pairs = F.zip_with(F.slice(codes, 1, n.cast("int") - 1), F.slice(codes, 2, n.cast("int") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] * 2 > m) != (p["b"] * 2 > m)))
        high = F.size(F.filter(codes, lambda c: c * 2 > m))
        low = n - high
        mean = 2.0 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(var > 0, 2 * _tail(F.abs(turns + 1 - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
        middle = (m + 1) / 2
        spread = (m * m - 1) / 12
        product = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle))
        serial = 2 * _tail(F.abs(product) / (spread * F.sqrt(n - 1)))
        return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))

    x = F.struct(codes.alias("codes"), F.size(codes).cast("double").alias("n"), size.cast("double").alias("m"))
    return _once(x, lambda y: F.when(y["n"] > 2, battery(y)).otherwise(F.lit(0.0)))


def ordinary(counts: dict[str, int]) -> dict[str, float]:
    """Weight of each of LETTERS in an ordinary string: how often it was seen, and a little more, so that all can be: one, and
    for a letter of one case a part of what both cases were seen."""
    both = lambda c: counts.get(c.lower(), 0) + counts.get(c.upper(), 0) if c.isalpha() else 0
    return {c: counts.get(c, 0) + 1 + OTHER_CASE * both(c) for c in LETTERS}


def log_e(codes: Column, alphabet: Column, counts: dict[str, int]) -> Column:
    """Natural logarithm of how much likelier a string is when drawn evenly from its alphabet than when its characters come as
    often as counted among that alphabet's, less the logarithm of the number of alphabets. codes are places in LETTERS."""
    seen = ordinary(counts)
    weight = F.array(*[F.lit(log(seen[c])) for c in LETTERS])
    even = F.array(*[F.lit(log(sum(seen[c] for c in a) / len(a))) for a, _ in ALPHABETS])
    return F.aggregate(codes, F.lit(-log(len(ALPHABETS))), lambda acc, i: acc + F.element_at(even, alphabet + 1) - F.element_at(weight, i))


def _band(n: Column) -> Column:
    out = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        out = F.when(n < BANDS[i], i).otherwise(out)
    return out


def dense(text: Column) -> Column:
    """Dense strings: start, end, kind and the token without padding."""

    def cut(s: Column) -> Column:
        token = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.regexp_replace(token, "=+$", "").alias("token"))

    return F.transform(matches(text, DENSE, KINDS.index("random")), cut)


def tested(found: Column, counts: dict[str, int]) -> Column:
    """Dense strings with the band of their length and the bin of their e-value; the bin is negative where the battery rejects."""

    letters = F.array(*[F.lit(a) for a, _ in ALPHABETS])

    def test(x: Column) -> Column:
        s, kind = x["s"], x["kind"]
        passes = p_random(_codes(s["token"], x["letters"]), F.length(x["letters"])) >= LEVEL
        e = F.floor(log_e(_codes(s["token"], F.lit(LETTERS)), kind, counts) * (10 / log(10)))
        bin_ = F.when(passes, F.least(F.lit(BINS), F.greatest(F.lit(0), e))).otherwise(F.lit(-1)).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), _band(s["end"] - s["start"]).alias("band"), bin_.alias("bin"))

    # each step's arrays hold what is worked out once for a string, not once for each of its characters
    own = F.transform(found, lambda s: F.struct(s.alias("s"), alphabet_of(s["token"]).alias("kind")))
    own = F.transform(own, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), F.element_at(letters, x["kind"] + 1).alias("letters")))
    return F.transform(own, test)


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS is in a text outside its dense strings."""
    text = F.when(text.rlike(DENSE), F.regexp_replace(text, DENSE, "")).otherwise(text)
    # one byte each
    return F.array(*[F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS])


def base_spans(text: Column) -> Column:
    return F.concat(matches(text, KEY, 0, 1, KEY_LEAST), matches(text, ACCESS, 1), matches(text, HEX, 2))


def _apart(rows: DataFrame) -> DataFrame:
    """Base spans, and dense strings that touch none of them."""
    apart = F.filter("dense", lambda d: ~F.exists("base", lambda b: (b["start"] < d["end"]) & (d["start"] < b["end"])))
    return rows.withColumn("dense", apart)


def cutoffs(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """band -> least bin that is random, by the Benjamini-Hochberg rule for e-values over all of a band's strings: the k largest
    are picked if each is at least strings / (rate * k). At most len(BANDS) + 1 rows of counts by bin reach the driver."""
    counts = found.select(F.explode("dense").alias("d")).groupBy(F.col("d.band").alias("band"), F.col("d.bin").alias("bin")).count().collect()
    out = {}
    for band in {r.band for r in counts}:
        own = sorted(((r.bin, r["count"]) for r in counts if r.band == band), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if b >= 0 and 10 ** (b / 10) >= total / (rate * seen):
                out[band] = b
    return out


def _with_spans(docs: DataFrame, rate: float, keep: list[str]) -> DataFrame:
    """row (those columns of docs) and spans. Texts are searched once; what was found is written, as the letters of all texts have
    to be counted before the first string can be judged."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), text.alias("text"))
    rows = rows.select("row", base_spans(F.col("text")).alias("base"), dense(F.col("text")).alias("dense"), letter_counts(F.col("text")).alias("letters"))
    rows = materialize(rows, "secrets")
    sums = rows.agg(*[F.sum(F.col("letters")[i]).alias(str(i)) for i in range(len(LETTERS))]).first()
    counts = {c: sums[i] or 0 for i, c in enumerate(LETTERS)}
    found = _apart(rows).withColumn("dense", tested(F.col("dense"), counts))
    least = cutoffs(found.where(F.size("dense") > 0), rate)
    bar = F.create_map(*[F.lit(x) for kv in {-1: 0, **least}.items() for x in kv])
    random = F.filter("dense", lambda d: d["bin"] >= F.coalesce(F.element_at(bar, d["band"]), F.lit(BINS + 1)))
    random = F.transform(random, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["kind"].alias("kind")))
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    spans = F.transform(F.sort_array(F.transform(F.concat("base", random), order)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("row", spans.alias("spans"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, spans (start, end in code points, end exclusive; kind, an index of KINDS) for every row of docs(doc_id, text);
    spans are in order of start, then kind.

    A null text is empty and has none; repeated rows stay; an empty table gives an empty one; other columns are not
    read.
    """
    found = _with_spans(docs, rate, ["doc_id"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "spans")


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs, with all columns, where the spans of scan() are replaced by a mark; n_chars, if there, follows the text.
    A text without spans, null too, stays as it is."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    found = _with_spans(docs, rate, docs.columns).withColumn("red", redacted(text, F.col("spans")))
    hit = F.size("spans") > 0
    out = []
    for c, kind in docs.dtypes:
        now = {"text": F.col("red"), "n_chars": F.length("red").cast(kind)}.get(c)
        out.append((F.col("row")[c] if now is None else F.when(hit, now).otherwise(F.col("row")[c])).alias(c))
    return found.select(*out)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the mark in place of each maximal run of covered characters."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
