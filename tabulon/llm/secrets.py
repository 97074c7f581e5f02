"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Long tokens are candidates. A token's encoding is inferred from its characters; chi-squared uniformity over that
alphabet, a runs test over character classes and lag-1 serial correlation say whether it can be random (combined by
Fisher's rule). How unlikely it is as ordinary text comes from two of the statistics against the corpus's own letter
frequencies and class changes, counted over all documents. Benjamini-Hochberg thresholds are set per length class from
a histogram of those probabilities over all candidates of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import cut, give_back, table, utf8_parts, word_spans

# The patterns of the base kinds, on UTF-8 bytes.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_TOKEN = 6, 20, 24, 20

#: False discoveries among the tokens reported as random; least probability of a random token under its own tests.
FDR, FIT = 0.01, 1e-3
#: First lengths of the length classes. Probabilities are binned in quarters of a power of ten.
LENGTHS, STEP, MOST_BIN = (20, 24, 32, 48, 80), 4, 400

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_CLASS = np.zeros(256, np.int8)  # 0 other, 1 digit, 2 upper, 3 lower, 4 symbol
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[[43, 45, 47, 61, 95]] = 4
_TOKEN = _CLASS > 0
_ALNUM = (_CLASS > 0) & (_CLASS < 4)


def corpus_null(docs: DataFrame) -> dict:
    """Over all texts: squared and cubed letter frequencies of alphanumeric bytes, and how often neighbours change class."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, pairs, changes = np.zeros(256, np.int64), 0, 0
        for batch in batches:
            for _, _, data, _ in utf8_parts(batch.column(0)):
                counts += np.bincount(data, minlength=256)
                kind = _CLASS[data]
                both = _ALNUM[data[:-1]] & _ALNUM[data[1:]]
                pairs += int(both.sum())
                changes += int((both & (kind[:-1] != kind[1:])).sum())
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [256, 257]), pa.int64()), pa.array(np.append(counts[used], [pairs, changes]), pa.int64())], ["what", "n"])

    found = dict(docs.select("text").mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n")).collect())  # at most 258 rows
    counts = np.array([found.get(b, 0) if _ALNUM[b] else 0 for b in range(256)], float) + 1e-9
    q = counts / counts.sum()
    return {"s2": float((q**2).sum()), "s3": float((q**3).sum()), "change": min(0.5, max(1e-3, (found.get(257, 0) + 1) / (found.get(256, 0) + 100)))}


def _alphabet(token: np.ndarray) -> np.ndarray | None:
    """Codes of the token's characters in the smallest encoding that holds them; None for digits alone."""
    kinds = set(np.unique(_CLASS[token]).tolist())
    upper, lower, digit, symbol = 2 in kinds, 3 in kinds, 1 in kinds, 4 in kinds
    if not (upper or lower):
        return None
    low = token - 97
    if not upper and not symbol and digit and _HEX[token].all():
        codes = np.where(token < 58, token - 48, low + 10), 16
    elif not lower and not symbol and digit and ((token >= 65) | (token < 56) & (token >= 50)).all():
        codes = np.where(token >= 65, token - 65, token - 24), 32
    elif symbol or (upper and lower):
        codes = np.select([_CLASS[token] == 2, _CLASS[token] == 3, _CLASS[token] == 1], [token - 65, token - 71, token + 4], np.where((token == 43) | (token == 45), 62, 63)), 64 if symbol else 62 if digit else 52
    else:
        first = 65 if upper else 97
        codes = np.where(token < 58, token - 48 + 26, token - first), 36 if digit else 26
    return np.append(codes[0].astype(np.int64), codes[1])


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fisher(parts: list[float]) -> float:
    half = -sum(math.log(max(p, 1e-300)) for p in parts)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(parts)))


def battery(token: np.ndarray, null: dict) -> tuple[float, float]:
    """(probability as a random token of its encoding, probability as ordinary text); (0, 1) for tokens without letters."""
    coded = _alphabet(token)
    if coded is None:
        return 0.0, 1.0
    codes, k = coded[:-1], int(coded[-1])
    n = len(codes)
    counts = np.bincount(codes, minlength=64).astype(float)
    squares = float((counts**2).sum())
    chi = k * squares / n - n
    uniform = _upper_normal(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))  # Wilson and Hilferty
    kind = _CLASS[token]
    plain = (kind[:-1] < 4) & (kind[1:] < 4)
    m, changes = int(plain.sum()), int((plain & (kind[:-1] != kind[1:])).sum())
    shares = {16: (10, 0, 6), 26: (0, 0, 26), 32: (6, 26, 0), 36: (10, 0, 26), 52: (0, 26, 26)}.get(k, (10, 26, 26))
    stay = sum((x / sum(shares)) ** 2 for x in shares)
    runs = 1.0 if stay == 1 or not m else 2 * _upper_normal(abs(changes - m * (1 - stay)) / math.sqrt(m * stay * (1 - stay)))
    centred = codes - codes.mean()
    spread = float((centred**2).sum())
    serial = 2 * _upper_normal(abs(float((centred[:-1] * centred[1:]).sum()) / spread) * math.sqrt(n)) if spread else 0.0
    fit = _fisher([max(uniform, 1e-300), max(min(runs, 1), 1e-300), max(serial, 1e-300)])
    # As text: few coincidences of letters, and many class changes (Chernoff's bound).
    pairs, s2, s3 = n * (n - 1) / 2, null["s2"], null["s3"]
    met = (squares - n) / 2
    few = _upper_normal((pairs * s2 - met - 0.5) / math.sqrt(pairs * (s2 - s2**2) + n * (n - 1) * (n - 2) * max(0.0, s3 - s2**2)))
    many, r = 1.0, null["change"]
    if m and (f := changes / m) > r:
        many = math.exp(-m * (f * math.log(f / r) + ((1 - f) * math.log((1 - f) / (1 - r)) if f < 1 else 0)))
    return fit, _fisher([max(few, 1e-300), max(many, 1e-300)])


def _bin(p: float) -> int:
    return min(MOST_BIN, int(-math.log10(max(p, 1e-300)) * STEP))


def _class_of(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, "right")) - 1


def _merged(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches that the spans cover, in order."""
    begins, ends = [], []
    for a, _, b in sorted(base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def scan_part(data: np.ndarray, offsets: np.ndarray, null: dict) -> Iterator[tuple[int, list[tuple[int, int, int]], list[tuple[int, int, int, int]]]]:
    """Of each row of UTF-8 bytes that has any: (row, base spans (start, kind, end), candidates (start, end, length class, bin)).

    Offsets are in code points. Candidates are long tokens of any score; those that meet a base span, or can't be random,
    have bin 0.
    """
    runs = lambda members, least: (lambda s, e, b: (s[k], e[k], np.searchsorted(s[k], offsets, "left")) if (k := e - s >= least) is not None else ())(*word_spans(data, offsets, members))
    hex_s, hex_e, hex_b = runs(_HEX, LEAST_HEX)
    tok_s, tok_e, tok_b = runs(_TOKEN, LEAST_TOKEN)
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        raw = data[lo:hi].tobytes()
        base = [(int(s) - lo, 2, int(e) - lo) for s, e in zip(hex_s[hex_b[i] : hex_b[i + 1]], hex_e[hex_b[i] : hex_b[i + 1]], strict=True)]
        if b"AKIA" in raw:
            base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
        low = raw.lower()
        if any(h in low for h in ASSIGN_HINTS):
            base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST_VALUE]
        tokens = []
        taken_s, taken_e = _merged(base)
        for s, e in zip(tok_s[tok_b[i] : tok_b[i + 1]].tolist(), tok_e[tok_b[i] : tok_b[i + 1]].tolist(), strict=True):
            near = bisect_right(taken_e, s - lo)  # the first span that ends beyond the token's begin
            meets = near < len(taken_s) and taken_s[near] < e - lo
            fit, as_text = (0.0, 1.0) if meets else battery(data[s:e], null)
            tokens.append((s - lo, e - lo, _class_of(e - s), _bin(as_text) if fit >= FIT else 0))
        if base or tokens:
            place = np.zeros(hi - lo + 1, np.int64)
            np.cumsum((data[lo:hi] & 0xC0) != 0x80, out=place[1:])
            at = place.tolist() if hi - lo < 4096 else place
            yield i, sorted((int(at[a]), k, int(at[b])) for a, k, b in base), [(int(at[a]), int(at[b]), c, p) for a, b, c, p in tokens]


SPANS = "array<struct<start:int,kind:int,stop:int>>"
CANDIDATES = "array<struct<start:int,stop:int,class:int,bin:int>>"


def scan(docs: DataFrame, null: dict, keep: list[str]) -> DataFrame:
    """The columns keep of docs with `base` spans and `candidates` of each whole text; kept columns of these names are replaced."""
    keep = [c for c in keep if c not in ("base", "candidates")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
        tokens = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            base, found = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for at, _, data, offsets in utf8_parts(batch.column("__tb_text"), 1 << 20):
                for i, own, more in scan_part(data, offsets, null):
                    base[at + i] = [dict(zip(("start", "kind", "stop"), x, strict=True)) for x in own]
                    found[at + i] = [dict(zip(("start", "stop", "class", "bin"), x, strict=True)) for x in more]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(base, spans), pa.array(found, tokens)], [*keep, "base", "candidates"])
        give_back()

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col("text").alias("__tb_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"base {SPANS}, candidates {CANDIDATES}"]))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> list[int]:
    """Per length class, the least bin whose candidates hold at most the share fdr of false discoveries (Benjamini-Hochberg)."""
    counts = scanned.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bin").count().collect()  # classes x bins at most
    out = []
    for c in range(len(LENGTHS)):
        mine = {r["bin"]: r["count"] for r in counts if r["class"] == c}
        total, above, least = sum(mine.values()), 0, MOST_BIN + 1
        for b in sorted(mine, reverse=True):
            above += mine[b]
            if b > 0 and total * 10 ** (-b / STEP) / above <= fdr:
                least = b
        out.append(least)
    return out


def with_spans(scanned: DataFrame, least: list[int]) -> DataFrame:
    """scanned with `found`: base spans and the candidates that pass, by start and kind."""
    limit = F.array(*[F.lit(x) for x in least])
    passed = F.transform(F.filter("candidates", lambda c: c["bin"] >= F.element_at(limit, c["class"] + 1)), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    return scanned.withColumn("found", F.array_sort(F.concat("base", passed)))


def find_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with `base` and `found` spans of each whole text (kind: place in KINDS, offsets in code points).

    Null texts are empty. Kept columns named base, found or candidates are replaced. Base spans always stay; a random token is reported unless it meets one. The thresholds depend
    on all rows of docs; repeated rows get equal spans. Empty in, empty out.
    """
    scanned = cut(scan(docs, corpus_null(docs), keep))
    return with_spans(scanned, thresholds(scanned)).drop("candidates")


def _shown(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>", length: str | None = None) -> DataFrame:
    """docs with every secret in `text` replaced by mark; overlapping spans are replaced once. Other rows stay as they are.

    length: a column that holds the text's length in characters, put right where the text changes. Null texts stay null,
    empty ones empty; repeated rows are changed alike; other columns stay, whatever their names. Empty in, empty out.
    """
    null = corpus_null(docs)
    least = thresholds(cut(scan(docs, null, [])))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, to, data, offsets in utf8_parts(batch.column("text"), 1 << 20):  # a part's texts are Python strings, not the batch's
                part = batch.slice(at, to - at)
                texts = part.column("text").to_pylist()
                lengths = part.column(length).to_pylist() if length else None
                for i, base, more in scan_part(data, offsets, null):
                    spans = sorted([(a, b) for a, _, b in base] + [(a, b) for a, b, c, p in more if p >= least[c]])
                    if spans:
                        text, parts, end = texts[i], [], 0
                        for a, b in spans:
                            if a >= end:
                                parts += [text[end:a], mark]
                            end = max(end, b)
                        texts[i] = "".join([*parts, text[end:]])
                        if lengths:
                            lengths[i] = len(texts[i])
                for name, new in (("text", texts), (length, lengths)):
                    if new:
                        place = part.schema.get_field_index(name)
                        part = part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))
                yield part
        give_back()

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The digest of base spans (start, kind, end), for checks."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
