"""What the tasks of the stored index do with a slice: blocks from texts, and queries met by products of small matrices.

Rows come sorted by slice, in Arrow batches of any size; a slice's rows may be in several of them. Memory is a slice's, not a
task's: about a thousand documents, and TOKENS rows of a matrix at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of texts that are split at once, pairs of token and document after which equal ones are joined, tokens in a matrix.
ROWS, BYTES, PAIRS, TOKENS = 256, 4 << 20, 2_000_000, 1_024
#: Bytes of texts whose windows of words are counted at once.
WINDOW_BYTES = 16 << 20


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of rows of equal keys, in their order."""
    if not batch.num_rows:
        return
    columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
    new = np.zeros(batch.num_rows, dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for a, z in zip(starts, starts[1:]):
        yield tuple(int(c[a]) for c in columns), batch.slice(a, z - a)


def _cuts(words: pa.Array, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many texts and about so many bytes, one text at least."""
    sizes, a, size = pc.binary_length(words).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and (i - a >= rows or size + n > most):
            yield a, i
            a, size = i, 0
        size += n
    if len(sizes):
        yield a, len(sizes)


def _pairs(part: pa.RecordBatch) -> tuple:
    """(tokens, code, id, dl, tf): each text's distinct tokens."""
    words = pc.split_pattern(part.column("words"), " ")
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(words) + row, return_counts=True)
    code, row = np.divmod(key, len(words))
    ids, dls = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "dl"))
    return coded.dictionary, code, ids[row], dls[row], tf


def _joined(parts: list[tuple]) -> tuple:
    """Parts as one, sorted by code and id; pairs of one document's several rows are one."""
    coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    to, at, code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0, []
    for p in parts:
        code.append(to[at : at + len(p[0])][p[1]])
        at += len(p[0])
    code, ids, dls, tf = np.concatenate(code), *(np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    order = np.lexsort((ids, code))
    code, ids, dls, tf = code[order], ids[order], dls[order], tf[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])])
    return coded.dictionary, code[first], ids[first], dls[first], np.add.reduceat(tf, first)


def _blocks(key: int, parts: list[tuple]) -> pa.RecordBatch:
    words, code, ids, dls, tf = _joined(parts)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    offsets = pa.array(np.r_[first, len(code)].astype(np.int32))
    lists = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x.astype(kind)))
    n = np.diff(np.r_[first, len(code)]).astype(np.int32)
    columns = [
        words.take(pa.array(code[first])), pa.array(np.full(len(first), key, dtype=np.int64)), pa.array(n), pa.array(np.maximum.reduceat(tf, first).astype(np.int32)),
        pa.array(np.minimum.reduceat(dls, first).astype(np.int64)), lists(ids, np.int64), lists(tf, np.int32), lists(dls, np.int64),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["token", "slice", "n", "max_tf", "min_dl", "ids", "tfs", "dls"])


def slice_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (slice, id, dl, words): words are a text's tokens, joined by blanks; rows of an id are one document."""
    now, parts = None, []
    for batch in batches:
        for (key,), rows in _runs(batch, ["slice"]):
            if key != now and parts:
                yield _blocks(now, parts)
                parts = []
            now = key
            for a, z in _cuts(rows.column("words"), ROWS, BYTES):
                parts.append(_pairs(rows.slice(a, z - a)))
                if len(parts) > 1 and sum(len(p[1]) for p in parts[1:]) > PAIRS + len(parts[0][1]):
                    parts = [_joined(parts)]
    if parts:
        yield _blocks(now, parts)


class _Lists:
    """A list column's values and the row of each."""

    def __init__(self, column: pa.Array):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        self.row, self.values = np.repeat(np.arange(len(n)), n), column.flatten().to_numpy(zero_copy_only=False)

    def of(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.searchsorted(self.row, (a, z))
        return self.row[i:j] - a, self.values[i:j]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table, pa.Table]]:
    """(block and slice, rows with places, rows without)."""
    now, parts = None, []

    def made():
        rows = pa.Table.from_batches(parts)
        has = pc.is_valid(rows.column("places"))
        return now, rows.filter(has).combine_chunks(), rows.filter(pc.invert(has)).combine_chunks()

    for batch in batches:
        for key, rows in _runs(batch, ["_block", "slice"]):
            if key != now and parts:
                yield made()
                parts = []
            now = key
            parts.append(rows)
    if parts:
        yield made()


def _column(rows: pa.Table, name: str) -> pa.Array:
    chunks = rows.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], rows.schema.field(name).type)


def _sums(rows: pa.Table, docs: np.ndarray, queries: int, of_query, of_doc) -> list[np.ndarray]:
    """Matrices of queries by documents: for each of the pairs of functions, the sum over tokens of what they say of token and query, and of token and document."""
    ids, places = _Lists(_column(rows, "ids")), _Lists(_column(rows, "places"))
    out = [np.zeros((queries, len(docs))) for _ in of_query]
    others = {c: _Lists(_column(rows, c)) for c in ("tfs", "dls", "weights")}
    for a in range(0, rows.num_rows, TOKENS):
        z = min(a + TOKENS, rows.num_rows)
        t, own = ids.of(a, z)
        at = np.searchsorted(docs, own)
        q_t, place = places.of(a, z)
        value = {c: others[c].of(a, z)[1] for c in others}
        for m, (f, g) in zip(out, zip(of_query, of_doc)):
            left, right = np.zeros((queries, z - a)), np.zeros((z - a, len(docs)))
            left[place, q_t] = f(value["weights"])
            right[t, at] = g(value["tfs"], value["dls"])
            m += left @ right
    return out


def _batch(key: tuple, columns: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    n = len(columns[0][1])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0], dtype=np.int32)), *[pa.array(c) for _, c in columns]], names=["_block", *[n for n, _ in columns]])


def best_overlaps(k: int, weighted: bool):
    """The k best documents of each query by the sum of its tokens' weights; weighted: of those with weights (ids, weights, tfs: copies), times 1 + weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, more in _groups(batches):
            if not rows.num_rows or (weighted and not more.num_rows):
                continue
            docs = np.unique(_Lists(_column(rows, "ids")).values)
            asks, inverse = np.unique(_Lists(_column(rows, "places")).values, return_inverse=True)
            rows = _renumbered(rows, inverse)
            (sums,) = _sums(rows, docs, len(asks), [lambda w: w], [lambda tf, dl: 1.0])
            score, ids = sums, docs
            if weighted:
                own, w, copies = (_Lists(_column(more, c)).values for c in ("ids", "weights", "tfs"))
                own, w = np.repeat(own, copies), np.repeat(w, copies)
                there = np.isin(own, docs)
                own, w = own[there], w[there]
                order = np.argsort(own, kind="stable")
                ids, w = own[order], w[order]
                sums = sums[:, np.searchsorted(docs, ids)]
                score = sums * (1 + w)
            if not len(ids):
                continue
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(asks)), best.shape[1])
            d = best.ravel()
            met = sums[q, d] > 0
            q, d = q[met], d[met]
            if len(q):
                yield _batch(key, [("_place", asks[q].astype(np.int32)), ("id", ids[d].astype(np.int64)), ("matches", np.rint(sums[q, d]).astype(np.int64)), ("score", score[q, d])])

    return run


def all_met(mean: float | None, k1: float, b: float):
    """The documents that have all tokens of a query, with BM25 by the tokens' weights; only for the queries in rows without places (ids), if mean is given, else for all and without a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, more in _groups(batches):
            if not rows.num_rows or (mean is not None and not more.num_rows):
                continue
            docs = np.unique(_Lists(_column(rows, "ids")).values)
            places = _Lists(_column(rows, "places")).values
            asks, first, inverse = np.unique(places, return_index=True, return_inverse=True)
            needed = _Lists(_column(rows, "needed")).values[first]
            rows = _renumbered(rows, inverse)
            part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
            of = [(lambda w: 1.0, lambda tf, dl: 1.0)] + ([(lambda w: w, part)] if mean is not None else [])
            sums = _sums(rows, docs, len(asks), *zip(*of))
            met = np.rint(sums[0]) == needed[:, None]
            if mean is not None:
                met &= np.isin(asks, _Lists(_column(more, "ids")).values)[:, None]
            q, d = np.nonzero(met)
            if len(q):
                yield _batch(key, [("_place", asks[q].astype(np.int32)), ("id", docs[d].astype(np.int64)), ("score", sums[-1][q, d])])

    return run


def _renumbered(rows: pa.Table, places: np.ndarray) -> pa.Table:
    """rows with their places as numbers from 0."""
    old = _column(rows, "places")
    n = np.r_[0, np.cumsum(pc.list_value_length(old).to_numpy(zero_copy_only=False))].astype(np.int32)
    new = pa.ListArray.from_arrays(pa.array(n), pa.array(places.astype(np.int64)))
    return rows.set_column(rows.schema.get_field_index("places"), "places", new)


def window_counts(least: int, most: int, stop: tuple[str, ...]):
    """(head, tail, n) of texts (words, joined by blanks): at each place the first `least` words and up to most - least that follow, counted over a part of the batch.

    Words with other characters than a to z and stop words are left out before.
    """

    def part(words: pa.Array) -> pa.RecordBatch | None:
        split = pc.split_pattern(words, " ")
        row = np.repeat(np.arange(len(words)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary
        good = pc.and_(pc.match_substring_regex(names, "^[a-z]+$"), pc.invert(pc.is_in(names, value_set=pa.array(stop)))).to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = good[code]
        code, row = code[kept], row[kept]
        n = len(code) - least + 1
        if n <= 0:
            return None
        columns = []
        for j in range(most):
            c = np.full(n, -1, dtype=np.int64)
            m = min(n, len(code) - j)
            c[:m] = np.where(row[j : j + m] == row[:m], code[j : j + m], -1)
            columns.append(c)
        there = columns[least - 1] >= 0
        columns = [c[there] for c in columns]
        if not len(columns[0]):
            return None
        wide = len(names) + 1
        keys = [columns[j] * wide + (columns[j + 1] + 1) if j + 1 < most else columns[j] for j in range(0, most, 2)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), dtype=bool)
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        spaced = pc.binary_join_element_wise(pa.scalar(" "), names, "")
        word = lambda of, c: pc.fill_null(of.take(pa.array(c[order[first]], mask=c[order[first]] < 0)), "")

        def join(own: list[np.ndarray]) -> pa.Array:
            taken = [word(spaced if j else names, c) for j, c in enumerate(own)]
            return pc.binary_join_element_wise(*taken, "") if taken else pa.array([""] * len(first))

        return pa.RecordBatch.from_arrays([join(columns[:least]), join(columns[least:]), pa.array(np.diff(np.r_[first, len(order)]).astype(np.int64))], names=["head", "tail", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            for a, z in _cuts(words, 1 << 30, WINDOW_BYTES):
                found = part(words.slice(a, z - a))
                if found is not None:
                    yield found

    return run


def start_counts(least: int, lengths: list[int]):
    """(phrase, n) of rows (head, tail, n) in their order: the sums over equal starts of each length. A sum goes on over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {}  # length: the last start and its sum so far
        for batch in batches:
            if not batch.num_rows:
                continue
            head, tail, n = batch.column("head"), batch.column("tail"), batch.column("n").to_numpy(zero_copy_only=False)
            size = np.where(pc.equal(tail, "").to_numpy(zero_copy_only=False), 0, pc.count_substring(tail, " ").to_numpy(zero_copy_only=False) + 1)
            for k in lengths:
                own = np.flatnonzero(size >= k - least)
                if not len(own):
                    continue
                at, more = pa.array(own), k - least
                phrase = head.take(at)
                if more:
                    rest = pc.replace_substring_regex(tail.take(at), rf"^((?:[a-z]+ ){{{more - 1}}}[a-z]+).*$", r"\1")
                    phrase = pc.binary_join_element_wise(phrase, rest, " ")
                new = np.flatnonzero(np.r_[True, pc.not_equal(phrase.slice(1), phrase.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)])
                sums, names = np.add.reduceat(n[own], new), phrase.take(pa.array(new))
                if k in open_:
                    word, before = open_[k]
                    if names[0].as_py() == word:
                        sums[0] += before
                    else:
                        names, sums = pa.concat_arrays([pa.array([word], names.type), names]), np.r_[before, sums]
                open_[k] = names[-1].as_py(), int(sums[-1])
                if len(sums) > 1:
                    yield pa.RecordBatch.from_arrays([names.slice(0, len(sums) - 1), pa.array(sums[:-1])], names=["phrase", "n"])
        for word, n in open_.values():
            yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([n])], names=["phrase", "n"])

    return run
