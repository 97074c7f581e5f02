"""SentencePiece encoding and decoding of whole texts, giant ones by a max-plus parallel scan.

No piece of such a model holds a word mark after another character, so a text falls apart before every word mark that
follows another character, and short texts are encoded word by word. A giant text is cut into chunks of fixed length,
wherever that falls. Across a cut runs one piece or none: that is the boundary state. A chunk yields its max-plus
transfer matrix (best sum of scores from each state at its left to each at its right, minus infinity if there is no
path), matrices are combined associatively in two levels, states are chosen from the top down, and every chunk is then
traced back on its own.

The scores make the optimum the model's own encoding: for a merge model, a row of pieces is what merging gives exactly
if every two neighbours are what merging gives for their joined text, so other neighbours weigh minus infinity; the one
path that is left is the answer. For a unigram model any neighbours are allowed and the sum of the scores decides.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, cut, give_back, hot_keys, kept_in_process, skew_join, table, utf8_parts

#: Where the public model lies, unless the caller says.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer texts are scanned. Chunks combined in the first level.
CHUNK, BLOCK = 16_384, 256
#: Words, their characters, and pairs of pieces that a Python worker remembers.
MOST_WORDS = MOST_PAIRS = 100_000
MOST_CHARS = 4 << 20
#: The scan's tasks get about so many bytes of rows at once, and return so many characters and numbers.
BATCH, MOST_OUT = 4 << 20, 1 << 18
MARK = "▁"
NONE = -np.inf


class Model:
    """A SentencePiece model with what the scan needs to know of it."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.words: dict[str, bytes] = {}
        self.chars = 0  # of the words
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece holds a word mark after another character: texts don't fall apart at word marks")
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        # Of two words joined by a merge only one piece may be left: such a model merges; a unigram model's scores add.
        self.merges = float(np.mean([sp.get_score(i) == round(sp.get_score(i)) for i in plain])) > 0.99
        out = [b"" if sp.is_control(i) else bytes([int(x[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.sizes = np.array([len(x) for x in out], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.pairs: dict[tuple[str, str], bool] = {}

    # ---- words ----

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, word by word; each new word is encoded once."""
        known, rows, new = self.words, [], {}
        if len(known) > MOST_WORDS or self.chars > MOST_CHARS:
            known.clear()
            self.chars = 0
        for text in texts:
            words = text.replace(MARK, " ").split(" ") if text else []
            if "" in words:
                joined, gap = [], 0
                for w in words:
                    if w:
                        joined.append(" " * gap + w)
                        gap = 0
                    else:
                        gap += 1
                words = joined + ([gap] if gap else [])
            rows.append(words)
            for w in words:
                if w not in known:
                    new[w] = None
        fresh = list(new)
        found = self.sp.encode([w if isinstance(w, str) else " " * (w - 1) for w in fresh], num_threads=1) if fresh else []
        for w, ids in zip(fresh, found, strict=True):
            known[w] = np.array(ids if w != 1 else [self.ids.get(MARK, self.unknown)], np.int32).tobytes()
            self.chars += len(w) if isinstance(w, str) else w
        return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in rows]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a row of ids, without the leading word mark's blank."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        out = self.bytes[np.repeat(self.at[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()
        return out[1:] if out[:1] == b" " else out

    # ---- the lattice of a stretch of text ----

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        if not self.merges:
            return True
        if (a, b) not in self.pairs:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = self.merged(a + b) == [a, b]
        return self.pairs[a, b]

    def piece_at(self, text: str, s: int, e: int) -> bool:
        """Whether text[s:e] can be a piece; a single character always can."""
        return s >= 0 and e <= len(text) and (e == s + 1 or text[s:e] in self.score)

    def weight(self, piece: str) -> float:
        return self.score.get(piece, -100.0)

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def states(self, text: str, place: int) -> list[tuple[int, int]]:
        """Pieces that run across or end at a place of text, as offsets from it; (0, 0) at the text's begin."""
        if place == 0:
            return [(0, 0)]
        k = self.longest
        return [(s - place, e - place) for s in range(max(0, place - k), place) for e in range(place, min(len(text), s + k) + 1) if self.piece_at(text, s, e)]

    def paths(self, text: str, begin: int, end: int, states: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[np.ndarray, list]]:
        """Best sums from each state at begin to every piece that ends in or runs across (begin, end], with the piece before."""
        best: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
        ending: dict[int, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(states):
            row = np.full(len(states), NONE)
            row[i] = self.weight(text[begin + a : begin + b]) if b > 0 else 0.0
            best[begin + a, begin + b] = (row, [None] * len(states))
            ending.setdefault(begin + b, []).append((begin + a, begin + b))
        for s in range(begin, end):
            for p in ending.pop(s, []):
                row, _ = best[p]
                before = text[p[0] : p[1]]
                for e in range(s + 1, min(len(text), s + self.longest) + 1):
                    if not self.piece_at(text, s, e) or (before and not self.fits(before, text[s:e])):
                        continue
                    total = row + self.weight(text[s:e])
                    if (s, e) not in best:
                        best[s, e] = (np.full(len(states), NONE), [None] * len(states))
                        ending.setdefault(e, []).append((s, e))
                    now, back = best[s, e]
                    for i in np.flatnonzero(total > now):
                        now[i], back[i] = total[i], p
        return best

    def resets(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and last place in (begin, end) where words fall apart."""
        first = last = None
        at = text.find(MARK, begin + 1, end)
        while at != -1:
            if text[at - 1] != MARK:
                first = at
                break
            at = text.find(MARK, at + 1, end)
        at = text.rfind(MARK, begin + 1, end)
        while first is not None and at >= first:
            if text[at - 1] != MARK:
                last = at
                break
            at = text.rfind(MARK, first, at)
        return None if first is None else (first, last)

    def transfer(self, text: str, begin: int, end: int) -> tuple[list, list, np.ndarray]:
        """States at begin and end and the matrix of best sums. What lies between two resets is alike for all states and left out."""
        left, right = self.states(text, begin), self.states(text, end)
        place = {(end + a, end + b): j for j, (a, b) in enumerate(right)}
        matrix = np.full((len(left), len(right)), NONE)
        if (cuts := self.resets(text, begin, end)) is None:
            for p, (row, _) in self.paths(text, begin, end, left).items():
                if p in place:
                    matrix[:, place[p]] = row
            return left, right, matrix
        head = np.full(len(left), NONE)
        for p, (row, _) in self.paths(text, begin, cuts[0], left).items():
            if p[1] == cuts[0]:
                head = np.maximum(head, row)
        for p, (row, _) in self.paths(text, cuts[1], end, [(0, 0)]).items():
            if p in place:
                matrix[:, place[p]] = head + row[0]
        return left, right, matrix

    def _traced(self, best: dict, last: tuple[int, int], i: int, text: str, begin: int) -> list[str]:
        out = []
        while last is not None:
            if last[1] > begin:
                out.append(text[last[0] : last[1]])
            last = best[last][1][i]
        return out[::-1]

    def trace(self, text: str, begin: int, end: int, left: tuple[int, int], right: tuple[int, int]) -> np.ndarray:
        """Ids of the pieces that end in (begin, end], given the states at both ends."""
        target = (end + right[0], end + right[1])
        kept = lambda pieces: [i for p in pieces for i in self.ids_of(p)]
        over = right[1] > 0  # the next chunk counts it
        if (cuts := self.resets(text, begin, end)) is None:
            pieces = self._traced(self.paths(text, begin, end, [left]), target, 0, text, begin)
            return np.array(kept(pieces[:-1] if over else pieces), np.int32)
        best = self.paths(text, begin, cuts[0], [left])
        last = max((p for p in best if p[1] == cuts[0]), key=lambda p: best[p][0][0])
        head = self._traced(best, last, 0, text, begin)
        tail = self._traced(self.paths(text, cuts[1], end, [(0, 0)]), target, 0, text, cuts[1])
        inner = text[cuts[0] : cuts[1]]
        middle = self.encode([inner[1:].replace(MARK, " ")])[0] if inner else np.zeros(0, np.int32)
        return np.concatenate([np.array(kept(head), np.int32), middle, np.array(kept(tail[:-1] if over else tail), np.int32)])


def loaded(proto: bytes) -> Model:
    """The model and its words, built once in a Python worker's process."""
    return kept_in_process(hashlib.md5(proto).hexdigest(), lambda: Model(proto))


def _normal(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def _rows(batches: Iterator) -> Iterator[tuple]:
    """Rows of Arrow batches, one after the other; lists are arrays."""
    import pyarrow as pa

    for batch in batches:
        kind = collections.namedtuple("Row", batch.schema.names)
        for row in zip(*batch.columns, strict=True):
            yield kind(*(x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else x.as_py() for x in row))


def _in_batches(rows: Iterator[tuple], schema: str) -> Iterator:
    """Arrow batches of rows: few at a time, so that a task holds no more than about MOST_OUT values of what it returns."""
    import pyarrow as pa

    arrow = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    build = lambda held: pa.RecordBatch.from_arrays([pa.array(x, arrow[k]) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if hasattr(x, "__len__") else 1 for x in row)
        if size >= MOST_OUT:
            yield build(held)
            held, size = [], 0
    if held:
        yield build(held)


def _chunks(held, marked: DataFrame, chunk: int) -> DataFrame:
    """(mark, no, before, body, after): chunks of the giant texts with as much of their neighbours as a piece is long."""
    schema = "mark string, no int, before string, body string, after string"

    def each(batches: Iterator) -> Iterator[tuple]:
        k = loaded(held.value).longest + 1
        for r in _rows(batches):
            whole = _normal(r.text)
            for no, a in enumerate(range(0, len(whole), chunk)):
                yield r.mark, no, whole[max(0, a - k) : a], whole[a : a + chunk], whole[a + chunk : a + chunk + k]

    def run(batches: Iterator) -> Iterator:
        yield from _in_batches(each(batches), schema)
        give_back()

    return marked.select("mark", "text").mapInArrow(run, schema)


MATRIX = "mark string, no int, block int, lefts array<int>, rights array<int>, sums array<double>"


def _code(states: list[tuple[int, int]]) -> list[int]:
    return [a * 1024 - b for a, b in states]


def _unpacked(code: int) -> tuple[int, int]:
    """(a, b) of a * 1024 - b with a <= 0 <= b < 1024."""
    b = (-code) % 1024
    return (code + b) // 1024, b


def _leaves(held, chunks: DataFrame) -> DataFrame:
    def each(batches: Iterator) -> Iterator[tuple]:
        model = loaded(held.value)
        for r in _rows(batches):
            left, right, sums = model.transfer(r.before + r.body + r.after, len(r.before), len(r.before) + len(r.body))
            yield r.mark, r.no, r.no // BLOCK, _code(left), _code(right), sums.ravel()

    def run(batches: Iterator) -> Iterator:
        yield from _in_batches(each(batches), MATRIX)
        give_back()

    return chunks.select("mark", "no", "before", "body", "after").mapInArrow(run, MATRIX)


def _groups(batches: Iterator, keys: list[str]) -> Iterator[list]:
    """Rows of sorted Arrow batches, one list for each run of equal keys. A run is a text's block or its blocks."""
    for _, group in itertools.groupby(_rows(batches), key=lambda r: tuple(getattr(r, k) for k in keys)):
        yield list(group)


def _matrices(rows: list) -> list[tuple[list, list, np.ndarray]]:
    return [(list(r.lefts), list(r.rights), np.asarray(r.sums, float).reshape(len(r.lefts), len(r.rights))) for r in rows]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1, initial=NONE)


def _folded(batches: Iterator) -> Iterator:
    """One matrix for each block of a text."""

    def each() -> Iterator[tuple]:
        for group in _groups(batches, ["mark", "block"]):
            rows = _matrices(group)
            total = rows[0][2]
            for _, _, m in rows[1:]:
                total = times(total, m)
            yield group[0].mark, int(group[0].block), 0, rows[0][0], rows[-1][1], total.ravel()

    return _in_batches(each(), MATRIX)


def choose(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The states at every boundary of the best path from state first to state last."""
    reach = [np.where(np.arange(len(matrices[0])) == first, 0.0, NONE)]
    for m in matrices:
        reach.append((reach[-1][:, None] + m).max(axis=0, initial=NONE))
    path = [last]
    for m, r in zip(matrices[::-1], reach[-2::-1], strict=True):
        path.append(int(np.argmax(r + m[:, path[-1]])))
    return path[::-1]


CHOSEN = "mark string, no int, first int, last int"


def _chosen(keys: list[str]):
    """Of consecutive matrices of a text: the states at each one's ends, given those at the ends of all (or the best ones)."""

    def each(batches: Iterator) -> Iterator[tuple]:
        for group in _groups(batches, keys):
            rows = _matrices(group)
            if hasattr(group[0], "first"):
                first, last = rows[0][0].index(int(group[0].first)), rows[-1][1].index(int(group[0].last))
            else:
                total = rows[0][2]
                for _, _, m in rows[1:]:
                    total = times(total, m)
                ends = np.array([_unpacked(c)[1] == 0 for c in rows[-1][1]])
                flat = int(np.argmax(np.where(ends[None], total, NONE)))
                first, last = divmod(flat, total.shape[1])
                if total[first, last] == NONE:
                    raise ValueError("no path of pieces through a text: the model doesn't merge by scores")
            path = choose([m for _, _, m in rows], first, last)
            for r, (lefts, rights, _), a, b in zip(group, rows, path, path[1:], strict=False):
                yield r.mark, r.no, lefts[a], rights[b]

    return lambda batches: _in_batches(each(batches), CHOSEN)


def scan_giants(held, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(mark, ids) of (mark, text), by the scan. A text's blocks are at most 2**31 / (chunk * BLOCK) matrices, about 500.

    Shuffles of the small matrices keep their number of partitions: they are light in bytes, not in work. Tasks hold
    BATCH bytes of rows and one chunk's pieces; what the chunks yield is a table, the steps before it are freed.
    """
    work, tasks = Scratch(texts.sparkSession), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = work.cut("chunks", _chunks(held, texts, chunk), BATCH)
    spread = chunks.repartition(tasks, "mark", "no")
    leaves = work.cut("leaves", _leaves(held, spread), BATCH)
    by_block = lambda df: df.repartition(tasks, "mark", "block").sortWithinPartitions("mark", "block", "no")
    blocks = work.cut("blocks", by_block(leaves).mapInArrow(_folded, MATRIX), BATCH)
    tops = work.cut("tops", blocks.repartition(tasks, "mark").sortWithinPartitions("mark", "no").mapInArrow(_chosen(["mark"]), CHOSEN), BATCH)
    states = by_block(leaves.join(tops.withColumnRenamed("no", "block"), ["mark", "block"])).mapInArrow(_chosen(["mark", "block"]), CHOSEN)
    schema = "mark string, no int, ids array<int>"

    def each(batches: Iterator) -> Iterator[tuple]:
        model = loaded(held.value)
        for r in _rows(batches):
            yield r.mark, r.no, model.trace(r.before + r.body + r.after, len(r.before), len(r.before) + len(r.body), _unpacked(r.first), _unpacked(r.last))

    def run(batches: Iterator) -> Iterator:
        yield from _in_batches(each(batches), schema)
        give_back()

    parts = work.cut("parts", chunks.join(states, ["mark", "no"]).select("mark", "no", "before", "body", "after", "first", "last").mapInArrow(run, schema), BATCH)
    work.free("chunks", "leaves", "blocks", "tops")
    return parts.groupBy("mark").agg(F.flatten(F.array_sort(F.collect_list(F.struct("no", "ids"))).getField("ids")).alias("ids"))


def encode_documents(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all but text, if not said) with ids: the pieces of each whole text.

    Null and empty texts have no ids. Texts of more than chunk characters are scanned; equal ones once. Repeated rows
    are repeated. A kept column named ids is replaced. Empty in, empty out. The model's file is read on the driver and
    broadcast (half a megabyte).
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c != "ids"]
    held = docs.sparkSession.sparkContext.broadcast(open(model, "rb").read())
    kinds = dict(docs.dtypes)
    inner = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__tb_text"))
    long = F.coalesce(F.char_length("__tb_text") > chunk, F.lit(False))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = loaded(held.value)
        for batch in batches:
            for at, to, data, offsets in utf8_parts(batch.column("__tb_text"), 1 << 20):
                raw = data.tobytes()
                ids = own.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at:to] for c in keep), lists], [*keep, "ids"])
        give_back()

    short = inner.filter(~long).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>"]))
    giants = inner.filter(long).withColumn("__tb_mark", F.sha2("__tb_text", 256))
    texts = cut(giants.groupBy(F.col("__tb_mark").alias("mark")).agg(F.first("__tb_text").alias("text"), F.count("*").alias("n")))
    if not texts.limit(1).count():
        return short
    scanned = scan_giants(held, texts.select("mark", "text"), chunk).withColumnRenamed("mark", "__tb_mark")
    counts = texts.select(F.col("mark").alias("__tb_mark"), "n")
    giants = giants.drop("__tb_text")
    if hot_keys(giants, ["__tb_mark"], counts).limit(1).count():  # a text with very many copies is dealt over several tasks
        whole = skew_join(giants, cut(scanned), "__tb_mark", counts=counts)
    else:  # the ids lie by mark already
        whole = giants.join(scanned, "__tb_mark")
    return short.unionByName(whole.select(*keep, "ids"))


def decode_documents(encoded: DataFrame, keep: list[str], model: str = MODEL, ids: str = "ids") -> DataFrame:
    """The columns keep of encoded with text: the pieces' text; bytes that are no UTF-8 become U+FFFD.

    Null ids give a null text, no ids an empty one. A kept column named text is replaced. Repeated rows are repeated.
    Empty in, empty out.
    """
    keep = [c for c in keep if c != "text"]
    held = encoded.sparkSession.sparkContext.broadcast(open(model, "rb").read())
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = loaded(held.value)
        for batch in batches:
            out = [own.decode(np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid else None for x in batch.column("__tb_ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    return encoded.select(*keep, F.col(ids).alias("__tb_ids")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))


def op7_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded_sha256: the digest of what the ids decode to."""
    encoded = encode_documents(table(spark, sf_dir, "documents"), model, keep=["doc_id"])
    held = spark.sparkContext.broadcast(open(model, "rb").read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = loaded(held.value)
        for batch in batches:
            lists = batch.column("ids")
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            marks = [hashlib.sha256(own.decode(flat[a:b])).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(marks)], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, n_tokens long, ids array<int>, decoded_sha256 string")
