"""AVI motion-JPEG: payloads as frames, RIFF indexes, intra decoding, and shots by adaptive histogram differences.

Stored losslessly, a payload byte is the level of one 8 x 8 block of a grey frame: the block is flat, its DC coefficient
(quantised by 8) is the level itself, so decoding gives back every byte. The Huffman tables give each DC difference a
code so long that code, extra bits and end-of-block are 16 bits; frames of that kind decode as whole arrays, any other
baseline grey stream is decoded bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import table, utf8_parts

#: Blocks across and down a frame, frames a second.
ACROSS, DOWN, RATE = 32, 32, 25
#: Histogram bins; a cut differs by more than so many mean deviations from the mean of the window before it, and by the least share.
HIST_BINS, WINDOW, DEVIATIONS, LEAST_CHANGE = 32, 12, 3.0, 0.08

_FRAME = ACROSS * DOWN
_CATEGORY = np.zeros(512, np.int64)  # of a DC difference, by its magnitude
_CATEGORY[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int64) + 1
# Categories 8 to 0 have codes of 7 to 15 bits, canonical: 0000000, 00000010, 000000110, ...
_CODES = {8 - i: (2 ** (i + 1) - 2, 7 + i) for i in range(9)}
_CODE = np.array([_CODES[c][0] for c in range(9)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    dqt = _segment(0xDB, bytes([0, 8] + [1] * 63))
    sof = _segment(0xC0, struct.pack(">BHHBBBB", 8, DOWN * 8, ACROSS * 8, 1, 1, 0x11, 0))
    lengths = [0] * 6 + [1] * 9 + [0]
    dc = _segment(0xC4, bytes([0, *lengths, *range(8, -1, -1)]))
    ac = _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    return b"\xff\xd8" + dqt + sof + dc + ac + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


HEAD, TAIL = _head(), b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> np.ndarray:
    """JPEG frames (n x bytes, all as long) of n x blocks samples."""
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)).astype(np.int64)
    kind = _CATEGORY[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << kind) - 1, diff)
    word = (_CODE[kind] << (kind + 1)) | (extra << 1)  # code, extra bits, end of block (0)
    out = np.empty((len(samples), len(HEAD) + 2 * samples.shape[1] + 2), np.uint8)
    out[:, : len(HEAD)] = np.frombuffer(HEAD, np.uint8)
    out[:, len(HEAD) : -2] = word.astype(">u2").view(np.uint8).reshape(len(samples), -1)
    out[:, -2:] = np.frombuffer(TAIL, np.uint8)
    return out


def write_avi(payload: np.ndarray, frames_a_part: int = 512) -> bytes:
    """An AVI (one MJPG stream, with idx1) that holds payload; its length is in the stream's name chunk."""
    n = max(1, -(-len(payload) // _FRAME))
    size = len(HEAD) + 2 * _FRAME + 2
    pad = size & 1
    chunk = size + 8 + pad
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, size, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 24, b"MJPG", ACROSS * DOWN * 192, 0, 0, 0, 0)
    name = str(len(payload)).encode().ljust(20, b"\0")
    piece = lambda tag, body: struct.pack("<4sI", tag, len(body)) + body + b"\0" * (len(body) & 1)
    strl = piece(b"LIST", b"strl" + piece(b"strh", strh) + piece(b"strf", strf) + piece(b"strn", name))
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, size, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    hdrl = piece(b"LIST", b"hdrl" + piece(b"avih", avih) + strl)
    parts = []
    for at in range(0, n, frames_a_part):
        block = payload[at * _FRAME : (at + frames_a_part) * _FRAME]
        count = min(frames_a_part, n - at)
        samples = np.zeros(count * _FRAME, np.uint8)
        samples[: len(block)] = block
        framed = np.zeros((count, chunk), np.uint8)
        framed[:, :8] = np.frombuffer(struct.pack("<4sI", b"00dc", size), np.uint8)
        framed[:, 8 : 8 + size] = encode_frames(samples.reshape(count, _FRAME))
        parts.append(framed.tobytes())
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, size
    index[:, 2] = 4 + chunk * np.arange(n)
    movi = struct.pack("<4sI4s", b"LIST", 4 + n * chunk, b"movi")
    body = b"".join([b"AVI ", hdrl, movi, *parts, piece(b"idx1", index.tobytes())])
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def riff_frames(avi: bytes) -> tuple[list[tuple[int, int]], int | None, int, float]:
    """((start, end) of each video frame, payload length if noted, blocks of a frame, frames a second), by the RIFF tree and idx1."""
    view = memoryview(avi)
    spans, noted, movi, scanned, blocks, rate = [], None, 0, [], 0, float(RATE)
    stack = [(12, len(avi))] if avi[:4] == b"RIFF" and avi[8:12] == b"AVI " else []
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            tag, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
            body = at + 8
            if tag == b"LIST":
                kind = bytes(view[body : body + 4])
                if kind == b"movi":
                    movi = body
                if kind in (b"hdrl", b"strl", b"movi", b"rec "):
                    stack.append((body + 4, min(end, body + size)))
            elif tag == b"strh":
                scale, ticks = struct.unpack("<II", view[body + 20 : body + 28])
                rate = ticks / scale if scale else rate
            elif tag == b"strf":
                wide, high = struct.unpack("<ii", view[body + 4 : body + 12])
                blocks = -(-wide // 8) * -(-abs(high) // 8)
            elif tag == b"strn":
                noted = int(bytes(view[body : body + size]).rstrip(b"\0") or b"0") if bytes(view[body : body + size]).rstrip(b"\0").isdigit() else None
            elif tag[2:] in (b"dc", b"db"):
                scanned.append((body, body + size))
            elif tag == b"idx1":
                entries = np.frombuffer(view[body : body + size // 16 * 16], "<u4").reshape(-1, 4)
                video = entries[np.isin(entries[:, 0] >> 16, [int.from_bytes(b"dc", "little"), int.from_bytes(b"db", "little")])]
                base = movi if not len(video) or video[0, 2] < movi else 0
                spans = [(int(o) + base + 8, int(o) + base + 8 + int(s)) for o, s in zip(video[:, 2], video[:, 3], strict=True)]
            at = body + size + (size & 1)
    return spans or scanned, noted, blocks, rate


def _jpeg_parts(frame: bytes) -> tuple[dict, int]:
    """Tables and the place of the entropy-coded data of a baseline grey JPEG."""
    at, info = 2, {"dc": {}, "dqt": {}}
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            info["dqt"][body[0] & 15] = body[1]
        elif marker == 0xC0:
            info |= {"high": int.from_bytes(body[1:3], "big"), "wide": int.from_bytes(body[3:5], "big"), "parts": body[5]}
        elif marker == 0xC4:
            while body:
                n, code, table_ = sum(body[1:17]), 0, {}
                symbols = iter(body[17 : 17 + n])
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table_[length, code] = next(symbols)
                        code += 1
                    code <<= 1
                info["dc"][body[0]] = table_
                body = body[17 + n :]
        elif marker == 0xDA:
            return info, at + 2 + size
        at += 2 + size
    return info, len(frame)


def _decode_slow(frame: bytes) -> np.ndarray:
    """Mean level of each block of a baseline grey JPEG, bit by bit."""
    info, at = _jpeg_parts(frame)
    bits = np.unpackbits(np.frombuffer(frame[at:-2].replace(b"\xff\x00", b"\xff"), np.uint8))
    dc, ac = info["dc"].get(0, {}), info["dc"].get(0x10, {})
    place, level, out = 0, 0, []

    def symbol(codes: dict) -> int:
        nonlocal place
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(bits[place])
            place += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def extra(n: int) -> int:
        nonlocal place
        v = int("".join(map(str, bits[place : place + n])) or "0", 2)
        place += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for _ in range(-(-info["wide"] // 8) * -(-info["high"] // 8)):
        level += extra(symbol(dc))
        k = 1
        while k < 64 and (s := symbol(ac)):
            extra(s & 15)
            k += (s >> 4) + 1
        out.append(min(255, max(0, round(level * info["dqt"].get(0, 8) / 8) + 128)))
    return np.array(out, np.uint8)


def decode_frames(avi: bytes, spans: list[tuple[int, int]], most: int = 512) -> Iterator[np.ndarray]:
    """The blocks' levels of the frames, some at a time (frames x blocks)."""
    size = len(HEAD) + 2 * _FRAME + 2
    at = 0
    while at < len(spans):
        group = spans[at : at + most]
        gap = group[1][0] - group[0][0] if len(group) > 1 else size
        raw = np.frombuffer(avi, np.uint8, count=min(len(avi) - group[0][0], gap * (len(group) - 1) + size), offset=group[0][0]) if group[0][0] + size <= len(avi) else np.zeros(0, np.uint8)
        same = all(b - a == size for a, b in group) and all(group[i][0] + gap == group[i + 1][0] for i in range(len(group) - 1)) and len(raw) == gap * (len(group) - 1) + size
        framed = np.lib.stride_tricks.as_strided(raw, (len(group), size), (gap, 1)) if same else None
        if framed is not None and (framed[:, : len(HEAD)] == np.frombuffer(HEAD, np.uint8)).all():
            word = np.ascontiguousarray(framed[:, len(HEAD) : -2]).view(">u2").astype(np.int64)
            ones = np.searchsorted(_STARTS, word, "right") - 1  # leading code: category 8 - ones
            kind = 8 - ones
            extra = (word >> 1) & ((1 << kind) - 1)
            diff = np.where((kind > 0) & (extra >> np.maximum(kind - 1, 0) == 0), extra - (1 << kind) + 1, extra)
            yield (128 + np.cumsum(diff, axis=1)).astype(np.uint8)
        else:
            for a, b in group:
                yield _decode_slow(bytes(avi[a:b]))[None]
        at += most


#: The least 16-bit word of each category's code, from category 8 down.
_STARTS = np.array([_CODES[c][0] << (c + 1) for c in range(8, -1, -1)], np.int64)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames of the shots: a cut where the histogram changes by more than the changes of the window before it allow."""
    if not len(histograms):
        return []
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * np.maximum(1, histograms[1:].sum(axis=1)))
    cuts, began = [], 0
    for i, c in enumerate(change.tolist()):
        past = change[max(began, i - WINDOW) : i]
        limit = max(LEAST_CHANGE, float(past.mean() + DEVIATIONS * np.abs(past - past.mean()).mean()) if len(past) else LEAST_CHANGE)
        if c > limit:
            cuts.append(i + 1)
            began = i + 1
    edges = [0, *cuts, len(histograms)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def read_media(avi: bytes) -> dict:
    """Payload digest, frame count and shots of an AVI; frames are decoded some at a time. Bytes without frames give none."""
    spans, noted, blocks, rate = riff_frames(avi)
    length = noted if noted is not None else len(spans) * blocks
    sha, left, tail, hists = hashlib.sha256(), length, b"", []
    for levels in decode_frames(avi, spans):
        got = levels.reshape(-1)[:left].tobytes()
        sha.update(got)
        left -= len(got)
        tail = (tail + got)[-64:]
        hists.append(np.stack([np.bincount(f >> 3, minlength=HIST_BINS) for f in levels]))
    clips = shots(np.concatenate(hists)) if hists else []
    return {"payload_bytes": length - left, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "frames": len(spans), "rate": rate, "clips": clips}


CLIPS = "array<struct<clip:int,first:int,stop:int,start_s:double,stop_s:double>>"


def clip_table(media: DataFrame, keep: list[str], avi: str = "media") -> DataFrame:
    """Timed clip rows of AVI columns: keep, clip, first, stop (frames), start_s, stop_s. Null or other bytes give no row.

    Kept columns of these names are replaced. Repeated rows give repeated clips. Empty in, empty out.
    """
    keep = [c for c in keep if c not in ("clip", "first", "stop", "start_s", "stop_s")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(i, c, a, b, r["rate"]) for i, x in enumerate(batch.column("__tb_avi")) if x.is_valid for r in [read_media(x.as_py())] for c, (a, b) in enumerate(r["clips"])]
            rows = pa.array([f[0] for f in found], pa.int64())
            cols = [pa.array([f[j] for f in found], pa.int32()) for j in (1, 2, 3)] + [pa.array([f[j] / f[4] for f in found], pa.float64()) for j in (2, 3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), *cols], [*keep, "clip", "first", "stop", "start_s", "stop_s"])

    kinds = dict(media.dtypes)
    return media.select(*keep, F.col(avi).alias("__tb_avi")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "clip int, first int, stop int, start_s double, stop_s double"]))


def payload_of(text: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    out = np.zeros(max(1, -(-len(text) // 64)) * 64, np.uint8)
    out[: len(text)] = text
    return out


def media_columns(docs: DataFrame, keep: list[str], with_media: bool = False, text: str = "text") -> DataFrame:
    """Each whole text stored as an AVI and read back: digests of both, shots, and the AVI itself if asked for.

    Null texts are empty; equal texts give equal values; repeated rows are repeated. Kept columns of the new ones' names
    are replaced. Empty in, empty out.
    """
    kinds = dict(docs.dtypes)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    keep = [c for c in keep if c not in [*names, "media"]]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, stored = [], []
            for _, _, data, offsets in utf8_parts(batch.column("__tb_text")):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    avi = write_avi(payload_of(data[a:b]))
                    back = read_media(avi)
                    clips = "|".join(f"{s / back['rate']:.2f}-{e / back['rate']:.2f}" for s, e in back["clips"])
                    rows.append((b - a, back["payload_bytes"], back["payload_sha256"], back["tail_crc32"], len(avi), hashlib.sha256(avi).hexdigest(), f"frames={back['frames']};shots={len(back['clips'])};clips={clips}"))
                    if with_media:
                        stored.append(avi)
            kind = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[j] for r in rows], kind[j]) for j in range(7)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols, *([pa.array(stored, pa.binary())] if with_media else [])], [*keep, *names, *(["media"] if with_media else [])])

    return docs.select(*keep, F.col(text).alias("__tb_text")).mapInArrow(run, schema + (", media binary" if with_media else ""))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), ["doc_id"])
