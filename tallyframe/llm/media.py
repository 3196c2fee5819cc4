"""Baseline JPEG columns: dimensions, DC-only luminance thumbnails and their hashes.

The decoder parses the markers of a baseline file (SOI, APPn, DQT, DHT, SOF0, DRI, SOS, RSTn,
EOI), Huffman-decodes every scan and keeps the DC coefficient of each luminance block, which
gives the picture at an eighth of its size without an inverse transform. Restart intervals are
independent of each other, so those of all pictures of a batch are decoded side by side in
numpy: each step takes one symbol from every interval.

``store_payloads`` goes the other way for bytes that must come back unchanged. It makes one 8x8
block of every byte: quantised by 8, the DC coefficient ``byte - 128`` reconstructs to a flat
block of exactly that sample value, all AC coefficients being zero. The thumbnail of the stored
picture is then the payload itself, read back through the ordinary decoder.

Defined results: null text is stored as the empty text (576 bytes of 255); null media gives null
columns; media that can't be parsed give null columns and a reason in ``media_error``. Columns of
the input are kept, those with the names of the output are replaced. Equal inputs give equal outputs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.arrowtools import extended, small_batches, steps, table, without

UNIT = 576
#: Blocks of a restart interval that the writer makes; UNIT is a multiple.
LANE = 24
#: Blocks along a side that 65,535 pixels allow.
SIDE = 8191
FRAME_BYTES = UNIT * SIDE
#: Restart intervals decoded side by side: their arrays stay in a core's cache.
LANES_AT_ONCE = 16384
#: Bytes in which the end of a scan is looked for first, and of scans that are decoded together.
SCAN_AT_ONCE = 1 << 20
#: Bytes of text or media that a step of the operators takes; a longer single one is a step of its own.
STEP_BYTES = 1 << 20


class BadJpeg(ValueError):
    pass


def pad_payload(raw: bytes) -> bytes:
    """``raw`` with bytes 255 appended up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _shape(n: int) -> tuple[int, int]:
    q = n // UNIT
    return (LANE, q * LANE) if q * LANE <= SIDE else (UNIT, q)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(width: int, height: int) -> bytes:
    """Grey, quantised by 8 at DC; nine DC categories of 4 bits, and end-of-block as AC's only code, of 1 bit."""
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0, 8]) + bytes([1] * 63)),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])),
            _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
            _segment(0xDD, struct.pack(">H", LANE)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each difference -255..255: category, extra bits, end-of-block."""
    code, length = np.zeros(511, np.uint32), np.zeros(511, np.int32)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        code[d + 255], length[d + 255] = ((s << s) | extra) << 1, 4 + s + 1
    return code, length


_CODE, _LENGTH = _dc_codes()


def _encode_lanes(rows: np.ndarray, mark: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entropy-coded bytes of restart intervals (a row each), every one followed by its marker, and how many bytes each has."""
    n = len(rows)
    step = np.diff(rows.astype(np.int16) - np.int16(128), axis=1, prepend=np.int16(0)) + np.int16(255)
    code, length = _CODE[step], _LENGTH[step]
    ends = np.cumsum(length, axis=1, dtype=np.int32)
    wide = (LANE * int(_LENGTH.max()) + 7) // 8 + 3
    out = np.zeros((n, wide + 2), np.uint8)
    flat, base = out.reshape(-1), np.arange(n) * (wide + 2)
    for j in range(LANE):
        start = ends[:, j] - length[:, j]
        value = code[:, j] << (24 - length[:, j] - (start & 7)).astype(np.uint32)
        at = base + (start >> 3)
        flat[at] |= (value >> 16).astype(np.uint8)
        flat[at + 1] |= (value >> 8 & 255).astype(np.uint8)
        flat[at + 2] |= (value & 255).astype(np.uint8)
    bits = ends[:, -1]
    size = (bits + 7) >> 3
    flat[base + size - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)
    flat[base + size], flat[base + size + 1] = 255, mark
    kept = np.arange(wide + 2) < (size + 2)[:, None]
    stuffed = (np.arange(wide + 2) < size[:, None]) & (out == 255)
    places = np.flatnonzero(stuffed[kept])
    return np.insert(out[kept], places + 1, 0).tobytes(), size + 2 + stuffed.sum(axis=1)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (lengths: positive multiples of UNIT); very long ones become several frames in a row."""
    frames = [(i, p[at : at + FRAME_BYTES]) for i, p in enumerate(payloads) for at in range(0, len(p), FRAME_BYTES)]
    if not frames:
        return []
    rows = np.frombuffer(b"".join(f for _, f in frames), np.uint8).reshape(-1, LANE)
    lanes = np.array([len(f) // LANE for _, f in frames])
    last = np.cumsum(lanes) - 1
    mark = (0xD0 + ((np.arange(len(rows)) - np.repeat(last + 1 - lanes, lanes)) & 7)).astype(np.uint8)
    mark[last] = 0xD9
    coded, sizes = zip(*(_encode_lanes(rows[at : at + LANES_AT_ONCE], mark[at : at + LANES_AT_ONCE]) for at in range(0, len(rows), LANES_AT_ONCE)), strict=True)
    raw, cut = b"".join(coded), np.concatenate([[0], np.cumsum(np.concatenate(sizes))[last]])
    parts: list[list[bytes]] = [[] for _ in payloads]
    for k, (i, f) in enumerate(frames):
        w, h = _shape(len(f))
        parts[i] += [_header(8 * w, 8 * h), raw[cut[k] : cut[k + 1]]]
    return [b"".join(p) for p in parts]


def _table(body: bytes) -> list[tuple[int, tuple]]:
    """The Huffman tables of a DHT segment: their class and place, then counts and symbols."""
    found, at = [], 0
    while at < len(body):
        counts = tuple(body[at + 1 : at + 17])
        found.append((body[at], (counts, bytes(body[at + 17 : at + 17 + sum(counts)]))))
        at += 17 + sum(counts)
    return found


_LOOKUPS: dict[tuple, np.ndarray] = {}


def _lookup(counts_symbols: tuple) -> np.ndarray:
    """For each 16 bits ahead: code length + 32 x symbol; 0 where no code fits."""
    if counts_symbols not in _LOOKUPS:
        counts, symbols = counts_symbols
        full = np.zeros(1 << 16, np.int32)
        code = k = 0
        for bits, c in enumerate(counts, 1):
            for _ in range(c):
                full[code << (16 - bits) : (code + 1) << (16 - bits)] = bits + 32 * symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[counts_symbols] = full
    return _LOOKUPS[counts_symbols]


def parse_frame(media: bytes, at: int = 0) -> tuple[dict, int]:
    """The frame that begins at ``at``, and where it ends. The scan is unstuffed, ``starts`` holds its intervals."""
    if media[at : at + 2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    at += 2
    quant: dict[int, int] = {}
    tables: dict[int, tuple] = {}
    frame: dict = {"interval": 0}
    while True:
        while media[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(media) or media[at] != 255:
            raise BadJpeg("no marker where one is due")
        marker, size = media[at + 1], struct.unpack(">H", media[at + 2 : at + 4])[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                two = body[i] >> 4
                quant[body[i] & 15] = struct.unpack(">H", body[i + 1 : i + 3])[0] if two else body[i + 1]
                i += 129 if two else 65
        elif marker == 0xC4:
            tables |= dict(_table(body))
        elif marker == 0xC0:
            precision, height, width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not height or not width:
                raise BadJpeg("not 8 bits a sample, or no size")
            frame |= {"height": height, "width": width, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise BadJpeg("not baseline")
        elif marker == 0xDD:
            frame["interval"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            break
    if "parts" not in frame:
        raise BadJpeg("a scan before its frame")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if set(chosen) != {p[0] for p in frame["parts"]}:
        raise BadJpeg("components in several scans")
    try:
        frame["layout"] = tuple((i, _h, _v, tables[chosen[c] >> 4], tables[0x10 | chosen[c] & 15]) for i, (c, _h, _v, _q) in enumerate(frame["parts"]))
        frame["quant"] = quant[frame["parts"][0][3]]
    except KeyError as e:
        raise BadJpeg("a table is missing") from e
    if len(frame["parts"]) == 1:  # a lone component isn't interleaved
        frame["layout"] = tuple((i, 1, 1, d, a) for i, _, _, d, a in frame["layout"])
        frame["most"] = (1, 1)
    else:
        frame["most"] = (max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"]))
    whole, span = np.frombuffer(media, np.uint8)[at:], SCAN_AT_ONCE
    while True:
        rest = whole[:span]
        ff = np.flatnonzero(rest[:-1] == 255)
        after = rest[ff + 1]
        marks, kinds = ff[after != 0], after[after != 0]
        ends = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
        if len(ends) or span >= len(whole):
            break
        span *= 2
    if not len(ends):
        raise BadJpeg("the scan has no end")
    end, restarts = int(marks[ends[0]]), marks[: ends[0]]
    drop = np.zeros(end, bool)
    drop[ff[(after == 0) & (ff < end)] + 1] = True
    drop[restarts] = drop[restarts + 1] = True
    frame["scan"] = rest[:end][~drop]
    after_marks = restarts + 2
    frame["starts"] = np.concatenate([[0], after_marks - np.searchsorted(np.flatnonzero(drop), np.minimum(after_marks, end))]).astype(np.int64)
    if media[at + end + 1] != 0xD9:
        raise BadJpeg("more than one scan")
    wide, high = -(-frame["width"] // (8 * frame["most"][0])), -(-frame["height"] // (8 * frame["most"][1]))
    frame["mcus"] = (high, wide)
    frame["interval"] = frame["interval"] or high * wide
    if len(frame["starts"]) != -(-high * wide // frame["interval"]):
        raise BadJpeg("restart markers are missing")
    return frame, at + end + 2


def _decode_lanes(scan: np.ndarray, starts: np.ndarray, mcus: np.ndarray, layout: tuple) -> np.ndarray:
    """Luminance DC coefficients (lane, MCU, block in MCU) of intervals that share tables; ``mcus``: their lengths, falling."""
    ahead = np.concatenate([scan, np.zeros(8, np.uint8)]).astype(np.uint32)
    ahead = ahead[:-3] << 24 | ahead[1:-2] << 16 | ahead[2:-1] << 8 | ahead[3:]
    top = len(ahead) - 1
    bit = starts * 8
    blocks = [(i, _lookup(d), _lookup(a)) for i, h, v, d, a in layout for _ in range(h * v)]
    luma = sum(i == 0 for i, _, _ in blocks)
    out = np.zeros((len(starts), int(mcus[0]), luma), np.int32)
    before = np.zeros((len(layout), len(starts)), np.int32)

    def peek(at: np.ndarray) -> np.ndarray:
        return (ahead[np.minimum(at >> 3, top)] << (at & 7).astype(np.uint32)) >> 16

    for m in range(int(mcus[0])):
        n = int(np.searchsorted(-mcus, -m))
        live = bit[:n]
        for b, (part, dc, ac) in enumerate(blocks):
            found = dc[peek(live)]
            if not found.all():
                raise BadJpeg("no such code")
            live = live + (found & 31)
            s = found >> 5
            extra = (peek(live) >> (16 - s).astype(np.uint32)).astype(np.int32)
            live += s
            before[part, :n] += np.where(extra < (1 << s >> 1), extra - (1 << s) + 1, extra)
            if part == 0:
                out[:n, m, b] = before[0, :n]
            left, k = np.arange(n), np.ones(n, np.int32)
            while len(left):
                found = ac[peek(live[left])]
                if not found.all():
                    raise BadJpeg("no such code")
                symbol = found >> 5
                live[left] += (found & 31) + (symbol & 15)
                k += np.where(symbol == 0, 64, (symbol >> 4) + 1)
                going = k < 64
                left, k = left[going], k[going]
        bit[:n] = live
    return out


def decode_thumbnails(media: list[bytes | None]) -> list[dict | str | None]:
    """Of each: width, height, frames and thumbnails (luminance, uint8); what is wrong with it; None for null."""
    result: list[dict | str | None] = [None] * len(media)
    groups: dict[tuple, list[tuple[int, int, dict]]] = {}
    held = 0
    for i, x in enumerate(media):
        if x is None:
            continue
        at, k = 0, 0
        result[i] = {"frames": 0, "thumbs": []}
        try:
            while not k or at < len(x):
                frame, at = parse_frame(x, at)
                own = result[i]
                if not isinstance(own, dict):  # an earlier frame of it turned out broken
                    break
                if not k:
                    own |= {"width": frame["width"], "height": frame["height"]}
                own["frames"] += 1
                own["thumbs"].append(None)
                groups.setdefault(frame["layout"], []).append((i, k, frame))
                held, k = held + len(frame["scan"]), k + 1
                if held >= SCAN_AT_ONCE:
                    _decode_groups(groups, result)
                    held = 0
        except (BadJpeg, struct.error, IndexError) as e:
            result[i] = str(e) or "cut short"
    _decode_groups(groups, result)
    return result


def _decode_groups(groups: dict[tuple, list[tuple[int, int, dict]]], result: list) -> None:
    """Thumbnails of the frames, by tables; empties ``groups``. Those of pictures found broken are left out."""
    for layout, found in groups.items():
        members = [m for m in found if isinstance(result[m[0]], dict)]
        if not members:
            continue
        try:
            _decode_group(layout, members, result)
        except BadJpeg:  # one of them is broken: find out which
            for one in members:
                try:
                    _decode_group(layout, [one], result)
                except BadJpeg as e:
                    result[one[0]] = str(e)
    groups.clear()


def _decode_group(layout: tuple, members: list[tuple[int, int, dict]], result: list) -> None:
    offsets = np.cumsum([0, *(len(f["scan"]) for _, _, f in members)])
    scan = np.concatenate([f["scan"] for _, _, f in members])
    starts = np.concatenate([f["starts"] + o for (_, _, f), o in zip(members, offsets, strict=False)])
    stops = np.concatenate([np.append(f["starts"][1:], len(f["scan"])) + o for (_, _, f), o in zip(members, offsets, strict=False)])
    counts = []
    for _, _, f in members:
        total, each = f["mcus"][0] * f["mcus"][1], f["interval"]
        c = np.full(len(f["starts"]), each)
        c[-1] = total - each * (len(c) - 1)
        counts.append(c)
    mcus = np.concatenate(counts)
    order = np.argsort(-mcus, kind="stable")
    luma = layout[0][1] * layout[0][2]
    first = np.concatenate([[0], np.cumsum(mcus)])
    values = np.zeros((int(first[-1]), luma), np.int32)
    for at in range(0, len(order), LANES_AT_ONCE):
        own = order[at : at + LANES_AT_ONCE]
        low, high = int(starts[own].min()), int(stops[own].max())
        got = _decode_lanes(scan[low:high], starts[own] - low, mcus[own], layout)
        there = np.arange(got.shape[1])
        inside = there < mcus[own][:, None]
        values[(first[own][:, None] + there)[inside]] = got[inside]
    at = 0
    for i, k, f in members:
        high, wide = f["mcus"]
        own = values[at : at + high * wide]
        at += high * wide
        if not isinstance(result[i], dict):
            continue
        h, v = layout[0][1:3]
        grid = own.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        ph, pv = (1, 1) if len(f["parts"]) == 1 else f["parts"][0][1:3]
        w8 = -(-(-(-f["width"] * ph // f["most"][0])) // 8) if len(f["parts"]) > 1 else -(-f["width"] // 8)
        h8 = -(-(-(-f["height"] * pv // f["most"][1])) // 8) if len(f["parts"]) > 1 else -(-f["height"] // 8)
        grid = grid[:h8, :w8]
        result[i]["thumbs"][k] = np.clip(np.floor(grid * f["quant"] / 8 + 128.5), 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Difference hash: 64 bits, each whether a cell of an 8 x 9 grid of means is darker than its right neighbour."""
    h, w = thumb.shape
    down = np.add.reduceat(thumb, np.arange(8) * h // 8, axis=0, dtype=np.float64)
    cells = np.add.reduceat(down, np.arange(9) * w // 9, axis=1)
    rows = np.maximum(1, np.diff(np.append(np.arange(8) * h // 8, h)))
    columns = np.maximum(1, np.diff(np.append(np.arange(9) * w // 9, w)))
    means = cells / rows[:, None] / columns
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def _added(df: DataFrame, work, fields: str, names: list[str]) -> DataFrame:
    """``df`` through ``work``, with the columns ``names`` at its end in place of any that it has."""
    small_batches(df.sparkSession)
    kept = without(df, names)
    return kept.mapInArrow(work, extended(kept, fields))


_STORED = ["n_bytes", "payload_bytes", "media"]
_READ = ["media_width", "media_height", "media_frames", "thumbnail", "thumbnail_hash", "media_error"]


def _store(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, text, STEP_BYTES):
        raw = [(x or "").encode() for x in b.column(text).to_pylist()]
        payloads = [pad_payload(x) for x in raw]
        sizes = [pa.array(map(len, x), pa.int64()) for x in (raw, payloads)]
        yield pa.RecordBatch.from_arrays([*b.columns, *sizes, pa.array(encode_payloads(payloads), pa.binary())], names=[*b.schema.names, *_STORED])


def _read(batches: Iterator[pa.RecordBatch], media: str) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    for b in steps(batches, media, STEP_BYTES):
        rows = []
        for x in decode_thumbnails(b.column(media).to_pylist()):
            if isinstance(x, dict):
                own = "-".join(thumbnail_hash(t) for t in x["thumbs"])
                rows.append((x["width"], x["height"], x["frames"], b"".join(t.tobytes() for t in x["thumbs"]), own, None))
            else:
                rows.append((None, None, None, None, None, x))
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*b.schema.names, *_READ])


def store_payloads(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``payload_bytes`` and ``media``: the padded UTF-8 bytes as a JPEG."""
    return _added(df, lambda batches: _store(batches, text), "n_bytes long, payload_bytes long, media binary", _STORED)


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds the dimensions, frames, thumbnail (bytes, row by row), its hash and what is wrong, of each JPEG in ``media``."""
    fields = "media_width int, media_height int, media_frames int, thumbnail binary, thumbnail_hash string, media_error string"
    return _added(df, lambda batches: _read(batches, media), fields, _READ)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``store_payloads``, then ``media_columns``, then digests of both, step by step in one worker."""
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(_store(batches, "text"), "media"):
            back, media = b.column("thumbnail").to_pylist(), b.column("media").to_pylist()
            shape = zip(*(b.column(c).to_pylist() for c in ("media_width", "media_height", "media_frames", "thumbnail_hash")), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in ("doc_id", "n_bytes")),
                    pa.array(map(len, back), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()),
                    pa.array(map(len, media), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                    pa.array([f"{w}x{h}x{n}:{own}" for w, h, n, own in shape]),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(
        work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
