"""Media columns: AVI motion-JPEG.  Lossless byte payloads in, RIFF parsing, intra decoding, shot detection out.

A payload is carried by the quantised coefficients of baseline JPEG blocks: 64 bytes are the 64 coefficients
of one 8x8 block.  Every coefficient has size category 8 (its magnitude is 128 to 255), whose eight extra bits are
the byte; DC restarts at each block (restart interval 1), so it needs no prediction.  Both Huffman tables hold
the single symbol 0x08 with an eight-bit code, which any baseline decoder reads.  Frames are 8 samples wide and
up to ``BLOCKS`` blocks high.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Blocks of 64 bytes per frame, and frames per second.
BLOCKS, FPS = 8, 25
#: Order in which JPEG stores the 64 coefficients of a block, by diagonals (built from the rule).
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in sorted(((r, s - r) for r in range(max(0, s - 7), min(8, s + 1))), reverse=s % 2 == 0)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(blocks: int) -> bytes:
    """JPEG headers of a frame of so many blocks: quantisers of 1, one component, the two one-symbol tables."""
    table = bytes([0] * 7 + [1] + [0] * 8 + [8])
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * blocks, 8, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + table + b"\x10" + table) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _scan(payload: np.ndarray) -> bytes:
    """Entropy-coded data of whole blocks: code byte 0, then the payload byte (stuffed after 0xFF); RST between blocks."""
    n = len(payload) // 64
    out = np.zeros((n, 130), np.uint8)
    out[:, 1:128:2] = payload.reshape(n, 64)
    out[:, 128] = 0xFF
    out[:, 129] = 0xD0 + np.arange(n) % 8
    if not (payload == 0xFF).any():
        return out.reshape(-1)[:-2].tobytes()
    parts = [row[:128].tobytes().replace(b"\xff", b"\xff\0") + row[128:].tobytes() for row in out]
    return b"".join(parts)[:-2]


def encode_frames(payload: bytes) -> list[bytes]:
    data = np.frombuffer(payload, np.uint8)
    size = 64 * BLOCKS
    out, full = [], len(data) // size
    if full:
        head = np.frombuffer(_head(BLOCKS), np.uint8)
        if (data == 0xFF).any():
            out = [head.tobytes() + _scan(data[k * size : (k + 1) * size]) + b"\xff\xd9" for k in range(full)]
        else:  # all frames of one size at once
            body = np.zeros((full, BLOCKS, 130), np.uint8)
            body[:, :, 1:128:2] = data[: full * size].reshape(full, BLOCKS, 64)
            body[:, :, 128] = 0xFF
            body[:, :, 129] = 0xD0 + np.arange(BLOCKS) % 8
            body[:, -1, 129] = 0xD9  # the end marker takes the last restart's place
            whole = np.concatenate([np.broadcast_to(head, (full, len(head))), body.reshape(full, -1)], 1)
            raw, step = whole.tobytes(), whole.shape[1]
            out = [raw[k * step : (k + 1) * step] for k in range(full)]
    if len(data) > full * size:
        rest = data[full * size :]
        out.append(_head(len(rest) // 64) + _scan(rest) + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = 8, height: int = 8 * BLOCKS, fps: int = FPS) -> bytes:
    """RIFF AVI with one MJPG stream and an idx1 index."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl)
    index, at, body = [], 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(struct.pack("<4sI", b"00dc", len(f)) + f + b"\0" * (len(f) % 2))
        at += 8 + len(f) + len(f) % 2
    movi = b"movi" + b"".join(body)
    riff = b"AVI " + hdrl + b"LIST" + struct.pack("<I", len(movi)) + movi + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """Video frames in index order (without an index: in file order) and seconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, entries, seconds, found = 0, None, 1 / FPS, []

    def walk(at: int, end: int) -> None:
        nonlocal movi, entries, seconds
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                if kind != b"movi" or b"idx1" != data[at + 8 + size + size % 2 :][:4]:
                    walk(at + 12, min(end, at + 8 + size))
            elif name == b"avih":
                seconds = struct.unpack_from("<I", data, at + 8)[0] / 1e6 or seconds
            elif name == b"idx1":
                entries = [struct.unpack_from("<4sIII", data, at + 8 + k) for k in range(0, size - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                found.append((at + 8, size))
            at += 8 + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if entries is None:
        return [data[a : a + n] for a, n in found], seconds
    video = [(o, n) for name, _, o, n in entries if name[2:] in (b"dc", b"db")]
    base = movi if not video or data[movi + video[0][0] : movi + video[0][0] + 4][2:] in (b"dc", b"db") else 0  # offsets count from 'movi' or from the file's start
    return [data[base + o + 8 : base + o + 8 + n] for o, n in video], seconds


class _Bits:
    """Bits of an entropy-coded segment, stuffing removed."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data.replace(b"\xff\0", b"\xff"), "big"), 8 * len(data.replace(b"\xff\0", b"\xff"))

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < -64:
            raise ValueError("entropy-coded data ends early")
        return (self.value >> self.left if self.left >= 0 else self.value << -self.left) & ((1 << n) - 1)

    def symbol(self, codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("unknown Huffman code")


def _extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def parse_jpeg(data: bytes) -> dict:
    """Tables, geometry and the scan's restart segments of a baseline JPEG of one component."""
    out: dict = {"quant": {}, "huff": {}, "interval": 0}
    at = 2
    while at < len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, code, k = body[1:17], 0, 17
                codes = {}
                for n, many in enumerate(counts, 1):
                    for _ in range(many):
                        codes[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                out["huff"][body[0]] = codes
                body = body[k:]
        elif marker == 0xC0:
            out["height"], out["width"], n = struct.unpack_from(">HHB", body, 1)
            if n != 1:
                raise ValueError("one component expected")
            out["table"] = body[8]
        elif marker == 0xDD:
            out["interval"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["dc"], out["ac"] = body[2] >> 4, 0x10 | body[2] & 15
            out["scan"] = data[at + 2 + size : data.rindex(b"\xff\xd9")]
            return out
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("baseline JPEG expected")
        at += 2 + size
    raise ValueError("no scan")


def coefficients(data: bytes) -> tuple[np.ndarray, dict]:
    """Quantised coefficients in zigzag order, one row per block, and the parsed headers."""
    j = parse_jpeg(data)
    blocks = -(-j["width"] // 8) * -(-j["height"] // 8)
    scan, one = j["scan"], {(8, 0): 8}
    if j["interval"] == 1 and j["huff"].get(j["dc"]) == one and j["huff"].get(j["ac"]) == one and len(scan) == 130 * blocks - 2:
        raw = np.frombuffer(scan + b"\xff\xd9", np.uint8).reshape(blocks, 130)[:, 1:128:2].astype(np.int32)  # equal-length codes: no serial pass
        return np.where(raw >= 128, raw, raw - 255), j
    parts, last = [], 0
    k = 0
    while k < len(scan) - 1:
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            parts.append(scan[last:k])
            last = k = k + 2
        else:
            k += 1
    parts.append(scan[last:])
    out, row = np.zeros((blocks, 64), np.int32), 0
    for part in parts:
        bits, dc = _Bits(part), 0
        for _ in range(min(j["interval"] or blocks, blocks - row)):
            n = bits.symbol(j["huff"][j["dc"]])
            dc += _extend(bits.take(n), n)
            out[row, 0], z = dc, 1
            while z < 64:
                s = bits.symbol(j["huff"][j["ac"]])
                if s == 0:
                    break
                z += s >> 4
                if s & 15:
                    out[row, z] = _extend(bits.take(s & 15), s & 15)
                z += 1
            row += 1
    return out, j


def _dct() -> np.ndarray:
    """64 x 64 matrix from coefficients in zigzag order to samples in row order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


def decode_frame(data: bytes, matrix: np.ndarray | None = None) -> np.ndarray:
    """Samples (blocks x 64, clipped to 0..255) of a frame."""
    coef, j = coefficients(data)
    samples = (coef * j["quant"][j["table"]]).astype(np.float32) @ (_dct() if matrix is None else matrix)
    return np.clip(samples + 128.5, 0, 255).astype(np.uint8)


def payload_of(frames: list[bytes]) -> bytes:
    """The bytes that encode_frames() stored: the extra bits of each category-8 coefficient."""
    out = []
    for coef in _all(frames)[0]:
        out.append(np.where(coef > 0, coef, coef + 255).astype(np.uint8).tobytes())
    return b"".join(out)


def _all(frames: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Coefficients per frame and each frame's quantisers; frames with equal headers are parsed once and split together."""
    out: list = [None] * len(frames)
    quant = np.ones((len(frames), 64), np.int32)
    like: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        like.setdefault((f[: f.index(b"\xff\xda") + 10], len(f)), []).append(i)
    for (head, size), at in like.items():
        first, j = coefficients(frames[at[0]])
        quant[at] = j["quant"][j["table"]]
        if len(at) > 1 and size == len(head) + 130 * len(first) and j["interval"] == 1 and j["huff"][j["dc"]] == j["huff"][j["ac"]] == {(8, 0): 8}:
            raw = np.frombuffer(b"".join([frames[i] for i in at]), np.uint8).reshape(len(at), size)[:, len(head) :].reshape(len(at), -1, 130)[:, :, 1:128:2].astype(np.int32)
            both = np.where(raw >= 128, raw, raw - 255)
            for k, i in enumerate(at):
                out[i] = both[k]
        else:
            for i in at:
                out[i] = coefficients(frames[i])[0]
    return out, quant


def histograms(frames: list[bytes], matrix: np.ndarray, coefs: list[np.ndarray] | None = None, quant: np.ndarray | None = None) -> np.ndarray:
    """Share of samples in 16 bins of brightness, per frame."""
    if not frames:
        return np.zeros((0, 16))
    if coefs is None:
        coefs, quant = _all(frames)
    sizes = np.array([len(c) for c in coefs])
    samples = (np.concatenate(coefs) * np.repeat(quant, sizes, 0)).astype(np.float32) @ matrix
    bins = np.clip(samples + 128.5, 0, 255).astype(np.int32) >> 4
    owner = np.repeat(np.arange(len(frames)), sizes * 64)
    count = np.bincount(owner * 16 + bins.reshape(-1), minlength=16 * len(frames)).reshape(-1, 16)
    return count / np.maximum(1, count.sum(1, keepdims=True))


def shots(hist: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.25) -> list[int]:
    """First frames of shots: the histogram difference is over ``least`` and over ``factor`` times the mean of the
    differences of the ``window`` frames before."""
    if len(hist) < 1:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    run = np.concatenate([[0.0], np.cumsum(d)])
    out = [0]
    for k in range(len(d)):
        a = max(0, k - window)
        mean = (run[k] - run[a]) / max(1, k - a)
        if d[k] > max(least, factor * mean if k > a else 0.0):
            out.append(k + 1)
    return out


def clips(avi: bytes, matrix: np.ndarray | None = None) -> list[tuple[int, float, float, int]]:
    """Timed clip rows of a file: number, start and end in seconds, frames."""
    frames, seconds = read_avi(avi)
    hist = histograms(frames, _dct() if matrix is None else matrix)
    first = shots(hist)
    return [(k, a * seconds, b * seconds, b - a) for k, (a, b) in enumerate(zip(first, [*first[1:], len(frames)], strict=True))]


def payload_for(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text (null: none) and their number before zeros fill them to a positive multiple of 64."""
    b = (text or "").encode()
    return len(b), b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))


def media_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and ``media``: each whole text as an AVI file."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                files = [write_avi(encode_frames(payload_for(t)[1])) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """One row per detected shot of each file in ``media`` (null files give none)."""

    def run(batches):
        matrix = _dct()
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), b.column("media")
            out = [(i, *c) for i, m in zip(ids, rows, strict=True) if m.is_valid for c in clips(m.as_py(), matrix)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())], ["doc_id", "clip", "start_s", "end_s", "frames"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, frames int")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None, matrix: np.ndarray) -> tuple:
    """Store a text, read the stored bytes back, and describe both: the digest columns after doc_id."""
    n, payload = payload_for(text)
    media = write_avi(encode_frames(payload))
    frames, seconds = read_avi(media)
    coefs, quant = _all(frames)
    back = np.concatenate([np.where(c > 0, c, c + 255).astype(np.uint8).reshape(-1) for c in coefs]).tobytes()
    hist = histograms(frames, matrix, coefs, quant)
    first = shots(hist)
    mean = hist.mean(0)
    feature = f"frames={len(frames)};shots={len(first)};cuts={','.join(map(str, first[1:]))};seconds={len(frames) * seconds:.2f};hist={','.join(f'{v:.3f}' for v in mean)}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op7(docs: DataFrame) -> DataFrame:
    """Per document the digests of its payload as read back from its AVI file, and shot features.

    Null and empty texts are 64 zero bytes, one frame.  Equal texts give equal values; extra columns are not read."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        matrix = _dct()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = list(zip(*[digest(t.as_py(), matrix) for t in part.column("text")], strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
