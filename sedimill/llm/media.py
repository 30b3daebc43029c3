"""Media columns in baseline JPEG.

``decoded`` parses markers, Huffman-decodes the scan of each restart interval (all
intervals of many images at once) and rebuilds the luminance image of one sample per
8x8 block from the DC coefficients alone. ``encoded`` writes any bytes as such an
image: one byte for each block, a flat block of that grey, so that the DC-only image
returns the bytes without loss. 64 blocks make a row and a restart interval; more
rows than a JPEG may have go to further images, stored one after the other.

Defined results: a null or empty text is a payload of 64 zero bytes; equal payloads
have equal media and features; bytes that are no baseline JPEG give a null size and
an empty image; repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import flat, tuned

ROW = 64
#: Rows of blocks in an image: 65,535 lines at most.
ROWS = 8191
#: Bytes of payload handled at once.
BLOCK = 1_500_000
#: Code lengths of the DC categories 0 to 8 in our images; text has mostly middling steps.
DC_LENGTHS = {6: 2, 5: 2, 4: 3, 3: 3, 7: 3, 2: 4, 1: 5, 0: 6, 8: 7}


def canonical(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a DHT table."""
    out, code, i = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[i]] = (code, length)
            code += 1
            i += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_symbols = sorted(DC_LENGTHS, key=lambda s: (DC_LENGTHS[s], s))
_counts = [sum(v == n for v in DC_LENGTHS.values()) for n in range(1, 17)]
_DC = canonical(_counts, _symbols)
_CODE = np.array([_DC[c][0] for c in range(9)])
_LEN = np.array([_DC[c][1] for c in range(9)])
_step = np.arange(-255, 256)
_cat = np.zeros(511, np.int64)
_cat[_step != 0] = np.floor(np.log2(np.abs(_step[_step != 0]))) + 1
#: For each step from -255 to 255: the DC code, the step's bits and the end of block (one 0 bit), times 32, and the number of bits.
_STEPS = ((((_CODE[_cat] << _cat) + np.where(_step < 0, _step + (1 << _cat) - 1, _step)) << 1) * 32 + _LEN[_cat] + _cat + 1).astype(np.int32)
_TABLES = _segment(0xC4, bytes([0x00, *_counts, *_symbols])) + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0x00]))


def _head(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xDB, bytes([0] + [8] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        _TABLES, _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def encoded(payload: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each payload (a multiple of 64 bytes, offsets ``at``) as one or more JPEG images."""
    v = payload.astype(np.int16).reshape(-1, ROW)
    diff = np.empty_like(v)
    np.subtract(v[:, 1:], v[:, :-1], out=diff[:, 1:])
    np.subtract(v[:, 0], 128, out=diff[:, 0])
    code = _STEPS[diff.ravel() + 255]
    length = code & 31
    upto = np.cumsum(length.reshape(-1, ROW), axis=1, dtype=np.int32)
    used = upto[:, -1]
    nbytes = ((used + 7) >> 3).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(nbytes)])
    bit = (upto - length.reshape(-1, ROW)).astype(np.int32)
    byte = ((bit >> 3) + base[:-1, None]).ravel()
    word = (code >> 5) << (24 - (bit.ravel() & 7) - length)
    total = int(base[-1])
    # the bits of symbols don't overlap, so sums are unions; 24 bits fit a double exactly
    sums = np.bincount(byte, word, total + 3).astype(np.int64)
    out = (sums >> 16).astype(np.uint8)
    out[1:] |= (sums[:-1] >> 8 & 255).astype(np.uint8)
    out[2:] |= (sums[:-2] & 255).astype(np.uint8)
    out = out[:total]
    out[base[1:] - 1] |= ((1 << (8 * nbytes - used)) - 1).astype(np.uint8)  # filled up with ones
    stuffed = np.concatenate([[0], np.cumsum(out == 255)])
    place = np.arange(total) + stuffed[:-1] + 2 * np.repeat(np.arange(len(nbytes)), nbytes)
    scan = np.zeros(total + int(stuffed[-1]) + 2 * len(nbytes), np.uint8)
    scan[place] = out
    stop = base[1:] + stuffed[base[1:]] + 2 * np.arange(len(nbytes))  # where each interval's bytes end
    scan[stop] = 255
    first = at[:-1] // ROW
    rows = np.diff(at) // ROW
    own = (np.arange(len(nbytes)) - np.repeat(first, rows)) % ROWS
    scan[stop + 1] = 0xD0 + own % 8
    ends = np.concatenate([[0], stop + 2])
    raw, done = scan.tobytes(), []
    for f, n in zip(first.tolist(), rows.tolist(), strict=True):
        parts = []
        for a in range(f, f + n, ROWS):
            b = min(a + ROWS, f + n)
            parts += [_head(b - a), raw[ends[a] : ends[b] - 2], b"\xff\xd9"]
        done.append(b"".join(parts))
    return done


def parsed(image: bytes) -> list[dict]:
    """The frames of one or more JPEG images: size, components, tables, and the scan's restart intervals."""
    frames, i, n = [], 0, len(image)
    while i + 4 <= n and image[i : i + 2] == b"\xff\xd8":
        i += 2
        f: dict = {"quant": {}, "dht": {}, "restart": 0, "comps": [], "width": None}
        while i + 2 <= n:
            if image[i] != 0xFF:
                raise ValueError("marker expected")
            marker = image[i + 1]
            if marker == 0xFF:
                i += 1
                continue
            if marker == 0xD9:
                i += 2
                break
            size = struct.unpack_from(">H", image, i + 2)[0]
            body = image[i + 4 : i + 2 + size]
            i += 2 + size
            if marker == 0xDB:
                j = 0
                while j < len(body):
                    wide, t = body[j] >> 4, body[j] & 15
                    f["quant"][t] = struct.unpack_from(">H", body, j + 1)[0] if wide else body[j + 1]
                    j += 1 + 64 * (1 + wide)
            elif marker in (0xC0, 0xC1):
                _, f["height"], f["width"], c = struct.unpack_from(">BHHB", body)
                f["comps"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(c)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                j = 0
                while j < len(body):
                    counts = body[j + 1 : j + 17]
                    m = sum(counts)
                    f["dht"][body[j]] = (bytes(counts), bytes(body[j + 17 : j + 17 + m]))
                    j += 17 + m
            elif marker == 0xDD:
                f["restart"] = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                f["scan"] = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                start = i
                while True:  # to the next marker that is neither a stuffed byte nor a restart
                    i = image.find(b"\xff", i)
                    if i < 0 or i + 1 >= n:
                        i = n
                        break
                    if image[i + 1] and not 0xD0 <= image[i + 1] <= 0xD7:
                        break
                    i += 2
                data = np.frombuffer(image, np.uint8)[start:i]
                mark = np.flatnonzero(data[:-1] == 255) if len(data) > 1 else np.zeros(0, np.int64)
                cut = mark[data[mark + 1] != 0]
                keep = np.ones(len(data), bool)
                keep[mark[data[mark + 1] == 0] + 1] = False
                keep[cut] = keep[cut + 1] = False
                f["data"] = data[keep]
                f["at"] = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], cut + 2])]
        if f["width"] is None or "data" not in f:
            raise ValueError("no image")
        frames.append(f)
    if not frames or i < n:
        raise ValueError("no image")
    return frames


def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for s, (code, n) in canonical(*table).items():
        a, b = code << (16 - n), (code + 1) << (16 - n)
        symbol[a:b], length[a:b] = s, n
    return symbol, length


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


_fused: dict = {}


def _whole(dc: tuple, ac: tuple) -> np.ndarray:
    """Step (times 256) and bits of a block that has only a DC coefficient, by the next 16 bits; 0 bits where that isn't enough."""
    if (dc, ac) not in _fused:
        symbol, n = _lookup(dc)
        word = np.arange(65536)
        used = n + symbol
        fits = (n > 0) & (used < 16)
        bits = np.where(fits, (word >> np.maximum(16 - used, 0)) & ((1 << symbol) - 1), 0)
        (code, m) = canonical(*ac).get(0, (0, 99))
        fits &= used + m <= 16
        fits &= ((word >> np.maximum(16 - used - m, 0)) & ((1 << min(m, 16)) - 1)) == code
        if len(_fused) > 16:
            _fused.clear()
        _fused[dc, ac] = (np.where(fits, _extend(bits, symbol), 0) * 256 + np.where(fits, used + m, 0)).astype(np.int32)
    return _fused[dc, ac]


def _dc_values(data: np.ndarray, at: np.ndarray, blocks_in: np.ndarray, order: list[int], tables: list[tuple]) -> np.ndarray:
    """DC coefficients of component 0 for all intervals: one row each, in the scan's order. ``order``: component of each block of an MCU."""
    n, steps = len(data) + 8, int(blocks_in.max())
    padded = np.zeros(n + 3, np.uint32)
    padded[: len(data)] = data
    word = (padded[:n] << 16 | padded[1 : n + 1] << 8 | padded[2 : n + 2]).astype(np.int32)
    pos, limit = at.astype(np.int32 if n < 1 << 27 else np.int64) * 8, (len(data) + 3) * 8
    last = np.zeros((max(order) + 1, len(at)), np.int32)
    out = np.zeros((-(-steps // len(order)) * order.count(0), len(at)), np.int16)
    whole = [_whole(*t) for t in tables]
    slow = [(_lookup(dc), _lookup(ac)) for dc, ac in tables]

    def peek(p):
        return (word[np.minimum(p >> 3, n - 1)] >> (8 - (p & 7))) & 0xFFFF

    put, least = 0, int(blocks_in.min())
    for t in range(steps):
        c = order[t % len(order)]
        w = peek(pos)
        both = whole[c][w]
        step, used = both >> 8, both & 255
        live = blocks_in > t if t >= least else None
        if not used.all():
            hard = np.flatnonzero(used == 0 if live is None else live & (used == 0))
            (ds, dn), (as_, an) = slow[c]
            p, v = pos[hard].astype(np.int64), w[hard]
            size = ds[v]
            p = p + dn[v]
            bits = peek(p) >> (16 - size)
            step[hard] = _extend(bits, size)
            p = p + size
            at_k, busy = np.ones(len(hard), np.int64), np.arange(len(hard))
            while len(busy):
                v = peek(p[busy])
                s, m = as_[v], an[v]
                p[busy] += m + (s & 15)
                at_k[busy] += (s >> 4) + 1
                busy = busy[(s != 0) & (m > 0) & (at_k[busy] < 64)]
            used[hard] = np.minimum(p, limit) - pos[hard]
        if live is not None:
            step, used = step * live, used * live
        pos += used
        last[c] += step
        if c == 0:
            out[put] = last[0]
            put += 1
    return out.T


def decoded(images: list[bytes | None]) -> list[tuple[int | None, int | None, list[np.ndarray]]]:
    """Each stored form's width (of its widest frame) and height (of all its frames), and the DC-only luminance images of its frames."""
    frames, groups = [], defaultdict(list)
    for i, image in enumerate(images):
        try:
            own = parsed(image or b"")
        except (ValueError, IndexError, struct.error):
            own = []
        for f in own:
            ids = {c[0]: k for k, c in enumerate(f["comps"])}
            scan = [(ids[s], d, a) for s, d, a in f["scan"]]
            single = len(scan) == 1
            order = [k for k, (c, _, _) in enumerate(scan) for _ in range(1 if single else f["comps"][c][1] * f["comps"][c][2])]
            tables = tuple((f["dht"][d], f["dht"][16 + a]) for _, d, a in scan)
            groups[tuple(order), tables].append(len(frames))
            frames.append((i, f, single))
    result: list = [(None, None, []) for _ in images]
    pictures: dict[int, np.ndarray] = {}
    for (order, tables), members in groups.items():
        datas, ats, counts, spans, base = [], [], [], [], 0
        for m in members:
            _, f, single = frames[m]
            hs, vs = max(c[1] for c in f["comps"]), max(c[2] for c in f["comps"])
            unit = (8, 8) if single else (8 * hs, 8 * vs)
            across, down = -(-f["width"] // unit[0]), -(-f["height"] // unit[1])
            each = f["restart"] or across * down
            n = np.minimum(each, across * down - each * np.arange(len(f["at"])))
            if n.min() <= 0 or n.sum() != across * down:
                continue
            spans.append((m, len(counts), len(n), across, down, n))
            datas.append(f["data"])
            ats.append(f["at"] + base)
            counts += (n * len(order)).tolist()
            base += len(f["data"])
        if not spans:
            continue
        values = _dc_values(np.concatenate(datas), np.concatenate(ats), np.array(counts), list(order), list(tables))
        for m, a, k, across, down, n in spans:
            _, f, single = frames[m]
            per = order.count(0)
            if (n == n[0]).all():
                dc = values[a : a + k, : n[0] * per].ravel()
            else:
                dc = np.concatenate([values[a + j, : n[j] * per] for j in range(k)])
            h, v = (1, 1) if single else f["comps"][0][1:3]
            grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            grey = np.clip((grid.astype(np.int64) * f["quant"][f["comps"][0][3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            if not single:
                grey = grey[: -(-f["height"] // 8), : -(-f["width"] // 8)]
            pictures[m] = grey
    for m, (i, f, _) in enumerate(frames):
        w, h, all_ = result[i]
        if m in pictures:
            result[i] = (max(w or 0, f["width"]), (h or 0) + f["height"], [*all_, pictures[m]])
    return result


def stacked(pictures: list[np.ndarray]) -> np.ndarray:
    """The frames of a stored form below one another, narrower ones filled up with zeros on the right."""
    if len(pictures) == 1:
        return pictures[0]
    width = max(p.shape[1] for p in pictures)
    return np.concatenate([p if p.shape[1] == width else np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in pictures])


def thumb_hash(picture: np.ndarray) -> int:
    """64 bits: which of 8x8 area means lie above the mean of them all."""
    rows = np.linspace(0, picture.shape[0], 9).astype(int)
    cols = np.linspace(0, picture.shape[1], 9).astype(int)
    r0, c0 = np.minimum(rows[:-1], picture.shape[0] - 1), np.minimum(cols[:-1], picture.shape[1] - 1)
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    # strip by strip, as a long text's picture is too large to be held in wider numbers
    total = np.zeros((8, picture.shape[1] + 1), np.int64)
    for k in range(8):
        picture[r0[k] : r1[k]].sum(0, dtype=np.int64).cumsum(out=total[k, 1:])
    area = (r1 - r0)[:, None] * (c1 - c0)
    means = (total[:, c1] - total[:, c0]) / area
    return int(np.packbits((means > means.mean()).ravel()).tobytes().hex(), 16)


def media_column(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and ``media``: each text, padded with zero bytes to a positive multiple of 64, as JPEG."""
    tuned(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column(len(keep)))
            lo, n = 0, len(at) - 1
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
                hi = min(hi, n)
                size = np.diff(at[lo : hi + 1])
                full = np.maximum(-(-size // ROW), 1) * ROW
                cut = np.concatenate([[0], np.cumsum(full)])
                payload = np.zeros(cut[-1], np.uint8)
                payload[np.arange(size.sum()) + np.repeat(cut[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)] = data[at[lo] : at[hi]]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(size), pa.array(encoded(payload, cut), pa.binary())], [*(f"k{i}" for i in range(len(keep))), "n_bytes", "media"])
                lo = hi

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(keep)), "n_bytes long, media binary"])
    return docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text")).mapInArrow(run, schema).toDF(*keep, "n_bytes", "media")


def media_features(frame: DataFrame, media: str = "media") -> DataFrame:
    """All columns but ``media``, and what the stored bytes hold: sizes, digests, the bytes of all frames' DC-only images digested, and the hash of these images below one another."""
    names = [c for c in frame.columns if c != media]
    types = dict(frame.dtypes)
    extra = ["width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            lo, n = 0, batch.num_rows
            while lo < n:
                images, total, hi = [], 0, lo
                while hi < n and (hi == lo or total < BLOCK):
                    images.append(batch.column(len(names))[hi].as_py())
                    total += len(images[-1] or b"")
                    hi += 1
                rows = []
                for image, (w, h, pictures) in zip(images, decoded(images), strict=True):
                    image = image or b""
                    payload = b"".join(p.tobytes() for p in pictures)
                    feature = f"{w}x{h}:{thumb_hash(stacked(pictures)):016x}" if pictures else ""
                    rows.append((w, h, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(names)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*(f"c{i}" for i in range(len(names))), *extra])
                lo = hi

    schema = ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(names)), "width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"])
    picked = frame.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(media).alias("_media"))
    return picked.mapInArrow(run, schema).toDF(*names, *extra)


def payload_digest(docs: DataFrame) -> DataFrame:
    """Per document: what its stored payload reads back as."""
    return media_features(media_column(docs)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )
