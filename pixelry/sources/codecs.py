"""Small picture codecs: bytes to samples and back.

`decode` gives (width, height, layout, sample type, samples as a flat array) or raises ValueError;
`encode` is its inverse for the layouts that a format holds.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

LAYOUT = {1: "L", 2: "La", 3: "Rgb", 4: "Rgba"}
CHANNELS = {v: k for k, v in LAYOUT.items()}
Picture = tuple[int, int, str, str, np.ndarray]


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def read_farbfeld(raw: bytes, most: int) -> Picture:
    _need(len(raw) >= 16 and raw[:8] == b"farbfeld", "no farbfeld header")
    w, h = struct.unpack(">II", raw[8:16])
    _need(w * h * 8 <= most, "limits")
    _need(len(raw) >= 16 + w * h * 8, "truncated")
    return w, h, "Rgba", "u16", np.frombuffer(raw, ">u2", w * h * 4, 16).astype(np.int32)


def write_farbfeld(w: int, h: int, layout: str, kind: str, samples: np.ndarray) -> bytes:
    _need(layout == "Rgba" and kind == "u16", "farbfeld holds Rgba u16 only")
    return b"farbfeld" + struct.pack(">II", w, h) + samples.astype(">u2").tobytes()


_PNM_HEAD = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def read_pnm(raw: bytes, most: int) -> Picture:
    """P1 to P7; samples are rescaled where the greatest value is not 255 or 65535."""
    kind, at, head = raw[1:2], 2, []
    _need(raw[:1] == b"P" and kind in b"1234567" and len(kind) == 1, "no PNM header")
    if kind == b"7":
        return _read_pam(raw, most)
    for _ in range(2 if kind in b"14" else 3):
        m = _PNM_HEAD.match(raw, at)
        _need(m is not None, "bad PNM header")
        head.append(int(m[1]))
        at = m.end()
    (w, h), top = head[:2], head[2] if len(head) > 2 else 1
    channels = 3 if kind in b"36" else 1
    wide = top > 255
    _need(0 < top < 65536, "bad greatest value")
    _need(w * h * channels * (1 + wide) <= most, "limits")
    n = w * h * channels
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", raw[at:])
        tokens = re.findall(rb"[01]", body) if kind == b"1" else body.split()
        _need(len(tokens) >= n, "truncated")
        v = np.array([int(t) for t in tokens[:n]], np.int64)
    else:
        at += 1
        row = -(-w // 8)
        size = row * h if kind == b"4" else n * (1 + wide)
        _need(len(raw) >= at + size, "truncated")
        if kind == b"4":
            v = np.unpackbits(np.frombuffer(raw, np.uint8, size, at).reshape(h, row), axis=1)[:, :w].ravel().astype(np.int64)
        else:
            v = np.frombuffer(raw, ">u2" if wide else np.uint8, n, at).astype(np.int64)
    _need(not len(v) or int(v.max()) <= top, "sample above the greatest value")
    if kind in b"14":
        v = 1 - v  # 1 is black
    full = 65535 if wide else 255
    return w, h, LAYOUT[channels], "u16" if wide else "u8", (v if top == full else (v * full + top // 2) // top).astype(np.int32)


def _read_pam(raw: bytes, most: int) -> Picture:
    end = raw.find(b"ENDHDR\n")
    _need(end >= 0, "bad PNM header")
    lines = [x.split(None, 1) for x in raw[2:end].decode("latin-1").split("\n") if x.strip() and not x.startswith("#")]
    head = {x[0]: x[1].strip() for x in lines if len(x) == 2}
    try:
        w, h, n, top = (int(head[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
    except (KeyError, ValueError) as e:
        raise ValueError("bad PNM header") from e
    _need(w > 0 and h > 0 and 1 <= n <= 4 and 0 < top < 65536, "bad PNM header")
    wide = top > 255
    _need(w * h * n * (1 + wide) <= most, "limits")
    _need(len(raw) >= end + 7 + w * h * n * (1 + wide), "truncated")
    v = np.frombuffer(raw, ">u2" if wide else np.uint8, w * h * n, end + 7).astype(np.int64)
    _need(int(v.max()) <= top, "sample above the greatest value")
    full = 65535 if wide else 255
    return w, h, LAYOUT[n], "u16" if wide else "u8", (v if top == full else (v * full + top // 2) // top).astype(np.int32)


def write_pnm(w: int, h: int, layout: str, kind: str, samples: np.ndarray) -> bytes:
    _need(kind in ("u8", "u16"), "PNM holds u8 and u16")
    if layout in ("La", "Rgba"):
        head = f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {CHANNELS[layout]}\nMAXVAL {255 if kind == 'u8' else 65535}\nTUPLTYPE {'GRAYSCALE_ALPHA' if layout == 'La' else 'RGB_ALPHA'}\nENDHDR\n"
        return head.encode() + samples.astype(np.uint8 if kind == "u8" else ">u2").tobytes()
    return b"P%d\n%d %d\n%d\n" % (5 if layout == "L" else 6, w, h, 255 if kind == "u8" else 65535) + samples.astype(np.uint8 if kind == "u8" else ">u2").tobytes()


# First column, first line and steps of the passes of an interlaced PNG.
_ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
_PNG = b"\x89PNG\r\n\x1a\n"


def _unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the PNG row filters; lines hold the filter number and the bytes of each row."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1), np.int64)
    for y, line in enumerate(lines):
        kind, cur, up = int(line[0]), line[1:].astype(np.int64), out[y]
        if kind == 0:
            out[y + 1] = cur
        elif kind == 1:
            padded = np.concatenate([cur, np.zeros(-len(cur) % step, np.int64)]).reshape(-1, step)
            out[y + 1] = (np.cumsum(padded, 0) & 255).ravel()[: len(cur)]
        elif kind == 2:
            out[y + 1] = (cur + up) & 255
        else:
            _need(kind < 5, "bad PNG filter")
            row = out[y + 1]
            for x in range(0, len(cur), step):  # each pixel needs the one before it
                left = row[x - step : x] if x else np.zeros(step, np.int64)
                above = up[x : x + step]
                if kind == 3:
                    guess = (left + above) >> 1
                else:
                    corner = up[x - step : x] if x else np.zeros(step, np.int64)
                    a, b, c = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                row[x : x + step] = (cur[x : x + step] + guess) & 255
    return out[1:].astype(np.uint8)


def read_png(raw: bytes, most: int) -> Picture:
    """Palettes and depths below 8 are expanded to 8 bits, tRNS to alpha."""
    _need(raw[:8] == _PNG, "no PNG signature")
    at, chunks = 8, {}
    while at + 12 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        name, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        _need(len(body) == size and zlib.crc32(name + body) == int.from_bytes(raw[at + 8 + size : at + 12 + size], "big"), "bad PNG chunk")
        chunks.setdefault(name, []).append(body)
        at += 12 + size
    _need(b"IHDR" in chunks and b"IDAT" in chunks, "truncated")
    w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", chunks[b"IHDR"][0])
    _need(laced < 2 and w > 0 and h > 0 and colour in (0, 2, 3, 4, 6) and depth in (1, 2, 4, 8, 16), "bad PNG header")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    _need(w * h * 4 * (2 if depth == 16 else 1) <= most, "limits")
    passes = _ADAM7 if laced else [(0, 0, 1, 1)]
    sizes = [(max(0, -(-(w - x) // dx)), max(0, -(-(h - y) // dy))) for x, y, dx, dy in passes]
    rows = [-(-a * n * depth // 8) + 1 if a and b else 0 for a, b in sizes]
    total = sum(row * b for row, (_, b) in zip(rows, sizes, strict=True))
    data = zlib.decompressobj().decompress(b"".join(chunks[b"IDAT"]), total)
    _need(len(data) == total, "truncated")
    v, at = np.zeros((h, w, n), np.int32), 0
    for row, (a, b), (x, y, dx, dy) in zip(rows, sizes, passes, strict=True):
        if not row:
            continue
        body = _unfilter(np.frombuffer(data, np.uint8, row * b, at).reshape(b, row), max(1, n * depth // 8))
        at += row * b
        if depth == 16:
            part = body.reshape(-1).view(">u2")
        elif depth == 8:
            part = body
        else:
            bits = np.unpackbits(body, axis=1)
            bits = bits[:, : bits.shape[1] // depth * depth].reshape(b, -1, depth)[:, :a]
            part = (bits.astype(np.int32) << np.arange(depth - 1, -1, -1)).sum(2)
        v[y::dy, x::dx] = part.reshape(b, a, n)
    v = v.reshape(-1, n)
    clear = chunks.get(b"tRNS", [None])[0]
    if colour == 3:
        table = np.frombuffer(chunks.get(b"PLTE", [b""])[0], np.uint8).reshape(-1, 3).astype(np.int32)
        _need(int(v.max()) < len(table), "index beyond the palette")
        alpha = np.full(len(table), 255, np.int32)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(table)]
        v = np.concatenate([table[v[:, 0]], alpha[v]], 1) if clear else table[v[:, 0]]
    else:
        key = None if clear is None or colour > 3 else np.frombuffer(clear, ">u2").astype(np.int32)
        hidden = None if key is None else (v == key).all(1, keepdims=True)
        if depth < 8:
            v = v * (255 // ((1 << depth) - 1))
        if hidden is not None:
            v = np.concatenate([v, np.where(hidden, 0, 65535 if depth == 16 else 255)], 1)
    return w, h, LAYOUT[v.shape[1]], "u16" if depth == 16 else "u8", v.ravel().astype(np.int32)


def _png_rows(w: int, h: int, kind: str, samples: np.ndarray, level: int, filtered: bool) -> bytes:
    lines = np.frombuffer(samples.astype(np.uint8 if kind == "u8" else ">u2").tobytes(), np.uint8).reshape(h, -1)
    body = np.diff(lines, axis=0, prepend=np.zeros((1, lines.shape[1]), np.uint8)) if filtered else lines
    return zlib.compress(np.concatenate([np.full((h, 1), 2 if filtered else 0, np.uint8), body], 1).tobytes(), level)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def write_png(w: int, h: int, layout: str, kind: str, samples: np.ndarray, level: int = -1, filtered: bool = True, icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    """level: of compression, 0 to 9; filtered: lines as differences from the one above; icc and exif: blocks to hold."""
    _need(kind in ("u8", "u16") and w > 0 and h > 0, "PNG holds u8 and u16")
    head = struct.pack(">IIBBBBB", w, h, 8 if kind == "u8" else 16, {"L": 0, "La": 4, "Rgb": 2, "Rgba": 6}[layout], 0, 0, 0)
    blocks = (_chunk(b"iCCP", b"icc\0\0" + zlib.compress(icc)) if icc else b"") + (_chunk(b"eXIf", exif) if exif else b"")
    return _PNG + _chunk(b"IHDR", head) + blocks + _chunk(b"IDAT", _png_rows(w, h, kind, samples, level, filtered)) + _chunk(b"IEND", b"")


def write_animation(w: int, h: int, frames: list[dict], loops: int = 0, level: int = -1) -> bytes:
    """An animated PNG of Rgba frames: dicts of left, top, width, height, dispose, blend, numer, denom (of a millisecond) and samples.  The first fills the canvas."""
    _need(bool(frames) and (frames[0]["width"], frames[0]["height"]) == (w, h), "the first frame must fill the canvas")
    out, number = [_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)), _chunk(b"acTL", struct.pack(">II", len(frames), loops))], 0
    for f in frames:
        _need(f["left"] + f["width"] <= w and f["top"] + f["height"] <= h, "a frame exceeds the canvas")
        wait = f["numer"] / max(1, f["denom"])
        parts = (int(wait), 1000) if wait < 65536 else (min(65535, int(wait / 10)), 100)
        out.append(_chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, f["width"], f["height"], f["left"], f["top"], *parts, ("keep", "background", "previous").index(f["dispose"]), f["blend"] == "over")))
        body = _png_rows(f["width"], f["height"], "u8", np.asarray(f["samples"]), level, True)
        out.append(_chunk(b"IDAT", body) if number == 0 else _chunk(b"fdAT", struct.pack(">I", number + 1) + body))
        number += 1 if number == 0 else 2
    return _PNG + b"".join(out) + _chunk(b"IEND", b"")


def read_ico(raw: bytes, most: int) -> Picture:
    """The largest picture of an icon, that of most bits among equals: a PNG, or a bitmap whose second half is a mask of clear places."""
    _need(raw[:4] == b"\0\0\1\0" and len(raw) >= 22, "no ICO header")
    entries = [struct.unpack_from("<BBBBHHII", raw, 6 + 16 * i) for i in range(min(int.from_bytes(raw[4:6], "little"), (len(raw) - 6) // 16))]
    _need(bool(entries), "truncated")
    *_, size, at = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    body = raw[at : at + size]
    _need(len(body) == size and size >= 40, "truncated")
    if body[:8] == _PNG:
        return read_png(body, most)
    head, w, h2, _, depth = struct.unpack_from("<IiiHH", body)
    h = h2 // 2
    _need(head == 40 and w > 0 and h > 0 and depth in (1, 4, 8, 16, 24, 32), "bad ICO header")
    colours = (int.from_bytes(body[32:36], "little") or 1 << depth) if depth <= 8 else 0
    single = body[:8] + struct.pack("<i", h) + body[12:]
    whole = b"BM" + struct.pack("<IHHI", 14 + size, 0, 0, 14 + head + 4 * colours) + single
    start, row = head + 4 * colours, -(-w * depth // 32) * 4
    _, _, layout, _, v = read_bmp(whole, most)
    v = v.reshape(h, w, -1)
    if depth == 32:
        _need(len(body) >= start + row * h, "truncated")
        alpha = np.frombuffer(body, np.uint8, row * h, start).reshape(h, w, 4)[::-1, :, 3].astype(np.int32)
        return w, h, "Rgba", "u8", np.concatenate([v[:, :, :3], alpha[:, :, None]], 2).ravel()
    mask_row = -(-w // 32) * 4
    _need(len(body) >= start + row * h + mask_row * h, "truncated")
    mask = np.unpackbits(np.frombuffer(body, np.uint8, mask_row * h, start + row * h).reshape(h, mask_row), axis=1)[::-1, :w]
    return w, h, "Rgba", "u8", np.concatenate([v[:, :, :3], np.where(mask, 0, 255)[:, :, None].astype(np.int32)], 2).ravel()


def write_ico(w: int, h: int, layout: str, kind: str, samples: np.ndarray) -> bytes:
    """An icon that holds one PNG."""
    _need(kind == "u8" and 0 < w <= 256 and 0 < h <= 256, "ICO holds u8 of at most 256 by 256")
    body = write_png(w, h, layout, kind, samples)
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, w % 256, h % 256, 0, 0, 1, 8 * CHANNELS[layout], len(body), 22) + body


def read_bmp(raw: bytes, most: int) -> Picture:
    """Uncompressed 1 to 32 bits a pixel, with palettes and bit masks, and run lengths of 4 and 8 bits."""
    _need(raw[:2] == b"BM" and len(raw) >= 26, "no BMP header")
    begin, size = struct.unpack_from("<II", raw, 10)
    if size == 12:
        w, h, _, depth = struct.unpack_from("<HHHH", raw, 18)
        packing, used = 0, 0
    else:
        _need(size >= 40 and len(raw) >= 54, "bad BMP header")
        w, h, _, depth, packing, _, _, _, used = struct.unpack_from("<iiHHIIiiI", raw, 18)
    flipped, h = h > 0, abs(h)
    _need(w > 0 and h > 0 and depth in (1, 4, 8, 16, 24, 32) and packing in (0, 1, 2, 3, 6), "bad BMP header")
    _need(w * h * 4 <= most, "limits")
    masks = None
    if depth in (16, 32):
        masks = [0x7C00, 0x3E0, 0x1F, 0] if depth == 16 else [0xFF0000, 0xFF00, 0xFF, 0]
        if packing in (3, 6):
            masks = list(struct.unpack_from("<IIII" if size >= 56 or packing == 6 else "<III", raw, 54))[:4]
            masks += [0] * (4 - len(masks))
    if depth <= 8:
        step, count = (3, 1 << depth) if size == 12 else (4, used or 1 << depth)
        at = 14 + size
        table = np.frombuffer(raw[at : at + step * count].ljust(step * 256, b"\0"), np.uint8).reshape(-1, step)[:256, 2::-1].astype(np.int32)
        index = _bmp_runs(raw[begin:], w, h, depth) if packing in (1, 2) else None
        if index is None:
            row = -(-w * depth // 32) * 4
            _need(len(raw) >= begin + row * h, "truncated")
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, row * h, begin).reshape(h, row), axis=1)
            index = (bits.reshape(h, -1, depth)[:, :w].astype(np.int32) << np.arange(depth - 1, -1, -1)).sum(2)
        v = table[index]
    else:
        row = -(-w * depth // 32) * 4
        _need(len(raw) >= begin + row * h, "truncated")
        body = np.frombuffer(raw, np.uint8, row * h, begin).reshape(h, row)
        if depth == 24:
            v = body[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1].astype(np.int32)
        else:
            word = body[:, : w * depth // 8].copy().view("<u2" if depth == 16 else "<u4").astype(np.int64)
            parts = []
            for m in masks if masks[3] else masks[:3]:
                low = (m & -m).bit_length() - 1 if m else 0
                top = m >> low
                parts.append((((word & m) >> low) * 255 + top // 2) // top if top else np.zeros_like(word))
            v = np.stack(parts, 2).astype(np.int32)
    return w, h, LAYOUT[v.shape[2]], "u8", np.ascontiguousarray(v[::-1] if flipped else v).ravel()


def _bmp_runs(body: bytes, w: int, h: int, depth: int) -> np.ndarray:
    out, x, y, at = np.zeros((h, w), np.int32), 0, 0, 0
    nibbles = lambda b, n: [(b[i // 2] >> (0 if i % 2 else 4)) & 15 for i in range(n)] if depth == 4 else list(b[:n])
    while y < h:
        _need(at + 2 <= len(body), "truncated")
        count, value = body[at], body[at + 1]
        at += 2
        if count:
            run = nibbles(bytes([value]) * count, count)
        elif value == 0:
            x, y = 0, y + 1
            continue
        elif value == 1:
            break
        elif value == 2:
            _need(at + 2 <= len(body), "truncated")
            x, y, at = x + body[at], y + body[at + 1], at + 2
            continue
        else:
            size = value if depth == 8 else -(-value // 2)
            _need(at + size <= len(body), "truncated")
            run = nibbles(body[at : at + size], value)
            at += size + size % 2
        room = max(0, min(len(run), w - x))
        out[y, x : x + room] = run[:room]
        x += len(run)
    return out


def write_bmp(w: int, h: int, layout: str, kind: str, samples: np.ndarray) -> bytes:
    """8 bits with a grey palette, 24 bits, or 32 bits with masks."""
    _need(kind == "u8" and layout in ("L", "Rgb", "Rgba"), "BMP holds L, Rgb and Rgba u8")
    n = CHANNELS[layout]
    v = samples.astype(np.uint8).reshape(h, w, n)
    if n >= 3:
        v = v[:, :, [2, 1, 0, 3][:n]]
    body = np.zeros((h, -(-w * n // 4) * 4), np.uint8)
    body[:, : w * n] = v.reshape(h, w * n)
    table = b"".join(bytes([i, i, i, 0]) for i in range(256)) if n == 1 else struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) if n == 4 else b""
    head = 108 if n == 4 else 40
    rest = struct.pack("<IiiHHIIiiII", head, w, h, 1, 8 * n, 3 if n == 4 else 0, body.nbytes, 2835, 2835, 256 if n == 1 else 0, 0) + table
    rest = rest.ljust(head + (1024 if n == 1 else 0), b"\0")
    return struct.pack("<2sIHHI", b"BM", 14 + len(rest) + body.nbytes, 0, 0, 14 + len(rest)) + rest + body[::-1].tobytes()


def read_tga(raw: bytes, most: int) -> Picture:
    """Palette, colour and grey pictures, plain or in runs."""
    _need(len(raw) >= 18, "truncated")
    skip, mapped, kind, first, count, entry, _, _, w, h, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", raw)
    _need(kind in (1, 2, 3, 9, 10, 11) and w > 0 and h > 0 and depth in (8, 15, 16, 24, 32), "bad TGA header")
    _need(w * h * 4 <= most, "limits")
    size, at = -(-depth // 8), 18 + skip
    table = None
    if mapped:
        step = -(-entry // 8)
        _need(step in (2, 3, 4), "bad TGA header")
        table = _tga_colours(np.frombuffer(raw[at : at + step * count].ljust(step * count, b"\0"), np.uint8).reshape(-1, step), True)
        at += step * count
    need = w * h * size
    if kind < 9:
        _need(len(raw) >= at + need, "truncated")
        body = raw[at : at + need]
    else:
        parts, have = [], 0
        while have < need:
            _need(at < len(raw), "truncated")
            n = (raw[at] & 127) + 1
            part = raw[at + 1 : at + 1 + size] * n if raw[at] & 128 else raw[at + 1 : at + 1 + size * n]
            _need(len(part) == size * n, "truncated")
            at += 1 + (size if raw[at] & 128 else size * n)
            parts.append(part)
            have += len(part)
        body = b"".join(parts)[:need]
    v = np.frombuffer(body, np.uint8).reshape(-1, size)
    if kind in (1, 9):
        _need(table is not None, "no palette")
        index = v.astype(np.int64)[:, 0] + (v.astype(np.int64)[:, 1] << 8 if size > 1 else 0) - first
        _need(not len(index) or (0 <= int(index.min()) and int(index.max()) < len(table)), "index beyond the palette")
        v = table[index]
    else:
        v = _tga_colours(v, kind in (2, 10))
    v = v.reshape(h, w, -1)
    v = v if flags & 32 else v[::-1]
    v = v[:, ::-1] if flags & 16 else v
    return w, h, LAYOUT[v.shape[2]], "u8", np.ascontiguousarray(v).astype(np.int32).ravel()


def _tga_colours(v: np.ndarray, coloured: bool) -> np.ndarray:
    if not coloured:
        return v
    if v.shape[1] == 2:
        word = v[:, 0].astype(np.int32) | v[:, 1].astype(np.int32) << 8
        return np.stack([((word >> k & 31) * 255 + 15) // 31 for k in (10, 5, 0)], 1)
    return v[:, [2, 1, 0, 3][: v.shape[1]]] if v.shape[1] > 1 else v


def write_tga(w: int, h: int, layout: str, kind: str, samples: np.ndarray) -> bytes:
    _need(kind == "u8" and 0 < w < 65536 and 0 < h < 65536, "TGA holds u8")
    n = CHANNELS[layout]
    v = samples.astype(np.uint8).reshape(-1, n)
    body = v[:, [2, 1, 0, 3][:n]] if n >= 3 else v
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2 if n >= 3 else 3, 0, 0, 0, 0, 0, w, h, 8 * n, 32 | (8 if n in (2, 4) else 0)) + body.tobytes()


def read_qoi(raw: bytes, most: int) -> Picture:
    _need(len(raw) >= 14 and raw[:4] == b"qoif", "no QOI header")
    w, h, n, space = struct.unpack_from(">IIBB", raw, 4)
    _need(w > 0 and h > 0 and n in (3, 4) and space < 2, "bad QOI header")
    _need(w * h * 4 <= most, "limits")
    out, seen, at, done = bytearray(), [b"\0\0\0\0"] * 64, 14, 0
    r, g, b, a = 0, 0, 0, 255
    while done < w * h:
        _need(at + 8 < len(raw), "truncated")
        tag, run = raw[at], 1
        at += 1
        if tag >= 254:
            r, g, b = raw[at : at + 3]
            a = raw[at + 3] if tag == 255 else a
            at += 3 + (tag == 255)
        elif tag < 64:
            r, g, b, a = seen[tag]
        elif tag < 128:
            r, g, b = (r + (tag >> 4 & 3) - 2) & 255, (g + (tag >> 2 & 3) - 2) & 255, (b + (tag & 3) - 2) & 255
        elif tag < 192:
            d, more = (tag & 63) - 32, raw[at]
            at += 1
            r, g, b = (r + d + (more >> 4) - 8) & 255, (g + d) & 255, (b + d + (more & 15) - 8) & 255
        else:
            run = min((tag & 63) + 1, w * h - done)
        pixel = bytes((r, g, b, a))
        seen[(r * 3 + g * 5 + b * 7 + a * 11) % 64] = pixel
        out += pixel * run
        done += run
    return w, h, LAYOUT[n], "u8", np.frombuffer(bytes(out), np.uint8).reshape(-1, 4)[:, :n].astype(np.int32).ravel()


def write_qoi(w: int, h: int, layout: str, kind: str, samples: np.ndarray) -> bytes:
    """Runs, repeated colours and whole colours."""
    _need(kind == "u8" and layout in ("Rgb", "Rgba") and w > 0 and h > 0, "QOI holds Rgb and Rgba u8")
    n = CHANNELS[layout]
    v = np.full((w * h, 4), 255, np.uint8)
    v[:, :n] = samples.astype(np.uint8).reshape(-1, n)
    starts = np.flatnonzero(np.append(True, (v[1:] != v[:-1]).any(1)))
    out, seen, last = bytearray(b"qoif" + struct.pack(">IIBB", w, h, n, 0)), [b""] * 64, b"\0\0\0\xff"
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(v)], strict=True):
        pixel, run = v[a].tobytes(), b - a
        if pixel != last:
            place = (pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64
            if seen[place] == pixel:
                out.append(place)
            elif pixel[3] == last[3]:
                out += b"\xfe" + pixel[:3]
            else:
                out += b"\xff" + pixel
            seen[place], last, run = pixel, pixel, run - 1
        while run:
            part = min(run, 62)
            out.append(0xC0 | part - 1)
            run -= part
    return bytes(out) + b"\0" * 7 + b"\1"


_HDR_SIZE = re.compile(rb"-Y (\d+) \+X (\d+)\n")


def read_hdr(raw: bytes, most: int) -> Picture:
    """Shared-exponent colours, plain or in runs, as floats."""
    _need(raw.startswith((b"#?RADIANCE", b"#?RGBE")), "no HDR header")
    m = _HDR_SIZE.search(raw)
    _need(m is not None, "bad HDR header")
    h, w, at = int(m[1]), int(m[2]), m.end()
    _need(w > 0 and h > 0, "bad HDR header")
    _need(w * h * 12 <= most, "limits")
    v = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if 8 <= w < 32768 and raw[at : at + 2] == b"\2\2" and raw[at + 2 : at + 4] == struct.pack(">H", w):
            at += 4
            for c in range(4):
                x = 0
                while x < w:
                    _need(at + 1 < len(raw), "truncated")
                    n = raw[at]
                    part = raw[at + 1 : at + 2] * (n - 128) if n > 128 else raw[at + 1 : at + 1 + n]
                    _need(0 < len(part) <= w - x and len(part) == (n - 128 if n > 128 else n), "truncated")
                    v[y, x : x + len(part), c] = np.frombuffer(part, np.uint8)
                    x, at = x + len(part), at + (2 if n > 128 else 1 + n)
        else:
            _need(len(raw) >= at + 4 * w, "truncated")
            v[y] = np.frombuffer(raw, np.uint8, 4 * w, at).reshape(w, 4)
            at += 4 * w
    scale = np.where(v[:, :, 3:] > 0, np.exp2(v[:, :, 3:].astype(np.float64) - 136), 0)
    return w, h, "Rgb", "f32", (v[:, :, :3] * scale).astype(np.float32).ravel()


def write_hdr(w: int, h: int, layout: str, kind: str, samples: np.ndarray) -> bytes:
    _need(kind == "f32" and layout == "Rgb", "HDR holds Rgb f32")
    v = np.asarray(samples, np.float64).reshape(-1, 3)
    top = v.max(1)
    power = np.where(top > 1e-38, np.floor(np.log2(np.maximum(top, 1e-38))) + 1, 0)
    out = np.zeros((w * h, 4), np.uint8)
    out[:, :3] = np.where(top[:, None] > 1e-38, np.clip(v * np.exp2(8 - power)[:, None], 0, 255), 0)
    out[:, 3] = np.where(top > 1e-38, np.clip(power + 128, 0, 255), 0)
    return b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n" + f"-Y {h} +X {w}\n".encode() + out.tobytes()


def _gif_codes(body: bytes, bits: int, need: int) -> bytes:
    """Palette indices from the variable-length codes of a GIF frame."""
    clear, out = 1 << bits, bytearray()
    table: list[bytes] = []
    held, have, width, before = 0, 0, bits + 1, b""
    for byte in body:
        held |= byte << have
        have += 8
        while have >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            have -= width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
                continue
            if code == clear + 1 or len(out) >= need:
                return bytes(out)
            _need(bool(table) and (code < len(table) or (code == len(table) and before != b"")), "bad GIF code")
            now = table[code] if code < len(table) else before + before[:1]
            out += now
            if before and len(table) < 4096:
                table.append(before + now[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = now
    return bytes(out)


def gif_frames(raw: bytes, most: int) -> tuple[int, int, int | None, list[dict]]:
    """Width and height of the canvas, repeats (0: without end, None: none stated) and the frames: their regions, what follows them, delays in ms, and Rgba samples."""
    _need(raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 13, "no GIF header")
    w, h, flags = struct.unpack_from("<HHB", raw, 6)
    _need(w > 0 and h > 0, "bad GIF header")
    _need(w * h * 4 <= most, "limits")
    palette = lambda at, flag: np.frombuffer(raw[at : at + 3 * (2 << (flag & 7))].ljust(768, b"\0"), np.uint8).reshape(-1, 3)
    at, shared, loops, frames = 13, None, None, []
    if flags & 128:
        shared, at = palette(at, flags), at + 3 * (2 << (flags & 7))
    dispose, wait, clear = "keep", 0, -1

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while True:
            _need(at < len(raw), "truncated")
            n = raw[at]
            parts.append(raw[at + 1 : at + 1 + n])
            _need(len(parts[-1]) == n, "truncated")
            at += 1 + n
            if not n:
                return b"".join(parts)

    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            _need(at + 2 < len(raw), "truncated")
            label, at = raw[at + 1], at + 2
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                dispose = {2: "background", 3: "previous"}.get(body[0] >> 2 & 7, "keep")
                wait, clear = 10 * int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else -1
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                loops = int.from_bytes(body[12:14], "little")
            continue
        _need(raw[at] == 0x2C and len(raw) > at + 10, "bad GIF block")
        left, top, fw, fh, kind = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        table = shared
        if kind & 128:
            table, at = palette(at, kind), at + 3 * (2 << (kind & 7))
        _need(table is not None and fw > 0 and fh > 0 and at < len(raw) and raw[at] < 12, "bad GIF frame")
        _need(fw * fh * 4 <= most, "limits")
        bits, at = raw[at], at + 1
        index = np.frombuffer(_gif_codes(blocks(), bits, fw * fh), np.uint8)
        _need(len(index) >= fw * fh, "truncated")
        index = index[: fw * fh]
        if kind & 64:  # four interlaced passes
            order = np.concatenate([np.arange(a, fh, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index.reshape(fh, fw)[np.argsort(order)].ravel()
        v = np.concatenate([table[index], np.where(index == clear, 0, 255)[:, None].astype(np.uint8)], 1)
        v[index == clear] = 0
        frames.append({"left": left, "top": top, "width": fw, "height": fh, "dispose": dispose, "blend": "source", "numer": wait, "denom": 1, "samples": v.astype(np.int32).ravel()})
        dispose, wait, clear = "keep", 0, -1
    _need(bool(frames), "truncated")
    return w, h, loops, frames


def read_gif(raw: bytes, most: int) -> Picture:
    """The first frame on its canvas."""
    w, h, _, frames = gif_frames(raw, most)
    f, out = frames[0], np.zeros((h, w, 4), np.int32)
    high, wide = max(0, min(f["height"], h - f["top"])), max(0, min(f["width"], w - f["left"]))
    out[f["top"] : f["top"] + high, f["left"] : f["left"] + wide] = f["samples"].reshape(f["height"], f["width"], 4)[:high, :wide]
    return w, h, "Rgba", "u8", out.ravel()


def png_chunks(raw: bytes) -> list[tuple[bytes, bytes]]:
    """Names and bodies of the chunks of a PNG, as far as they are whole."""
    at, out = 8, []
    while raw[:8] == _PNG and at + 12 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 12 + size > len(raw):
            break
        out.append((raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]))
        at += 12 + size
    return out


def png_frames(raw: bytes, most: int) -> tuple[int, int, int | None, list[dict]]:
    """The same of an animated PNG; a plain one has its picture as its only frame."""
    chunks = png_chunks(raw)
    _need(bool(chunks) and chunks[0][0] == b"IHDR" and len(chunks[0][1]) == 13, "no PNG signature")
    head, shared = chunks[0][1], [c for c in chunks if c[0] in (b"PLTE", b"tRNS")]
    w, h = struct.unpack_from(">II", head)
    _need(w * h * 4 <= most, "limits")
    loops = next((int.from_bytes(b[4:8], "big") for n, b in chunks if n == b"acTL" and len(b) == 8), None)
    frames: list[tuple[bytes, list[bytes]]] = []
    if loops is None:
        frames = [(struct.pack(">IIIIIHHBB", 0, w, h, 0, 0, 0, 1, 0, 0), [b for n, b in chunks if n == b"IDAT"])]
    for n, b in chunks if loops is not None else ():
        if n == b"fcTL":
            _need(len(b) == 26, "bad PNG frame")
            frames.append((b, []))
        elif n == b"IDAT" and frames:  # without a frame before it, it is the still picture alone
            frames[-1][1].append(b)
        elif n == b"fdAT" and frames:
            frames[-1][1].append(b[4:])
    out = []
    for control, data in frames:
        _, fw, fh, left, top, numer, denom, dispose, blend = struct.unpack(">IIIIIHHBB", control)
        _need(left + fw <= w and top + fh <= h, "bad PNG frame")
        own = _PNG + _chunk(b"IHDR", struct.pack(">II", fw, fh) + head[8:]) + b"".join(_chunk(*c) for c in shared) + _chunk(b"IDAT", b"".join(data)) + _chunk(b"IEND", b"")
        _, _, layout, kind, v = read_png(own, most)
        v = v.reshape(fw * fh, -1)
        v = v if kind == "u8" else (v + 128) // 257
        full = np.full((fw * fh, 4), 255, np.int32)
        full[:, :3] = v[:, :3] if layout in ("Rgb", "Rgba") else v[:, :1]
        if layout in ("La", "Rgba"):
            full[:, 3] = v[:, -1]
        out.append({"left": left, "top": top, "width": fw, "height": fh, "dispose": ("keep", "background", "previous")[dispose % 3], "blend": "over" if blend == 1 else "source", "numer": 1000 * numer, "denom": denom or 100, "samples": full.ravel()})
    _need(bool(out), "truncated")
    return w, h, loops, out


FRAMES = {"gif": gif_frames, "png": png_frames}
READERS = {"bmp": read_bmp, "farbfeld": read_farbfeld, "gif": read_gif, "hdr": read_hdr, "ico": read_ico, "pnm": read_pnm, "png": read_png, "qoi": read_qoi, "tga": read_tga}
WRITERS = {"bmp": write_bmp, "farbfeld": write_farbfeld, "hdr": write_hdr, "ico": write_ico, "pnm": write_pnm, "png": write_png, "qoi": write_qoi, "tga": write_tga}


def decode(name: str | None, raw: bytes, most: int = 512 << 20) -> Picture:
    _need(name in READERS, "unsupported format")
    try:
        return READERS[name](raw, most)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"bad {name}: {e}") from e


def decode_frames(name: str | None, raw: bytes, most: int = 512 << 20) -> tuple[int, int, int | None, list[dict]]:
    _need(name in FRAMES, "no animations in this format")
    try:
        return FRAMES[name](raw, most)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"bad {name}: {e}") from e


def encode(name: str, w: int, h: int, layout: str, kind: str, samples: np.ndarray, **options) -> bytes:
    """options: of the format's writer."""
    _need(name in WRITERS, "unsupported format")
    return WRITERS[name](w, h, layout, kind, samples, **options)
