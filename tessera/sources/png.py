"""PNG images to arrays of red, green and blue, with array work only: for images that come as bytes, in Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: The signature, samples per pixel by colour type, and the passes of interlaced images (first row and column, steps).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unfiltered(raw: np.ndarray, kind: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from what their filters left of them; a byte's left neighbour is `step` bytes before it."""
    h, w = raw.shape
    if not np.isin(kind, (3, 4)).any():
        out = raw.copy()
        for y in range(h):
            if kind[y] == 1:
                wide = np.zeros(-(-w // step) * step, np.uint8)
                wide[:w] = out[y]
                out[y] = np.cumsum(wide.reshape(-1, step), 0, dtype=np.uint8).ravel()[:w]
            elif kind[y] == 2 and y:
                out[y] += out[y - 1]
        return out
    # every pixel needs those to the left and above only, so all on a diagonal are worked out at once
    n = -(-w // step)
    given = np.zeros((h, n, step), np.int16)
    given.reshape(h, -1)[:, :w] = raw
    done = np.zeros((h + 1, n + 1, step), np.int16)
    for d in range(h + n - 1):
        y = np.arange(max(0, d - n + 1), min(h, d + 1))
        x, k = d - y, kind[y][:, None]
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        p, q, r = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, paeth, 0))))
        done[y + 1, x + 1] = (given[y, x] + guess) & 255
    return done[1:, 1:].reshape(h, -1)[:, :w].astype(np.uint8)


def _samples(data: np.ndarray, h: int, w: int, depth: int, samples: int) -> tuple[np.ndarray, int]:
    """A pass's samples, height x width x samples, and how many bytes of data it took; of 16 bits the upper eight are kept."""
    line = -(-w * samples * depth // 8)
    size = h * (line + 1)
    if len(data) < size:
        raise ValueError("the image's data ends early")
    rows = data[:size].reshape(h, line + 1)
    if rows[:, 0].max(initial=0) > 4:
        raise ValueError("unknown filter")
    flat = _unfiltered(rows[:, 1:], rows[:, 0], max(1, samples * depth // 8))
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1)[:, : w * samples * depth].reshape(h, -1, depth)
        flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return flat[:, : w * samples].reshape(h, w, samples), size


def decode(content: bytes) -> np.ndarray:
    """height x width x 3 bytes; transparency is left out.  ValueError for what isn't a whole PNG image."""
    if content[:8] != SIGNATURE:
        raise ValueError("no PNG image")
    at, head, palette, packed = 8, None, None, []
    while True:
        if at + 12 > len(content):
            raise ValueError("the file ends early")
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged chunk")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[3] not in SAMPLES or head[2] not in (1, 2, 4, 8, 16) or not head[0] or not head[1]:
        raise ValueError("no usable header")
    w, h, depth, colour, _, _, interlaced = head
    try:
        data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError("damaged data") from e
    n = SAMPLES[colour]
    if interlaced:
        image, start = np.zeros((h, w, n), np.uint8), 0
        for top, left, down, right in PASSES:
            rows, columns = len(range(top, h, down)), len(range(left, w, right))
            if rows and columns:
                part, size = _samples(data[start:], rows, columns, depth, n)
                image[top::down, left::right], start = part, start + size
    else:
        image, _ = _samples(data, h, w, depth, n)
    if colour == 3:
        if palette is None or image.max() >= len(palette):
            raise ValueError("no palette")
        return palette[image[..., 0]]
    if colour in (0, 4):
        gray = image[..., :1]
        if depth < 8:
            gray = (gray.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        return np.repeat(gray, 3, 2)
    return image[..., :3]
