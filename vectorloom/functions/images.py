"""Arrays of pixels (height x width x channels) for Arrow kernels. Resizing is bilinear at pixel centres when it grows, and averages with a triangle filter when it shrinks."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _weights(old: int, new: int) -> np.ndarray:
    """new x old: each new pixel's shares of the old ones, by a triangle about its centre that reaches to the neighbouring centres, old ones when it grows and new ones when it shrinks."""
    scale = old / new
    centre = (np.arange(new) + 0.5) * scale
    share = np.maximum(0, 1 - np.abs(np.arange(old) + 0.5 - centre[:, None]) / max(scale, 1.0))
    return share / share.sum(1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Along one axis after the other."""
    h, w = image.shape[:2]
    across = np.einsum("nw,hwc->hnc", _weights(w, width), image.astype(float))
    return np.einsum("nh,hwc->nwc", _weights(h, height), across)


def letterboxed(image: np.ndarray, size: int, resized_w: int, resized_h: int, pad_x: int, pad_y: int) -> np.ndarray:
    """channels x size x size in 0 to 1, the picture in its box and zero around it."""
    out = np.zeros((image.shape[2], size, size))
    out[:, pad_y : pad_y + resized_h, pad_x : pad_x + resized_w] = resized(image, resized_w, resized_h).transpose(2, 0, 1) / 255
    return out


def reviewed(image: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The crop's pixels where the mask is set; zero elsewhere and beyond the mask's extent."""
    x0, y0, x1, y1 = box
    on = np.zeros(image.shape[:2], bool)
    part = mask[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] > 0
    on[max(0, -y0) : max(0, -y0) + part.shape[0], max(0, -x0) : max(0, -x0) + part.shape[1]] = part
    return image * on[:, :, None]


def turned(image: np.ndarray, rot: int, h: bool, v: bool) -> np.ndarray:
    """Quarter turns anticlockwise, then flips: what ``augmented`` does to points."""
    out = np.rot90(image, rot)
    out = out[:, ::-1] if h else out
    return out[::-1] if v else out


def png(px: np.ndarray, planes_first: bool = False) -> bytes:
    """A PNG file of an image: height x width x 1 or 3 with values up to 255, or planes first with values up to 1 (or 255, if any is greater)."""
    if planes_first:
        px = np.moveaxis(px, 0, -1)
        px = px * 255 if px.size and px.max() <= 1 else px
    px = np.clip(px, 0, 255).astype(np.uint8)
    h, w, n = px.shape
    rows = b"".join(b"\0" + row.tobytes() for row in px)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
