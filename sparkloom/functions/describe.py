"""Image descriptors in NumPy: colour histogram, oriented gradients (Dalal and Triggs 2005), local binary patterns (Ojala et al. 2002)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Descriptor:
    """Settings of a variant; the two below are the ones in use."""

    #: Edge of the resized image, bins of hue, saturation and value, orientations, cell and block of gradients.
    size: int = 96
    hsv_bins: tuple[int, int, int] = (10, 4, 4)
    orientations: int = 9
    cell: int = 16
    block: int = 2
    luma: bool = False
    epsilon: float = 1e-8
    #: Whether images are turned as their Exif orientation states.
    exif: bool = False


MAIN = Descriptor()
WORKSHOP = Descriptor(hsv_bins=(8, 8, 8), luma=True, epsilon=0.0, exif=True)
#: The luma weights of red, green and blue.
LUMA = np.array([0.2125, 0.7154, 0.0721])


def resize(rgb: np.ndarray, size: int) -> np.ndarray:
    """Area-weighted linear resampling to size x size."""

    def weights(n: int) -> np.ndarray:
        scale = max(n / size, 1.0)
        centre = (np.arange(size)[:, None] + 0.5) * n / size - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre) / scale)
        return w / w.sum(axis=1, keepdims=True)

    out = np.einsum("ih,hwc,jw->ijc", weights(rgb.shape[0]), rgb, weights(rgb.shape[1]))
    return np.clip(out, 0, 1).astype(np.float32)


def grey(rgb: np.ndarray, luma: bool) -> np.ndarray:
    return rgb @ LUMA if luma else rgb.mean(axis=2)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value in 0..1, through 8-bit levels."""
    x = np.floor(rgb.astype(np.float64) * 255 + 1e-6)
    top, low = x.max(axis=2), x.min(axis=2)
    spread = top - low
    safe = np.where(spread == 0, 1, spread)
    r, g, b = ((top - x[..., i]) / safe for i in range(3))
    hue = np.select([x[..., 0] == top, x[..., 1] == top], [b - g, 2 + r - b], 4 + g - r) / 6 % 1
    saturation = np.where(top > 0, spread / np.where(top == 0, 1, top), 0)
    levels = np.stack([np.where(spread == 0, 0, hue) * 255, saturation * 255, top], axis=2)
    return np.floor(levels) / 255


def normalised(counts: np.ndarray, epsilon: float) -> np.ndarray:
    total = counts.sum() + epsilon
    return (counts / total if total > 0 else counts).astype(np.float32)


def colour(rgb: np.ndarray, d: Descriptor) -> np.ndarray:
    counts = np.histogramdd(hsv(rgb).reshape(-1, 3), bins=d.hsv_bins, range=[(0, 1)] * 3)[0]
    return normalised(counts.ravel(), d.epsilon)


def hog(image: np.ndarray, d: Descriptor) -> np.ndarray:
    """Unsigned gradient orientations by cell, L2-Hys over overlapping blocks."""
    gx, gy = np.zeros_like(image, dtype=np.float64), np.zeros_like(image, dtype=np.float64)
    gx[:, 1:-1] = image[:, 2:] - image[:, :-2]
    gy[1:-1] = image[2:] - image[:-2]
    size = np.hypot(gx, gy)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    n = image.shape[0] // d.cell
    which = np.minimum((angle / 180 * d.orientations).astype(int), d.orientations - 1)
    cells = np.zeros((n, n, d.orientations))
    for o in range(d.orientations):
        own = np.where(which == o, size, 0)[: n * d.cell, : n * d.cell]
        cells[..., o] = own.reshape(n, d.cell, n, d.cell).mean(axis=(1, 3))
    out = []
    for i in range(n - d.block + 1):
        for j in range(n - d.block + 1):
            v = cells[i : i + d.block, j : j + d.block].ravel()
            v = np.minimum(v / np.sqrt((v * v).sum() + 1e-10), 0.2)
            out.append(v / np.sqrt((v * v).sum() + 1e-10))
    return np.concatenate(out).astype(np.float32)


def lbp(image: np.ndarray, d: Descriptor) -> np.ndarray:
    """Uniform patterns of 8 neighbours at radius 1: their number of ones, 9 for all others."""
    x = np.floor(image * 255 + 1e-6)
    y = np.pad(x, 1)
    angles = 2 * np.pi * np.arange(8) / 8
    rows, cols = np.meshgrid(np.arange(x.shape[0]) + 1.0, np.arange(x.shape[1]) + 1.0, indexing="ij")
    bits = []
    for a in angles:
        r, c = np.round(rows - np.sin(a), 5), np.round(cols + np.cos(a), 5)
        r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
        r1, c1 = np.minimum(r0 + 1, y.shape[0] - 1), np.minimum(c0 + 1, y.shape[1] - 1)
        fr, fc = r - r0, c - c0
        v = (y[r0, c0] * (1 - fr) + y[r1, c0] * fr) * (1 - fc) + (y[r0, c1] * (1 - fr) + y[r1, c1] * fr) * fc
        bits.append(v - x >= -1e-9)
    bits = np.stack(bits, axis=-1)
    changes = (bits != np.roll(bits, 1, axis=-1)).sum(axis=-1)
    codes = np.where(changes <= 2, bits.sum(axis=-1), 9)
    return normalised(np.bincount(codes.ravel(), minlength=10).astype(np.float64), d.epsilon)


def describe(rgb: np.ndarray, d: Descriptor = MAIN) -> dict[str, np.ndarray]:
    """The groups color, hog, lbp and all of an image with values in 0..1."""
    small = resize(rgb, d.size)
    g = grey(small, d.luma)
    groups = {"color": colour(small, d), "hog": hog(g, d), "lbp": lbp(g, d)}
    return groups | {"all": np.concatenate(list(groups.values()))}
