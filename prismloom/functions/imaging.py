"""Image features in numpy over decoded grey or RGB arrays (no decoder is bundled)."""

from __future__ import annotations

import hashlib

import numpy as np


def entropy(grey: np.ndarray) -> float:
    """Entropy in bits of the 256-bin histogram."""
    counts = np.bincount(grey.astype(np.uint8).ravel(), minlength=256).astype(np.float64)
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, edges mirrored."""
    g = np.pad(grey.astype(np.float64), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def edge_map(grey: np.ndarray, threshold: float = 60.0) -> np.ndarray:
    """Pixels whose Sobel magnitude exceeds the threshold."""
    g = np.pad(grey.astype(np.float64), 1, mode="edge")
    gx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
    gy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
    return np.hypot(gx, gy) > threshold


def edge_probability(edges: np.ndarray) -> float:
    """How likely the picture is split by a straight edge: four fifths of the densest row or column
    and one fifth of the largest step between neighbours."""
    lines = [edges.mean(axis=1), edges.mean(axis=0)]
    densest = max(float(v.max()) for v in lines)
    step = max(float(np.abs(np.diff(v)).max()) if len(v) > 1 else 0.0 for v in lines)
    return 0.8 * densest + 0.2 * step


def near_edge_min_std(grey: np.ndarray, edges: np.ndarray, lines: int = 3) -> float | None:
    """Least deviation of the two parts into which the densest rows (or columns, where these are as
    dense) cut the picture; cuts at its border do not count, None where none is left."""
    rows, cols = edges.mean(axis=1), edges.mean(axis=0)
    density, image = (rows, grey) if rows.max() > cols.max() else (cols, grey.T)
    cuts = [i for i in np.argsort(density, kind="stable")[-lines:] if 0 < i < len(density) - 1]
    parts = [part for i in cuts for part in (image[:i], image[i:])]
    return min((float(part.astype(np.float64).std()) for part in parts), default=None)


def features(rgb: np.ndarray, raw: bytes) -> dict:
    """All features of one decoded picture."""
    c = rgb.astype(np.float64)
    high, low = c.max(axis=2), c.min(axis=2)
    grey = c @ np.array([0.299, 0.587, 0.114])
    saturation = np.where(high > 0, (high - low) / np.maximum(high, 1e-9), 0.0)
    edges = edge_map(grey)
    return {
        "file_hash": hashlib.md5(raw).digest(),
        "file_size": len(raw),
        "width": rgb.shape[1],
        "height": rgb.shape[0],
        "mean_lightness": float(((high + low) / 2).mean()),
        "mean_saturation": float(saturation.mean()),
        "clarity": laplacian_variance(grey),
        "entropy": entropy(np.rint(grey)),
        "edge_probability": edge_probability(edges),
        "edge_near_patch_min_std": near_edge_min_std(grey, edges),
    }


def hamming(a: bytes, b: bytes) -> int:
    """Bits in which two hashes differ."""
    return int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
