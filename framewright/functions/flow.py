"""Displacement fields of single images, in numpy: followed from frame to frame, and lifted to three dimensions by depths and camera poses."""

from __future__ import annotations

import numpy as np

#: Added to focal lengths where a pose is predicted: fixed value.
SMALL = 1e-8


def grid(height: int, width: int) -> np.ndarray:
    """[H, W, 2]: each pixel's own x and y."""
    y, x = np.mgrid[:height, :width].astype(np.float64)
    return np.stack([x, y], -1)


def sampled(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A field [H, W, C] at places [..., 2] between its pixels, bilinearly; a place outside reads the border."""
    top = np.array([field.shape[1] - 1, field.shape[0] - 1])
    at = np.clip(at, 0, top)
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, top)
    share = (at - low)[..., None, :]
    left, right = low[..., 0], high[..., 0]
    across = lambda row: field[row, left] + (field[row, right] - field[row, left]) * share[..., 0]
    above, below = across(low[..., 1]), across(high[..., 1])
    return above + (below - above) * share[..., 1]


def lifted(depth: np.ndarray, camera: np.ndarray, small: float = 0.0) -> np.ndarray:
    """[H, W, 3]: pixels with depths as points of their camera, by its 3 x 3 matrix."""
    at = grid(*depth.shape)
    focal, middle = camera[[0, 1], [0, 1]] + small, camera[:2, 2]
    return np.concatenate([(at - middle) * depth[..., None] / focal, depth[..., None]], -1)


def turned(vector: np.ndarray) -> np.ndarray:
    """The 3 x 3 rotation of a rotation vector."""
    angle = max(float(np.linalg.norm(vector)), SMALL)
    x, y, z = vector / angle
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * (cross @ cross)


def static_flow(pose: np.ndarray, depth: np.ndarray, camera: np.ndarray) -> np.ndarray:
    """[H, W, 3]: where the points of a still scene go as its camera moves by a pose (rotation vector, translation)."""
    points = lifted(depth, camera, SMALL)
    return points @ turned(pose[:3]).T + pose[3:] - points


def _smooth(depth: np.ndarray, steepest: float) -> np.ndarray:
    """Pixels with a depth whose central differences (0 at the border) are below a slope."""
    slope = np.zeros((2, *depth.shape))
    slope[0, :, 1:-1] = (depth[:, 2:] - depth[:, :-2]) / 2
    slope[1, 1:-1] = (depth[2:] - depth[:-2]) / 2
    return (np.sqrt((slope**2).sum(0)) < steepest) & np.isfinite(depth) & (depth > 0)


def scene_flow(depths: np.ndarray, cameras: np.ndarray, poses: np.ndarray, flow: np.ndarray, steepest: float) -> tuple[np.ndarray, np.ndarray]:
    """[H, W, 3] and the pixels where it holds: each point's way to where the image's flow leads, in the first camera's coordinates. depths [2, H, W], cameras [2, 3, 3],
    poses [2, 4, 4] (world to camera). A pixel that leaves the image, or has no depth or a steep one at either end, is 0. A flow of three numbers a pixel is the way already, and holds where
    both depths do."""
    if flow.shape[-1] == 3:
        holds = (np.isfinite(depths) & (depths > 0)).all(0)
        return np.where(holds[..., None], flow, 0.0), holds
    height, width = depths.shape[1:]
    with np.errstate(invalid="ignore", over="ignore"):
        first, second = (lifted(d, k) for d, k in zip(depths, cameras))
        move = poses[0] @ np.linalg.inv(poses[1])
        second = second @ move[:3, :3].T + move[:3, 3]
        target = grid(height, width) + flow
        inside = (np.isfinite(target) & (target >= 0) & (target <= [width - 1, height - 1])).all(-1)
        x, y = np.moveaxis(np.rint(np.where(inside[..., None], target, 0)).astype(np.int64), -1, 0)
        way = second[y, x] - first
        holds = inside & _smooth(depths[0], steepest) & _smooth(depths[1], steepest)[y, x] & np.isfinite(way).all(-1)
    return np.where(holds[..., None], way, 0.0), holds
