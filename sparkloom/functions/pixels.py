"""Pixels of one image in numpy, for use inside Arrow batches: rows, columns, samples."""

from __future__ import annotations

import numpy as np

#: Fixed values of the detector: mean and deviation of the blue, green and red plane, in this order.
DETECTOR_MEAN, DETECTOR_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def image_of(data: bytes, width: int, height: int) -> np.ndarray:
    """RGBA bytes, row by row, as an array."""
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes between pixels at (x, y), edges repeated: bilinear, rounded half to even."""
    high, wide = image.shape[:2]
    x, y = np.clip(x, 0, wide - 1), np.clip(y, 0, high - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, wide - 1), np.minimum(y0 + 1, high - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    low = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled with half-pixel centres."""
    high, wide = image.shape[:2]
    if (high, wide) == (height, width):
        return image
    x = np.clip((np.arange(width) + 0.5) * wide / width - 0.5, 0, wide - 1)
    y = np.clip((np.arange(height) + 0.5) * high / height - 0.5, 0, high - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[None, :, None], (y - y0)[:, None, None]
    if not ((fx * 256) % 1).any() and not ((fy * 256) % 1).any():
        fx, fy = fx.astype(np.float32), fy.astype(np.float32)  # 8 bits of a byte and of each share: exact in 24
    across = image[:, x0] * (1 - fx) + image[:, np.minimum(x0 + 1, wide - 1)] * fx  # once for each row there is
    return np.rint(across[y0] * (1 - fy) + across[np.minimum(y0 + 1, high - 1)] * fy).astype(np.uint8)


def warped(image: np.ndarray, frame: dict) -> np.ndarray:
    """The upright crop of a frame (``geometry.crop_frame``)."""
    cx, cy = np.meshgrid(np.arange(frame["width"]), np.arange(frame["height"]))
    at = lambda c: frame["origin"][c] + cx * frame["r"][c] + cy * frame["a"][c]
    return sampled(image, at("x"), at("y"))


def detector_tensor(image: np.ndarray) -> np.ndarray:
    """Planes blue, green and red, each less its mean and over its deviation."""
    planes = image[..., 2::-1].transpose(2, 0, 1) / 255
    mean, deviation = (np.array(v)[:, None, None] for v in (DETECTOR_MEAN, DETECTOR_DEVIATION))
    return ((planes - mean) / deviation).astype(np.float32)


_FROM_BYTE = (np.arange(256) / 127.5 - 1).astype(np.float32)


def recogniser_tensor(image: np.ndarray) -> np.ndarray:
    """Planes blue, green and red, from -1 to 1."""
    return _FROM_BYTE[image[..., 2::-1].transpose(2, 0, 1)]
