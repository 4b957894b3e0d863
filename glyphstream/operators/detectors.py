"""Detectors made of models: scaling to the request's width, one run per scope, and one model for all tasks of a worker."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ..functions.pixels import area_resize
from .engine import Box, Detector, Request, covers

#: an image and the least score of a box -> (box, score) pairs in pixels of that image
Model = Callable[[np.ndarray, float], list[tuple[Box, float]]]
THRESHOLDS = {"FAST": 0.35, "LOCAL": 0.28, "AUDIT": 0.22}


@lru_cache(maxsize=None)
def shared(make: Callable[[], object]) -> object:
    """What ``make`` (a function of a module) returns, made once per Python worker."""
    return make()


def scaled(image: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """(the image, shrunk to the width if it is wider, the scale)."""
    scale = min(1.0, width / max(image.shape[1], 1))
    if scale == 1.0:
        return image, scale
    w, h = max(2, round(image.shape[1] * scale)), max(2, round(image.shape[0] * scale))
    planes = [area_resize(p, w, h) for p in (np.moveaxis(image, 2, 0) if image.ndim == 3 else [image])]
    return np.rint(np.stack(planes, 2) if image.ndim == 3 else planes[0]).astype(np.uint8), scale


def model_detector(make: Callable[[], Model], thresholds: dict[str, float] | None = None) -> Detector:
    """A detector that runs a worker's shared model on the frame, or on each of the request's scopes; boxes come back in pixels of the frame, less those that an
    excluded region covers."""
    least = THRESHOLDS | (thresholds or {})

    def detect(image: np.ndarray, request: Request) -> list[tuple[Box, float]]:
        height, width = image.shape[:2]
        found: list[tuple[Box, float]] = []
        for l, t, r, b in request.scopes or ((0.0, 0.0, float(width), float(height)),):
            left, top = min(max(int(np.floor(l)), 0), width - 1), min(max(int(np.floor(t)), 0), height - 1)
            right, bottom = max(left + 1, min(width, int(np.ceil(r)))), max(top + 1, min(height, int(np.ceil(b))))
            part, scale = scaled(image[top:bottom, left:right], request.width)
            for box, score in shared(make)(part, least[request.tier]):
                x0, y0, x1, y1 = (v / scale for v in box)
                whole = (x0 + left, y0 + top, x1 + left, y1 + top)
                if not any(covers(whole, e) >= 0.35 for e in request.excluded):
                    found.append((whole, float(score)))
        return found

    return detect
