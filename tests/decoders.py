"""Decoders, detectors and recognizers that tests name as module:function."""

import numpy as np


def from_key_frame(path, start, end, options):
    """Begins before its range, as at a key frame, and runs on after it."""
    assert options["skip"] == "nonref"
    for k in range(max(0, int(start) - 2), int(end) + 3):
        yield float(k), np.zeros((3, 4), np.uint8)


def detector(image, request):
    return [((10.0, 20.0, 110.0, 60.0), 0.95)]


def recognizer(crops):
    return [(f" text {int(c[:24, :40].mean())} ", 0.9) for c in crops]


def model():
    """A model that sees one box in the middle half of whatever it is shown."""
    model.made = getattr(model, "made", 0) + 1
    return lambda image, least: [((image.shape[1] / 4, image.shape[0] / 4, image.shape[1] * 3 / 4, image.shape[0] * 3 / 4), least)]
