"""Perceptual hashes of decoded images; decoding and scaling are the reader's work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The side of the grey image, and of the low frequencies that are kept.
SIDE, KEPT = 32, 8


@F.pandas_udf(T.StringType())
def phash(pixels: pd.Series) -> pd.Series:
    """16 hex digits of a 32 x 32 grey image given row by row: which of the 8 x 8 lowest
    frequencies of its cosine transform are above their median. NULL for any other size."""
    waves = np.cos(np.pi * np.outer(np.arange(KEPT), 2 * np.arange(SIDE) + 1) / (2 * SIDE))
    fits = pixels.map(lambda x: x is not None and len(x) == SIDE * SIDE)
    out = pd.Series([None] * len(pixels), dtype=object)
    if fits.any():
        images = np.stack([np.asarray(x, float) for x in pixels[fits]]).reshape(-1, SIDE, SIDE)
        low = (waves @ images @ waves.T).reshape(len(images), -1)
        bits = np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1)
        out[fits.to_numpy()] = [b.tobytes().hex() for b in bits]
    return out
