"""Small rasters as pixel tables, for tests."""

from __future__ import annotations

import numpy as np

MAGENTA = (255, 0, 255)


def canvas(width, height, colour=MAGENTA, alpha=255):
    image = np.zeros((height, width, 4), dtype=np.int32)
    image[..., :3], image[..., 3] = colour, alpha
    return image


def fill(image, x0, y0, x1, y1, colour, alpha=255):
    """Half-open on the right and below."""
    image[y0:y1, x0:x1, :3], image[y0:y1, x0:x1, 3] = colour, alpha
    return image


def table(spark, images, frames=False):
    """(image_id, [frame,] x, y, r, g, b, a) of images, or of one set's frames."""
    import pandas as pd

    parts = []
    for i, image in enumerate(images):
        h, w = image.shape[:2]
        y, x = np.divmod(np.arange(w * h), w)
        flat = image.reshape(-1, 4)
        part = pd.DataFrame({"image_id": 0 if frames else i, "x": x, "y": y, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2], "a": flat[:, 3]})
        if frames:
            part.insert(1, "frame", i)
            part["w"], part["h"] = w, h
        parts.append(part)
    kinds = "image_id bigint, " + ("frame int, " if frames else "") + "x int, y int, r int, g int, b int, a int" + (", w int, h int" if frames else "")
    return spark.createDataFrame(pd.concat(parts), kinds)
