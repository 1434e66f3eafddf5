"""A small demonstration corpus: three texts and painted images, PNG files written without an image library."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np

DOCUMENTS = [
    ("hybrid search", ["rag"], "Keyword search and vector search are fused by rank. Every hit shows where its text matches."),
    ("segments", ["storage"], "Rows are buffered first. A segment is sealed by size, by rows or when nothing comes for a while. The log brings back what was lost."),
    ("images", ["vision"], "Local features are a colour histogram, a perceptual hash and edge directions: they say what looks alike, not what means the same."),
]


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of an (h, w, 3) array of bytes."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgb, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def solid(rgb: tuple[int, int, int], side: int = 64) -> np.ndarray:
    return np.broadcast_to(np.array(rgb, np.uint8), (side, side, 3)).copy()


def painted(kind: str, side: int = 160) -> np.ndarray:
    """gradient, stripes, square or grid."""
    y, x = np.mgrid[:side, :side]
    out = np.zeros((side, side, 3), np.uint8)
    if kind == "gradient":
        out[..., 0], out[..., 2] = x * 255 // side, y * 255 // side
    elif kind == "stripes":
        out[..., 1] = np.where(x // 16 % 2, 220, 30)
    elif kind == "square":
        out[:] = (20, 40, 200)
        out[side // 4 : side // 2, side // 4 : side // 2] = (230, 210, 40)
    else:
        out[:] = np.where(((x // 20 + y // 20) % 2)[..., None], 200, 60)
    return out


def write_images(folder: str) -> list[str]:
    os.makedirs(folder, exist_ok=True)
    names = []
    for kind in ("gradient", "stripes", "square", "grid"):
        names.append(os.path.join(folder, f"{kind}.png"))
        with open(names[-1], "wb") as f:
            f.write(png(painted(kind)))
    return names


def image_files(spark, path: str) -> str:
    """The painted images and a file that is no image, written to any file system; gives the folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(conf)
    files = {f"{kind}.png": png(painted(kind)) for kind in ("gradient", "stripes", "square", "grid")} | {"bad.png": b"this is not an image"}
    for name, data in files.items():
        out = fs.create(make(f"{path}/{name}"), True)
        out.write(bytearray(data))
        out.close()
    return path
