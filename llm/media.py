"""Media columns: a text's bytes held as the coefficients of a progressive JPEG, read back, and its pixels.

The UTF-8 bytes of a text, spaces up to a positive multiple of 192, are the coefficients of 8 x 8
blocks of three components (255 is taken from those under 128), chroma at half the width (4:2:2); the file
is written in progressive scans, read back from its bytes, and decoded to an RGB tensor of full size, for
which chroma is upsampled. Equal texts give equal files.

A null text is an empty one (one unit of spaces). Rows are independent; repeated rows repeat, an empty table gives an
empty result, other columns of docs are left out. A very long text is held whole by one task, with some 60 bytes for
each of its own.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import map_slices
from .textarrays import Texts, plain

UNIT = 192
#: Blocks that an image is high at most.
TALL = 8191


def store(payload: bytes) -> bytes:
    """A file that holds a payload of whole units."""
    # units of 4:2:2: two blocks of luma beside each other, one of each chroma
    n = -(-len(payload) // 256)
    columns = -(-n // TALL)
    rows = -(-n // columns)
    data = np.full(rows * columns * 256, 32, np.int32)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    # a byte as a coefficient of 128 to 255 or its negative
    blocks = np.where(data >= 128, data, data - 255).reshape(-1, 4, 64)
    return jpeg.encode([blocks[:, :2].reshape(-1, 64), blocks[:, 2], blocks[:, 3]], rows * 8, columns * 16, b"bytes=%d" % len(payload))


def load(data: bytes) -> tuple[bytes, jpeg.Image]:
    """The payload of a stored file, and the image."""
    image = jpeg.decode(data)
    size = int(image.comment.partition(b"=")[2])
    values = np.concatenate([b.reshape(-1, h, 64) for b, (h, _) in zip(image.blocks, image.sampling, strict=True)], axis=1)
    values += np.where(values < 0, 255, 0)
    return values.astype(np.uint8).tobytes()[:size], image


def feature(rgb: np.ndarray) -> str:
    """Size and channel sums of an RGB tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ":".join(map(str, sums))


def media(docs: DataFrame, tensors: bool = False, files: bool = False) -> DataFrame:
    """The digest columns of each row's file; with files and tensors the file (media) and the RGB bytes (rgb, with height and width) too."""
    fields = ["doc_id long", "n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]
    fields += ["media binary"] * files + ["rgb binary", "height int", "width int"] * tensors

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Texts(plain(batch.column("text")))
        raw, rows = x.data.tobytes(), []
        for a, b in zip(x.starts[:-1].tolist(), x.starts[1:].tolist(), strict=True):
            size = max(1, -(-(b - a) // UNIT)) * UNIT
            stored = store(raw[a:b].ljust(size, b" "))
            payload, image = load(stored)
            rgb = jpeg.pixels(image)
            row = [b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(rgb)]
            row += [stored] * files
            if tensors:
                row += [rgb.tobytes(), rgb.shape[0], rgb.shape[1]]
            rows.append(row)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(fields) - 1)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
        named = [f.split() for f in fields]
        return pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named[1:], strict=True)], [f for f, _ in named])

    return map_slices(docs.withColumn("doc_id", F.col("doc_id").cast("long")), run, ", ".join(fields), "doc_id", "text")
