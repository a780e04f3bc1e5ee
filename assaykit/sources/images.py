"""Images in Spark: decoding, hashes, comparison of pairs, the near-duplicate cascade, and views for a predictor."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import geometry
from assaykit.operators.neardup import hamming_pairs, shortlist, tiers

#: Channels of the colour types of PNG files.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _png(data: bytes) -> np.ndarray:
    """An eight-bit PNG without interlacing; the lines' filters are undone byte by byte where they have to be."""
    at, body, head, palette = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    if head is None or head[2] != 8 or head[6] or (head[3] not in _CHANNELS and head[3] != 3):
        raise ValueError("an eight-bit PNG without interlacing is wanted")
    width, height, kind = head[0], head[1], head[3]
    step = _CHANNELS.get(kind, 1)
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width * step + step), np.uint8)  # a line above and a pixel to the left, all zero
    for y in range(height):
        rule, raw, above = lines[y, 0], lines[y, 1:], out[y]
        if rule in (0, 2):
            out[y + 1, step:] = raw + (above[step:] if rule else 0)
        elif rule == 1:
            out[y + 1, step:] = np.cumsum(raw.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        else:
            row = [0] * step
            up = above.tolist()
            for i, v in enumerate(raw.tolist()):
                a, b, c = row[i], up[i + step], up[i]
                if rule == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda q: abs(p - q))  # noqa: B023
                row.append((v + guess) & 255)
            out[y + 1] = row
    image = out[1:, step:].reshape(height, width, step)
    return palette[image[:, :, 0]] if kind == 3 else image


def _netpbm(data: bytes) -> np.ndarray:
    """A binary PGM or PPM of eight bits."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while data[end : end + 1].strip():
            end += 1
        word = data[at:end]
        if word.startswith(b"#"):
            end = data.index(b"\n", at)
        elif word:
            fields.append(word)
        at = end + 1
    width, height, channels = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    if int(fields[3]) > 255:
        raise ValueError("eight bits a sample are wanted")
    return np.frombuffer(data, np.uint8, width * height * channels, at).reshape(height, width, channels)


def decode(data: bytes) -> np.ndarray:
    """``height x width x channels`` of a PNG, PGM or PPM file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    raise ValueError("neither PNG nor PGM nor PPM")


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of colour images, by the usual weights of broadcast video."""
    if image.shape[2] < 3:
        return image[:, :, 0].astype(float)
    return image[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A gray image as means over the areas that fall on each pixel of the new size."""
    def weights(old: int, new: int) -> np.ndarray:
        edge = np.linspace(0, old, new + 1)
        lo, hi = np.arange(old)[None, :], np.arange(1, old + 1)[None, :]
        part = np.maximum(np.minimum(hi, edge[1:, None]) - np.maximum(lo, edge[:-1, None]), 0)
        return part / part.sum(1, keepdims=True)

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def scanned(files: DataFrame, side: int = 64, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """``path, readable, width, height, channels, pixel_sha256, phash, small`` of ``files (path, content)``.

    ``small`` is the gray image at ``side x side``, for comparison. A file that cannot be decoded has only ``readable`` false.
    ``decoder`` may be any function from bytes to an array, such as one for a further format.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    image = decoder(bytes(content))
                except Exception:  # noqa: BLE001  whatever a broken file raises
                    rows.append((path, False, None, None, None, None, None, None))
                    continue
                plain = gray(image)
                bits = geometry.dct_hash(resized(plain, 32, 32))
                pixels = hashlib.sha256(struct.pack("<III", *image.shape) + np.ascontiguousarray(image).tobytes()).hexdigest()
                signed = bits - (1 << 64) if bits >> 63 else bits
                small = resized(plain, side, side).astype(np.float32).ravel().tolist()
                rows.append((path, True, image.shape[1], image.shape[0], image.shape[2], pixels, signed, small))
            yield pd.DataFrame(rows, columns=["path", "readable", "width", "height", "channels", "pixel_sha256", "phash", "small"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32", "phash": "Int64"})

    return files.select("path", "content").mapInPandas(kernel, "path string, readable boolean, width int, height int, channels int, pixel_sha256 string, phash long, small array<float>")


def compared(pairs: DataFrame, left: str = "left_small", right: str = "right_small", side: int = 64, reach: int = 10) -> DataFrame:
    """``pairs`` with similarity as they are and at the best shift: ``original_mae, original_pearson, best_dx, best_dy,
    aligned_mae, aligned_pearson, overlap_fraction``; differences are parts of the full range."""
    names = ["original_mae", "original_pearson", "best_dx", "best_dy", "aligned_mae", "aligned_pearson", "overlap_fraction"]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b in zip(batch[left], batch[right]):
                a, b = (np.asarray(x, float).reshape(side, side) / 255 for x in (a, b))
                best = geometry.best_shift(a, b, reach)
                rows.append((*geometry.similarity(a, b), best["dx"], best["dy"], best["mae"], best["pearson"], best["overlap"]))
            yield pd.concat([batch.drop(columns=[left, right]).reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name not in (left, right)]
    kinds = "original_mae double, original_pearson double, best_dx int, best_dy int, aligned_mae double, aligned_pearson double, overlap_fraction double"
    return pairs.mapInPandas(kernel, f"{', '.join(kept)}, {kinds}" if kept else kinds)


def near_duplicate_cascade(left: DataFrame, right: DataFrame, rules: dict, distance: int = 10, most_mae: float = 0.015, least_r: float = 0.985) -> dict[str, DataFrame]:
    """From scanned images of two splits: hash candidates, those with similarity and tiers, and the shortlist for a person."""
    found = hamming_pairs(left.where("readable"), right.where("readable"), distance, key="path", bits="phash").withColumnRenamed("distance", "phash_distance")
    small = lambda df, side: df.select(F.col("path").alias(f"{side}_id"), F.col("small").alias(f"{side}_small"))
    pairs = compared(found.join(small(left, "left"), "left_id").join(small(right, "right"), "right_id"))
    tiered = tiers(pairs, rules)
    return {"candidates": found, "compared": tiered, "shortlist": shortlist(tiered, most_mae, least_r)}


def git_blob_id(content: Column) -> Column:
    """The identity that git gives a file's bytes (SHA-1 form)."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.lit(b"\x00"), content))


def text_blob_id(content: Column) -> Column:
    """The same of a text whose line ends have been made LF, as a checkout with other line ends would be stored."""
    return git_blob_id(F.regexp_replace(content.cast("string"), "\r\n", "\n").cast("binary"))


def view_of(image: np.ndarray, view: dict) -> np.ndarray:
    """One transformed view of a decoded image."""
    if "factor" in view:
        return (geometry.brightness if view["family"] == "brightness" else geometry.contrast)(image, view["factor"])
    if "sigma" in view:
        return geometry.blur(image, view["sigma"])
    h, w = image.shape[:2]
    return geometry.warp(image, geometry.view_matrix(w, h, view.get("degrees", 0.0), view.get("shift", (0.0, 0.0))))


def detected(files: DataFrame, predictor: Callable[[np.ndarray], list[tuple]], views: tuple[dict, ...] = (), decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """What a detector sees in every image and each of its views.

    ``predictor`` takes a decoded image and gives ``class_id, confidence, x1, y1, x2, y2`` of each detection; it travels to
    the executors. Rows are ``image, transform_id, width, height, detection_index, class_id, confidence, x1..y2``; the plain image's
    ``transform_id`` is ``original``. An image or view without detections has one row with nulls.
    """
    wanted = ({"id": "original", "family": "original"}, *views)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                image = decoder(bytes(content))
                for v in wanted:
                    seen = predictor(image if v["id"] == "original" else view_of(image, v))
                    head = (path, v["id"], image.shape[1], image.shape[0])
                    rows += [(*head, i, *d) for i, d in enumerate(seen)] or [(*head, None, None, None, None, None, None, None)]
            names = ["image", "transform_id", "width", "height", "detection_index", "class_id", "confidence", "x1", "y1", "x2", "y2"]
            yield pd.DataFrame(rows, columns=names).astype({"detection_index": "Int32", "class_id": "Int32"})

    kinds = "image string, transform_id string, width int, height int, detection_index int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    return files.select("path", "content").mapInPandas(kernel, kinds)
