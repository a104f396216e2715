"""Image signals over arrays and numbers; decoding pixels is the page extractor's business."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
INK_BELOW, MAX_INK_SHARE, MAX_VARIANCE = 220, 0.0008, 40.0
UNDECODABLE = 0.5


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """A bit for each pixel that is darker than its right neighbour, row by row, the first bit highest."""
    bits = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.transform(
        F.sequence(F.lit(0), F.lit(width - 2)), lambda x: F.when(F.get(pixels, y * width + x) < F.get(pixels, y * width + x + 1), F.lit(1)).otherwise(0).cast("long"))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))


def color_similarity(a: Column, b: Column) -> Column:
    """1 less the distance of two colours over the largest one."""
    apart = F.sqrt(F.pow(a["r"] - b["r"], 2) + F.pow(a["g"] - b["g"], 2) + F.pow(a["b"] - b["b"], 2))
    return 1.0 - apart / (3 * 255.0**2) ** 0.5


def image_similarity(a: Column, b: Column) -> Column:
    """1 for equal bytes, else the lower of what the hashes and the colours say; 0.5 if either couldn't be decoded."""
    alike = F.least(1.0 - hamming(a["perceptual_hash"], b["perceptual_hash"]) / 64.0, color_similarity(a["average_color"], b["average_color"]))
    return F.when(a["byte_sha256"] == b["byte_sha256"], 1.0).otherwise(F.coalesce(alike, F.lit(UNDECODABLE)))


def images_similarity(a: Column, b: Column) -> Column:
    """The least similarity of images in the same place; null without images."""
    return F.when(F.size(a) > 0, F.array_min(F.zip_with(a, b, image_similarity)))


def is_blank_image(pixels: Column) -> Column:
    """Nearly no ink and nearly no variance; an image without pixels is blank."""
    n = F.size(pixels)
    total = lambda f: F.aggregate(pixels, F.lit(0.0), lambda acc, x: acc + f(x))
    mean = total(lambda x: x.cast("double")) / n
    variance = total(lambda x: x.cast("double") * x) / n - mean * mean
    ink = total(lambda x: F.when(x < INK_BELOW, 1.0).otherwise(0.0)) / n
    return F.when(n == 0, True).otherwise((ink <= MAX_INK_SHARE) & (variance <= MAX_VARIANCE))
