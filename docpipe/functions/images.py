"""Text placeholders for the images of a page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IMAGE_MODES = ("skip", "reference", "extract", "base64")


def _pixels(value: Column) -> Column:
    """Half-even whole number, 0 when the box carries no value."""
    return F.format_string("%.0f", F.bround(F.coalesce(value, F.lit(0.0)), 0))


def image_lines(images: Column, page_number: Column, mode: str, output_dir: str | None = None) -> Column:
    """One line per image in page order. ``base64`` yields size placeholders:
    pixel data is not part of an extraction."""
    if mode not in IMAGE_MODES:
        raise ValueError(f"Unsupported image mode: {mode}")
    if mode == "extract" and not output_dir:
        raise ValueError("output_dir required for 'extract' mode")
    if mode == "skip":
        return F.lit("")
    page = page_number.cast("string")

    def line(image: Column, position: Column) -> Column:
        number = (position + 1).cast("string")
        if mode == "reference":
            return F.concat(F.lit("![Image "), number, F.lit(" on page "), page, F.lit("]()"))
        if mode == "extract":
            return F.concat(
                F.lit("![Image "), number, F.lit("](page"), page, F.lit("_image"), number, F.lit(".png)")
            )
        size = F.concat(_pixels(image.width), F.lit("x"), _pixels(image.height))
        return F.concat(
            F.lit("[Image "), number, F.lit(": "), size, F.lit("px on page "), page, F.lit("]")
        )

    return F.coalesce(F.array_join(F.transform(images, line), "\n"), F.lit(""))
