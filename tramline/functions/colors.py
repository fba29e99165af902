"""Colour texts, luminance and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLACK, WHITE = 0xFF000000, 0xFFFFFFFF


def to_color(text: Column) -> Column:
    """An opaque ARGB number of six hex digits, 0 for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{6}$"), F.conv(text, 16, 10).cast("long") + F.lit(BLACK)).otherwise(F.lit(0).cast("long"))


def to_text(color: Column) -> Column:
    """Six hex digits, null for 0."""
    return F.when(color != 0, F.lpad(F.hex(color.bitwiseAND(0xFFFFFF)), 6, "0"))


def luminance(color: Column) -> Column:
    def channel(shift: int) -> Column:
        c = F.shiftright(color, shift).bitwiseAND(0xFF) / F.lit(255.0)
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))

    return 0.2126 * channel(16) + 0.7152 * channel(8) + 0.0722 * channel(0)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def better(color: Column) -> Column:
    """Black or white, whichever contrasts more; white for equal ones."""
    black, white = F.lit(BLACK), F.lit(WHITE)
    return F.when(contrast(color, black) > contrast(color, white), black).otherwise(white)


def corrected(color: Column, text: Column) -> tuple[Column, Column]:
    """Colour and text colour: a missing one, or a text with a contrast below 2, becomes black or white."""
    fixed = F.when((color != 0) & (text != 0) & (contrast(color, text) < 2.0), better(color)).otherwise(text)
    new_color = F.when((color == 0) & (text != 0), better(text)).otherwise(color)
    return new_color, F.when((color != 0) & (text == 0), better(color)).otherwise(fixed)
