"""Column expressions over pixel events. Integer results are LONG, ratios DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# In-band codes of the decimation exponent d, and the largest one that is a power of two.
D_MAX = 127
D_ZERO = 128
D_NO_EVENT = 253
D_EMPTY = 255
EOF_ADDRESS = 65535
# Weights of blue, green and red in a gray value.
GRAY = (0.114, 0.587, 0.299)
# Fixed values: (camera, is framed, source type).
CAMERAS = [
    ("FramedU8", True, "U8"),
    ("FramedU16", True, "U16"),
    ("FramedU32", True, "U32"),
    ("FramedU64", True, "U64"),
    ("FramedF32", True, "F32"),
    ("FramedF64", True, "F64"),
    ("Dvs", False, "U8"),
    ("DavisU8", False, "U8"),
    ("Atis", False, "U8"),
    ("Asint", False, "F64"),
]
# Quality level, baseline and greatest threshold, growth velocity, divisor of the feature radius (0: none).
QUALITY_LEVELS = [
    (0, 0, 0, 10, 0),
    (1, 0, 1, 9, 12),
    (2, 1, 3, 8, 14),
    (3, 2, 7, 7, 15),
    (4, 5, 9, 6, 18),
    (5, 6, 10, 5, 20),
    (6, 7, 13, 4, 25),
    (7, 8, 16, 3, 30),
    (8, 10, 20, 2, 30),
    (9, 15, 25, 1, 30),
]
LARGEST = {"U8": 255.0, "U16": 65535.0, "U32": 4294967295.0, "U64": 18446744073709551615.0}


def long(value: Column) -> Column:
    return value.cast("long")


def magnitude(d: Column) -> Column:
    """2^d, and 0 for the codes above D_MAX."""
    return F.when(d <= D_MAX, F.pow(F.lit(2.0), d)).otherwise(F.lit(0.0))


def intensity(d: Column, dt: Column) -> Column:
    """Light per tick of an event that took dt ticks; dt 0 counts as 1."""
    return magnitude(d) / F.greatest(dt, F.lit(1))


def decimation(value: Column) -> Column:
    """Exponent of the largest power of two within an intensity; D_ZERO below 1."""
    return long(F.when(value < 1, F.lit(D_ZERO)).otherwise(F.least(F.floor(F.log2(F.floor(F.greatest(value, F.lit(1.0))))), F.lit(D_MAX))))


def log_intensity(d: Column, dt: Column, ref: int) -> Column:
    return F.log1p(intensity(d, dt) * ref / 255.0)


def saturate(value: Column, most: float) -> Column:
    """Truncated towards zero and held within 0 and most; a double, as 64-bit targets exceed LONG."""
    whole = F.when(value < 0, F.ceil(F.greatest(value, F.lit(-9e18)))).otherwise(F.least(value, F.lit(most)))
    cut = F.when(F.abs(whole) < 9e15, F.floor(F.greatest(whole, F.lit(0.0))).cast("double")).otherwise(whole.cast("double"))
    return F.greatest(F.least(cut, F.lit(most)), F.lit(0.0))


def frame_value(d: Column, dt: Column, ref: int, source: str = "U8", target: str = "U8") -> Column:
    """Value of an event in a frame of type target, scaled from the range of source."""
    light = intensity(d, dt)
    scaled = light * ref if source == target else light / LARGEST[source] * ref * LARGEST[target]
    return saturate(scaled, LARGEST[target])


def practical_d_max(dtm: int, ref: int) -> float:
    from math import log2

    return log2(255 * (dtm // ref))


def clamp(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(255.0)), F.lit(0.0))


def mid_clamp(value: Column) -> Column:
    """Values out of range become the middle."""
    return F.when((value < 0) | (value > 255), F.lit(128.0)).otherwise(value)


def gray(blue: Column, green: Column, red: Column) -> Column:
    return long(F.floor(sum((w * c for w, c in zip(GRAY, (blue, green, red))), F.lit(0.0))))


def round_up(value: Column, step: int) -> Column:
    """The next multiple of step, for ticks that are not negative."""
    return long(F.floor((value + (step - 1)) / step)) * step


def whole(value: Column, step: int | Column) -> Column:
    """Integer quotient of ticks that are not negative."""
    return long(F.floor(value / step))


def ring_run(bits: list[Column], need: int = 9) -> Column:
    """Whether ``need`` neighbouring conditions on a ring hold.

    The conditions become a string of marks, written twice and searched for a run: each is evaluated
    once, where shifts of a bit mask would repeat it in every term.
    """
    marks = F.concat(*(F.when(b, F.lit("1")).otherwise(F.lit("0")) for b in bits))
    return F.repeat(marks, 2).contains("1" * need)
