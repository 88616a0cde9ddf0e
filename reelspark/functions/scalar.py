"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy

ABSENT = ("", "N/A")


def number(text: Column, default: float = 0.0) -> Column:
    """The number in a text field, or the default where it is null, empty or N/A."""
    return F.coalesce(F.when(~text.isin(*ABSENT), text).try_cast("double"), F.lit(float(default)))


def parse_fraction(text: Column) -> Column:
    """num/den, or a plain number; 0 where absent or where the denominator is 0."""
    num, den = F.substring_index(text, "/", 1), F.when(text.contains("/"), F.substring_index(text, "/", -1)).otherwise("")
    n, d = num.try_cast("double"), F.when(den != "", den).try_cast("double")
    return F.when(text.isNull() | text.isin(*ABSENT) | num.isin(*ABSENT), 0.0).when(den == "", n).when(d == 0, 0.0).otherwise(F.try_divide(n, d))


def elementary_fps(rate: Column, container: Column, codec: Column) -> Column:
    """The rate that a raw stream states itself; 0 for others and for implausible rates."""
    ticks = F.lit(None).cast("double")
    for name, n in policy.TICKS.items():
        ticks = F.when((container == name) & (codec == name), n).otherwise(ticks)
    fps = F.coalesce(parse_fraction(rate) / ticks, F.lit(0.0))
    return F.when((fps > 0) & (fps <= policy.MOST_FPS), fps).otherwise(0.0)


def timing_source(source: Column, container: Column) -> Column:
    """absent, then synthesized by container, then presentation or decode."""
    invented = container.isin(*policy.INVENTED_TIMING_CONTAINERS)
    return F.when(source == "none", "absent").when(invented, "synthesized").when(source == "pts", "presentation").otherwise("decode")


def supplied(source: Column) -> Column:
    return source.isin(*policy.SUPPLIED)


def rotation(value: Column) -> Column:
    """Degrees rounded half to even, from 0 to 359."""
    return F.pmod(F.bround(value).cast("int"), F.lit(360))


def square_pixels(ratio: Column) -> Column:
    return F.coalesce(ratio, F.lit("")).isin("", "N/A", "0:1", "1:1")


def progressive(order: Column) -> Column:
    return F.coalesce(order, F.lit("")).isin("", "N/A", "progressive")


def displayed(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    turned = F.pmod(degrees, F.lit(180)) == 90
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def thumbnail(width: Column, height: Column, longest: int = 320) -> tuple[Column, Column]:
    """Dimensions with the long side at most ``longest``; rounded half to even, at least 1."""
    side = F.greatest(width, height)
    scale = F.lit(longest).cast("double") / side
    fit = lambda x: F.when(side <= longest, x.cast("int")).otherwise(F.greatest(F.lit(1), F.bround(x * scale).cast("int")))
    return fit(width), fit(height)


def timing_tolerance(value: Column, duration: Column) -> Column:
    """Null where the duration isn't above 0."""
    return F.when(duration > 0, F.lit(4.0) * value * F.lit(0.001) / duration)


def truncated(measured: Column, declared: Column, ratio: float) -> Column:
    return F.when(declared > 0, measured / declared < ratio).otherwise(F.lit(False))


def reading(text: Column) -> Column:
    """A progress reading: one trailing x goes; what is absent or no number is null."""
    t = F.regexp_replace(F.trim(text), "x$", "")
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def clock(text: Column) -> Column:
    """Seconds of HH:MM:SS.ffffff; null unless it has three parts that are numbers."""
    p = F.split(F.trim(text), ":")
    whole = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, whole(0) * 3600 + whole(1) * 60 + F.get(p, F.lit(2)).try_cast("double"))


def av1_crf(crf: Column) -> Column:
    return F.least(F.lit(policy.MOST_CRF), F.greatest(F.lit(0), crf + policy.CRF_OFFSET))


def av1_preset(name: Column) -> Column:
    """Null for a name that isn't one of x264's."""
    out = F.lit(None).cast("int")
    for k, v in policy.X264_PRESETS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def quality(crf: Column, preset: Column, own_crf: Column, own_preset: Column) -> tuple[Column, Column, Column]:
    """(rate, preset, error) on AV1's scale, of x264's rate and preset name (null: not given) and AV1's own.

    x264's values are carried over; both kinds of the same value are an error, and so is an unknown name.
    """
    both = F.when(crf.isNotNull() & (own_crf != policy.DEFAULT_CRF), "both scales").when(preset.isNotNull() & (own_preset != policy.DEFAULT_PRESET), "both scales")
    error = F.coalesce(both, F.when(preset.isNotNull() & av1_preset(preset).isNull(), "unknown preset"))
    fine = error.isNull()
    return F.when(fine, F.coalesce(av1_crf(crf), own_crf)), F.when(fine, F.coalesce(av1_preset(preset), own_preset)), error


def stream_offset(seconds: Column, time_base: Column) -> Column:
    """Ticks, rounded half to even."""
    return F.bround(F.try_divide(seconds, time_base)).cast("long")


def suffix(path: Column) -> Column:
    """The last suffix of the file's name, in lower case; a leading dot starts none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def joined(reasons: Column) -> Column:
    return F.array_join(F.array_sort(reasons), ",")
