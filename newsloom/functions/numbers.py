"""Number and colour functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WHITE, INK = "#ffffff", "#101418"


def number(value: Column, path: str) -> Column:
    """A finite number at a VARIANT path, also if it is written as a string."""
    out = F.try_variant_get(value, path, "double")
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def text_at(value: Column, path: str) -> Column:
    """A non-empty string at a VARIANT path."""
    return F.nullif(F.try_variant_get(value, path, "string"), F.lit(""))


def whole_within(value: Column, least: int, most: int) -> Column:
    return F.when((value == F.floor(value)) & value.between(least, most), value.cast("int"))


def percent_label(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.concat(F.floor(100.0 * part / whole + 0.5).cast("string"), F.lit("%"))).otherwise(F.lit("-"))


def moneyline(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(value.cast("string"))


def weighted_dice(a: Column, b: Column, weights: Column | None = None) -> Column:
    """2 * weight of the shared tokens by the weight of both; weights: map of token to weight, 1 where absent."""
    of = (lambda t: F.coalesce(F.try_element_at(weights, t), F.lit(1.0))) if weights is not None else (lambda t: F.lit(1.0))
    weigh = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, t: acc + of(t))
    both = weigh(a) + weigh(b)
    return F.when(both > 0, 2 * weigh(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def channel(colour: Column, n: int) -> Column:
    """A channel of a hex colour, three or six digits with or without #, from 0 to 1; null if malformed."""
    digits = F.regexp_replace(F.lower(F.trim(colour)), "^#", "")
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.when(six.rlike("^[0-9a-f]{6}$"), F.conv(F.substring(six, 1 + 2 * n, 2), 16, 10).cast("int") / 255)


def luminance(colour: Column) -> Column:
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    return 0.2126 * linear(channel(colour, 0)) + 0.7152 * linear(channel(colour, 1)) + 0.0722 * linear(channel(colour, 2))


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def ink_on(ground: Column) -> Column:
    """White or ink, whichever stands out more; ink if the ground is malformed."""
    return F.when(contrast(F.lit(WHITE), ground) >= contrast(F.lit(INK), ground), F.lit(WHITE)).otherwise(F.lit(INK))


def team_colour(colour: Column) -> Column:
    return F.when(F.lower(F.trim(colour)).isin("", "ffffff", "#ffffff"), None).otherwise(colour)


# Fixed values of the published OKLab conversion.
TO_LMS = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
TO_LAB = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])


def _linear(rgb):
    return np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)


def _gamma(rgb):
    return np.where(rgb <= 0.0031308, rgb * 12.92, 1.055 * np.abs(rgb) ** (1 / 2.4) - 0.055)


def _to_rgb(lightness, chroma, hue):
    lab = np.stack([lightness, chroma * np.cos(hue), chroma * np.sin(hue)], -1)
    return (lab @ np.linalg.inv(TO_LAB).T) ** 3 @ np.linalg.inv(TO_LMS).T


def _in_gamut(lightness, chroma, hue):
    """Linear RGB of the colour with the most chroma up to the given that the screen has."""
    low, high = np.zeros_like(chroma), chroma.copy()
    fits = lambda c: ((x := _to_rgb(lightness, c, hue)) >= -1e-6).all(-1) & (x <= 1 + 1e-6).all(-1)
    for _ in range(20):
        mid = np.where(fits(high), high, (low + high) / 2)
        ok = fits(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid)
    return _to_rgb(lightness, low, hue).clip(0, 1)


def _luminance(linear):
    return linear @ np.array([0.2126, 0.7152, 0.0722])


def legible(colours: np.ndarray, ground: np.ndarray, ratio: float) -> np.ndarray:
    """Colours (rows of RGB, 0 to 1) moved in lightness, hue kept, just until they have the contrast with the ground."""
    base = _luminance(_linear(ground))
    lms = np.cbrt(_linear(colours) @ TO_LMS.T)
    lab = lms @ TO_LAB.T
    chroma, hue = np.hypot(lab[:, 1], lab[:, 2]), np.arctan2(lab[:, 2], lab[:, 1])
    enough = lambda rgb: (np.maximum(_luminance(rgb), base) + 0.05) / (np.minimum(_luminance(rgb), base) + 0.05) >= ratio
    near, far = lab[:, 0].copy(), np.full(len(lab), 1.0 if base < 0.18 else 0.0)
    painted = lambda l: np.round(_gamma(_in_gamut(l, chroma, hue)).clip(0, 1) * 255) / 255  # noqa: E731  (what is looked at has 8 bits a channel)
    for _ in range(24):
        mid = (near + far) / 2
        ok = enough(_linear(painted(mid)))
        near, far = np.where(ok, near, mid), np.where(ok, mid, far)
    return np.where(enough(_linear(colours))[:, None], colours, painted(far))


def visible_on(colour: Column, ground: str, ratio: float = 3.0) -> Column:
    """A colour's legible form on a ground; null if malformed."""
    parse = lambda s: np.array([int(s[i : i + 2], 16) / 255 for i in (1, 3, 5)])
    base = parse(ground)

    @pandas_udf(StringType())
    def solve(colours: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(colours), dtype=object)
        known = colours.dropna()
        if len(known):
            rgb = (legible(np.stack([parse(c) for c in known]), base, ratio).clip(0, 1) * 255).round().astype(int)
            out.loc[known.index] = ["#%02x%02x%02x" % tuple(x) for x in rgb]
        return out

    digits = F.regexp_replace(F.lower(F.trim(colour)), "^#", "")
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return solve(F.when(six.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), six)))
