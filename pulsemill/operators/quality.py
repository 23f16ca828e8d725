"""Scores and rules of signal quality, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the composite score, for the highest threshold passed.
RATIO = ((0.25, 0.40), (0.15, 0.25))
SNR = ((0.0, 0.20), (-5.0, 0.15), (-10.0, 0.05))
SHAPE = ((2.5, 8.0, 0.20), (1.5, 12.0, 0.10))
TEMPLATE = ((0.7, 0.20), (0.4, 0.10), (0.2, 0.05))
GOOD, MEDIOCRE = 0.65, 0.35


def _points(x: Column, steps, inclusive: bool = False) -> Column:
    out = F.lit(0.0)
    for bar, points in reversed(steps):
        out = F.when(x >= bar if inclusive else x > bar, points).otherwise(out)
    return out


def composite(ratio: Column, snr: Column, kurtosis: Column, template: Column) -> Column:
    """Sum of points for the QRS share, the signal-to-noise ratio, the kurtosis and the template quality."""
    energy = F.when(ratio >= 0.15, _points(ratio, RATIO, True)).when(ratio > 0.10, 0.10).otherwise(0.0)
    shape = F.lit(0.0)
    for lo, hi, points in reversed(SHAPE):
        shape = F.when((kurtosis > lo) & (kurtosis < hi), points).otherwise(shape)
    return energy + _points(snr, SNR) + shape + _points(template, TEMPLATE)


def label(score: Column) -> Column:
    """good, mediocre or poor. Sums of points are binary fractions: half a millionth keeps 0.65 at 0.65."""
    s = score + 5e-7
    return F.when(s >= GOOD, "good").when(s >= MEDIOCRE, "mediocre").otherwise("poor")


def from_kurtosis(k: Column) -> Column:
    """Quality where no template can be had: the more peaked the window, the worse."""
    return F.when(k > 8, 0.1).when(k > 5, 0.4).when(k > 3, 0.7).otherwise(0.9)


def stepped(k: Column) -> Column:
    return F.when(k > 8, 0.1).when(k > 5, 0.4).when(k > 3, 0.7).otherwise(1.0)


def linear(k: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - (k - 2) / 10))


def ecg_rules(share: Column, snr: Column, kurtosis: Column, crossings: Column) -> Column:
    on = lambda c, p: F.when(c, p).otherwise(0.0)
    return on(share > 0.3, 0.4) + on(snr > 0, 0.2) + on(kurtosis > 3, 0.2) + on((crossings > 0) & (crossings < 0.2), 0.2)


def ppg_rules(share: Column, skew: Column, entropy: Column, kurtosis: Column) -> Column:
    on = lambda c, p: F.when(c, p).otherwise(0.0)
    return on(share > 0.5, 0.4) + on(F.abs(skew) > 0.5, 0.2) + on(entropy < 4.0, 0.2) + on(kurtosis > 0, 0.2)
