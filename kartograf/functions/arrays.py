"""Column functions over ``ARRAY<DOUBLE>`` signals.

Everything but the Fourier transforms stays inside the JVM: ``zip_with``/``transform``/``aggregate`` over the
taps of one row.  A missing antenna is a NULL array, and NULL flows through every function to a NULL result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kartograf.operators.blocks import lists, matrix


def doubles(values) -> Column:
    """Array literal of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Inside a lambda an outer expression would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda a: a * a)))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def scale(x: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(x, lambda a: a * f))


def divide(x: Column, divisor: Column) -> Column:
    """Elementwise division; a zero divisor gives NULL taps (the array code's NaN)."""
    return let(divisor, lambda f: F.transform(x, lambda a: F.try_divide(a, f)))


def magnitude(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b))


def power(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda a, b: a * a + b * b)


def replace_missing(x: Column, value: float = 0.0) -> Column:
    """NaN and NULL become ``value``; infinities become the largest finite double."""
    big = 1.7976931348623157e308
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(float(value)))
        .when(x == float("inf"), F.lit(big))
        .when(x == float("-inf"), F.lit(-big))
        .otherwise(x)
    )


# --- pairwise distances -------------------------------------------------------------------------


def cityblock(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def sqeuclidean(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(sqeuclidean(x, y))


def chebyshev(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def minkowski(x: Column, y: Column, p: float = 2.0) -> Column:
    return F.pow(total(F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(p)))), F.lit(1.0 / p))


def cosine(x: Column, y: Column) -> Column:
    return 1.0 - F.try_divide(dot(x, y), norm(x) * norm(y))


def centered(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda a: a - m))


def correlation(x: Column, y: Column) -> Column:
    return let(centered(x), lambda u: let(centered(y), lambda v: cosine(u, v)))


def canberra(x: Column, y: Column) -> Column:
    def term(a, b):
        return F.when((a == 0) & (b == 0), 0.0).otherwise(
            F.try_divide(F.abs(a - b), F.abs(a) + F.abs(b))
        )

    return total(F.zip_with(x, y, term))


def braycurtis(x: Column, y: Column) -> Column:
    return F.try_divide(cityblock(x, y), total(F.zip_with(x, y, lambda a, b: F.abs(a + b))))


def hamming(x: Column, y: Column) -> Column:
    return mean(F.zip_with(x, y, lambda a, b: F.when(a == b, 0.0).when(a != b, 1.0)))


def jensenshannon(x: Column, y: Column) -> Column:
    def relative_entropy(u, v):
        def term(a, b):
            return F.when(a == 0, 0.0).otherwise(a * F.ln(F.try_divide(a, (a + b) / 2.0)))

        return total(F.zip_with(u, v, term))

    def divergence(p, q):
        return F.sqrt(F.greatest((relative_entropy(p, q) + relative_entropy(q, p)) / 2.0, F.lit(0.0)))

    return let(divide(x, total(x)), lambda p: let(divide(y, total(y)), lambda q: divergence(p, q)))


METRICS = {
    "cityblock": cityblock,
    "euclidean": euclidean,
    "sqeuclidean": sqeuclidean,
    "cosine": cosine,
    "correlation": correlation,
    "chebyshev": chebyshev,
    "canberra": canberra,
    "braycurtis": braycurtis,
    "minkowski": minkowski,
    "hamming": hamming,
    "jensenshannon": jensenshannon,
}


# --- aggregation over antennas, skipping the missing ones -----------------------------------------


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def skipping_sum(values: Column) -> Column:
    return total(_present(values))


def skipping_mean(values: Column) -> Column:
    kept = _present(values)
    return F.try_divide(total(kept), F.size(kept).cast("double"))


def skipping_max(values: Column) -> Column:
    return F.array_max(values)


def skipping_median(values: Column) -> Column:
    kept = F.array_sort(_present(values))
    n = F.size(kept)
    low = F.get(kept, F.floor((n - 1) / 2).cast("int"))
    high = F.get(kept, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


ANTENNA_AGGREGATIONS = {
    "sum": skipping_sum,
    "mean": skipping_mean,
    "max": skipping_max,
    "median": skipping_median,
}


def antenna_distance(left: Column, right: Column, metric: str = "cityblock", aggregation: str = "sum",
                     single_antenna: bool = True, **params) -> Column:
    """Distance of two ``ARRAY<ARRAY<DOUBLE>>`` snapshots (antenna, tap)."""
    distance = METRICS[metric]
    if not single_antenna:
        return distance(F.flatten(left), F.flatten(right), **params)
    per_antenna = F.zip_with(left, right, lambda a, b: distance(a, b, **params))
    return ANTENNA_AGGREGATIONS[aggregation](per_antenna)


# --- signature -------------------------------------------------------------------------------------


def energy_share(p: Column) -> Column:
    """Power per tap as a share of the row's energy; an all-zero row is left as it is."""
    energy = total(F.transform(p, lambda v: F.coalesce(v, F.lit(0.0))))
    return let(F.when(energy == 0, 1.0).otherwise(energy), lambda e: F.transform(p, lambda v: v / e))


def signature_weights(taps: int) -> list[float]:
    """Weight of tap n for uniform tap times t=n/T: 1 + 2t^2 + 2s^2 + 2ts - 3(t+s), s=(n-1)/T."""
    out = []
    for n in range(1, taps + 1):
        t, s = n / taps, (n - 1) / taps
        out.append(1.0 + 2 * t * t + 2 * s * s + 2 * t * s - 3 * (t + s))
    return out


def signature(re: Column, im: Column, taps: int) -> Column:
    return dot(energy_share(power(re, im)), doubles(signature_weights(taps))) / 12.0


# --- discrete Fourier transform --------------------------------------------------------------------
# A transform of a whole Arrow batch at once; the plan holds no matrix, and the cost per row is that of an FFT.

_COMPLEX = "struct<re: array<double>, im: array<double>>"
_COMPLEX_ROWS = "struct<re: array<array<double>>, im: array<array<double>>>"


def _complex(re: pa.Array, im: pa.Array, taps: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two list arrays as a complex matrix, NaN where a value is missing, and the rows that are missing."""
    z = matrix(pa.chunked_array([re]), taps) + 1j * matrix(pa.chunked_array([im]), taps)
    return z, pc.or_(pc.is_null(re), pc.is_null(im)).to_numpy(zero_copy_only=False)


def _parts(z: np.ndarray, missing: np.ndarray) -> list[pa.Array]:
    return [lists(np.ascontiguousarray(part), missing) for part in (z.real, z.imag)]


def dft(re: Column, im: Column, taps: int, bins: int | None = None) -> Column:
    """Forward DFT as a struct (re, im); more ``bins`` pad with zeros, fewer truncate the input; a NULL tap makes all bins NULL."""

    @F.arrow_udf(_COMPLEX)
    def run(re: pa.Array, im: pa.Array) -> pa.Array:
        z, missing = _complex(re, im, taps)
        return pa.StructArray.from_arrays(_parts(np.fft.fft(z, n=bins or taps), missing), ["re", "im"])

    return run(re, im)


def dft_rows(re: Column, im: Column, taps: int, bins: int | None = None) -> Column:
    """``dft`` of every antenna of two (antenna, tap) columns; both hold the same antennas, a NULL one stays NULL."""

    @F.arrow_udf(_COMPLEX_ROWS)
    def run(re: pa.Array, im: pa.Array) -> pa.Array:
        z, missing = _complex(re.flatten(), im.flatten(), taps)
        sizes = pc.fill_null(pc.list_value_length(re), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        rows = [pa.ListArray.from_arrays(offsets, part, mask=re.is_null()) for part in _parts(np.fft.fft(z, n=bins or taps), missing)]
        return pa.StructArray.from_arrays(rows, ["re", "im"])

    return run(re, im)


def delay_taps(re: Column, im: Column, delay: Column, taps: int) -> Column:
    """Circular delay by a fractional number of taps, as a struct (re, im); NULL delay gives NULL."""

    @F.arrow_udf(_COMPLEX)
    def run(re: pa.Array, im: pa.Array, delay: pa.Array) -> pa.Array:
        z, missing = _complex(re, im, taps)
        by = pc.fill_null(delay, float("nan")).to_numpy(zero_copy_only=False)
        turn = np.exp(-2j * np.pi * by[:, None] * np.fft.fftfreq(taps)[None])
        moved = np.fft.ifft(np.fft.fft(z) * turn)
        missing = missing | delay.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays(_parts(moved, missing), ["re", "im"], mask=pa.array(missing))

    return run(re, im, delay.cast("double"))
