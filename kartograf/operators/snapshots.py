"""Steps on snapshots: layout, masks, normalisation, alignment and augmentations.

Two layouts: *wide*, one row per snapshot with ``cir`` ARRAY<ARRAY<ARRAY<DOUBLE>>> (channel, antenna,
tap), and *antenna-long*, one row per (snapshot, antenna) with ``re``/``im`` tap arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartograf.functions import arrays
from kartograf.functions.scalars import pick


def antenna_long(df: DataFrame) -> DataFrame:
    """Wide snapshots to one row per antenna; optional columns are carried where present."""
    keep = [c for c in ("id", "take", "ts", "reference", "interp_diff") if c in df.columns]
    parts = [F.element_at("cir", 1).alias("re"), F.element_at("cir", 2).alias("im")]
    antenna = F.posexplode(F.arrays_zip(*parts)).alias("antenna", "_s")
    rest = [c for c in ("valid_mask", "toa") if c in df.columns]
    long = df.select(*keep, *rest, antenna)
    long = long.withColumn("re", F.col("_s.re")).withColumn("im", F.col("_s.im"))
    own = F.col("antenna")
    long = long.withColumn("valid", F.get("valid_mask", own) if "valid_mask" in rest else F.lit(True))
    long = long.withColumn("toa", F.get("toa", own) if "toa" in rest else F.lit(None).cast("double"))
    return long.select(*keep, "antenna", "valid", "toa", "re", "im")


def snapshots_wide(df: DataFrame, values=("re", "im")) -> DataFrame:
    """Antenna-long rows back to one row per snapshot (a group is one snapshot's antennas)."""
    shared = [c for c in ("take", "ts", "reference", "interp_diff") if c in df.columns]
    ordered = F.sort_array(F.collect_list(F.struct("antenna", "valid", "toa", *values)))
    grouped = df.groupBy("id").agg(*[F.first(c).alias(c) for c in shared], ordered.alias("_a"))

    def channel(name):
        return F.transform("_a", lambda a: a[name])

    channels = [channel(v) for v in values]
    return grouped.select(
        "id", *shared, F.array(*channels).alias("cir"),
        F.transform("_a", lambda a: a["valid"]).alias("valid_mask"), F.transform("_a", lambda a: a["toa"]).alias("toa"))


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column where the table has it, otherwise a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def keep_antennas(df: DataFrame, antennas) -> DataFrame:
    """Only the listed antennas, in their stored order."""
    return df.filter(F.col("antenna").isin(sorted(set(antennas))))


def reference_valid(interp_diff: Column) -> Column:
    """A reference is usable when its interpolation spans less than one second in total."""
    return arrays.total(interp_diff) < 1


def relative_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts) - df.agg(F.min(ts)).scalar())


def blank_invalid(value: Column, valid: Column) -> Column:
    return F.when(valid, value)


def zero_invalid(signal: Column, valid: Column) -> Column:
    return F.when(valid, signal).otherwise(F.transform(signal, lambda v: F.lit(0.0)))


def shape(cir: Column) -> list[Column]:
    return [F.size(cir).alias("channels"), F.size(cir[0]).alias("antennas"), F.size(cir[0][0]).alias("taps")]


def with_norm_factor(df: DataFrame, norm: str, norm_range: str) -> DataFrame:
    """Add ``factor``: unit (L2) or max magnitude over a row, a snapshot, an antenna or everything."""
    if norm not in ("unit", "max"):
        raise ValueError(f"Invalid norm {norm}!")
    if norm_range not in ("self", "set", "antenna", "full"):
        raise ValueError(f"Invalid norm_range {norm_range}!")
    mag = F.transform(arrays.magnitude(F.col("re"), F.col("im")), lambda v: arrays.replace_missing(v))
    if norm == "unit":
        if norm_range in ("antenna", "full"):
            raise NotImplementedError(f"unit norm over {norm_range} does not make sense")
        energy = F.coalesce(arrays.dot(mag, mag), F.lit(0.0))
        if norm_range == "set":
            energy = F.sum(energy).over(W.partitionBy("id"))
        return df.withColumn("factor", F.sqrt(energy))
    top = F.coalesce(F.array_max(mag), F.lit(0.0))
    if norm_range == "self":
        return df.withColumn("factor", top)
    if norm_range == "set":
        return df.withColumn("factor", F.max(top).over(W.partitionBy("id")))
    # one number per antenna, or one in all: aggregated with map-side combine and sent back small
    if norm_range == "full":
        return df.withColumn("factor", df.agg(F.max(top)).scalar())
    peaks = df.groupBy("antenna").agg(F.max(top).alias("factor"))
    return df.join(F.broadcast(peaks), "antenna")  # one row per antenna


def normalize(df: DataFrame, norm: str, norm_range: str = "self") -> DataFrame:
    df = with_norm_factor(df, norm, norm_range)
    for c in ("re", "im"):
        df = df.withColumn(c, arrays.divide(F.col(c), F.col("factor")))
    return df.drop("factor")


def align_to_toa(df: DataFrame, tap_seconds: float, taps: int) -> DataFrame:
    """Circularly delay each antenna's signal by its time of arrival; no time, no signal."""
    df = df.withColumn("_moved", arrays.delay_taps(F.col("re"), F.col("im"), F.col("toa") / tap_seconds, taps))
    return df.withColumn("re", F.col("_moved.re")).withColumn("im", F.col("_moved.im")).drop("_moved")


def iq_to_abs(df: DataFrame, keep_iq: bool = False) -> DataFrame:
    """Magnitude of every ``inputs*`` column (channel, antenna, tap), alone or as an extra channel."""
    for c in [c for c in df.columns if c.startswith("inputs")]:
        mag = F.zip_with(F.col(c)[0], F.col(c)[1], arrays.magnitude)
        df = df.withColumn(c, F.concat(F.col(c), F.array(mag)) if keep_iq else F.array(mag))
    return df


def time_to_frequency(df: DataFrame, taps: int, n_fft: int | None = None, normalize: bool = True) -> DataFrame:
    """Channel frequency response of every ``inputs*`` column."""
    bins = n_fft or taps
    factor = F.lit(1.0 / bins ** 0.5 if normalize else 1.0)
    for c in [c for c in df.columns if c.startswith("inputs")]:
        df = df.withColumn("_cfr", arrays.dft_rows(F.col(c)[0], F.col(c)[1], taps, bins))
        part = lambda name: F.transform(F.col("_cfr")[name], lambda z: F.transform(z, lambda v: v * factor))
        df = df.withColumn(c, F.array(part("re"), part("im"))).drop("_cfr")
    return df


def drop_antennas_to(df: DataFrame, k: int, seed: int, mask_name: str | None = None, key: str = "id") -> DataFrame:
    """Randomly invalidate antennas of every ``inputs*`` column so that at least k stay valid.

    ``valid - k`` antennas are drawn with replacement, so more than k may stay valid.  A column
    without a mask of its own counts as all valid.
    """
    for number, c in enumerate(c for c in df.columns if c.startswith("inputs")):
        suffix = c[len("inputs"):]
        own = f"valid_mask{suffix}"
        mask = F.col(own) if own in df.columns else F.transform(F.col(c)[0], lambda a: F.lit(True))
        df = df.withColumn("_mask", mask)
        places = F.filter(F.transform("_mask", lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
        df = df.withColumn("_places", places)
        n = F.size("_places")
        draws = F.transform(F.sequence(F.lit(0), n - k - 1), lambda m: F.get(
            F.col("_places"), pick(F.col(key) * 64 + m, seed + number, n).cast("int")))
        thinned = F.transform("_mask", lambda v, i: v & ~F.array_contains(F.col("_draws"), i))
        df = df.withColumn("_draws", F.when(n > k, draws)).withColumn(
            f"{mask_name}{suffix}" if mask_name else own,
            F.when(F.col("_draws").isNotNull(), thinned).otherwise(F.col("_mask"))).drop("_mask", "_places", "_draws")
    return df
