"""Wave spectra to swell components.

A spectrum is one row with an array of bins, so the whole decomposition is a
chain of array expressions on that row: no shuffle, no Python, and no group
that could grow with the data. Long (one row per bin) forms are provided for
the steps that are useful on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import circular as C
from ..functions import units as U
from ..functions.arrays import let

# Band limit, peak floor, merge thresholds and output floors.
SWELL_CUTOFF_HZ = 1.0 / 6.0
EDGE_HZ = 0.015
NOISE_FLOOR = 0.005
MERGE_DIR_DEG = 35.0
MERGE_VALLEY = 0.70
MIN_HEIGHT_FT = 0.2
MIN_PERIOD_S = 6.0

BIN = "struct<freq:double,energy:double,dir:double>"


def join_direction(energy: DataFrame, direction: DataFrame, keys: list[str]) -> DataFrame:
    """Long energy bins with the direction of the same frequency, null if absent or a fill."""
    d = direction.select(*keys, "freq", F.when(~F.col("dir").isin(*U.DIRECTION_FILLS), F.col("dir")).alias("dir"))
    return energy.join(d, [*keys, "freq"], "left")


def both_present(energy: DataFrame, direction: DataFrame, keys: list[str]) -> DataFrame:
    """Energy rows whose spectrum also has a direction file."""
    return energy.join(direction.select(*keys).distinct(), keys, "left_semi")


def to_arrays(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Long bins to one row per spectrum; a spectrum has a fixed set of frequencies."""
    return bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("freq", "energy", "dir"))).alias("bins"))


def to_bins(spectra: DataFrame, keys: list[str], bins: str = "bins") -> DataFrame:
    return (spectra.select(*keys, F.posexplode(bins).alias("bin", "_b"))
            .select(*keys, "bin", "_b.freq", "_b.energy", "_b.dir"))


def with_widths(bins: Column) -> Column:
    """Bins with their width: centred difference, one-sided at both ends."""
    n = F.size(bins)

    def f(i: Column) -> Column:
        return F.get(bins, i)["freq"]

    def width(i: Column) -> Column:
        return (F.when(i == 0, f(F.lit(1)) - f(F.lit(0)))
                .when(i == n - 1, f(n - 1) - f(n - 2))
                .otherwise((f(i + 1) - f(i - 1)) / 2.0))

    return F.transform(bins, lambda b, i: F.struct(
        i.alias("i"), b["freq"].alias("freq"), b["energy"].alias("energy"), b["dir"].alias("dir"),
        width(i).alias("bw")))


def raw_peaks(ext: Column) -> Column:
    """Strict local maxima above the floor; the first and last bin cannot be peaks."""
    def is_peak(b: Column, i: Column) -> Column:
        e = b["energy"]
        return ((i > 0) & (i < F.size(ext) - 1) & (e > F.get(ext, i - 1)["energy"])
                & (e > F.get(ext, i + 1)["energy"]) & (e > NOISE_FLOOR))

    return F.filter(ext, is_peak)


def _first_min(energies: Column, lo: Column, hi: Column) -> Column:
    """Index of the first smallest energy between two bins, both included."""
    part = F.slice(energies, lo + 1, hi - lo + 1)
    return lo + F.array_position(part, F.array_min(part)).cast("int") - 1


def merge_peaks(peaks: Column, energies: Column) -> Column:
    """Fold neighbouring peaks into one when they look like one swell train.

    Each peak is compared with the last kept one: directions within 35 degrees
    and a valley at least 0.70 of the smaller peak. The higher peak stays.
    """
    def step(kept: Column, pk: Column) -> Column:
        prev = F.element_at(kept, -1)
        valley = F.array_min(F.slice(energies, prev["i"] + 1, pk["i"] - prev["i"] + 1))
        small = F.least(prev["energy"], pk["energy"])
        ratio = F.when(small > 0, valley / small).otherwise(F.lit(0.0))
        close = F.coalesce(C.abs_diff_deg(prev["dir"], pk["dir"]) < MERGE_DIR_DEG, F.lit(False))
        winner = F.when(pk["energy"] > prev["energy"], pk).otherwise(prev)
        return (F.when(F.size(kept) == 0, F.array(pk))
                .when(close & (ratio >= MERGE_VALLEY),
                      F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(winner)))
                .otherwise(F.concat(kept, F.array(pk))))

    return F.aggregate(peaks, F.slice(peaks, 1, 0), step)


def _moments(part: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, b: Column) -> Column:
        w = b["energy"] * b["bw"]
        return F.struct((acc["e"] + w).alias("e"), (acc["t"] + w / b["freq"]).alias("t"),
                        (acc["s"] + F.coalesce(w * C.sin_deg(b["dir"]), F.lit(0.0))).alias("s"),
                        (acc["c"] + F.coalesce(w * C.cos_deg(b["dir"]), F.lit(0.0))).alias("c"))

    return F.aggregate(part, zero, add)


def _bounds(swell: Column, energies: Column, merged: Column) -> Column:
    """Bin range of each kept peak: from past the valley before to the valley after, in the swell band."""
    def one(pk: Column, r: Column) -> Column:
        prev, nxt = F.get(merged, r - 1)["i"], F.get(merged, r + 1)["i"]
        lo = F.when(r > 0, _first_min(energies, prev, pk["i"]) + 1).otherwise(F.lit(0))
        hi = F.when(nxt.isNotNull(), _first_min(energies, pk["i"], nxt)).otherwise(F.size(swell) - 1)
        return F.struct(pk.alias("pk"), lo.alias("lo"), F.least(hi, F.size(swell) - 1).alias("hi"))

    return F.filter(F.transform(merged, one),
                    lambda x: (x["pk"]["freq"] <= SWELL_CUTOFF_HZ) & (x["hi"] >= x["lo"]))


def analyse(bins: Column) -> Column:
    """struct(bins, peaks, merged, parts) of one spectrum, each step evaluated once.

    ``parts`` holds per kept swell-band peak its bin range and moments.
    """
    def bands(b: Column) -> Column:
        return F.struct(
            b.alias("bins"), F.filter(b, lambda x: x["freq"] <= SWELL_CUTOFF_HZ + EDGE_HZ).alias("ext"),
            F.filter(b, lambda x: x["freq"] <= SWELL_CUTOFF_HZ).alias("swell"),
            F.transform(b, lambda x: x["energy"]).alias("energies"))

    def parts(s: Column, merged: Column) -> Column:
        return F.transform(_bounds(s["swell"], s["energies"], merged), lambda x: F.struct(
            x["pk"]["i"].alias("peak"), x["lo"].alias("lo"), x["hi"].alias("hi"),
            _moments(F.slice(s["swell"], x["lo"] + 1, x["hi"] - x["lo"] + 1)).alias("m")))

    def from_bands(s: Column) -> Column:
        return let(raw_peaks(s["ext"]), lambda pk: let(
            merge_peaks(pk, s["energies"]), lambda mg: F.struct(
                s["bins"].alias("bins"), pk.alias("peaks"), mg.alias("merged"), parts(s, mg).alias("parts"))))

    return let(F.array_sort(bins), lambda raw: let(with_widths(raw), lambda b: let(bands(b), from_bands)))


def with_peaks(spectra: DataFrame, keys: list[str], bins: str = "bins") -> DataFrame:
    """Per spectrum: widened bins, raw peaks, merged peaks and partitions."""
    return spectra.select(*keys, analyse(F.col(bins)).alias("_x")).select(*keys, "_x.*")


def decompose(spectra: DataFrame, keys: list[str], bins: str = "bins") -> DataFrame:
    """Spectra to their two most energetic swell components.

    Adds ``components``: array of (height_ft, period_s, direction_deg, energy,
    type), empty where nothing clears the height and period floors.
    """
    from .waves import top_components

    shaped = lambda parts: F.transform(parts, lambda x, i: F.struct(
        U.m_to_ft(F.lit(4.0) * F.sqrt(x["m"]["e"])).alias("height_ft"), (x["m"]["t"] / x["m"]["e"]).alias("tm"),
        C.from_sincos(x["m"]["s"], x["m"]["c"]).alias("dir"), i.alias("_i")))
    strong = lambda parts: F.filter(parts, lambda x: x["m"]["e"] > 0)
    kept = F.filter(shaped(strong(analyse(F.col(bins))["parts"])),
                    lambda x: (x["height_ft"] >= MIN_HEIGHT_FT) & (x["tm"] >= MIN_PERIOD_S))
    comps = F.transform(kept, lambda x: F.struct(
        x["height_ft"].alias("height_ft"), F.round(x["tm"], 1).alias("period_s"),
        F.rint(x["dir"]).alias("direction_deg"), U.observed_energy(x["height_ft"], x["tm"]).alias("energy"),
        F.lit("swell").alias("type"), x["_i"].alias("_i")))
    return spectra.select(*keys, top_components(comps).alias("components"))


def moments_by(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of any grouping of long bins that carry a width ``bw``."""
    w = F.col("energy") * F.col("bw")
    return bins.groupBy(*keys).agg(
        F.sum(w).alias("m0"), (F.lit(4.0) * F.sqrt(F.sum(w))).alias("hm0_m"),
        (F.sum(w / F.col("freq")) / F.sum(w)).alias("tm_s"),
        C.weighted_mean_deg(w, F.col("dir")).alias("dir_deg"))


def display_spectrum(spectra: DataFrame, keys: list[str], bins: str = "bins") -> DataFrame:
    """Rounded [freq, energy, dir or null] triples for charts."""
    return spectra.select(*keys, F.transform(F.array_sort(F.col(bins)), lambda b: F.struct(
        F.round(b["freq"], 5).alias("freq"), F.round(b["energy"], 6).alias("energy"),
        F.round(b["dir"], 1).alias("dir"))).alias("spectrum"))


def components_to_obs(decomposed: DataFrame, station: str, ts: str, source: str, ingest: Column) -> DataFrame:
    """Component k of a spectrum becomes an observation with partition k."""
    d = decomposed.select(F.col(station).alias("station"), F.col(ts).alias("valid_utc"),
                          F.posexplode("components").alias("pos", "c"))
    return d.select("station", "valid_utc", (F.col("pos") + 1).cast("int").alias("partition"),
                    U.ft_to_m(F.col("c.height_ft")).alias("hs_m"), F.col("c.period_s").alias("tp_s"),
                    F.col("c.direction_deg").alias("dp_deg"), F.lit(source).alias("source"),
                    ingest.alias("ingest_utc"))
