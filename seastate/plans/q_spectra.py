"""Spectrum queries, from bins to components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import let
from ..operators import spectra as S
from .ctes import cdiff, cosd, iso, m2ft, m360, r6, rint, sc2deg, sind
from .registry import query

KEYS = ["station", "ts"]
K = f"station, {iso('ts')} AS ts"

# Peaks of each spectrum: strict maxima with two neighbours inside the extended band.
_EXT = "ext AS (SELECT *, lag(energy) OVER w AS pe, lead(energy) OVER w AS ne FROM spw WHERE freq <= 1.0::DOUBLE / 6 + 0.015 WINDOW w AS (PARTITION BY vec_id ORDER BY i))"
_PK = f"{_EXT}, pk AS (SELECT * FROM ext WHERE energy > pe AND energy > ne AND energy > 0.005)"


@query("w16_bin_widths", f"SELECT {K}, i::INTEGER AS bin, {r6('freq')} AS freq, {r6('bw')} AS bw FROM spw")
def _(v):
    d = v.spectra.select(*KEYS, let(F.col("bins"), S.with_widths).alias("b"))
    return d.select(*KEYS, F.explode("b").alias("b")).select(*KEYS, F.col("b.i").alias("bin"), "b.freq", "b.bw")


@query("w04_raw_peaks", f"WITH {_PK} SELECT {K}, i::INTEGER AS bin, {r6('freq')} AS freq, {r6('energy')} AS energy FROM pk")
def _(v):
    d = S.with_peaks(v.spectra, KEYS).select(*KEYS, F.explode("peaks").alias("p"))
    return d.select(*KEYS, F.col("p.i").alias("bin"), "p.freq", "p.energy")


# The fold over peaks as a recursion: one step per peak, carrying the last kept peak and how many are kept.
_FOLD = f"""RECURSIVE {_PK},
 pn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS r FROM pk),
 ar AS (SELECT vec_id, list(energy ORDER BY i) AS es FROM spw GROUP BY 1),
 fold AS (SELECT vec_id, r, i AS ki, energy AS ke, dir AS kd, 1 AS slot FROM pn WHERE r = 1
  UNION ALL SELECT vec_id, r, CASE WHEN merge AND pe2 <= ke THEN ki ELSE pi END, CASE WHEN merge AND pe2 <= ke THEN ke ELSE pe2 END,
   CASE WHEN merge AND pe2 <= ke THEN kd ELSE pd END, CASE WHEN merge THEN slot ELSE slot + 1 END FROM (
   SELECT f.vec_id, n.r, f.ki, f.ke, f.kd, f.slot, n.i AS pi, n.energy AS pe2, n.dir AS pd,
    coalesce(abs({cdiff('f.kd', 'n.dir')}) < 35, FALSE) AND list_min(a.es[f.ki + 1:n.i + 1]) / least(f.ke, n.energy) >= 0.70 AS merge
   FROM fold f JOIN pn n ON n.vec_id = f.vec_id AND n.r = f.r + 1 JOIN ar a ON a.vec_id = f.vec_id)),
 kept AS (SELECT vec_id, slot, arg_max(ki, r) AS ki, arg_max(ke, r) AS ke FROM fold GROUP BY 1, 2)"""


@query("w08_merged_peaks", f"WITH {_FOLD} SELECT {K}, ki::INTEGER AS bin, {r6('ke')} AS energy FROM kept JOIN (SELECT DISTINCT vec_id, station, ts FROM spb) USING (vec_id)")
def _(v):
    d = S.with_peaks(v.spectra, KEYS).select(*KEYS, F.explode("merged").alias("p"))
    return d.select(*KEYS, F.col("p.i").alias("bin"), "p.energy")


# Partition bounds: one past the valley before, up to the valley after, inside the swell band.
_RANGE = f"""{_FOLD},
 sw AS (SELECT vec_id, max(i) AS imax FROM spw WHERE freq <= 1.0::DOUBLE / 6 GROUP BY 1),
 nb AS (SELECT k.*, lag(ki) OVER w AS pki, lead(ki) OVER w AS nki FROM kept k WINDOW w AS (PARTITION BY vec_id ORDER BY slot)),
 rg AS (SELECT nb.vec_id, nb.slot, ki, CASE WHEN pki IS NULL THEN 0 ELSE pki + list_position(a.es[pki + 1:ki + 1], list_min(a.es[pki + 1:ki + 1])) END AS lo,
  least(imax, CASE WHEN nki IS NULL THEN imax ELSE ki + list_position(a.es[ki + 1:nki + 1], list_min(a.es[ki + 1:nki + 1])) - 1 END) AS hi
  FROM nb JOIN ar a USING (vec_id) JOIN sw USING (vec_id) WHERE ki <= imax)"""


@query("w09_partition_bins", f"WITH {_RANGE} SELECT {K}, ki::INTEGER AS peak, lo::INTEGER AS lo, hi::INTEGER AS hi FROM rg JOIN (SELECT DISTINCT vec_id, station, ts FROM spb) USING (vec_id) WHERE hi >= lo")
def _(v):
    d = S.with_peaks(v.spectra, KEYS).select(*KEYS, F.explode("parts").alias("p"))
    return d.select(*KEYS, "p.peak", "p.lo", "p.hi")


_MOM = f"""{_RANGE}, mo AS (SELECT rg.vec_id, rg.slot, b.station, b.ts, sum(energy * bw) AS e, sum(energy * bw / freq) AS t, coalesce(sum(energy * bw * {sind('dir')}), 0.0) AS s,
 coalesce(sum(energy * bw * {cosd('dir')}), 0.0) AS c FROM rg JOIN spw b ON b.vec_id = rg.vec_id AND b.i BETWEEN rg.lo AND rg.hi GROUP BY 1, 2, 3, 4),
 cp AS (SELECT *, {m2ft('4.0 * sqrt(e)')} AS h, t / e AS tm, {sc2deg('s', 'c')} AS d FROM mo WHERE e > 0),
 tp AS (SELECT *, round(h * tm * tm, 1) AS en, row_number() OVER (PARTITION BY vec_id ORDER BY round(h * tm * tm, 1) DESC, slot) AS rn FROM cp WHERE h >= 0.2 AND tm >= 6.0)"""


@query("a13_partition_moments", f"WITH {_MOM} SELECT {K}, {r6('e')} AS m0, {r6('4.0 * sqrt(e)')} AS hm0_m, {r6('tm')} AS tm_s, {r6('d')} AS dir_deg FROM cp")
def _(v):
    from ..functions import circular as C
    d = S.with_peaks(v.spectra, KEYS).select(*KEYS, F.explode("parts.m").alias("m")).filter(F.col("m.e") > 0)
    return d.select(*KEYS, F.col("m.e").alias("m0"), (F.lit(4.0) * F.sqrt("m.e")).alias("hm0_m"), (F.col("m.t") / F.col("m.e")).alias("tm_s"),
                    C.from_sincos(F.col("m.s"), F.col("m.c")).alias("dir_deg"))


@query("a13_band_moments", f"""
SELECT station, CAST(floor(freq / 0.05) AS INTEGER) AS band, {r6('sum(energy * bw)')} AS m0, {r6('4.0 * sqrt(sum(energy * bw))')} AS hm0_m,
 {r6('sum(energy * bw / freq) / sum(energy * bw)')} AS tm_s, {r6(sc2deg(f'sum(energy * bw * {sind("dir")})', f'sum(energy * bw * {cosd("dir")})'))} AS dir_deg FROM spw GROUP BY 1, 2""")
def _(v):
    d = v.spectra.select(*KEYS, F.explode(let(F.col("bins"), S.with_widths)).alias("b")).select(*KEYS, "b.*")
    return S.moments_by(d.withColumn("band", F.floor(F.col("freq") / 0.05).cast("int")), ["station", "band"])


@query("x02_decompose", f"""WITH {_MOM}
SELECT {K}, rn::INTEGER AS rank, {r6('h')} AS height_ft, {r6('round(tm, 1)')} AS period_s, {r6(rint('d'))} AS direction_deg, {r6('en')} AS energy FROM tp WHERE rn <= 2""")
def _(v):
    d = S.decompose(v.spectra, KEYS).select(*KEYS, F.posexplode("components").alias("pos", "c"))
    return d.select(*KEYS, (F.col("pos") + 1).alias("rank"), "c.height_ft", "c.period_s", "c.direction_deg", "c.energy")


@query("a22_largest_component", f"""WITH {_MOM}
SELECT station, {r6('max(en)')} AS energy, {iso('arg_max(ts, (en, epoch(ts)))')} AS at FROM tp WHERE rn <= 2 GROUP BY station""")
def _(v):
    """The single strongest component of each station and when it was seen."""
    d = S.decompose(v.spectra, KEYS).select(*KEYS, F.explode("components").alias("c"))
    return d.groupBy("station").agg(F.max("c.energy").alias("energy"), F.max_by("ts", F.struct("c.energy", "ts")).alias("at"))


@query("j05_join_direction", f"""
SELECT {K}, {r6('freq')} AS freq, {r6('energy')} AS energy, dir FROM spb""")
def _(v):
    """Energy and direction bins as two long tables, matched on frequency."""
    b = S.to_bins(v.spectra, KEYS)
    e = b.select(*KEYS, "freq", "energy")
    d = b.filter(F.col("bin") % 2 == 0).unionByName(b.filter(F.col("bin") % 2 != 0)).select(*KEYS, "freq", F.coalesce("dir", F.lit(999.0)).alias("dir"))
    return S.join_direction(e, d, KEYS)


@query("j06_both_present", f"""
SELECT {K}, count(*) AS bins FROM spb e WHERE EXISTS (SELECT 1 FROM (SELECT vec_id, sum(energy) AS s FROM spb GROUP BY 1) x WHERE x.vec_id = e.vec_id AND x.s > 6.5) GROUP BY station, ts""")
def _(v):
    """Spectra that also appear in a second feed, here the ones above an energy level."""
    b = S.to_bins(v.spectra, KEYS)
    second = b.groupBy(*KEYS).agg(F.sum("energy").alias("s")).filter(F.col("s") > 6.5)
    return S.both_present(b, second, KEYS).groupBy(*KEYS).agg(F.count("*").alias("bins"))


@query("x02_components_to_obs", f"""WITH {_MOM}
SELECT station, {iso('ts')} AS valid_utc, rn::INTEGER AS partition, {r6('h / 3.28084')} AS hs_m, {r6('round(tm, 1)')} AS tp_s, {r6(rint('d'))} AS dp_deg FROM tp WHERE rn <= 2""")
def _(v):
    return S.components_to_obs(S.decompose(v.spectra, KEYS), "station", "ts", "spectral", F.lit("2024-02-01").cast("timestamp")).select(
        "station", "valid_utc", "partition", "hs_m", "tp_s", "dp_deg")


@query("w09_display_spectrum", f"""
SELECT {K}, string_agg(CAST(CAST(round(energy * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS energies FROM spb GROUP BY station, ts""")
def _(v):
    d = S.display_spectrum(v.spectra, KEYS)
    return d.select(*KEYS, F.array_join(F.transform("spectrum", lambda b: F.round(b["energy"] * 1000000).cast("long").cast("string")), ",").alias("energies"))
