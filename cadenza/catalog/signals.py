"""Signal queries and their oracles."""

from pyspark.sql import functions as F

from cadenza.catalog.base_sql import TIMED_WORDS
from cadenza.catalog.joins import line_onsets
from cadenza.operators import signals as G
from cadenza.sources import testbed as B

RATE = 1000
CLIP_RATE = 100


def rms(spark, sf_dir):
    return G.frame_rms(B.signals(spark, sf_dir), RATE)


def flux(spark, sf_dir):
    return G.energy_flux(rms(spark, sf_dir))


def candidates(spark, sf_dir):
    return G.onset_candidates(flux(spark, sf_dir))


def spectra(spark, sf_dir):
    return G.spectrum_bins(B.signals(spark, sf_dir), RATE, 10, 128)


def syllables(spark, sf_dir):
    words = B.timed_words(spark, sf_dir).select(
        "track_id", "n", "start_us", "end_us", (F.col("event_id") % 4 + 1).alias("syllables")
    )
    return G.syllable_starts(words, line_onsets(spark, sf_dir))


QUERIES = {
    "frame_rms": rms,
    "energy_flux": lambda s, d: flux(s, d).withColumn("flux", F.round("flux", 6)),
    "onset_candidates": lambda s, d: candidates(s, d).withColumn("flux", F.round("flux", 6)),
    "onset_thin": lambda s, d: G.onset_thin(candidates(s, d), 4).withColumn("flux", F.round("flux", 6)),
    "detect_onsets": lambda s, d: G.detect_onsets(B.signals(s, d), RATE),
    "syllable_starts": syllables,
    "waveform_peaks": lambda s, d: G.waveform_peaks(B.signals(s, d), 100),
    "downsample": lambda s, d: G.downsample(B.signals(s, d), 441, 160),
    "spectrum_bins": spectra,
    "band_energy": lambda s, d: G.band_energy(spectra(s, d)),
    "lag_xcorr": lambda s, d: G.lag_xcorr(B.signal_blocks(s, d), B.clips(s, d), B.BLOCK_LEN),
    "lag_xcorr_coarse": lambda s, d: G.lag_xcorr_coarse(
        B.signal_blocks(s, d), B.clips(s, d), B.BLOCK_LEN, CLIP_RATE
    ),
    "clip_search_window": lambda s, d: G.clip_search_window(
        B.signal_blocks(s, d), B.clips(s, d), B.BLOCK_LEN, CLIP_RATE
    ),
}

_SAMPLES = """
samples AS (
  SELECT vec_id // 8 AS track_id, vec_id % 8 * 64 + unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings
),
lens AS (SELECT track_id, max(pos) + 1 AS len FROM samples GROUP BY track_id)"""

_RMS = _SAMPLES + """,
grid AS (SELECT track_id, unnest(range(0, (len - 25) // 10)) AS frame FROM lens),
rms AS (
  SELECT track_id, frame, round(sqrt(sum(v * v) / 25), 6) AS rms
  FROM grid JOIN samples USING (track_id) WHERE pos >= frame * 10 AND pos < frame * 10 + 25 GROUP BY track_id, frame
)"""

_FLUX = _RMS + """,
rise AS (SELECT track_id, frame, greatest(0, coalesce(rms - lag(rms) OVER (PARTITION BY track_id ORDER BY frame), 0)) AS r FROM rms),
flux AS (SELECT track_id, frame, r / greatest(1e-6, max(r) OVER (PARTITION BY track_id)) AS flux FROM rise)"""

_CANDIDATES = _FLUX + """,
near AS (
  SELECT *, lag(flux, 1) OVER w AS b1, lag(flux, 2) OVER w AS b2, lead(flux, 1) OVER w AS a1, lead(flux, 2) OVER w AS a2,
         avg(flux) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m
  FROM flux WINDOW w AS (PARTITION BY track_id ORDER BY frame)
),
cand AS (
  SELECT track_id, frame, flux, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS r FROM near
  WHERE flux >= 0.12 AND flux > b1 AND flux > b2 AND flux >= a1 AND flux >= a2 AND flux >= m * 1.35 + 0.05
),
walk AS (
  SELECT track_id, r, frame, flux, frame AS last, true AS kept FROM cand WHERE r = 1
  UNION ALL
  SELECT c.track_id, c.r, c.frame, c.flux, CASE WHEN c.frame - last >= 4 THEN c.frame ELSE last END, c.frame - last >= 4
  FROM walk w JOIN cand c ON c.track_id = w.track_id AND c.r = w.r + 1
)"""

_BINS = _SAMPLES + """,
fr AS (SELECT track_id, len, unnest(range(0, CAST(ceil(len * 10 / 1000) AS BIGINT))) AS frame FROM lens),
win AS (SELECT track_id, frame, greatest(0, frame * 100 - 64) AS lo, least(len, greatest(0, frame * 100 - 64) + 128) AS hi FROM fr),
lev AS (
  SELECT track_id, frame, (pos - lo) // ((hi - lo) // 48) AS bin, sqrt(sum(v * v) / count(*)) AS rms
  FROM win JOIN samples USING (track_id) WHERE hi - lo > 64 AND pos >= lo AND pos < hi GROUP BY 1, 2, 3
),
bins AS (
  SELECT w.track_id, w.frame, b.bin, round(coalesce(least(1, rms * 4.5 * (1 + b.bin / 48 * 1.5)), 0), 6)::DOUBLE AS value
  FROM win w CROSS JOIN range(48) b(bin) LEFT JOIN lev l ON l.track_id = w.track_id AND l.frame = w.frame AND l.bin = b.bin
)"""

_CLIPS = _SAMPLES + """,
clip AS (
  SELECT vec_id AS clip_id, vec_id // 8 AS track_id, q, list_extract(embedding, q + 1)::DOUBLE * 0.5 + ((q * 7) % 5 - 2) * 0.01 AS c,
         vec_id % 8 * 640000 + vec_id % 3 * 400000 AS cursor_us
  FROM embeddings CROSS JOIN range(64) t(q)
)"""

# best hit per job: jobs(clip_id, track_id, rs, re) at a decimation factor
_HIT = """
m{x} AS (
  SELECT clip_id, (pos - rs) // {f} AS p, avg(v) AS v, (re - rs) // {f} AS n
  FROM {jobs} JOIN samples USING (track_id) WHERE pos >= rs AND pos < rs + (re - rs) // {f} * {f} GROUP BY 1, 2, 4
),
c{x} AS (SELECT clip_id, q // {f} AS q, avg(c) AS c FROM clip JOIN {jobs} USING (clip_id) GROUP BY 1, 2),
s{x} AS (
  SELECT clip_id, p - q AS lag, sum(v * c) AS val, sum(v * v) AS loc
  FROM m{x} JOIN c{x} USING (clip_id) WHERE p >= q AND p - q < greatest(1, n - 1) GROUP BY 1, 2
),
e{x} AS (SELECT clip_id, sum(c * c) AS own FROM c{x} GROUP BY 1),
h{x} AS (
  SELECT clip_id, lag, round(greatest(0, least(1, val / sqrt(greatest(1e-12, own * greatest(1e-12, loc))))), 6) AS confidence
  FROM s{x} JOIN e{x} USING (clip_id)
  QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY round(val, 9) DESC, lag) = 1
)"""

_REFINE = """
jc AS (SELECT * FROM jobs WHERE len >= 200 AND re - rs >= 200),
""" + _HIT.format(x="1", f=4, jobs="jc") + """,
found AS (SELECT jc.*, rs + lag * 4 AS tick, confidence FROM jc JOIN h1 USING (clip_id)),
jf AS (
  SELECT clip_id, track_id, greatest(0, tick - 50) AS rs, least(len, tick + 64 + 50) AS re FROM found WHERE confidence >= 0.25
  UNION ALL SELECT clip_id, track_id, rs, re FROM jobs WHERE NOT (len >= 200 AND re - rs >= 200)
),""" + _HIT.format(x="2", f=1, jobs="jf") + """
SELECT clip_id, rs + lag AS lag, confidence FROM jf JOIN h2 USING (clip_id)
UNION ALL SELECT clip_id, tick, confidence FROM found WHERE confidence < 0.25"""

ORACLE = {
    "frame_rms": "WITH " + _RMS + " SELECT * FROM rms",
    "energy_flux": "WITH " + _FLUX + " SELECT track_id, frame, round(flux, 6) AS flux FROM flux",
    "onset_candidates": "WITH RECURSIVE " + _CANDIDATES + " SELECT track_id, frame, round(flux, 6) AS flux FROM cand",
    "onset_thin": "WITH RECURSIVE " + _CANDIDATES + " SELECT track_id, frame, round(flux, 6) AS flux FROM walk WHERE kept",
    "detect_onsets": "WITH RECURSIVE " + _CANDIDATES + " SELECT track_id, frame * 10000 AS at_us FROM walk WHERE kept",
    "syllable_starts": "WITH " + TIMED_WORDS + """,
w AS (SELECT track_id, n, start_us, end_us, event_id % 4 + 1 AS k FROM timed_words),
o AS (
  SELECT DISTINCT track_id, greatest(0, start_us + ((event_id * 31) % 401 - 200) * 1000) AS tick FROM timed_words
),
first AS (
  SELECT w.track_id, w.n, k, tick, tick > start_us + 30000 AND tick < end_us - 30000 AS good
  FROM w JOIN o ON o.track_id = w.track_id AND tick BETWEEN start_us AND end_us
  QUALIFY row_number() OVER (PARTITION BY w.track_id, w.n ORDER BY tick) <= k - 1
),
heard AS (
  SELECT track_id, n, list(tick ORDER BY tick) AS ticks FROM first WHERE good GROUP BY track_id, n, k HAVING count(*) = k - 1
),
starts AS (
  SELECT track_id, n, CASE WHEN ticks IS NULL
           THEN list_transform(range(k), lambda i: start_us + greatest(40000, end_us - start_us) * i // k)
           ELSE list_prepend(start_us, ticks) END AS s
  FROM w LEFT JOIN heard USING (track_id, n)
)
SELECT track_id, n, generate_subscripts(s, 1) - 1 AS syllable, unnest(s) AS start_us FROM starts""",
    "waveform_peaks": "WITH " + _SAMPLES + """,
p AS (SELECT track_id, pos // greatest(1, len // 100) AS bucket, max(abs(v)) AS peak FROM samples JOIN lens USING (track_id) GROUP BY 1, 2)
SELECT l.track_id, b.bucket, coalesce(peak, 0) AS peak
FROM lens l CROSS JOIN range(100) b(bucket) LEFT JOIN p ON p.track_id = l.track_id AND p.bucket = b.bucket""",
    "downsample": "WITH " + _SAMPLES + """,
o AS (SELECT track_id, unnest(range(0, greatest(1, len * 160 // 441))) AS i FROM lens)
SELECT o.track_id, i AS pos, v FROM o JOIN samples s ON s.track_id = o.track_id AND s.pos = i * 441 // 160""",
    "spectrum_bins": "WITH " + _BINS + " SELECT * FROM bins",
    "band_energy": "WITH " + _BINS + """,
e AS (SELECT track_id, frame, bin, CAST(round(value * 1000000) AS BIGINT) AS u FROM bins),
l AS (
  SELECT track_id, frame, sum(CASE WHEN bin < 6 THEN u ELSE 0 END) / 6 / 1000000 AS bass,
         sum(CASE WHEN bin BETWEEN 6 AND 19 THEN u ELSE 0 END) / 14 / 1000000 AS mid,
         sum(CASE WHEN bin > 19 THEN u ELSE 0 END) / 28 / 1000000 AS high
  FROM e GROUP BY track_id, frame
)
SELECT *, round(pow(greatest(0, bass * 1.5), 1.6), 5) AS kick FROM l""",
    "lag_xcorr": "WITH " + _CLIPS + """,
jobs AS (SELECT DISTINCT clip_id, track_id, 0 AS rs, len AS re FROM clip JOIN lens USING (track_id)),"""
    + _HIT.format(x="1", f=1, jobs="jobs") + " SELECT * FROM h1",
    "lag_xcorr_coarse": "WITH " + _CLIPS + """,
jobs AS (SELECT DISTINCT clip_id, track_id, 0 AS rs, len AS re, len FROM clip JOIN lens USING (track_id)),""" + _REFINE,
    "clip_search_window": "WITH " + _CLIPS + """,
j0 AS (
  SELECT DISTINCT clip_id, track_id, len, greatest(0, CAST(floor((cursor_us / 1000000 - 1.5) * 100) AS BIGINT)) AS a,
         least(len, CAST(ceil((cursor_us / 1000000 + 12) * 100) AS BIGINT)) AS re
  FROM clip JOIN lens USING (track_id)
),
jobs AS (SELECT clip_id, track_id, least(a, re) AS rs, re, len FROM j0),""" + _REFINE,
}
