"""Symbolic screening of timing: inter-arrival times become a short word whose regularity is tested.

Input is a frame of events with an entity column and a time in seconds.  An entity's series stays in rows
until it is down to at most ``word_length`` segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: breakpoints of equal areas below the normal curve
BREAKPOINTS = {
    2: (0.0,),
    3: (-0.4307, 0.4307),
    4: (-0.6745, 0.0, 0.6745),
    5: (-0.8416, -0.2533, 0.2533, 0.8416),
    6: (-0.9674, -0.4307, 0.0, 0.4307, 0.9674),
    7: (-1.0676, -0.5659, -0.1800, 0.1800, 0.5659, 1.0676),
    8: (-1.1503, -0.6745, -0.3186, 0.0, 0.3186, 0.6745, 1.1503),
}
ALPHABET = "abcdefgh"


def iat_rows(events: DataFrame, entity: str, time: str) -> DataFrame:
    """(entity, j, iat): all inter-arrival times, zeros too, numbered from 0."""
    w = Window.partitionBy(entity).orderBy(time)
    rows = events.where(F.col(time).isNotNull()).select(entity, (F.col(time) - F.lag(time).over(w)).alias("iat"), (F.row_number().over(w) - 2).alias("j"))
    return rows.where("iat IS NOT NULL")


def znorm(rows: DataFrame, entity: str, value: str = "iat") -> DataFrame:
    """Adds ``z`` by the entity's mean and population deviation (0 where it does not vary) and ``n``."""
    stats = rows.groupBy(entity).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(stats, entity).withColumn("z", F.when(F.col("_s") < 1e-8, F.lit(0.0)).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def paa(rows: DataFrame, entity: str, word_length: int = 20, value: str = "z") -> DataFrame:
    """(entity, n, w, i, mean): the series cut into ``w = min(word_length, n - 1)`` equal parts; elements on a border count by their share."""
    w, n, j = F.col("w"), F.col("n"), F.col("j")
    wide = rows.withColumn("w", F.least(F.lit(word_length), n - 1)).where("w >= 1")
    cut = wide.withColumn("i", F.explode(F.sequence(F.floor(j * w / n), F.floor(((j + 1) * w - 1) / n))))
    i = F.col("i")
    share = F.greatest(F.lit(0.0), F.least((j + 1).cast("double"), (i + 1) * n / w) - F.greatest(j.cast("double"), i * n / w))
    return cut.groupBy(entity, "n", "w", "i").agg((F.sum(share * F.col(value)) / F.sum(share)).alias("mean"))


def encode(parts: DataFrame, entity: str, alphabet: int = 4) -> DataFrame:
    """(entity, n, w, sax_word, symbols)."""
    symbol = sum(((F.col("mean") > b).cast("int") for b in BREAKPOINTS[alphabet]), F.lit(0))
    rows = parts.withColumn("s", symbol)
    lists = rows.groupBy(entity, "n", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("symbols"))
    return lists.select(entity, "n", "w", F.concat_ws("", F.transform("symbols", lambda s: F.substring(F.lit(ALPHABET), s + 1, F.lit(1)))).alias("sax_word"), "symbols")


def _mean(x):
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def word_tests(words: DataFrame, max_lag: int = 10) -> DataFrame:
    """Adds ``sax_symbol_cv``, ``sax_acf_peak`` and ``sax_motif_fraction`` of ``symbols`` and ``sax_word``."""
    x = F.transform("symbols", lambda s: s.cast("double"))
    out = words.withColumn("_mu", _mean(x))
    out = out.withColumn("_sd", F.sqrt(_mean(F.transform("symbols", lambda s: (s - F.col("_mu")) * (s - F.col("_mu"))))))
    z = F.transform("symbols", lambda s: (s - F.col("_mu")) / F.col("_sd"))
    n = F.size("symbols")
    lags = F.least(F.lit(max_lag), F.floor(n / 2).cast("int"))
    peak = F.array_max(F.transform(F.sequence(F.lit(1), lags), lambda k: F.abs(F.aggregate(F.zip_with(F.slice("_z", F.lit(1), n - k), F.slice("_z", k + 1, n - k), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / (n - k))))
    word, size = F.col("sax_word"), F.length("sax_word")
    motif = F.array_max(F.transform(F.sequence(F.lit(2), F.floor(size / 2).cast("int")), lambda m: (size - F.length(F.replace(word, F.substring(word, F.lit(1), m), F.lit("")))) / size))
    return (
        out.withColumn("_z", F.when(F.col("_sd") >= 1e-9, z))
        .withColumn("sax_symbol_cv", F.col("_sd") / (F.col("_mu") + 1e-9))
        .withColumn("sax_acf_peak", F.when((F.col("_sd") < 1e-9) | (n < lags + 2) | (lags < 1), F.lit(0.0)).otherwise(peak))
        .withColumn("sax_motif_fraction", F.round(F.when(size >= 4, motif).otherwise(F.lit(0.0)), 4))
        .drop("_mu", "_sd", "_z")
    )


def top_channels(events: DataFrame, entity: str, least: int = 8, most: int = 5000) -> DataFrame:
    """(entity, n_observations) of the entities with most events; ties by entity."""
    counts = events.groupBy(entity).agg(F.count("*").alias("n_observations")).where(F.col("n_observations") >= least)
    return counts.orderBy(F.desc("n_observations"), entity).limit(most)


def screen(events: DataFrame, entity: str, time: str, cfg=None) -> DataFrame:
    """(entity, n_observations, sax_word, three tests, sax_passes) of the ``max_channels`` richest entities."""
    from tidewatch.config import Settings

    cfg = cfg or Settings()
    s = cfg.sax
    chosen = top_channels(events, entity, s.min_observations, cfg.channels.max_channels)
    rows = iat_rows(events.join(chosen.select(entity), entity, "left_semi"), entity, time)
    words = word_tests(encode(paa(znorm(rows, entity), entity, s.word_length).where((F.col("n") >= 3) & (F.col("w") >= 4)), entity, s.alphabet_size), s.max_acf_lag)
    votes = (F.col("sax_symbol_cv") < s.cv_threshold).cast("int") + (F.col("sax_acf_peak") > s.acf_threshold).cast("int") + (F.col("sax_motif_fraction") > s.motif_threshold).cast("int")
    scored = words.withColumn("sax_passes", votes >= s.min_tests_passing).select(entity, "sax_word", "sax_symbol_cv", "sax_acf_peak", "sax_motif_fraction", "sax_passes")
    return chosen.join(scored, entity, "left").withColumn("sax_passes", F.coalesce("sax_passes", F.lit(False)))
