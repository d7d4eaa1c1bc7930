"""Queries on survey counts and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import array_sum, first_covered_hour, masked_rate
from ..functions.time import clock_hours, coverage_mask, in_season, local_to_utc, midpoint_hour, scaled_doy, scaled_year, year_used
from ..operators import intervals, survey
from . import adapters as a
from . import query


@query(f"WITH {a.HOURS} SELECT date::VARCHAR AS date, hour::BIGINT AS hour FROM per")
def survey_periods(spark, sf_dir):
    return a.written(survey.periods(a.hour_counts(spark, sf_dir), ("date", "hour")))


@query(f"WITH {a.HOURS} SELECT species::BIGINT AS species, date::VARCHAR AS date, hour::BIGINT AS hour, count::DOUBLE AS count FROM hs")
def survey_zero_fill(spark, sf_dir):
    return a.written(survey.zero_fill(a.hour_counts(spark, sf_dir), by=("date", "hour")).select("species", "date", "hour", "count"))


_RATE = f"""WITH {a.INTERVALS}, p AS (SELECT DISTINCT date, s, e FROM ti), sp AS (SELECT DISTINCT species FROM ti), c AS (SELECT species, date, s, e, sum(count) AS n FROM ti GROUP BY ALL)
SELECT sp.species, p.date::VARCHAR AS date, p.s AS start_minute, p.e AS end_minute, coalesce(n, 0)::DOUBLE AS count, round((p.e - p.s) / 60.0::DOUBLE, 6) AS duration, round(coalesce(n, 0) / ((p.e - p.s) / 60.0::DOUBLE), 6) AS rate
FROM p CROSS JOIN sp LEFT JOIN c ON c.species = sp.species AND c.date = p.date AND c.s = p.s AND c.e = p.e"""


@query(_RATE)
def survey_rate(spark, sf_dir):
    filled = survey.with_rate(survey.zero_fill(a.intervals(spark, sf_dir)))
    out = filled.select("species", "date", a.minute_of("start").alias("start_minute"), (a.minute_of("start") + F.round(F.col("duration") * 60).cast("long")).alias("end_minute"), "count", "duration", "rate")
    return a.written(a.rounded(out, "duration", "rate"))


_CLIP = "least(greatest({}, 0), 1)"
_MASK = f"""least({_CLIP.format("h - s / 60.0::DOUBLE + 1")}, {_CLIP.format("e / 60.0::DOUBLE - h")})"""


@query(f"WITH {a.INTERVALS}, p AS (SELECT DISTINCT date, s, e FROM ti) SELECT date::VARCHAR AS date, s AS start_minute, e AS end_minute, h::BIGINT AS hour, round({_MASK}, 6) AS mask, round(greatest(0, least(e / 60.0::DOUBLE, h + 1) - greatest(s / 60.0::DOUBLE, h)), 6) AS exact FROM p CROSS JOIN range(24) r(h) WHERE {_MASK} > 0")
def survey_mask(spark, sf_dir):
    p = survey.periods(a.intervals(spark, sf_dir)).withColumn("s", a.minute_of("start")).withColumn("e", a.minute_of("end"))
    start, end = clock_hours(F.col("start")), clock_hours(F.col("end"))
    both = p.select("date", F.col("s").alias("start_minute"), F.col("e").alias("end_minute"), F.posexplode(F.arrays_zip(coverage_mask(start, end).alias("mask"), coverage_mask(start, end, exact=True).alias("exact"))).alias("hour", "m"))
    return a.written(a.rounded(both.select("date", "start_minute", "end_minute", "hour", "m.mask", "m.exact").where("mask > 0"), "mask", "exact"))


@query(f"""WITH {a.INTERVALS}, p AS (SELECT DISTINCT date, s, e FROM ti), m AS (SELECT date, s, e, h, {_MASK} AS m FROM p CROSS JOIN range(24) r(h))
SELECT date::VARCHAR AS date, s AS start_minute, e AS end_minute, round(sum((1 + h % 5) * m) / nullif(sum(m), 0), 6) AS rate, round(sum(m), 6) AS coverage, coalesce(min(CASE WHEN m > 0 THEN h END), 0)::BIGINT AS start_hour FROM m GROUP BY ALL""")
def survey_masked_rate(spark, sf_dir):
    p = survey.periods(a.intervals(spark, sf_dir)).withColumn("mask", coverage_mask(clock_hours(F.col("start")), clock_hours(F.col("end"))))
    told = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.log1p((1 + h % 5).cast("double")))
    out = p.select("date", a.minute_of("start").alias("start_minute"), a.minute_of("end").alias("end_minute"), masked_rate(told, F.col("mask")).alias("rate"), array_sum(F.col("mask")).alias("coverage"), first_covered_hour(F.col("mask")).alias("start_hour"))
    return a.written(a.rounded(out, "rate", "coverage"))


@query(f"WITH {a.HOURS} SELECT species::BIGINT AS species, date::VARCHAR AS date, doy::BIGINT AS doy, year::BIGINT AS year, count::DOUBLE AS count, duration, round(rate, 6) AS rate FROM dy")
def daily_ratio_of_sums(spark, sf_dir):
    return a.written(a.rounded(a.daily(spark, sf_dir), "rate"))


_FRAME = "species::BIGINT AS species, date::VARCHAR AS date, round(obs, 6) AS obs, round(pred, 6) AS pred, coverage, n_rows::BIGINT AS n_rows"


@query(f"WITH {a.EVALUATION} SELECT {_FRAME} FROM df")
def daily_weighted_frame(spark, sf_dir):
    return a.written(a.rounded(survey.daily_frame(a.evaluation(spark, sf_dir)).select("species", "date", "obs", "pred", "coverage", "n_rows"), "obs", "pred"))


@query(f"WITH {a.HOURS} SELECT x.species::BIGINT AS species, x.date::VARCHAR AS date, round(x.rate, 6) AS obs, round(y.rate, 6) AS persistence FROM dy x LEFT JOIN dy y ON x.species = y.species AND y.date = x.date - 1")
def persistence(spark, sf_dir):
    daily = a.daily(spark, sf_dir).select("species", "date", F.col("rate").alias("obs"))
    return a.written(a.rounded(survey.with_persistence(daily), "obs", "persistence"))


_OVER = "EXISTS (SELECT 1 FROM ti b WHERE b.date = t.date AND b.species = t.species AND b.id <> t.id AND t.s < b.e AND t.e > b.s)"


@query(f"WITH {a.INTERVALS} SELECT id, species, date::VARCHAR AS date FROM ti t WHERE {_OVER}")
def interval_overlap_semi(spark, sf_dir):
    iv = a.intervals(spark, sf_dir)
    return a.written(intervals.overlapping(iv, iv, "id", ("species",), unlike_itself=True).select("id", "species", "date"))


@query(f"WITH {a.INTERVALS} SELECT id, species, date::VARCHAR AS date FROM ti t WHERE NOT {_OVER}")
def interval_overlap_anti(spark, sf_dir):
    iv = a.intervals(spark, sf_dir)
    return a.written(intervals.apart(iv, iv, "id", ("species",), unlike_itself=True).select("id", "species", "date"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS species, o_orderdate::DATE::TIMESTAMP + to_minutes((240 + 60 * (o_orderkey % 12))::INT) AS s, o_orderdate::DATE::TIMESTAMP + to_minutes((240 + 60 * (o_orderkey % 12) + 15 * (1 + o_orderkey % 29))::INT) AS e, o_custkey FROM orders),
spans AS (SELECT o_custkey, species, min(s) AS s, max(e) AS e FROM t GROUP BY ALL HAVING max(e) - min(s) > INTERVAL 300 DAY)
SELECT id, species FROM t WHERE NOT EXISTS (SELECT 1 FROM spans x WHERE x.species = t.species AND t.s < x.e AND t.e > x.s)""")
def interval_long_apart(spark, sf_dir):
    """Surveys of minutes or hours that overlap no season of the same species, seasons lasting from 300 days to years."""
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"), F.lit(0))
    first, day = F.lit(240) + 60 * (F.col("o_orderkey") % 12), F.to_date("o_orderdate").cast("timestamp")
    t = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("species"), "o_custkey", (day + minutes(first)).alias("start"), (day + minutes(first + 15 * (1 + F.col("o_orderkey") % 29))).alias("end"))
    spans = t.groupBy("o_custkey", "species").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") > F.expr("INTERVAL 300 DAY"))
    return intervals.apart(t, spans, "id", ("species",)).select("id", "species")


@query(f"WITH {a.INTERVALS} SELECT id, coalesce(s < lag(e) OVER w, false) OR coalesce(e > lead(s) OVER w, false) AS overlaps FROM ti WINDOW w AS (PARTITION BY species, date ORDER BY s, e, id)")
def interval_adjacent_overlap(spark, sf_dir):
    return intervals.neighbours_overlap(a.intervals(spark, sf_dir), ("species", "date"), "id").select("id", "overlaps")


@query(f"WITH {a.INTERVALS} SELECT id, greatest(s, h * 60)::BIGINT AS start_minute, least(e, h * 60 + 60)::BIGINT AS end_minute FROM ti CROSS JOIN range(24) r(h) WHERE greatest(s, h * 60) < least(e, h * 60 + 60)")
def interval_hourly_expand(spark, sf_dir):
    cut = intervals.hourly(a.intervals(spark, sf_dir))
    start = a.minute_of("part_start")
    return cut.select("id", start.alias("start_minute"), (start + F.round((F.unix_micros("part_end") - F.unix_micros("part_start")) / 6e7).cast("long")).alias("end_minute"))


@query(f"WITH {a.INTERVALS} SELECT DISTINCT id, m::BIGINT AS minute FROM (SELECT id, unnest([s, e]) AS m FROM ti UNION ALL SELECT id, h * 60 FROM ti CROSS JOIN range(24) r(h) WHERE h * 60 > s AND h * 60 <= e)")
def interval_instants(spark, sf_dir):
    return intervals.sample_instants(a.intervals(spark, sf_dir)).select("id", a.minute_of("instant").alias("minute"))


@query(f"WITH {a.INTERVALS}, q AS (SELECT *, s + (id * 7) % len AS m FROM ti) SELECT id, greatest(m // 60 * 60, s)::BIGINT AS start_minute, least(m // 60 * 60 + 60, e)::BIGINT AS end_minute FROM q")
def interval_clip(spark, sf_dir):
    iv = a.intervals(spark, sf_dir)
    length = (F.unix_micros("end") - F.unix_micros("start")) / 60_000_000
    seen = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 7 % length.cast("long")).cast("int"), F.lit(0))
    cut = intervals.clipped_hour(iv.withColumn("seen", seen))
    day = F.unix_micros(F.col("date").cast("timestamp"))
    minute = lambda c: ((F.unix_micros(c) - day) / 60_000_000).cast("long")
    return cut.select("id", minute("hour_start").alias("start_minute"), minute("hour_end").alias("end_minute"))


@query(f"""WITH {a.INTERVALS}, q AS (SELECT *, s + (id * 13) % (len + 60) - 30 AS m FROM ti), k AS (SELECT *, CASE WHEN m < s AND m >= s - 10 THEN s + 1 WHEN m > e AND m <= e + 10 THEN e - 1 ELSE m END AS k FROM q)
SELECT id, k::BIGINT AS seen_minute FROM k WHERE NOT (k < s OR k > e)""")
def survey_clamp(spark, sf_dir):
    iv = a.intervals(spark, sf_dir)
    length = ((F.unix_micros("end") - F.unix_micros("start")) / 60_000_000).cast("long")
    seen = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 13 % (length + 60) - 30).cast("int"), F.lit(0))
    iv = iv.withColumn("seen", survey.clamped_time(seen, F.col("start"), F.col("end"))).where(survey.inside_period(F.col("seen"), F.col("start"), F.col("end")))
    return iv.select("id", a.minute_of("seen").alias("seen_minute"))


@query(f"""WITH {a.INTERVALS}, q AS (SELECT date, s, e, count(*) AS n, count(*) FILTER (WHERE id % 3 = 0) AS u FROM ti GROUP BY ALL), d AS (SELECT date, count(DISTINCT s) AS k FROM q GROUP BY ALL)
SELECT q.date::VARCHAR AS date, s AS start_minute, n::BIGINT AS n, u::BIGINT AS n_untimed, round(u / n, 6) AS untimed_share, round((e - s) / 60.0::DOUBLE, 6) AS duration, k::BIGINT AS periods_of_day FROM q JOIN d ON q.date = d.date WHERE (e - s) > 120 AND u / n < 0.5""")
def survey_period_stats(spark, sf_dir):
    iv = a.intervals(spark, sf_dir).withColumn("seen", F.when(F.col("id") % 3 != 0, F.col("start")))
    out = survey.expandable(survey.period_statistics(iv)).select("date", a.minute_of("start").alias("start_minute"), "n", "n_untimed", "untimed_share", "duration", "periods_of_day")
    return a.written(a.rounded(out, "untimed_share", "duration"))


@query(f"WITH {a.INTERVALS} SELECT id FROM ti WHERE len < 30")
def survey_short_periods(spark, sf_dir):
    iv = a.intervals(spark, sf_dir)
    return iv.join(survey.long_enough(iv, 30), "id", "left_anti").select("id")


@query(f"""WITH {a.INTERVALS}, l AS (SELECT id, date + to_minutes(s) AS t FROM ti), u AS (SELECT id, epoch(timezone('Europe/Paris', t))::BIGINT AS sec FROM l)
SELECT id, sec AS utc_seconds FROM u""")
def local_to_utc_times(spark, sf_dir):
    return a.intervals(spark, sf_dir).select("id", F.unix_seconds(local_to_utc(F.col("start"), "Europe/Paris")).alias("utc_seconds"))


@query(f"WITH {a.INTERVALS} SELECT id, ((s + e) // 2 // 60 % 24)::BIGINT AS hour, round((year(date) - 2000) / 100.0::DOUBLE, 6) AS year_scaled, round((dayofyear(date) - 183) / 366.0::DOUBLE, 6) AS doy_scaled, (CASE WHEN year(date) < 1997 THEN 2000 WHEN year(date) < 2000 THEN 2100 ELSE 2200 END)::BIGINT AS year_used FROM ti WHERE dayofyear(date) BETWEEN 196 AND 335")
def derived_features(spark, sf_dir):
    iv = a.intervals(spark, sf_dir).where(in_season(F.col("date"), (196, 335)))
    out = iv.select("id", midpoint_hour(F.col("start"), F.col("end")).alias("hour"), scaled_year(F.year("date")).alias("year_scaled"), scaled_doy(F.dayofyear("date")).alias("doy_scaled"), year_used(F.year("date"), "period", a.ERA_EDGES, (2000, 2100, 2200)).alias("year_used"))
    return a.written(a.rounded(out, "year_scaled", "doy_scaled"))


@query("SELECT * FROM (VALUES ('2026-01-15', false), ('2026-07-14', false), ('2026-07-15', true), ('2026-09-15', true), ('2026-12-01', true), ('2026-12-02', false), ('2026-12-31', false)) t(date, in_season)")
def season_guard(spark, sf_dir):
    days = spark.createDataFrame([(d,) for d in ("2026-01-15", "2026-07-14", "2026-07-15", "2026-09-15", "2026-12-01", "2026-12-02", "2026-12-31")], "date string")
    return days.select("date", in_season(F.to_date("date"), (196, 335)).alias("in_season"))
