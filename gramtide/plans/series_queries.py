"""Series, windows, moments and other numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import ngrams, series, vocab, windows
from ..operators.lineage import cut, sized_join
from ..operators.quantiles import exact as exact_quantiles
from .registry import query, sql
from .tables import Tables
from .text_queries import WORDS, matrix


def r(c, digits: int = 6):
    return F.round(c, digits)


@query("rolling_freq", sql("SELECT mot, date, round(CASE WHEN count(*) OVER w = 7 THEN 1e5 * sum(x) OVER w / nullif(sum(n_tot) OVER w, 0) END, 6) AS f FROM bser WINDOW w AS (PARTITION BY mot ORDER BY date ROWS 6 PRECEDING)", "bser"))
def rolling_freq(t: Tables):
    return series.rolling(t.series, 7).select("mot", "date", r("f").alias("f"))


_JUMP = "SELECT mot, date, f - lag(f, 7) OVER (PARTITION BY mot ORDER BY date) AS d FROM (SELECT mot, date, CASE WHEN count(*) OVER w = 7 THEN 1e5 * sum(x) OVER w / nullif(sum(n_tot) OVER w, 0) END AS f FROM bser WINDOW w AS (PARTITION BY mot ORDER BY date ROWS 6 PRECEDING)) WHERE f IS NOT NULL"


@query("jump_diff", sql(f"SELECT mot, date, round(d, 6) AS d FROM ({_JUMP}) WHERE d IS NOT NULL", "bser"))
def jump_diff(t: Tables):
    return series.jumps(t.series, 7).select("mot", "date", r("d").alias("d"))


@query("jumps_up_down", sql(f"WITH j AS (SELECT * FROM ({_JUMP}) WHERE d IS NOT NULL), q AS (SELECT mot, quantile_cont(d, 0.99) AS hi, quantile_cont(d, 0.01) AS lo FROM j GROUP BY mot) SELECT mot, way, rank, date, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY mot, way ORDER BY abs(d) DESC, date) AS rank FROM (SELECT mot, date, d, CASE WHEN d > hi THEN 'up' WHEN d < lo THEN 'down' END AS way FROM j JOIN q USING (mot)) WHERE way IS NOT NULL) WHERE rank <= 15", "bser").replace("\nWITH j AS", ", j AS", 1))
def jumps_up_down(t: Tables):
    return series.extreme_jumps(t.series, 7).withColumn("d", r("d"))


@query("moving_avg7", sql("SELECT mot, date, round(avg(x) OVER (PARTITION BY mot ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS avg FROM bser", "bser"))
def moving_avg7(t: Tables):
    return series.moving_average(t.series, "x").select("mot", "date", r("avg").alias("avg"))


@query("calendar_fill", sql("SELECT c.mot, c.date, coalesce(b.x, 0)::BIGINT AS x FROM (SELECT mot, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM brand GROUP BY mot) c LEFT JOIN brand b USING (mot, date)", "brand"))
def calendar_fill(t: Tables):
    return series.calendar(t.brands, values=["x"])


@query("block_agg", sql("SELECT mot, block::INT AS block, sum(x)::BIGINT AS x, sum(n_tot)::BIGINT AS n_tot, max(CASE WHEN pos % 7 = 3 THEN date END) AS date FROM (SELECT *, (row_number() OVER (PARTITION BY mot ORDER BY date) - 1) AS pos, pos // 7 AS block FROM bser) GROUP BY mot, block HAVING count(*) = 7", "bser"))
def block_agg(t: Tables):
    return series.blocks(t.series, 7).select("mot", "block", "x", "n_tot", "date")


@query("moments", sql("SELECT mot, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(var_pop(x) / avg(x), 6) AS var_mean, round((avg(x::DOUBLE ** 3) - 3 * avg(x) * avg(x::DOUBLE ** 2) + 2 * avg(x) ** 3) / stddev_pop(x) ** 3, 4) AS skew, round((avg(x::DOUBLE ** 4) - 4 * avg(x) * avg(x::DOUBLE ** 3) + 6 * avg(x) ** 2 * avg(x::DOUBLE ** 2) - 3 * avg(x) ** 4) / var_pop(x) ** 2 - 3, 4) AS kurt FROM bser GROUP BY mot", "bser"))
def moments(t: Tables):
    out = series.moments(t.series, "x")
    return out.select("mot", r("mean").alias("mean"), r("std").alias("std"), r("var_mean").alias("var_mean"), r("skew", 4).alias("skew"), r("kurt", 4).alias("kurt"))


@query("quantiles", " UNION ALL ".join(f"SELECT l_returnflag AS flag, {q}::DOUBLE AS q, round(quantile_cont(l_extendedprice, {q}), 4) AS value FROM lineitem GROUP BY ALL" for q in (0.01, 0.25, 0.5, 0.75, 0.99)))
def quantiles(t: Tables):
    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    out = exact_quantiles(t.raw("lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), ["flag"], "l_extendedprice", qs)
    return out.select("flag", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("v").alias("value"))).alias("s")).select("flag", "s.q", r("s.value", 4).alias("value"))


@query("histogram", "SELECT flag, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY flag) / 5.0, 8) AS density FROM (SELECT l_returnflag AS flag, CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 40 THEN 9 ELSE floor(l_quantity / 5)::BIGINT + 1 END AS bin FROM lineitem) GROUP BY flag, bin")
def histogram(t: Tables):
    out = series.histogram(t.raw("lineitem").withColumn("flag", F.col("l_returnflag")), "l_quantity", 0, 40, 8, ["flag"])
    return out.select("flag", F.col("bin").cast("long").alias("bin"), "n", r("density", 8).alias("density"))


@query("avg_rank", "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000)) + (count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 1000)) - 1) / 2.0 AS avg_rank FROM customer")
def avg_rank(t: Tables):
    rows = t.raw("customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).alias("v"))
    return series.average_rank(rows, "v", ["c_nationkey"]).select("c_custkey", "c_nationkey", "avg_rank")


@query("acf1", sql("SELECT mot, round(sum((x - m) * (b - m)) / sum((x - m) * (x - m)), 8) AS acf1 FROM (SELECT mot, x, avg(x) OVER (PARTITION BY mot) AS m, lag(x) OVER (PARTITION BY mot ORDER BY date) AS b FROM bser) GROUP BY mot", "bser"))
def acf1(t: Tables):
    return series.acf1(t.series, "x").select("mot", r("acf1", 8).alias("acf1"))


@query("series_pivot", sql("SELECT date, sum(n) FILTER (gram = 'the')::BIGINT AS the, sum(n) FILTER (gram = 'de')::BIGINT AS de, sum(n) FILTER (gram = 'und')::BIGINT AS und, any_value(tt)::BIGINT AS n_1gram FROM (SELECT * FROM uni WHERE gram IN ('the', 'de', 'und')) JOIN (SELECT date, sum(total) AS tt FROM tot GROUP BY date) USING (date) GROUP BY date", "uni", "tot"))
def series_pivot(t: Tables):
    wide = t.uni.where(F.col("gram").isin(*WORDS)).groupBy("date").pivot("gram", list(WORDS)).agg(F.sum("n"))
    return wide.join(t.totals.groupBy("date").agg(F.sum("total").alias("n_1gram")), "date")


@query("series_unpivot", sql("SELECT date, gram, n::BIGINT AS n FROM (SELECT date, gram, sum(n) AS n FROM uni WHERE gram IN ('the', 'de', 'und') GROUP BY ALL)", "uni"))
def series_unpivot(t: Tables):
    wide = t.uni.where(F.col("gram").isin(*WORDS)).groupBy("date").pivot("gram", list(WORDS)).agg(F.sum("n"))
    return wide.unpivot("date", list(WORDS), "gram", "n").where("n is not null")


@query("series_quality", sql("SELECT media, gram, count(*) AS days, sum(n)::BIGINT AS n FROM (SELECT u.media, u.gram, u.n FROM uni u JOIN tot t USING (media, date) WHERE t.total > 0) GROUP BY ALL HAVING count(*) >= 60", "uni", "tot"))
def series_quality(t: Tables):
    return t.uni.join(t.totals.where("total > 0").select("media", "date"), ["media", "date"]).groupBy("media", "gram").agg(F.count("*").alias("days"), F.sum("n").alias("n")).where("days >= 60")


@query("thin_days", sql("SELECT media, date, total FROM tot WHERE total >= 1000", "tot"))
def thin_days(t: Tables):
    return t.totals.where("total >= 1000")


@query("winsorize", sql("SELECT mot, date, round(greatest(-2, least(2, (x - mu * n_tot) / sqrt(mu * n_tot))), 6) AS z FROM (SELECT *, sum(x) OVER (PARTITION BY mot)::DOUBLE / sum(n_tot) OVER (PARTITION BY mot) AS mu FROM bser)", "bser"))
def winsorize(t: Tables):
    w = Window.partitionBy("mot")
    z = (F.col("x") - F.col("mu") * F.col("n_tot")) / F.sqrt(F.col("mu") * F.col("n_tot"))
    return t.series.withColumn("mu", F.sum("x").over(w) / F.sum("n_tot").over(w)).select("mot", "date", r(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z))).alias("z"))


@query("peaks_threshold", sql("SELECT mot, date, x FROM (SELECT *, row_number() OVER (PARTITION BY mot ORDER BY x DESC, date) AS r FROM bser) WHERE r <= 30 AND x >= 4", "bser"))
def peaks_threshold(t: Tables):
    return t.series.withColumn("r", F.row_number().over(Window.partitionBy("mot").orderBy(F.desc("x"), "date"))).where("r <= 30 and x >= 4").select("mot", "date", "x")


_P = "exp(-x * ln(10) / 2)"


@query("surprise", sql(f"SELECT mot, date, round(-log10(greatest({_P}, 1e-300)), 8) AS surprise FROM bser", "bser"))
def surprise(t: Tables):
    return t.series.select("mot", "date", r(series.surprise(F.exp(-F.col("x") * F.log(F.lit(10.0)) / 2)), 8).alias("surprise"))


@query("date_parts", sql("SELECT id, date, date // 10000 AS year, (date // 100) % 100 AS month, date % 100 AS day, ((date // 10000) * 2 + ((date // 100) % 100 > 6)::INT) AS semester FROM articles", "articles"))
def date_parts(t: Tables):
    d = F.col("date")
    return t.articles.select("id", "date", dates.year(d).alias("year"), dates.month(d).alias("month"), (d % 100).alias("day"), dates.semester(d).alias("semester"))


@query("parse_day", "SELECT o_orderkey, CASE WHEN length(s) >= 10 THEN try_cast(replace(left(s, 10), '-', '') AS INT) END AS day FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN left(strftime(o_orderdate, '%Y-%m-%d'), 7) WHEN 1 THEN 'le ' || strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS s FROM orders)")
def parse_day(t: Tables):
    k, iso = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    s = F.when(k == 0, F.substring(iso, 1, 7)).when(k == 1, F.concat(F.lit("le "), iso)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.raw("orders").select("o_orderkey", dates.parse_day(s).alias("day"))


@query("date_guard", "SELECT o_orderkey, day FROM (SELECT o_orderkey, (strftime(o_orderdate, '%Y%m%d')::INT + CASE WHEN o_orderkey % 3 = 0 THEN 400000 ELSE 0 END)::INT AS day FROM orders) WHERE day BETWEEN 19000101 AND 20301231")
def date_guard(t: Tables):
    day = (dates.day_number(F.col("o_orderdate")) + F.when(F.col("o_orderkey") % 3 == 0, 400000).otherwise(0)).cast("int")
    return t.raw("orders").select("o_orderkey", day.alias("day")).where(dates.in_range(F.col("day")))


_PARTIAL = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y%m%d') END"


@query("parse_bounds", f"SELECT o_orderkey, (left(d || '0101', 8))::INT AS low, CASE length(d) WHEN 4 THEN d || '1231' WHEN 6 THEN d || '31' ELSE d END::INT AS high FROM (SELECT o_orderkey, regexp_replace({_PARTIAL}, '[-/]', '', 'g') AS d FROM orders)")
def parse_bounds(t: Tables):
    """The days that an order's date, given as a year, a month or a day in several spellings, may mean."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    given = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyyMMdd"))
    return t.raw("orders").select("o_orderkey", dates.bound(given, False).alias("low"), dates.bound(given, True).alias("high"))


@query("period_bounds", "SELECT resolution, period, low, CASE resolution WHEN 'year' THEN low + 1130 WHEN 'month' THEN low + 30 ELSE low END AS high, count(*) AS orders FROM (SELECT resolution, CASE resolution WHEN 'year' THEN d // 10000 WHEN 'month' THEN d // 100 ELSE d END AS period, CASE resolution WHEN 'year' THEN d // 10000 * 10000 + 101 WHEN 'month' THEN d // 100 * 100 + 1 ELSE d END AS low FROM (SELECT strftime(o_orderdate, '%Y%m%d')::INT AS d FROM orders), (VALUES ('year'), ('month'), ('day')) AS r(resolution)) GROUP BY ALL")
def period_bounds(t: Tables):
    """First and last day of every year, month and day that has orders."""
    day = dates.day_number(F.col("o_orderdate"))
    every = F.explode(F.array(*[F.struct(F.lit(r).alias("resolution"), dates.period(day, r).alias("period")) for r in ("year", "month", "day")])).alias("p")
    low, high = dates.period_bounds(F.col("period"), F.col("resolution"))
    counted = t.raw("orders").select(every).groupBy("p.resolution", "p.period").agg(F.count("*").alias("orders"))
    return counted.select("resolution", "period", low.alias("low"), high.alias("high"), "orders")


@query("year_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND extract(year FROM o_orderdate) NOT IN (1993, 1996)")
def year_filter(t: Tables):
    return t.raw("orders").where("o_orderdate is not null").where(~F.year("o_orderdate").isin(1993, 1996)).select("o_orderkey")


@query("epoch_paris", "SELECT event_id, strftime(timezone('Europe/Paris', timezone('UTC', to_timestamp(floor(epoch(ts))::BIGINT)::TIMESTAMP)), '%Y-%m-%dT%H:%M:%S') AS iso FROM (SELECT event_id, ts::TIMESTAMP AS ts FROM events)")
def epoch_paris(t: Tables):
    seconds = F.unix_timestamp("ts")
    return t.raw("events").select("event_id", F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), "Europe/Paris"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


# windows of the dense brand series

_GRID = "bgrid AS (SELECT mot, date, x, n_tot, 1e5 * x / nullif(n_tot, 0) AS f, row_number() OVER (PARTITION BY mot ORDER BY date) - 1 AS pos FROM bser)"
_CENTRES = "cen AS (SELECT mot, pos FROM (SELECT mot, pos, row_number() OVER (PARTITION BY mot ORDER BY x DESC, date) AS r FROM bgrid) WHERE r <= 10)"
_LONG = "wl AS (SELECT * FROM (SELECT c.mot, c.pos AS centre, g.pos - c.pos AS j, g.f, g.n_tot, count(*) OVER (PARTITION BY c.mot, c.pos) AS k FROM cen c JOIN bgrid g ON g.mot = c.mot AND g.pos BETWEEN c.pos - 15 AND c.pos + 15) WHERE k = 31)"
HALF = 15


def _wsql(body: str) -> str:
    return sql("\x00", "bser").replace("\x00", f", {_GRID}, {_CENTRES}, {_LONG}\n{body}")


def grid(t: Tables):
    pos = F.row_number().over(Window.partitionBy("mot").orderBy("date")) - 1
    return t.series.select("mot", "date", "x", "n_tot", series.freq(F.col("x"), F.col("n_tot")).alias("f"), pos.alias("pos"))


def centres(t: Tables):
    w = Window.partitionBy("mot").orderBy(F.desc("x"), "date")
    return grid(t).withColumn("r", F.row_number().over(w)).where("r <= 10").select("mot", "pos")


def long_windows(t: Tables, *more: str):
    g = grid(t)
    out = windows.windows_long(centres(t), g, HALF)
    if more:
        out = out.join(g.select("mot", (F.col("pos")).alias("at"), *more), (F.expr("centre + j") == F.col("at")) & (out.mot == g.mot)).drop(g.mot, "at")
    return out


def array_windows(t: Tables):
    return long_windows(t).groupBy("mot", "centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "f"))), lambda s: s.f).alias("w"))


@query("windows_long", _wsql("SELECT mot, centre, j, round(f, 6) AS f FROM wl"))
def windows_long(t: Tables):
    return long_windows(t).select("mot", "centre", F.col("j").cast("long").alias("j"), r("f").alias("f"))


@query("windows_array", _wsql("SELECT mot, pos, w FROM (SELECT mot, pos, list(round(f, 6)) OVER (PARTITION BY mot ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM bgrid) WHERE len(w) = 7"))
def windows_array(t: Tables):
    out = windows.windows_array(grid(t).withColumn("f", r("f")), 3)
    return out.select("mot", F.col("pos").cast("long").alias("pos"), "w")


@query("windows_edges", _wsql("SELECT mot, count(*) AS centres, count(*) FILTER (pos - 400 < 0 OR pos + 400 >= n) AS at_edge FROM cen JOIN (SELECT mot, count(*) AS n FROM bgrid GROUP BY mot) USING (mot) GROUP BY mot"))
def windows_edges(t: Tables):
    size = grid(t).groupBy("mot").agg(F.count("*").alias("n"))
    edge = (F.col("pos") - 400 < 0) | (F.col("pos") + 400 >= F.col("n"))
    return sized_join(centres(t), size, "mot").groupBy("mot").agg(F.count("*").alias("centres"), F.count_if(edge).alias("at_edge"))


@query("norm_z", _wsql("SELECT mot, centre, j, round((f - m) / s, 6) AS z FROM (SELECT *, avg(f) OVER w AS m, stddev_pop(f) OVER w AS s FROM wl WINDOW w AS (PARTITION BY mot, centre)) WHERE s > 0"))
def norm_z(t: Tables):
    out = windows.z_scores(array_windows(t)).select("mot", "centre", F.posexplode("w").alias("k", "z"))
    return out.select("mot", "centre", (F.col("k") - HALF).cast("long").alias("j"), r("z").alias("z"))


@query("norm_minmax", _wsql("SELECT mot, centre, j, round((f - lo) / (hi - lo), 6) AS v FROM (SELECT *, min(f) OVER w AS lo, max(f) OVER w AS hi FROM wl WINDOW w AS (PARTITION BY mot, centre)) WHERE hi > lo"))
def norm_minmax(t: Tables):
    out = windows.min_max(array_windows(t)).select("mot", "centre", F.posexplode("w").alias("k", "v"))
    return out.select("mot", "centre", (F.col("k") - HALF).cast("long").alias("j"), r("v").alias("v"))


@query("norm_col", _wsql("SELECT mot, centre, j, round((f - avg(f) OVER w) / stddev_pop(f) OVER w, 6) AS v FROM wl WINDOW w AS (PARTITION BY j)"))
def norm_col(t: Tables):
    return windows.column_scores(long_windows(t)).select("mot", "centre", F.col("j").cast("long").alias("j"), r("f").alias("v"))


@query("log_windows", _wsql("SELECT mot, centre, j, round(ln(1 + f), 6) AS v FROM wl"))
def log_windows(t: Tables):
    return long_windows(t).select("mot", "centre", F.col("j").cast("long").alias("j"), r(F.log1p("f")).alias("v"))


@query("thin_interp", _wsql(
    "SELECT mot, centre, j, thin, round(CASE WHEN NOT thin THEN f WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (j - k0) / (k1 - k0) END, 6) AS f FROM (SELECT *, n_tot < 15 AS thin, "
    "last_value(CASE WHEN n_tot >= 15 THEN f END IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN n_tot >= 15 THEN j END IGNORE NULLS) OVER a AS k0, first_value(CASE WHEN n_tot >= 15 THEN f END IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN n_tot >= 15 THEN j END IGNORE NULLS) OVER b AS k1, "
    "max((j = 0 AND n_tot >= 15)::INT) OVER (PARTITION BY mot, centre) AS ok FROM wl WINDOW a AS (PARTITION BY mot, centre ORDER BY j ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY mot, centre ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE ok = 1"))
def thin_interp(t: Tables):
    out = windows.interpolate_thin(long_windows(t, "n_tot"), 15)
    return out.select("mot", "centre", F.col("j").cast("long").alias("j"), "thin", r("f").alias("f"))


@query("asymmetry", _wsql("SELECT mot, centre, round(avg(f) FILTER (j > 0) - avg(f) FILTER (j < 0), 6) AS asymmetry FROM wl GROUP BY ALL"))
def asymmetry(t: Tables):
    return array_windows(t).select("mot", "centre", r(windows.asymmetry(F.col("w"), HALF)).alias("asymmetry"))


@query("profile_shape", _wsql("SELECT mot, round(sum(CASE WHEN abs(j) <= 3 THEN v * v END) / sum(v * v), 6) AS centre_energy, sign(round(sum(v) FILTER (j < 0), 9))::DOUBLE AS sign_before, sign(round(sum(v) FILTER (j > 0), 9))::DOUBLE AS sign_after, (count(*) FILTER (sign(v) <> sign(b)))::BIGINT AS changes FROM (SELECT *, lag(v) OVER (PARTITION BY mot ORDER BY j) AS b FROM (SELECT mot, j, round(avg(f) - avg(avg(f)) OVER (PARTITION BY mot), 6) AS v FROM wl GROUP BY mot, j)) GROUP BY mot"))
def profile_shape(t: Tables):
    mean = long_windows(t).groupBy("mot", "j").agg(F.avg("f").alias("v"))
    mean = mean.withColumn("v", r(F.col("v") - F.avg("v").over(Window.partitionBy("mot"))))
    w = mean.groupBy("mot").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s.v).alias("w"))
    changes, energy, before, after = windows.profile_shape(F.col("w"), HALF)
    return w.select("mot", changes, r(energy).alias("centre_energy"), before, after)


@query("profile_slices", _wsql("SELECT slice, j, round(avg(f), 5) AS mean FROM wl JOIN (SELECT mot, centre, unnest(CASE WHEN a <= q1 THEN ['low'] WHEN a >= q4 THEN ['high'] WHEN a BETWEEN q2 AND q3 THEN ['middle'] ELSE [] END) AS slice FROM (SELECT mot, centre, round(avg(f) FILTER (j > 0) - avg(f) FILTER (j < 0), 6) AS a FROM wl GROUP BY ALL) s, (SELECT quantile_cont(a, 0.1) AS q1, quantile_cont(a, 0.35) AS q2, quantile_cont(a, 0.65) AS q3, quantile_cont(a, 0.9) AS q4 FROM (SELECT round(avg(f) FILTER (j > 0) - avg(f) FILTER (j < 0), 6) AS a FROM wl GROUP BY mot, centre)) q) USING (mot, centre) GROUP BY ALL"))
def profile_slices(t: Tables):
    """Mean windows of the lowest tenth, the middle and the highest tenth by asymmetry."""
    scored = array_windows(t).withColumn("a", r(windows.asymmetry(F.col("w"), HALF)))
    q = exact_quantiles(scored, [], "a", (0.1, 0.35, 0.65, 0.9)).withColumnRenamed("v", "q")
    a = F.col("a")
    slice_ = F.when(a <= F.col("q")[0], "low").when(a >= F.col("q")[3], "high").when(a.between(F.col("q")[1], F.col("q")[2]), "middle")
    rows = scored.crossJoin(F.broadcast(q)).withColumn("slice", slice_).where("slice is not null").select("slice", F.posexplode("w").alias("k", "f"))
    return rows.groupBy("slice", (F.col("k") - HALF).cast("long").alias("j")).agg(r(F.avg("f"), 5).alias("mean"))


@query("array_roll", "SELECT vec_id, list_concat(e[65 - k:64], e[1:64 - k]) AS rolled FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x, 5)) AS e, (vec_id % 64)::INT AS k FROM embeddings)")
def array_roll(t: Tables):
    # a negative that is rounded to zero keeps its sign
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when((x < 0) & (F.round(x, 5) == 0), -F.lit(0.0)).otherwise(F.round(x, 5)))
    return t.raw("embeddings").select("vec_id", windows.roll(e, F.col("vec_id") % 64).alias("rolled"))


@query("subsample", _wsql("SELECT mot, centre FROM (SELECT DISTINCT mot, centre FROM wl) ORDER BY md5('1:' || mot || ':' || centre), mot, centre LIMIT 50"))
def subsample(t: Tables):
    """A seeded sample of N windows: a function of their names, so it doesn't depend on partitions."""
    rows = long_windows(t).select("mot", "centre").distinct()
    return rows.orderBy(F.md5(F.concat(F.lit("1:"), "mot", F.lit(":"), F.col("centre").cast("string")).cast("binary")), "mot", "centre").limit(50)


@query("volume_filter", _wsql("SELECT mot, centre, x FROM (SELECT *, x >= floor AS kept, count(*) FILTER (x >= floor) OVER () AS left_ FROM (SELECT c.mot, c.pos AS centre, g.x FROM cen c JOIN bgrid g USING (mot, pos)), (SELECT greatest(quantile_cont(g.x, 0.5), 3) AS floor FROM cen c JOIN bgrid g USING (mot, pos))) WHERE kept OR left_ < 30"))
def volume_filter(t: Tables):
    """Centres of at least max(median, 3) occurrences, or all of them if under 30 would be left."""
    rows = centres(t).join(grid(t).select("mot", "pos", "x"), ["mot", "pos"]).select("mot", F.col("pos").alias("centre"), "x")
    floor = exact_quantiles(rows, [], "x", (0.5,)).select(F.greatest(F.col("v")[0], F.lit(3)).alias("floor"))
    held = rows.crossJoin(F.broadcast(floor)).withColumn("kept", F.col("x") >= F.col("floor"))
    left = held.agg(F.count_if("kept").alias("left"))
    return held.crossJoin(F.broadcast(left)).where("kept or left < 30").select("mot", "centre", "x")


@query("quality_bins", _wsql("SELECT bin, count(*) AS windows, round(avg((z > 2.5)::INT), 8) AS rate FROM (SELECT CASE WHEN min(n_tot) < 10 THEN 0 WHEN min(n_tot) < 15 THEN 1 WHEN min(n_tot) < 20 THEN 2 ELSE 3 END AS bin, abs((max(f) - avg(f)) / stddev_pop(f)) AS z FROM wl GROUP BY mot, centre) GROUP BY bin"))
def quality_bins(t: Tables):
    per = long_windows(t, "n_tot").groupBy("mot", "centre").agg(F.min("n_tot").alias("least"), F.abs((F.max("f") - F.avg("f")) / F.stddev_pop("f")).alias("z"))
    bins = F.when(F.col("least") < 10, 0).when(F.col("least") < 15, 1).when(F.col("least") < 20, 2).otherwise(3)
    return per.groupBy(bins.alias("bin")).agg(F.count("*").alias("windows"), r(F.avg((F.col("z") > 2.5).cast("int")), 8).alias("rate"))


@query("peaks_by_quarter", sql("SELECT q.quarter, count(b.x) AS peaks FROM (SELECT unnest(generate_series(date_trunc('quarter', min(date)), date_trunc('quarter', max(date)), INTERVAL 3 MONTH))::DATE AS quarter FROM brand) q LEFT JOIN (SELECT * FROM brand WHERE x >= 5) b ON date_trunc('quarter', b.date)::DATE = q.quarter GROUP BY ALL", "brand"))
def peaks_by_quarter(t: Tables):
    ends = t.brands.agg(F.trunc(F.min("date"), "quarter").alias("a"), F.trunc(F.max("date"), "quarter").alias("b"))
    quarters = ends.select(F.explode(F.expr("sequence(a, b, interval 3 months)")).alias("quarter"))
    n = t.brands.where("x >= 5").groupBy(F.trunc("date", "quarter").alias("quarter")).agg(F.count("*").alias("n"))
    return quarters.join(n, "quarter", "left").select("quarter", F.coalesce("n", F.lit(0)).alias("peaks"))


@query("co_jumps", sql("SELECT a.mot, a.date, b.mot AS other, b.x, row_number() OVER (PARTITION BY a.mot, a.date ORDER BY b.x DESC, b.mot) AS rank FROM (SELECT * FROM brand WHERE x >= 6) a JOIN (SELECT * FROM brand WHERE x >= 4) b ON a.date = b.date AND a.mot <> b.mot QUALIFY rank <= 5", "brand"))
def co_jumps(t: Tables):
    """Other words that peak on the same day, the most surprising first."""
    a = t.brands.where("x >= 6").select("mot", "date")
    b = t.brands.where("x >= 4").select(F.col("mot").alias("other"), "date", "x")
    w = Window.partitionBy("mot", "date").orderBy(F.desc("x"), "other")
    return a.join(b, "date").where("mot <> other").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("mot", "date", "other", "x", "rank")


@query("balanced_cells", "SELECT p_size AS cell, avg_price, n FROM (SELECT p_size, round(avg(m), 4) AS avg_price, count(*) AS n FROM (SELECT p_size, left(p_brand, 7) AS g, avg(p_retailprice) AS m FROM part GROUP BY ALL) GROUP BY p_size) WHERE n = (SELECT count(DISTINCT left(p_brand, 7)) FROM part)")
def balanced_cells(t: Tables):
    """Means over groups, for the cells that every group has."""
    part = t.raw("part").withColumn("g", F.substring("p_brand", 1, 7))
    groups = part.agg(F.countDistinct("g").alias("groups"))
    cells = part.groupBy("p_size", "g").agg(F.avg("p_retailprice").alias("m")).groupBy(F.col("p_size").alias("cell")).agg(r(F.avg("m"), 4).alias("avg_price"), F.count("*").alias("n"))
    return cells.join(F.broadcast(groups), F.col("n") == F.col("groups")).select("cell", "avg_price", "n")


@query("pmf_moments", sql("SELECT mot, round(m, 6) AS mean, round(sqrt(v), 6) AS std, round(v / m, 6) AS var_mean, round(s3 / v ** 1.5, 5) AS skew, round(s4 / v ** 2 - 3, 5) AS kurt FROM (SELECT mot, any_value(m) AS m, sum((x - m) ** 2 * p) AS v, sum((x - m) ** 3 * p) AS s3, sum((x - m) ** 4 * p) AS s4 FROM (SELECT *, sum(x * p) OVER (PARTITION BY mot) AS m FROM (SELECT mot, x, count(*) / sum(count(*)) OVER (PARTITION BY mot) AS p FROM bser GROUP BY mot, x)) GROUP BY mot)", "bser"))
def pmf_moments(t: Tables):
    """Moments of a discrete law given as (value, probability) rows."""
    w = Window.partitionBy("mot")
    pmf = t.series.groupBy("mot", "x").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(w))
    d = pmf.withColumn("m", F.sum(F.col("x") * F.col("p")).over(w)).withColumn("d", F.col("x") - F.col("m"))
    s = d.groupBy("mot").agg(F.first("m").alias("m"), *[F.sum(F.pow("d", F.lit(k)) * F.col("p")).alias(f"s{k}") for k in (2, 3, 4)])
    return s.select("mot", r("m").alias("mean"), r(F.sqrt("s2")).alias("std"), r(F.try_divide("s2", "m")).alias("var_mean"), r(F.try_divide("s3", F.pow("s2", F.lit(1.5))), 5).alias("skew"), r(F.try_divide("s4", F.pow("s2", F.lit(2))) - 3, 5).alias("kurt"))


@query("word_whitelist", sql("SELECT media, gram, n FROM (SELECT media, gram, sum(n)::BIGINT AS n FROM uni GROUP BY ALL) WHERE gram IN (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM benchmark)", "uni"))
def word_whitelist(t: Tables):
    words = t.raw("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("gram")).distinct()
    return vocab.coverage(t.uni).select("gram").join(words, "gram", "left_semi").join(t.uni, "gram").groupBy("media", "gram").agg(F.sum("n").alias("n"))


@query("corr_residual", sql("SELECT mot_i, mot_j, round(corr(a, b), 6) AS r FROM (SELECT p.mot AS mot_i, q.mot AS mot_j, p.z AS a, q.z AS b FROM zz p JOIN zz q ON p.date = q.date AND p.mot < q.mot) GROUP BY ALL", "bser").replace("\nSELECT mot_i", ", zz AS (SELECT mot, date, greatest(-8, least(8, (x - mu * n_tot) / sqrt(mu * n_tot))) AS z FROM (SELECT *, sum(x) OVER (PARTITION BY mot)::DOUBLE / sum(n_tot) OVER (PARTITION BY mot) AS mu FROM bser))\nSELECT mot_i", 1))
def corr_residual(t: Tables):
    from ..operators import corr

    return corr.pairs(corr.residuals(t.series), "z").withColumn("r", r("r"))


_SPEAR = sql("SELECT mot_i, mot_j, corr(a, b) AS r FROM (SELECT p.mot AS mot_i, q.mot AS mot_j, p.k AS a, q.k AS b FROM rk p JOIN rk q ON p.date = q.date AND p.mot < q.mot) GROUP BY ALL", "bser").replace("\nSELECT mot_i", ", rk AS (SELECT mot, date, rank() OVER (PARTITION BY mot ORDER BY x / n_tot) + (count(*) OVER (PARTITION BY mot, x / n_tot) - 1) / 2.0 AS k FROM bser)\nSELECT mot_i", 1)


def _ranks(t: Tables):
    rate = t.series.withColumn("rate", F.col("x") / F.col("n_tot"))
    return series.average_rank(rate, "rate")


def _spearman(t: Tables):
    from ..operators import corr

    return corr.pairs(_ranks(t), "avg_rank")


@query("corr_spearman", f"SELECT mot_i, mot_j, round(r, 6) AS r FROM ({_SPEAR})")
def corr_spearman(t: Tables):
    return _spearman(t).withColumn("r", r("r"))


@query("corr_summary", f"SELECT count(*) AS pairs, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.01), 6) AS q01, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.99), 6) AS q99 FROM ({_SPEAR})")
def corr_summary(t: Tables):
    pairs, q = cut(_spearman(t)), F.col("v")
    means = pairs.agg(F.count("*").alias("pairs"), r(F.avg("r")).alias("mean"))
    return means.crossJoin(F.broadcast(exact_quantiles(pairs, [], "r", (0.01, 0.5, 0.99)))).select("pairs", "mean", r(q[0]).alias("q01"), r(q[1]).alias("q50"), r(q[2]).alias("q99"))


@query("corr_neighbours", f"SELECT mot, other, round(r, 6) AS r, rank FROM (SELECT *, row_number() OVER (PARTITION BY mot ORDER BY round(r, 9) DESC, other) AS rank FROM (SELECT mot_i AS mot, mot_j AS other, r FROM ({_SPEAR}) UNION ALL SELECT mot_j, mot_i, r FROM ({_SPEAR}))) WHERE rank <= 5")
def corr_neighbours(t: Tables):
    from ..operators import corr

    return corr.neighbours(_ranks(t), "avg_rank", 5).withColumn("r", r("r"))


@query("rbf_gram", "SELECT a.vec_id AS i, b.vec_id AS j, round(exp(-0.05 * list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS k FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b WHERE a.vec_id <= b.vec_id")
def rbf_gram(t: Tables):
    """Kernel of all vectors: the result has one row for each pair."""
    from ..operators import spectral

    return spectral.rbf_gram(t.raw("embeddings"), "vec_id", "embedding", 0.05).withColumn("k", r("k"))


@query("median_distance", "SELECT round(quantile_cont(d, 0.5), 6) AS median, round(1 / (2 * quantile_cont(d, 0.5)), 8) AS gamma FROM (SELECT list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 7)")
def median_distance(t: Tables):
    """Median squared distance of deterministic pairs, and the kernel width that it suggests."""
    from ..operators import spectral

    return spectral.median_distance(t.raw("embeddings"), "vec_id", "embedding", 7).select(r("median").alias("median"), r("gamma", 8).alias("gamma"))


@query("lrt_poisson", sql("SELECT mot, round(2 * (CASE WHEN x1 > 0 THEN x1 * ln(x1 / n1) ELSE 0 END + CASE WHEN x2 > 0 THEN x2 * ln(x2 / n2) ELSE 0 END - (x1 + x2) * ln((x1 + x2) / (n1 + n2))), 6) AS lrt FROM (SELECT mot, sum(x) FILTER (date < DATE '1995-06-17')::DOUBLE AS x1, sum(n_tot) FILTER (date < DATE '1995-06-17')::DOUBLE AS n1, sum(x) FILTER (date >= DATE '1995-06-17')::DOUBLE AS x2, sum(n_tot) FILTER (date >= DATE '1995-06-17')::DOUBLE AS n2 FROM bser GROUP BY mot)", "bser"))
def lrt_poisson(t: Tables):
    """Likelihood ratio of a break of the Poisson rate at a known date."""
    late = F.col("date") >= F.lit("1995-06-17").cast("date")
    s = t.series.groupBy("mot").agg(*[F.sum(F.when(late if k else ~late, F.col(c)).otherwise(0)).cast("double").alias(f"{c}{k}") for c in ("x", "n_tot") for k in (0, 1)])
    part = lambda x, n: F.when(x > 0, x * F.log(F.try_divide(x, n))).otherwise(0.0)
    x0, x1, n0, n1 = (F.col(c) for c in ("x0", "x1", "n_tot0", "n_tot1"))
    return s.select("mot", r(2 * (part(x0, n0) + part(x1, n1) - part(x0 + x1, n0 + n1))).alias("lrt"))


@query("share_series", sql("SELECT date, mot, round(x / sum(x) OVER (PARTITION BY date), 8) AS share FROM brand", "brand"))
def share_series(t: Tables):
    """Share of a word among the words of its family on each day."""
    return t.brands.select("date", "mot", r(F.col("x") / F.sum("x").over(Window.partitionBy("date")), 8).alias("share"))


@query("fit_poisson", sql("SELECT mot, round(sum(x) / sum(n_tot), 10) AS lam FROM bser GROUP BY mot", "bser"))
def fit_poisson(t: Tables):
    return t.series.groupBy("mot").agg(r(F.sum("x") / F.sum("n_tot"), 10).alias("lam"))


@query("pearson_residuals", sql("SELECT mot, date, round((x - mu * n_tot) / sqrt(mu * n_tot), 6) AS z FROM (SELECT *, sum(x) OVER (PARTITION BY mot)::DOUBLE / sum(n_tot) OVER (PARTITION BY mot) AS mu FROM bser)", "bser"))
def pearson_residuals(t: Tables):
    from ..operators import corr

    return corr.residuals(t.series, None).select("mot", "date", r("z").alias("z"))


@query("gof_chi2", sql("SELECT mot, round(sum(z * z), 4) AS chi2, count(*) - 1 AS dof, round(sum(z * z) / (count(*) - 1), 6) AS ratio FROM (SELECT mot, (x - mu * n_tot) / sqrt(mu * n_tot) AS z FROM (SELECT *, sum(x) OVER (PARTITION BY mot)::DOUBLE / sum(n_tot) OVER (PARTITION BY mot) AS mu FROM bser)) GROUP BY mot", "bser"))
def gof_chi2(t: Tables):
    from ..operators import corr

    z = corr.residuals(t.series, None)
    return z.groupBy("mot").agg(F.sum(F.col("z") * F.col("z")).alias("chi2"), (F.count("*") - 1).alias("dof")).select("mot", r("chi2", 4).alias("chi2"), "dof", r(F.col("chi2") / F.col("dof"), 6).alias("ratio"))
