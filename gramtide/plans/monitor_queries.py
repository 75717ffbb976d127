"""Progress, rates and audits of a collection; URL queues and sitemaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import monitor, urls
from .registry import query, sql
from .tables import Tables

_PROGRESS = "SELECT media, todo, failed, done, todo + failed + done AS total, round(100.0 * (failed + done) / nullif(todo + failed + done, 0), 1)::DOUBLE AS treated_pct, round(100.0 * done / nullif(failed + done, 0), 1)::DOUBLE AS success_pct FROM (SELECT coalesce(media, 'TOTAL') AS media, count(*) FILTER (state = 0) AS todo, count(*) FILTER (state IN (1, 4)) AS failed, count(*) FILTER (state = 2) AS done FROM queue GROUP BY ROLLUP (media))"
_LABELS = [("th", "Thé"), ("en", "En"), ("fr", "Français")]


@query("progress", sql(_PROGRESS, "queue"))
def progress(t: Tables):
    return monitor.progress(t.queue)


@query("progress_totals", sql("SELECT count(DISTINCT media) AS media_count, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END)::BIGINT AS todo, sum(CASE WHEN state = 2 THEN 1 ELSE 0 END)::BIGINT AS done FROM queue", "queue"))
def progress_totals(t: Tables):
    rows = monitor.progress(t.queue).where("media <> 'TOTAL'")
    return rows.agg(F.count("*").alias("media_count"), F.sum("todo").alias("todo"), F.sum("done").alias("done"))


@query("progress_labels", sql(f"SELECT coalesce(l.name, p.media) AS name, done, success_pct FROM ({_PROGRESS}) p LEFT JOIN (SELECT DISTINCT media, 'Media ' || media AS name FROM queue WHERE id % 5 = 0) l USING (media)", "queue"))
def progress_labels(t: Tables):
    labels = t.queue.where("id % 5 = 0").select("media", F.concat(F.lit("Media "), "media").alias("name")).distinct()
    return monitor.progress(t.queue).join(labels, "media", "left").select(F.coalesce("name", "media").alias("name"), "done", "success_pct")


@query("failure_rate", sql("SELECT media, count(*) AS treated, round(100.0 * avg((state <> 2)::INT), 1)::DOUBLE AS failure_pct FROM queue WHERE state IN (1, 2, 4) GROUP BY media", "queue"))
def failure_rate(t: Tables):
    return monitor.failure_rate(t.queue)


@query("length_stats", "SELECT coalesce(lang, 'TOTAL') AS media, count(*) AS n, round_even(avg(w), 0) AS mean, round_even(quantile_cont(w, 0.5), 0) AS median, min(w) AS min, max(w) AS max FROM (SELECT lang, len(list_filter(string_split_regex(text, '[ \\t\\n\\f\\r\\x0B]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY ROLLUP (lang)")
def length_stats(t: Tables):
    return monitor.length_stats(t.articles, text.word_count(F.col("contenu")).cast("long"))


@query("articles_by_year", "SELECT lang AS media, CASE WHEN regexp_matches(left(s, 4), '^[0-9]{4}$') THEN left(s, 4) ELSE 'none' END AS year, count(*) AS n FROM (SELECT lang, CASE WHEN doc_id % 11 = 0 THEN '' ELSE (2000 + doc_id % 7)::VARCHAR || '-01-01' END AS s FROM documents) GROUP BY ALL")
def articles_by_year(t: Tables):
    s = F.when(F.col("id") % 11 == 0, "").otherwise(F.concat((2000 + F.col("id") % 7).cast("string"), F.lit("-01-01")))
    year = F.substring("s", 1, 4)
    return t.articles.withColumn("s", s).groupBy("media", F.when(year.rlike("^[0-9]{4}$"), year).otherwise("none").alias("year")).agg(F.count("*").alias("n"))


@query("top_values", "SELECT trim(v) AS value, count(*) AS n FROM (SELECT unnest(string_split(source || ', ' || lang || CASE WHEN doc_id % 3 = 0 THEN ', ' ELSE '' END, ', ')) AS v FROM documents) WHERE trim(v) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def top_values(t: Tables):
    joined = F.concat("section", F.lit(", "), "media", F.when(F.col("id") % 3 == 0, ", ").otherwise(""))
    return monitor.top_values(t.articles.withColumn("v", joined), "v", 12)


@query("access_share", "SELECT free, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM (SELECT CASE toxic WHEN 0 THEN 'oui' WHEN 1 THEN 'non' ELSE '' END AS free FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY free")
def access_share(t: Tables):
    """Share of each access class; the total is a scalar, so no window gathers all rows."""
    free = F.when(F.col("toxic") == 0, "oui").when(F.col("toxic") == 1, "non").otherwise("")
    n = t.articles.join(t.raw("labels"), F.col("id") == F.col("doc_id"), "left").groupBy(free.alias("free")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("free", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("pct"))


@query("adds_by_halfday", "SELECT CAST(ts AS DATE) AS day, CASE WHEN extract(hour FROM ts) < 12 THEN 'morning' ELSE 'afternoon' END AS half, round(sum(value), 4) AS added FROM events GROUP BY ALL")
def adds_by_halfday(t: Tables):
    half = F.when(F.hour("ts") < 12, "morning").otherwise("afternoon")
    return t.raw("events").groupBy(F.col("ts").cast("date").alias("day"), half.alias("half")).agg(F.round(F.sum("value"), 4).alias("added"))


@query("adds_by_run", "SELECT date_trunc('hour', ts) AS run, count(*) AS listed, round(sum(value), 4) AS added FROM events GROUP BY ALL")
def adds_by_run(t: Tables):
    return t.raw("events").groupBy(F.date_trunc("hour", "ts").alias("run")).agg(F.count("*").alias("listed"), F.round(F.sum("value"), 4).alias("added"))


@query("tumbling_12h", "SELECT event_type, time_bucket(INTERVAL 12 HOURS, ts::TIMESTAMP, TIMESTAMP '2024-01-01') AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling_12h(t: Tables):
    return t.raw("events").groupBy("event_type", F.window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("sliding_events", "SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([b, b - INTERVAL 5 MINUTES]) AS start FROM (SELECT *, time_bucket(INTERVAL 5 MINUTES, ts::TIMESTAMP, TIMESTAMP '2024-01-01') AS b FROM events)) GROUP BY ALL")
def sliding_events(t: Tables):
    return t.raw("events").groupBy("event_type", F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("session_events", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOURS)::INT AS new FROM events)) GROUP BY user_id, s")
def session_events(t: Tables):
    out = t.raw("events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("success_windows", sql("SELECT media, ok, bad, round(100.0 * ok / nullif(ok + bad, 0), 1)::DOUBLE AS pct, round(100.0 * (ok - ok24) / nullif(ok + bad - ok24 - bad24, 0), 1)::DOUBLE AS pct24, round(100.0 * (ok - ok72) / nullif(ok + bad - ok72 - bad72, 0), 1)::DOUBLE AS pct72 FROM (SELECT media, max_by(ok, (ts, event_id)) AS ok, max_by(bad, (ts, event_id)) AS bad, max_by(ok, (ts, event_id)) FILTER (ts <= h - INTERVAL 24 HOURS) AS ok24, max_by(bad, (ts, event_id)) FILTER (ts <= h - INTERVAL 24 HOURS) AS bad24, max_by(ok, (ts, event_id)) FILTER (ts <= h - INTERVAL 72 HOURS) AS ok72, max_by(bad, (ts, event_id)) FILTER (ts <= h - INTERVAL 72 HOURS) AS bad72 FROM snap, (SELECT max(ts) AS h FROM snap) GROUP BY media)", "snap"))
def success_windows(t: Tables):
    return monitor.success_windows(t.snapshots)


@query("success_over_time", sql("SELECT media, ts, event_id, round(100.0 * ok / nullif(ok + bad, 0), 1)::DOUBLE AS pct FROM snap WHERE media IN ('click', 'view')", "snap"))
def success_over_time(t: Tables):
    return t.snapshots.where(F.col("media").isin("click", "view")).select("media", "ts", "event_id", monitor.percent(F.col("ok"), F.col("ok") + F.col("bad")).alias("pct"))


_INTERVALS = "SELECT media, row_number() OVER (PARTITION BY media ORDER BY ts, event_id) AS batch, ts, event_id, n, a / n AS rate FROM (SELECT media, ts, event_id, greatest(0, ok - lag(ok) OVER w) AS a, greatest(0, ok - lag(ok) OVER w) + greatest(0, bad - lag(bad) OVER w) AS n, lag(ok) OVER w AS o FROM snap WINDOW w AS (PARTITION BY media ORDER BY ts, event_id)) WHERE n > 0 AND o IS NOT NULL"


@query("interval_rates", sql(f"SELECT media, batch, n::BIGINT AS n, round(rate, 8) AS rate FROM ({_INTERVALS})", "snap"))
def interval_rates(t: Tables):
    return monitor.intervals(t.snapshots).select("media", F.col("batch").cast("long").alias("batch"), "n", F.round("rate", 8).alias("rate"))


@query("control_chart", sql(f"SELECT media, history, round(mean, 8) AS mean, round(sigma, 8) AS sigma, round(rate, 8) AS rate, round(mean - 3 * sigma, 8) AS bound, rate < mean - 3 * sigma AS alert FROM (SELECT media, count(*) FILTER (r > 1) AS history, avg(rate) FILTER (r > 1) AS mean, stddev_samp(rate) FILTER (r > 1) AS sigma, max(rate) FILTER (r = 1) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY batch DESC) AS r FROM ({_INTERVALS})) GROUP BY media) WHERE history >= 5 AND sigma > 0", "snap"))
def control_chart(t: Tables):
    out = monitor.control_chart(monitor.intervals(t.snapshots))
    return out.select("media", "history", *[F.round(c, 8).alias(c) for c in ("mean", "sigma", "rate", "bound")], "alert")


@query("control_bound", sql(f"SELECT media, round(avg(rate) - 3 * stddev_samp(rate), 8) AS bound FROM ({_INTERVALS}) GROUP BY media", "snap"))
def control_bound(t: Tables):
    return monitor.control_bound(monitor.intervals(t.snapshots)).withColumn("bound", F.round("bound", 8))


@query("count_trigger", sql("SELECT media, ts, event_id, step FROM (SELECT *, coalesce(lag(step) OVER (PARTITION BY media ORDER BY ts, event_id), 0) AS old FROM (SELECT *, (ok + bad) // 100 AS step FROM snap)) WHERE step > old", "snap"))
def count_trigger(t: Tables):
    return monitor.count_trigger(t.snapshots, 100).select("media", "ts", "event_id", "step")


@query("latest_state", sql("SELECT media, ts, ok, bad FROM snap QUALIFY row_number() OVER (PARTITION BY media ORDER BY ts DESC, event_id DESC) = 1", "snap"))
def latest_state(t: Tables):
    best = t.snapshots.groupBy("media").agg(F.max_by(F.struct("ts", "ok", "bad"), F.struct("ts", "event_id")).alias("s"))
    return best.select("media", "s.ts", "s.ok", "s.bad")


@query("distinct_media", "SELECT DISTINCT event_type AS media FROM events")
def distinct_media(t: Tables):
    return t.raw("events").select(F.col("event_type").alias("media")).distinct()


@query("audit_counts", "SELECT source, count(*) AS rows, count(*) - count(DISTINCT doc_id % 40) AS repeats, count(*) FILTER (trim(CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END) = '') AS blank FROM documents GROUP BY source")
def audit_counts(t: Tables):
    d = t.raw("documents").withColumn("key", F.col("doc_id") % 40).withColumn("body", F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text")))
    return d.groupBy("source").agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("key")).alias("repeats"), F.count_if(F.trim("body") == "").alias("blank"))


@query("audit_states", sql("SELECT coalesce(q.state::VARCHAR, 'absent') AS state, count(*) AS n FROM (SELECT doc_id FROM documents) d LEFT JOIN queue q ON q.id = d.doc_id GROUP BY 1", "queue"))
def audit_states(t: Tables):
    return t.raw("documents").select("doc_id").join(t.queue, F.col("id") == F.col("doc_id"), "left").groupBy(F.coalesce(F.col("state").cast("string"), F.lit("absent")).alias("state")).agg(F.count("*").alias("n"))


@query("dedup_exact", "SELECT doc_id, key, verdict FROM (SELECT doc_id, key, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY key) THEN 'first' WHEN h = first_value(h) OVER (PARTITION BY key ORDER BY doc_id) THEN 'repeat' ELSE 'differs' END AS verdict FROM (SELECT doc_id, doc_id % 300 AS key, lang || (doc_id % 2)::VARCHAR AS h FROM documents)) WHERE verdict <> 'repeat'")
def dedup_exact(t: Tables):
    """The first row of each id stays, equal repeats go, unequal repeats stay and are named."""
    d = t.raw("documents").select("doc_id", (F.col("doc_id") % 300).alias("key"), F.concat("lang", (F.col("doc_id") % 2).cast("string")).alias("h"))
    w = Window.partitionBy("key").orderBy("doc_id")
    verdict = F.when(F.row_number().over(w) == 1, "first").when(F.col("h") == F.first("h").over(w), "repeat").otherwise("differs")
    return d.withColumn("verdict", verdict).where("verdict <> 'repeat'").select("doc_id", "key", "verdict")


@query("changed_rows", sql(f"WITH new AS ({_PROGRESS}) SELECT n.* FROM new n JOIN (SELECT media, done - CASE WHEN length(media) % 2 = 0 THEN 1 ELSE 0 END AS old FROM new) o USING (media) WHERE done <> old", "queue").replace("\nWITH new AS", ", new AS", 1))
def changed_rows(t: Tables):
    """Rows of an export that differ from the one published before."""
    new = monitor.progress(t.queue)
    return new.exceptAll(new.withColumn("done", F.col("done") - F.when(F.length("media") % 2 == 0, 1).otherwise(0)))


# URLs

_PAGES = "SELECT page_id, url FROM pages"


@query("url_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, '^https?://m\\.')")
def url_filter(t: Tables):
    return t.raw("pages").where(F.col("url").rlike("/(en|fr)/") & ~F.col("url").rlike(r"^https?://m\.")).select("page_id", "url")


_ODD = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN regexp_extract(url, '^https?://[^/]+') || '/' WHEN 1 THEN replace(url, '://', '://video.') WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '.PDF' WHEN 3 THEN url || '%20http' ELSE url END AS url FROM pages"


def _odd(t: Tables):
    k, u = F.col("page_id") % 7, F.col("url")
    odd = F.when(k == 0, F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("/"))).when(k == 1, F.regexp_replace(u, "://", "://video."))
    return t.raw("pages").select("page_id", odd.when(k == 2, F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit(".PDF"))).when(k == 3, F.concat(u, F.lit("%20http"))).otherwise(u).alias("url"))


@query("url_non_article", f"SELECT page_id, url, trim(regexp_extract(b, '^[^/]*//[^/]*/(.*)$', 1), '/') = '' OR regexp_matches(regexp_extract(b, '^[^/]*//([^/]*)', 1), '^(video|podcasts)\\.') OR regexp_matches(rtrim(lower(b), '/'), '\\.(jpg|jpeg|png|webp|gif|pdf|mp3|mp4|xml)$') OR contains(url, 'image:media') OR contains(url, 'httpRequest') OR contains(url, '%20http') OR contains(b, '/es/9') AS bad FROM (SELECT *, split_part(url, '?', 1) AS b FROM ({_ODD}))")
def url_non_article(t: Tables):
    return _odd(t).select("page_id", "url", urls.not_article(F.col("url"), F.lit("m"), {"m": ("/es/9",)}).alias("bad"))


@query("url_clean", "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http://', 'https://') AS url FROM pages")
def url_clean(t: Tables):
    return t.raw("pages").select("page_id", urls.clean(F.col("url")).alias("url"))


@query("url_section", "SELECT page_id, nullif(split_part(split_part(regexp_replace(url, '^https?://[^/]+/?', ''), '?', 1), '/', 1), '') AS section, CASE WHEN starts_with(rel, 'http') THEN rel ELSE 'https://example.org' || rel END AS absolute FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://[^/]+', '') ELSE url END AS rel FROM pages)")
def url_section(t: Tables):
    rel = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://[^/]+", "")).otherwise(F.col("url"))
    path = F.split_part(F.split_part(F.regexp_replace("url", "^https?://[^/]+/?", ""), F.lit("?"), F.lit(1)), F.lit("/"), F.lit(1))
    return t.raw("pages").select("page_id", F.nullif(path, F.lit("")).alias("section"), F.when(rel.startswith("http"), rel).otherwise(F.concat(F.lit("https://example.org"), rel)).alias("absolute"))


@query("url_article", "SELECT page_id, CASE page_id % 4 WHEN 2 THEN NULL ELSE url END AS url FROM pages")
def url_article(t: Tables):
    k = F.col("page_id") % 4
    fields = F.when(k == 0, F.array(F.lit("http://map.xml"), F.concat(F.lit(" "), "url"))).when(k == 1, F.array("url")).when(k == 2, F.array(F.lit("x"), F.lit(""))).otherwise(F.array("url", F.lit("rest")))
    return t.raw("pages").select("page_id", urls.article_of(fields).alias("url"))


@query("url_list_quality", f"SELECT page_id % 5 AS list, count(*) AS n, count(*) - count(DISTINCT url) AS repeats, count(*) FILTER (trim(url) = '') AS blank, count(*) FILTER (NOT regexp_matches(url, '/[a-z]{{2}}/[0-9]+')) AS off_pattern, count(*) FILTER (regexp_matches(url, '[?#]|^http://')) AS dirty FROM ({_ODD}) GROUP BY 1")
def url_list_quality(t: Tables):
    u = F.col("url")
    return _odd(t).groupBy((F.col("page_id") % 5).alias("list")).agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("url")).alias("repeats"), F.count_if(F.trim("url") == "").alias("blank"), F.count_if(~u.rlike("/[a-z]{2}/[0-9]+")).alias("off_pattern"), F.count_if(u.rlike("[?#]|^http://")).alias("dirty"))


@query("url_pattern_probe", "SELECT matches, rank, url FROM (SELECT matches, url, row_number() OVER (PARTITION BY matches ORDER BY url) AS rank FROM (SELECT url, regexp_matches(url, '/[a-z]{2}/[0-9]+$') AS matches FROM pages)) WHERE rank <= 5")
def url_pattern_probe(t: Tables):
    m = t.raw("pages").select("url", F.col("url").rlike("/[a-z]{2}/[0-9]+$").alias("matches"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("matches").orderBy("url"))).where("rank <= 5").select("matches", "rank", "url")


@query("slug_date_match", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def slug_date_match(t: Tables):
    """Links whose compact date is that of the archive page."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    slug = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("/a/x-"), F.date_format(F.date_add("o_orderdate", 1), "yyyyMMdd"), F.lit("-y"))).when(F.col("o_orderkey") % 3 == 0, F.lit("/a/none")).otherwise(F.concat(F.lit("/a/x-"), day, F.lit("-y")))
    return t.raw("orders").where(F.regexp_extract(slug, r"(\d{8})", 1) == day).select("o_orderkey")


@query("mark_covered", sql("SELECT id, CASE WHEN state = 0 AND EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = queue.id) THEN 3 ELSE state END AS state FROM queue", "queue"))
def mark_covered(t: Tables):
    seen = t.raw("benchmark").select(F.col("item_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    return t.queue.join(seen, "id", "left").select("id", F.when((F.col("state") == 0) & F.col("seen"), 3).otherwise(F.col("state")).alias("state"))


@query("new_urls", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages WHERE regexp_replace(url, '[?#].*$', '') NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 3 = 0)")
def new_urls(t: Tables):
    bare = F.regexp_replace("url", "[?#].*$", "").alias("url")
    return t.raw("pages").select(bare).distinct().join(t.raw("pages").where("page_id % 3 = 0").select(bare), "url", "left_anti")


@query("append_dedup", "SELECT min(page_id) AS page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE page_id >= 20 AND regexp_extract(url, '^https?://([^/]+)', 1) NOT IN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages WHERE page_id < 20) GROUP BY host")
def append_dedup(t: Tables):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    rows = t.raw("pages").where("page_id >= 20").select("page_id", host).groupBy("host").agg(F.min("page_id").alias("page_id"))
    return urls.append_new(t.raw("pages").where("page_id < 20").select(host), rows, "host").select("page_id", "host")


@query("queue_insert", "SELECT media, url, min(page_id) AS id, 0 AS state FROM (SELECT page_id, event AS media, url FROM (SELECT page_id, url, (page_id % 5)::VARCHAR AS event FROM pages)) WHERE page_id % 4 <> 0 GROUP BY media, url HAVING NOT list_contains((SELECT list((page_id % 5)::VARCHAR || url) FROM pages WHERE page_id % 4 = 0), media || url)")
def queue_insert(t: Tables):
    """Insert or ignore on (media, url)."""
    p = t.raw("pages").select("page_id", (F.col("page_id") % 5).cast("string").alias("media"), "url")
    fresh = p.where("page_id % 4 <> 0").groupBy("media", "url").agg(F.min("page_id").alias("id"))
    return fresh.join(p.where("page_id % 4 = 0").select("media", "url"), ["media", "url"], "left_anti").withColumn("state", F.lit(0))


@query("dedup_urls", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(page_id) AS first FROM pages GROUP BY host")
def dedup_urls(t: Tables):
    """First place of each value."""
    return t.raw("pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.min("page_id").alias("first"))


@query("incremental_ids", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def incremental_ids(t: Tables):
    return t.raw("conversations").select("conv_id").dropDuplicates().join(t.raw("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti")


@query("absent_media", sql("SELECT DISTINCT media FROM queue WHERE media NOT IN (SELECT media FROM queue WHERE id % 3 = 0)", "queue"))
def absent_media(t: Tables):
    return t.queue.select("media").distinct().join(t.queue.where("id % 3 = 0").select("media").distinct(), "media", "left_anti")


@query("next_url", sql("SELECT id, media, url, state FROM queue WHERE state IN (0, 1) QUALIFY row_number() OVER (PARTITION BY media ORDER BY state, id) = 1", "queue"))
def next_url(t: Tables):
    return urls.next_urls(t.queue)


@query("next_batch", sql("SELECT media, arg_min(url, id) AS url, min(id) AS id FROM queue WHERE state = 0 GROUP BY media", "queue"))
def next_batch(t: Tables):
    return t.queue.where("state = 0").groupBy("media").agg(F.min_by("url", "id").alias("url"), F.min("id").alias("id"))


@query("url_state", "SELECT user_id AS id, CASE WHEN max((value > 60)::INT) = 1 THEN 2 WHEN count(*) >= 2 THEN 4 ELSE 1 END AS state FROM events WHERE event_type = 'error' GROUP BY user_id")
def url_state(t: Tables):
    tries = t.raw("events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), (F.col("value") > 60).alias("ok"))
    return urls.state_after(tries)


_XML = "'<urlset><url><loc> ' || url || ' </loc></url><url><loc>https://b.example/' || page_id || '</loc></url></urlset>'"
_INDEX = "'<sitemapindex><sitemap><loc>https://s.example/' || page_id || '-2024-0' || (1 + page_id % 9) || '.xml</loc>' || CASE WHEN page_id % 3 = 0 THEN '<lastmod>2024-0' || (1 + page_id % 7) || '-11T10:00:00Z</lastmod>' ELSE '' END || '</sitemap>' || chr(10) || '<sitemap><loc>https://s.example/plain</loc></sitemap></sitemapindex>'"


def _index(t: Tables):
    i = F.col("page_id")
    mod = F.when(i % 3 == 0, F.concat(F.lit("<lastmod>2024-0"), (1 + i % 7).cast("string"), F.lit("-11T10:00:00Z</lastmod>"))).otherwise("")
    xml = F.concat(F.lit("<sitemapindex><sitemap><loc>https://s.example/"), i.cast("string"), F.lit("-2024-0"), (1 + i % 9).cast("string"), F.lit(".xml</loc>"), mod, F.lit("</sitemap>\n<sitemap><loc>https://s.example/plain</loc></sitemap></sitemapindex>"))
    return t.raw("pages").select("page_id", F.explode(urls.sub_sitemaps(xml)).alias("s")).select("page_id", "s.loc", "s.lastmod")


@query("sitemap_locs", f"SELECT page_id, trim(unnest(regexp_extract_all({_XML}, '<loc>\\s*([^<]*?)\\s*</loc>', 1))) AS loc FROM pages")
def sitemap_locs(t: Tables):
    xml = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url><url><loc>https://b.example/"), F.col("page_id").cast("string"), F.lit("</loc></url></urlset>"))
    return t.raw("pages").select("page_id", F.explode(urls.locs(xml)).alias("loc"))


_SUBS = f"SELECT page_id, regexp_extract(b, '<loc>\\s*([^<]*?)\\s*</loc>', 1) AS loc, nullif(left(regexp_extract(b, '<lastmod>\\s*([^<]*?)\\s*</lastmod>', 1), 10), '') AS lastmod FROM (SELECT page_id, unnest(regexp_extract_all({_INDEX}, '(?s)<sitemap>(.*?)</sitemap>', 1)) AS b FROM pages)"


@query("sitemap_index", _SUBS)
def sitemap_index(t: Tables):
    return _index(t)


@query("sitemap_bound", f"SELECT page_id, loc FROM ({_SUBS}) WHERE coalesce(left(lastmod, 7), nullif(regexp_extract(loc, '(20[0-9]{{2}}-[0-9]{{2}})', 1), ''), '9999') >= '2024-05'")
def sitemap_bound(t: Tables):
    return _index(t).where(urls.may_cover(F.col("loc"), F.col("lastmod"), "2024-05")).select("page_id", "loc")


@query("sitemap_tree", "WITH RECURSIVE e AS (SELECT (page_id // 3)::VARCHAR AS parent, page_id::VARCHAR AS child FROM pages WHERE page_id > 0 AND page_id % 5 <> 0), w AS (SELECT '0' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM w JOIN e ON parent = node) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def sitemap_tree(t: Tables):
    lastmod = F.when(F.col("page_id") % 5 == 0, "2020-01-01").otherwise("2024-06-01")
    edges = t.raw("pages").where("page_id > 0").select(F.floor(F.col("page_id") / 3).cast("string").alias("parent"), F.col("page_id").cast("string").alias("child"), lastmod.alias("lastmod"))
    return urls.tree(edges, t.rows([("0",)], "node string"), "2024-05")


# readers and lists of addresses

_JSONL = "SELECT page_id % 3 AS file, 'map' || page_id AS sitemap, CASE WHEN page_id % 4 = 0 THEN 'error' ELSE 'ok' END AS type, [url, url || '/b'] AS urls FROM pages"


def _lines(t: Tables):
    """JSON lines as a crawler writes them."""
    kind = F.when(F.col("page_id") % 4 == 0, "error").otherwise("ok")
    record = F.struct(kind.alias("type"), F.concat(F.lit("map"), F.col("page_id").cast("string")).alias("sitemap"), F.array("url", F.concat("url", F.lit("/b"))).alias("urls"))
    return t.raw("pages").select((F.col("page_id") % 3).alias("file"), F.to_json(record).alias("value"))


@query("jsonl_flatten", f"SELECT sitemap, unnest(urls) AS url FROM ({_JSONL}) WHERE type = 'ok'")
def jsonl_flatten(t: Tables):
    from ..sources import readers

    return readers.flatten_jsonl(_lines(t), "value")


@query("jsonl_counts", f"SELECT coalesce(file::VARCHAR, 'TOTAL') AS file, sum(len(urls))::BIGINT AS n FROM ({_JSONL}) GROUP BY ROLLUP (file)")
def jsonl_counts(t: Tables):
    parsed = _lines(t).select("file", F.from_json("value", "type string, sitemap string, urls array<string>").alias("r"))
    out = parsed.rollup("file").agg(F.grouping("file").alias("g"), F.sum(F.size("r.urls")).alias("n"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("file").cast("string")).alias("file"), "n")


@query("union_tagged", "SELECT 'pages' AS config, url FROM pages UNION ALL SELECT 'even', url FROM pages WHERE page_id % 2 = 0")
def union_tagged(t: Tables):
    p = t.raw("pages")
    return p.select(F.lit("pages").alias("config"), "url").unionByName(p.where("page_id % 2 = 0").select(F.lit("even").alias("config"), "url"))


# control of a collection

_PAGED = "(SELECT user_id AS crawl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_id % 3 <> 0 AS empty FROM events)"


def _paged(t: Tables):
    """Users as crawls, their events as pages, two of three empty."""
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.raw("events").select(F.col("user_id").alias("crawl"), page.alias("page"), (F.col("event_id") % 3 != 0).alias("empty"))


@query("stop_rules", f"SELECT crawl, min(page) FILTER (empty AND b1 AND n > 1) AS two, min(page) FILTER (empty AND b1 AND b2 AND n > 2) AS three FROM (SELECT *, lag(empty) OVER w AS b1, lag(empty, 2) OVER w AS b2, row_number() OVER w AS n FROM {_PAGED} WINDOW w AS (PARTITION BY crawl ORDER BY page)) GROUP BY crawl")
def stop_rules(t: Tables):
    """The page at which a crawl stops by two, and by three, empty pages in a row."""
    two, three = (monitor.stop_page(_paged(t), "crawl", "page", F.col("empty"), k) for k in (2, 3))
    return two.withColumnRenamed("stop", "two").join(three.withColumnRenamed("stop", "three"), "crawl").select("crawl", F.col("two").cast("long").alias("two"), F.col("three").cast("long").alias("three"))


_LEDGER = "(SELECT event_type AS title, ts::DATE AS day, count(*) % 3 <> 0 AS ok FROM events GROUP BY ALL)"


@query("resume_ledger", f"SELECT title, day FROM {_LEDGER} WHERE NOT ok UNION SELECT title, unnest(generate_series(CASE WHEN last IS NULL THEN first ELSE last + 1 END, DATE '2024-02-10', INTERVAL 1 DAY))::DATE FROM (SELECT title, max(day) FILTER (ok) AS last, min(day) AS first FROM {_LEDGER} GROUP BY title) WHERE CASE WHEN last IS NULL THEN first ELSE last + 1 END <= DATE '2024-02-10'")
def resume_ledger(t: Tables):
    """Days that a run which goes on has to do: failed ones, and all after the last finished one."""
    day = F.col("ts").cast("date")
    rows = t.raw("events").groupBy(F.col("event_type").alias("title"), day.alias("day")).agg((F.count("*") % 3 != 0).alias("ok"))
    return monitor.days_to_do(rows, "title", "day", "ok", F.lit("2024-02-10").cast("date"))


@query("result_lines", sql("SELECT json_object('media', media, 'date', date, 'total', total)::VARCHAR AS json, media || ',' || date || ',' || total AS csv FROM tot", "tot"))
def result_lines(t: Tables):
    """Rows as the front end gives them: JSON and CSV text."""
    row = F.struct("media", "date", "total")
    return t.totals.select(F.to_json(row).alias("json"), F.to_csv(row).alias("csv"))
