"""N-gram counts, the n-gram store, series, vocabularies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import ngrams, series, vocab
from ..operators.lineage import cut, small_enough
from .registry import query, sql
from .tables import Tables

WORDS = ("the", "de", "und")
_IN = ", ".join(f"'{w}'" for w in WORDS)
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_ADMIT = f"gram NOT IN ({_STOP}) AND NOT regexp_matches(gram, '^[0-9]') AND length(gram) > 1"
_BARE = "regexp_replace(strip_accents(gram), '[^\\x00-\\x7F]', '', 'g')"
_SERIES = f"SELECT t.media, w.gram, t.date, coalesce(u.n, 0)::BIGINT AS n, t.total FROM tot t CROSS JOIN (SELECT unnest(['the', 'de', 'und']) AS gram) w LEFT JOIN uni u ON u.media = t.media AND u.gram = w.gram AND u.date = t.date"


@query("unigram_counts", sql("SELECT media, date, gram, n FROM uni", "uni"))
def unigram_counts(t: Tables):
    return t.uni


@query("bigram_counts", sql("SELECT media, date, gram, n FROM bi", "bi"))
def bigram_counts(t: Tables):
    return t.bi


@query("trigram_counts", sql("SELECT media, date, gram, n FROM tri", "tri"))
def trigram_counts(t: Tables):
    return t.tri


@query("daily_totals", sql("SELECT * FROM (SELECT 1 AS size, * FROM tot UNION ALL SELECT 2, * FROM tot2)", "tot", "tot2"))
def daily_totals(t: Tables):
    return t.totals.withColumn("size", F.lit(1)).unionByName(ngrams.daily_totals(t.bi).withColumn("size", F.lit(2)))


@query("ngram_min_total", sql("SELECT media, date, gram, n FROM (SELECT *, sum(n) OVER (PARTITION BY media, gram) AS s FROM bi) WHERE s > 10", "bi"))
def ngram_min_total(t: Tables):
    return ngrams.min_total(t.bi, 10)


@query("token_gc", sql("SELECT DISTINCT word FROM (SELECT unnest(string_split(gram, ' ')) AS word FROM (SELECT gram, sum(n) OVER (PARTITION BY media, gram) AS s FROM bi) WHERE s > 10)", "bi"))
def token_gc(t: Tables):
    """Words that a kept gram still uses."""
    used = ngrams.min_total(t.bi, 10).select("gram").distinct().select(F.explode(F.split("gram", " ")).alias("word")).distinct()
    return t.uni.select(F.col("gram").alias("word")).distinct().join(used, "word", "left_semi")


def _query(name: str, resolution: str, parts: str):
    columns = {"year": "date // 10000 AS year", "month": "(date // 100) % 100 AS month", "day": "date % 100 AS day"}
    picked = ", ".join(f"({c.split(' AS ')[0]})::INT AS {c.split(' AS ')[1]}" for k, c in columns.items() if k in parts)

    @query(name, sql(f"SELECT media, gram, {picked}, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total FROM ({_SERIES}) GROUP BY ALL", "uni", "tot"))
    def run(t: Tables):
        return ngrams.rolled_up(ngrams.series(t.uni, t.totals, WORDS), resolution)


_query("query_day", "day", "year month day")
_query("query_month", "month", "year month")
_query("query_year", "year", "year")


@query("query_multi", sql("SELECT media, gram, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total FROM (SELECT t.media, 'the' AS gram, coalesce(u.n, 0) AS n, total FROM tot t LEFT JOIN uni u ON u.media = t.media AND u.date = t.date AND u.gram = 'the' UNION ALL SELECT t.media, 'of the', coalesce(b.n, 0), total FROM tot2 t LEFT JOIN bi b ON b.media = t.media AND b.date = t.date AND b.gram = 'of the') GROUP BY ALL", "tot", "tot2"))
def query_multi(t: Tables):
    """Grams of several sizes: each is set against the totals of its size."""
    one, two = ngrams.tokenised(["The"]), ngrams.tokenised(["of the"])
    rows = ngrams.series(t.uni, t.totals, one).unionByName(ngrams.series(t.bi, ngrams.daily_totals(t.bi), two))
    return rows.groupBy("media", "gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("series_range", sql("SELECT media, date, n FROM uni WHERE gram = 'the' AND date BETWEEN 20240201 AND 20240331", "uni"))
def series_range(t: Tables):
    low, high = dates.parse_bound("2024-02", False), dates.parse_bound("2024-03", True)
    # the date filter reaches the articles before they are tokenised
    return ngrams.counts(t.dealt.where(F.col("date").between(low, high))).where("gram = 'the'").select("media", "date", "n")


@query("series_point", sql("SELECT date, n FROM uni WHERE media = 'en' AND gram = 'and'", "uni"))
def series_point(t: Tables):
    return ngrams.counts(t.dealt.where("media = 'en'")).where("gram = 'and'").select("date", "n")


@query("series_zero_fill", sql(f"SELECT * FROM ({_SERIES})", "uni", "tot"))
def series_zero_fill(t: Tables):
    return ngrams.series(t.uni, t.totals, WORDS)


@query("series_variants", sql("SELECT media, date, sum(n)::BIGINT AS n FROM uni WHERE gram IN ('été', 'ete', 'é', 'e') GROUP BY ALL", "uni"))
def series_variants(t: Tables):
    return ngrams.variants(t.uni, "été").unionByName(ngrams.variants(t.uni, "é")).groupBy("media", "date").agg(F.sum("n").alias("n"))


@query("freq_1e5", sql("SELECT media, gram, date, round(1e5 * n / nullif(total, 0), 6) AS f FROM (" + _SERIES + ")", "uni", "tot"))
def freq_1e5(t: Tables):
    return ngrams.series(t.uni, t.totals, WORDS).select("media", "gram", "date", F.round(series.freq(F.col("n"), F.col("total")), 6).alias("f"))


@query("word_month", sql("SELECT media, date // 100 AS month, sum(n)::BIGINT AS n FROM uni WHERE gram = 'de' GROUP BY ALL", "uni"))
def word_month(t: Tables):
    return t.uni.where("gram = 'de'").groupBy("media", dates.period(F.col("date"), "month").alias("month")).agg(F.sum("n").alias("n"))


def _top(resolution: str, expr: str, k: int) -> str:
    return f"SELECT media, period, gram, n, rank, stop FROM (SELECT media, {expr} AS period, gram, sum(n)::BIGINT AS n, row_number() OVER (PARTITION BY media, {expr} ORDER BY sum(n) DESC, gram) AS rank, (gram IN ({_STOP}) OR regexp_matches(gram, '^[0-9]')) AS stop FROM uni GROUP BY media, {expr}, gram) WHERE rank <= {k}"


for _name, _resolution, _expr in (("top_day", "day", "date"), ("top_month", "month", "date // 100"), ("top_year", "year", "date // 10000")):
    query(_name, sql(_top(_resolution, _expr, 500), "uni"))(lambda t, r=_resolution: ngrams.top(t.uni, r, 500))


@query("top_query", sql("SELECT gram, n FROM (" + _top("month", "date // 100", 500) + ") WHERE media = 'en' AND period = 202402 AND NOT stop ORDER BY rank LIMIT 10", "uni"))
def top_query(t: Tables):
    return ngrams.top_query(ngrams.top(t.uni, "month"), "en", 202402, 10)


_EVO = "SELECT gram, n / (SELECT sum(total) FROM tot WHERE media = 'en' AND date // 100 = {p}) * 1e5 AS f FROM (" + _top("month", "date // 100", 500) + ") WHERE media = 'en' AND period = {p} AND NOT stop"


@query("evolution", sql("SELECT way, gram, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta FROM (SELECT *, CASE WHEN a > b THEN 'up' ELSE 'down' END AS way, row_number() OVER (PARTITION BY a > b ORDER BY abs(a - b) DESC, gram) AS r FROM (SELECT gram, coalesce(x.f, 0) AS b, coalesce(y.f, 0) AS a FROM (" + _EVO.format(p=202401) + ") x FULL JOIN (" + _EVO.format(p=202403) + ") y USING (gram)) WHERE a <> b) WHERE r <= 10", "uni", "tot"))
def evolution(t: Tables):
    top = ngrams.top(t.uni.where("media = 'en'"), "month")
    out = ngrams.evolution(top, t.totals.where("media = 'en'"), "month", 202401, 202403, 10)
    return out.select("way", "gram", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query("stop_flag", sql(f"SELECT gram, list_bool_and(list_transform(string_split(gram, ' '), lambda w: w IN ({_STOP}) OR regexp_matches(w, '^[0-9]'))) AS stop FROM (SELECT DISTINCT gram FROM bi)", "bi"))
def stop_flag(t: Tables):
    return t.bi.select("gram").distinct().withColumn("stop", text.stop_flag(F.split("gram", " ")))


@query("vocab_census", sql("SELECT * FROM cens", "cens"))
def vocab_census(t: Tables):
    return t.census


@query("vocab_census_period", sql("SELECT media, gram, count(*) AS active_days, sum(n)::BIGINT AS total FROM uni WHERE date BETWEEN 20240201 AND 20240229 GROUP BY ALL", "uni"))
def vocab_census_period(t: Tables):
    return vocab.census(ngrams.counts(t.dealt.where("date between 20240201 and 20240229")))


@query("vocab_exclude", sql(f"SELECT media, gram, total FROM cens WHERE {_ADMIT}", "cens"))
def vocab_exclude(t: Tables):
    return t.census.where(vocab.admissible(F.col("gram"))).select("media", "gram", "total")


_CATS = [("the", "other"), ("and", "other"), ("que", "other"), ("thand", "noun"), ("mente", "verb"), ("ención", "verb"), ("keit", "noun"), ("ver", "verb"), ("ie", "proper"), ("tion", "noun"), ("eau", "proper"), ("ing", "verb"), ("ed", "verb")]
_CATS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CATS) + ") AS c(gram, category)"


def _categories(t: Tables):
    return t.rows(_CATS, "gram string, category string")


@query("vocab_select", sql(f"SELECT media, gram, total FROM cens LEFT JOIN {_CATS_SQL} USING (gram) WHERE {_ADMIT} AND NOT contains(gram, '''') AND gram NOT IN (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM benchmark) AND (category IN ('noun', 'proper') OR category IS NULL)", "cens"))
def vocab_select(t: Tables):
    rejected = t.raw("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("gram")).distinct()
    return vocab.select_vocabulary(t.census, _categories(t), rejected, ("noun", "proper")).select("media", "gram", "total")


@query("filter_category", sql(f"SELECT kind, media, gram FROM (SELECT unnest(['all', 'no_verbs', 'nouns', 'proper']) AS kind, * FROM cens LEFT JOIN {_CATS_SQL} USING (gram) WHERE total > 20) WHERE kind = 'all' OR (kind = 'no_verbs' AND category IS DISTINCT FROM 'verb') OR (kind = 'nouns' AND category IN ('noun', 'proper')) OR (kind = 'proper' AND category = 'proper')", "cens"))
def filter_category(t: Tables):
    words, out = t.census.where("total > 20"), None
    for kind in ("all", "no_verbs", "nouns", "proper"):
        rows = vocab.filter_category(words, _categories(t), kind).select(F.lit(kind).alias("kind"), "media", "gram")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("category_counts", sql(f"SELECT coalesce(category, 'unknown') AS category, count(*) AS n FROM cens LEFT JOIN {_CATS_SQL} USING (gram) GROUP BY 1", "cens"))
def category_counts(t: Tables):
    return t.census.join(_categories(t), "gram", "left").groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("classify_rules", sql(f"SELECT DISTINCT gram, coalesce(c.category, e.category, CASE WHEN regexp_matches(gram, '^[0-9]') THEN 'other' END, 'unknown') AS category FROM (SELECT gram, regexp_extract(gram, '^(?:l|d|s|n|j|m|t|c|qu|jusqu|lorsqu|puisqu)''(.+)$', 1) AS base FROM (SELECT DISTINCT gram FROM uni)) LEFT JOIN {_CATS_SQL} USING (gram) LEFT JOIN {_CATS_SQL.replace('AS c(gram', 'AS e(base')} USING (base)", "uni"))
def classify_rules(t: Tables):
    """Category by table, else by the word behind an elision, else by form."""
    words = t.uni.select("gram").distinct().withColumn("base", text.elided(F.col("gram")))
    cats = _categories(t)
    rows = words.join(cats, "gram", "left").join(cats.select(F.col("gram").alias("base"), F.col("category").alias("of_base")), "base", "left")
    return rows.select("gram", F.coalesce("category", "of_base", F.when(F.col("gram").rlike("^[0-9]"), "other"), F.lit("unknown")).alias("category"))


@query("vocab_sliding", sql(f"SELECT gram, count(*) AS windows, max(days)::BIGINT AS best, min(start // 2) || CASE WHEN min(start) % 2 = 0 THEN '-01' ELSE '-07' END AS first, max(start // 2) || CASE WHEN max(start) % 2 = 0 THEN '-01' ELSE '-07' END AS last FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY days DESC, gram) AS r FROM (SELECT gram, start, sum(days) AS days FROM (SELECT gram, days, unnest([sem - 1, sem]) AS start FROM (SELECT gram, (date // 10000) * 2 + ((date // 100) % 100 > 6)::INT AS sem, count(DISTINCT date) AS days FROM uni WHERE {_ADMIT} GROUP BY ALL)) GROUP BY ALL)) WHERE r <= 50 GROUP BY gram", "uni"))
def vocab_sliding(t: Tables):
    return vocab.sliding(t.uni)


_UNIT = f"SELECT media, gram, total, CASE WHEN total < 0.01 * max(total) OVER (PARTITION BY media, {_BARE}) THEN first_value(gram) OVER (PARTITION BY media, {_BARE} ORDER BY total DESC, gram) ELSE gram END AS unit FROM cens"


@query("variant_absorb", sql(_UNIT, "cens"))
def variant_absorb(t: Tables):
    return vocab.absorbed(t.census)


@query("vocab_topk", sql(f"SELECT media, unit, active_days, total, rank FROM (SELECT media, unit, count(DISTINCT date) AS active_days, sum(n)::BIGINT AS total, row_number() OVER (PARTITION BY media ORDER BY count(DISTINCT date) DESC, unit) AS rank FROM uni JOIN (SELECT media, gram, unit FROM ({_UNIT})) USING (media, gram) GROUP BY media, unit) WHERE rank <= 40", "uni", "cens"))
def vocab_topk(t: Tables):
    return vocab.top_units(t.uni, vocab.absorbed(t.census), 40)


@query("grid_position", sql("SELECT media, date, total, row_number() OVER (PARTITION BY media ORDER BY date) - 1 AS pos FROM tot", "tot"))
def grid_position(t: Tables):
    return vocab.grid(t.totals)


_TOP20 = "SELECT media, gram FROM (SELECT media, gram, row_number() OVER (PARTITION BY media ORDER BY active_days DESC, total DESC, gram) AS r FROM cens) WHERE r <= 20"
MATRIX_SQL = f"SELECT w.media, w.gram, pos, date, coalesce(n, 0)::BIGINT AS n, total FROM ({_TOP20}) w JOIN (SELECT *, row_number() OVER (PARTITION BY media ORDER BY date) - 1 AS pos FROM tot) USING (media) LEFT JOIN uni USING (media, gram, date)"


def matrix(t: Tables, k: int = 20):
    words = t.census.withColumn("r", F.row_number().over(Window.partitionBy("media").orderBy(F.desc("active_days"), F.desc("total"), "gram"))).where(F.col("r") <= k)
    return vocab.matrix_long(t.uni, t.totals, words)


@query("matrix_long", sql(MATRIX_SQL, "uni", "tot", "cens"))
def matrix_long(t: Tables):
    return matrix(t)


@query("unified_counts", sql("SELECT gram, date, sum(n)::BIGINT AS n FROM uni GROUP BY ALL", "uni"))
def unified_counts(t: Tables):
    return vocab.unified(t.uni)


@query("unified_coverage", sql("SELECT gram, count(DISTINCT media) AS media_count, sum(n)::BIGINT AS total FROM uni GROUP BY ALL", "uni"))
def unified_coverage(t: Tables):
    return vocab.coverage(t.uni)


@query("totals_pivot", sql("SELECT date, sum(total) FILTER (media = 'de')::BIGINT AS de, sum(total) FILTER (media = 'en')::BIGINT AS en, sum(total) FILTER (media = 'es')::BIGINT AS es, sum(total) FILTER (media = 'fr')::BIGINT AS fr FROM tot GROUP BY date", "tot"))
def totals_pivot(t: Tables):
    return t.totals.groupBy("date").pivot("media", ["de", "en", "es", "fr"]).agg(F.sum("total"))


@query("media_bounds", sql("SELECT media, min(date) AS first, max(date) AS last FROM tot WHERE date BETWEEN 20240110 AND 20240420 GROUP BY ALL", "tot"))
def media_bounds(t: Tables):
    return t.totals.where("date between 20240110 and 20240420").groupBy("media").agg(F.min("date").alias("first"), F.max("date").alias("last"))


@query("decode_tokens", sql("SELECT w1, w2, date, n FROM (SELECT split_part(gram, ' ', 1) AS w1, split_part(gram, ' ', 2) AS w2, date, n FROM bi)", "bi"))
def decode_tokens(t: Tables):
    """Facts by word id, joined back to their words. Facts and ids are made once; ids are broadcast if they are few."""
    facts = cut(t.bi.select(F.split_part("gram", F.lit(" "), F.lit(1)).alias("a"), F.split_part("gram", F.lit(" "), F.lit(2)).alias("b"), "date", "n"))
    words = facts.select(F.explode(F.array("a", "b")).alias("word")).distinct()
    ids = cut(vocab.new_ids(t.rows([], "id long, word string"), words))
    few = small_enough(ids)
    side = lambda i, word: (F.broadcast if few else lambda x: x)(ids.select(F.col("id").alias(i), F.col("word").alias(word)))
    coded = facts.join(side("i", "a"), "a").join(side("j", "b"), "b").select("i", "j", "date", "n")
    return coded.join(side("i", "w1"), "i").join(side("j", "w2"), "j").select("w1", "w2", "date", "n")


@query("vocab_ids", sql("SELECT 1000 + row_number() OVER (ORDER BY word) AS id, word FROM (SELECT DISTINCT gram AS word FROM uni WHERE media = 'fr' AND gram NOT IN (SELECT gram FROM uni WHERE media = 'es'))", "uni"))
def vocab_ids(t: Tables):
    known = t.uni.where("media = 'es'").select(F.col("gram").alias("word")).distinct().withColumn("id", F.lit(1000).cast("long"))
    return vocab.new_ids(known, t.uni.where("media = 'fr'").select(F.col("gram").alias("word")))


@query("tokenize_query", "SELECT doc_id, regexp_extract_all(replace(lower(regexp_replace(text, '([A-Z])\\.', '\\1', 'g')), '’', ''''), '[a-zà-ÿ0-9'']+') AS tokens FROM documents")
def tokenize_query(t: Tables):
    return t.raw("documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


@query("sentences", sql("SELECT id, len(t) AS size, list_aggregate(t, 'string_agg', ' ') AS sentence FROM sent WHERE len(t) > 0", "sent"))
def sentences(t: Tables):
    return ngrams.sentence_tokens(t.dealt, "id").select("id", F.size("tokens").cast("long").alias("size"), F.array_join("tokens", " ").alias("sentence"))


@query("tokens_long", sql("SELECT id, media, count(*) AS tokens, count(DISTINCT gram) AS distinct_tokens FROM (SELECT id, media, unnest(t) AS gram FROM sent) GROUP BY ALL", "sent"))
def tokens_long(t: Tables):
    return ngrams.sentence_tokens(t.dealt, "id", "media").select("id", "media", F.explode("tokens").alias("gram")).groupBy("id", "media").agg(F.count("*").alias("tokens"), F.countDistinct("gram").alias("distinct_tokens"))


@query("count_terms", sql("SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(t) AS gram FROM sent) JOIN (SELECT gram FROM (SELECT gram, count(DISTINCT id) AS df FROM (SELECT id, unnest(t) AS gram FROM sent) GROUP BY gram) WHERE df >= 40) USING (gram) GROUP BY ALL", "sent"))
def count_terms(t: Tables):
    rows = ngrams.counts(t.dealt, 1, ("id",))
    common = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 40").select("gram")
    return rows.join(common, "gram").select("id", "gram", "n")


_TFIDF = "tf AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(t) AS gram FROM sent) GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING df >= 20 AND df <= 0.5 * (SELECT count(DISTINCT id) FROM tf)), w AS (SELECT id, gram, n * (ln((1.0 + (SELECT count(DISTINCT id) FROM tf)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram)), v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM w)"


def _tfidf(t: Tables):
    from ..operators.corr import tfidf

    return tfidf(ngrams.counts(t.dealt, 1, ("id",)), 20, 0.5)


@query("tfidf", sql("SELECT id, gram, round(tfidf, 8) AS tfidf FROM v", "sent").replace("\nSELECT id, gram, round", f",\n{_TFIDF}\nSELECT id, gram, round"))
def tfidf(t: Tables):
    return _tfidf(t).select("id", "gram", F.round("tfidf", 8).alias("tfidf"))


@query("tfidf_by_period", sql("SELECT month, gram, round(s / c, 8) AS mean FROM (SELECT date // 100 AS month, gram, sum(tfidf) AS s FROM v JOIN articles USING (id) GROUP BY ALL) JOIN (SELECT date // 100 AS month, count(*) AS c FROM articles GROUP BY ALL) USING (month)", "sent").replace("\nSELECT month", f",\n{_TFIDF}\nSELECT month", 1))
def tfidf_by_period(t: Tables):
    """Mean weight of a term over all articles of a month; an article without the term counts 0."""
    month = t.articles.select("id", dates.period(F.col("date"), "month").alias("month"))
    size = month.groupBy("month").agg(F.count("*").alias("c"))
    sums = _tfidf(t).join(month, "id").groupBy("month", "gram").agg(F.sum("tfidf").alias("s"))
    return sums.join(F.broadcast(size), "month").select("month", "gram", F.round(F.col("s") / F.col("c"), 8).alias("mean"))


@query("term_by_period", sql("SELECT date // 10000 AS year, gram, sum(n)::BIGINT AS n FROM bi GROUP BY ALL", "bi"))
def term_by_period(t: Tables):
    return t.bi.groupBy(dates.period(F.col("date"), "year").alias("year"), "gram").agg(F.sum("n").alias("n"))
