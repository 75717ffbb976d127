"""The registry of queries and of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Common table expressions of the oracles: name -> (names it needs, SQL).
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "articles": ((), "SELECT doc_id AS id, coalesce(lang, 'unknown') AS media, source AS section, text AS contenu, CAST(strftime(DATE '2024-01-01' + (doc_id % 120)::INT, '%Y%m%d') AS INT) AS date FROM documents"),
    "sent": (("articles",), "SELECT id, media, date, regexp_extract_all(s, '[a-zà-ÿ0-9'']+') AS t FROM (SELECT id, media, date, unnest(string_split_regex(replace(lower(regexp_replace(contenu, '([A-Z])\\.', '\\1', 'g')), '’', ''''), '[!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~\\n]')) AS s FROM articles)"),
    "uni": (("sent",), "SELECT media, date, gram, count(*) AS n FROM (SELECT media, date, unnest(t) AS gram FROM sent) GROUP BY ALL"),
    "bi": (("sent",), "SELECT media, date, gram, count(*) AS n FROM (SELECT media, date, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM sent) GROUP BY ALL"),
    "tri": (("sent",), "SELECT media, date, gram, count(*) AS n FROM (SELECT media, date, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram FROM sent) GROUP BY ALL"),
    "tot": (("uni",), "SELECT media, date, sum(n)::BIGINT AS total FROM uni GROUP BY ALL"),
    "tot2": (("bi",), "SELECT media, date, sum(n)::BIGINT AS total FROM bi GROUP BY ALL"),
    "cens": (("uni",), "SELECT media, gram, count(*) AS active_days, sum(n)::BIGINT AS total FROM uni GROUP BY ALL"),
    "brand": ((), "SELECT p_brand AS mot, CAST(l_shipdate AS DATE) AS date, count(*) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"),
    "btot": (("brand",), "SELECT date, sum(x)::BIGINT AS n_tot FROM brand GROUP BY ALL"),
    "bser": (("brand", "btot"), "SELECT m.mot, t.date, coalesce(b.x, 0)::BIGINT AS x, t.n_tot FROM (SELECT DISTINCT mot FROM brand) m CROSS JOIN btot t LEFT JOIN brand b ON b.mot = m.mot AND b.date = t.date"),
    "snap": ((), "SELECT event_type AS media, ts, event_id, sum(CASE WHEN floor(value)::BIGINT % 2 = 0 THEN 1 ELSE 0 END) OVER w::BIGINT AS ok, sum(CASE WHEN floor(value)::BIGINT % 2 <> 0 THEN 1 ELSE 0 END) OVER w::BIGINT AS bad FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "queue": ((), "SELECT page_id AS id, regexp_extract(url, '^https?://([^/]+)', 1) AS media, url, (page_id % 6)::INT AS state FROM pages"),
}


def sql(body: str, *names: str) -> str:
    """A query over CTEs, with those that they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for d in CTE[name][0]:
            add(d)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in needed) + "\n" if needed else "") + body


def query(name: str, oracle: str | None = None):
    """Registers a function of Tables as a query, with its oracle."""

    def put(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return put
