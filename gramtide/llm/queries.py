"""Queries of the training-data operators: name -> function of (session, folder), and DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus, exact_dedup, knn_quality, langid, licenses, line_dedup, mixing, phrases, pieces, quality_rules, simhash, suffix_dedup, token_counts
from .common import table

#: Folder of the public tokenizers' files; each machine has it.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level vocabulary's tokenizer cuts a text before it merges (fixed value of that vocabulary).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(mixing.leaves(table(spark, sf_dir, "documents")))


def op4_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.documents_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", CUT, END_OF_DOCUMENT)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_knn_quality": op4_knn_quality,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_langid": op10_langid,
    "op11_licenses": op11_licenses,
    "op12_collocations": op12_collocations,
    "op13_clustering": op13_clustering,
}

def _level(name: str, key: str, parent: str, given: str, weight: str, source: str) -> str:
    """One level of the budget tree, as CTEs that end in ``name`` (key..., given)."""
    part = f"PARTITION BY {parent}" if parent else ""
    last = key.split(", ")[-1]
    return f"""
        {name}_a AS (SELECT {key}, sum(tokens) * {mixing.MAX_EPOCHS} AS room, {weight} AS weight FROM stats GROUP BY {key}),
        {name}_b AS (SELECT a.*, {given} AS above FROM {name}_a a {source}),
        {name}_c AS (SELECT *, (above - coalesce(sum(room) OVER ({part} ORDER BY room / weight, {last} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({part} ORDER BY room / weight, {last} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM {name}_b),
        {name} AS (SELECT {key}, CASE WHEN room / weight <= level THEN room::DOUBLE
            ELSE (max(CASE WHEN room / weight > level THEN level END) OVER ({part})) * weight END AS given FROM {name}_c)"""


_LANGUAGE_WEIGHT = "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mixing.WEIGHTS["language"].items()) + " ELSE 1 END"
_MIXING = f"""
    WITH narrow AS (
        SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]$') THEN 'domain' || (right(source, 1)::INT % 4)::VARCHAR ELSE 'other' END AS domain,
               coalesce(lang, '') AS language, coalesce(source, '') AS source,
               coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0) AS tokens
        FROM documents),
    usable AS (SELECT * FROM narrow WHERE tokens > 0),
    stats AS (SELECT domain, language, source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM usable GROUP BY ALL),
    {_level("l1", "domain", "", f"floor((SELECT sum(tokens) FROM usable) * {mixing.BUDGET_SHARE}::DOUBLE)", "1", "")},
    {_level("l2", "domain, language", "domain", "l1.given", _LANGUAGE_WEIGHT, "JOIN l1 USING (domain)")},
    {_level("l3", "domain, language, source", "domain, language", "l2.given", "1", "JOIN l2 USING (domain, language)")},
    plan AS (SELECT s.*, given, least(floor(given / tokens), {mixing.MAX_EPOCHS})::BIGINT AS epochs FROM stats s JOIN l3 USING (domain, language, source)),
    placed AS (SELECT u.*, epochs, floor(given)::BIGINT - epochs * p.tokens AS rest,
                  ('0x' || left(md5('{mixing.SEED}:' || epochs::VARCHAR || ':' || doc_id::VARCHAR), 13))::BIGINT AS place
           FROM usable u JOIN plan p USING (domain, language, source)),
    summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
    SELECT doc_id, domain, language, source, tokens, copies
    FROM (SELECT *, epochs + (rest > 0 AND upto <= rest)::BIGINT AS copies FROM summed) WHERE copies > 0
"""


_F, _S = "(a::HUGEINT * a * 1000000)", "score DESC, a DESC, phrase"
_COLLOCATIONS = f"""
    WITH pieces AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w
                    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
    one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM pieces) GROUP BY ALL),
    two AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces)) GROUP BY ALL),
    three AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM pieces)) GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
    over AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
    cuts AS (
        SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, l.f AS l, r.f AS r, 1 AS k FROM two t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN one r ON r.lang = t.lang AND r.x = t.y
            LEFT JOIN over o ON o.lang = t.lang AND o.x = t.x AND o.y = t.y WHERE t.f >= {phrases.MIN_COUNT} AND (o.f IS NULL OR 100 * o.f < {phrases.COVERED} * t.f)
        UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, l.f, r.f, 1 FROM three t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
        UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, l.f, r.f, 2 FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.x = t.z),
    scored AS (SELECT *, ({_F} // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_S}) AS rank FROM worst)
    SELECT lang, rank, phrase, a, l, r, (SELECT sum(f) FROM one WHERE one.lang = ranked.lang)::BIGINT AS n, score FROM ranked WHERE rank <= {phrases.TOP}
"""


def _clustering() -> str:
    """Each round as two tables: what the vectors are nearest to (distance and number in one), and the centroids after."""
    dot = "list_sum(list_transform(list_zip(o.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = lambda k: f"a{k} AS MATERIALIZED (SELECT o.row, any_value(o.vec_id) AS vec_id, any_value(o.v) AS v, min({dot} * {annulus.CLUSTERS} + c.c) AS best FROM ok o, c{k} c GROUP BY o.row)"
    parts = [
        f"ok AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {annulus.SCALE})::BIGINT) AS v FROM embeddings WHERE len(embedding) = {annulus.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{annulus.SEED}:' || vec_id) AS h, v FROM ok ORDER BY h LIMIT {annulus.CLUSTERS}))",
    ]
    for k in range(annulus.ROUNDS):
        parts += [
            near(k),
            f"s{k} AS (SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT best % {annulus.CLUSTERS} AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i)",
            f"c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM s{k} GROUP BY c) m USING (c))",
        ]
    last = annulus.ROUNDS
    parts += [near(last), f"f AS (SELECT vec_id, (best % {annulus.CLUSTERS})::INT AS cluster, (best // {annulus.CLUSTERS})::BIGINT AS distance FROM a{last})"]
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM f JOIN c{last} c ON c.c = f.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op12_collocations": _COLLOCATIONS,
    "op13_clustering": _clustering(),
    "op1_line_dedup": f"""
        WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
        boiler AS (SELECT line FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
        numbered AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        kept AS (SELECT n.doc_id, count(*) AS n_lines, count(b.line) AS n_removed_lines,
                        coalesce(string_agg(n.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS text
                 FROM numbered n LEFT JOIN boiler b USING (line) GROUP BY n.doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM (SELECT doc_id FROM documents) LEFT JOIN kept USING (doc_id)
    """,
    "op3_mixing": _MIXING,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
}
