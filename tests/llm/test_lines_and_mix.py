import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from gramtide.llm import line_dedup, mixing
from gramtide.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_mixing", "op9_exact_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert collections.Counter(map(tuple, mine.select(*columns).collect())) == collections.Counter(want)


def test_lines_near_and_over_the_threshold(spark, docs):
    sites = [f"s{k}" for k in range(14)]
    rows = [(k, f"wide\nnine\nown {k}\n\n \nwide" if k < 9 else f"wide\nown {k}", "en", s) for k, s in enumerate(sites)]
    rows += [(20, "nine", "en", "s0"), (21, None, "en", "s1"), (22, "", None, None), (23, "wide", None, None), (None, "wide\nx", "en", "s3"), (0, rows[0][1], "en", "s0")]
    out = {(r.doc_id, r.text): (r.n_lines, r.n_removed_lines) for r in line_dedup.remove_boilerplate(docs(rows), min_sites=10).collect()}
    assert out[0, "nine\nown 0\n\n "] == (6, 2) and out[9, "own 9"] == (2, 1)
    assert out[20, "nine"] == (1, 0) and out[21, None] == (0, 0) and out[22, ""] == (1, 0) and out[23, ""] == (1, 1) and out[None, "x"] == (2, 1)
    clashing = docs(rows).columns  # n_lines is one of them
    assert line_dedup.remove_boilerplate(docs(rows)).columns == [c for c in clashing if c != "n_lines"] + ["n_lines", "n_removed_lines"]
    assert line_dedup.remove_boilerplate(docs([])).count() == 0


def test_blank_lines_and_ties(spark, docs):
    blank = ["\t", " \r", "", "   "]
    rows = [(k, "\n".join([*blank, "ten", "ten", f"nine {k % 9}"]), "en", f"s{k}") for k in range(10)]
    out = line_dedup.remove_boilerplate(docs(rows), min_sites=10).collect()
    assert {r.text for r in out} == {"\n".join([*blank, f"nine {k % 9}"]) for k in range(10)}  # ten sites: exactly the bound
    assert {(r.n_lines, r.n_removed_lines) for r in out} == {(7, 2)}
    assert line_dedup.boilerplate(docs(rows), min_sites=11).count() == 0
    long = "\n".join(f"line {i}" for i in range(20_000))
    got = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in line_dedup.remove_boilerplate(docs([(k, long if k else "line 7", "en", f"s{k}") for k in range(4)]), min_sites=4).collect()}
    assert got == {0: (1, 1), 1: (20_000, 1), 2: (20_000, 1), 3: (20_000, 1)}


def fill(given, nodes):
    """nodes: {name: (room, weight)}; plain water-filling."""
    out, open_ = {}, dict(nodes)
    while open_:
        level = (given - sum(out.values())) / sum(w for _, w in open_.values())
        full = [k for k, (room, w) in open_.items() if room <= level * w]
        if not full:
            return out | {k: level * w for k, (_, w) in open_.items()}
        out |= {k: open_.pop(k)[0] for k in full}
    return out


def test_budgets_go_to_siblings_first(spark):
    stats = [("a", "x", "1", 10, 100), ("a", "x", "2", 10, 1000), ("a", "y", "1", 10, 1000), ("b", "x", "1", 10, 5000), ("b", "z", "9", 1, 1)]
    df = spark.createDataFrame(stats, "domain string, language string, source string, docs long, tokens long")
    got = {(r.domain, r.language, r.source): r.given for r in mixing.budgets(df, 4000, {"domain": {"a": 3}}, 1).collect()}
    top = fill(4000, {"a": (2100, 3), "b": (5001, 1)})
    a, b = fill(top["a"], {"x": (1100, 1), "y": (1000, 1)}), fill(top["b"], {"x": (5000, 1), "z": (1, 1)})
    ax = fill(a["x"], {"1": (100, 1), "2": (1000, 1)})
    want = {("a", "x", "1"): ax["1"], ("a", "x", "2"): ax["2"], ("a", "y", "1"): a["y"], ("b", "x", "1"): b["x"], ("b", "z", "9"): b["z"]}
    assert got == pytest.approx(want)


def test_edge_rows_of_a_mix(spark, docs):
    rows = [(1, "a b c", "en", "s1"), (1, "a b c", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, "d", None, None), (None, "e f", "fr", "s2")]
    out = mixing.selection(mixing.leaves(docs(rows)), budget_share=2.0).collect()
    assert sorted((r.doc_id or 0, r.copies) for r in out) == [(0, 2), (1, 2), (1, 2), (4, 2)]
    assert mixing.selection(mixing.leaves(docs(rows)), budget_share=0.0).count() == 0
    assert mixing.selection(mixing.leaves(docs([]))).count() == 0


def test_a_leaf_takes_the_longest_prefix(spark):
    n = 30_000
    narrow = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("d").alias("domain"), F.lit("l").alias("language"), F.lit("s").alias("source"), (F.col("id") % 7).alias("tokens"))
    total = sum(k % 7 for k in range(n))
    out = mixing.selection(narrow, 1.3)
    assert {r.copies for r in out.select("copies").distinct().collect()} == {1, 2}
    used = out.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert int(1.3 * total) - 7 < used <= int(1.3 * total)


def test_halves_of_the_line_hash_are_independent(spark):
    """Two lines that share one half must not share the other by construction."""
    lines = spark.range(2000).select(F.concat(F.lit("line "), F.col("id")).alias("line"))
    halves = lines.select(line_dedup._hash(F.col("line")).alias("h")).select("h.x", "h.y")
    # the second half is no hash that is seeded with the first one
    assert halves.where(F.xxhash64("x", F.lit(1)) == F.col("y")).count() == 0
    chained = lines.select(F.xxhash64("line").alias("x"), F.xxhash64("line", F.lit(1)).alias("z"), line_dedup._hash(F.col("line"))["y"].alias("y"))
    assert chained.where("z = y").count() == 0 and halves.distinct().count() == 2000


def test_a_document_of_very_many_boilerplate_lines(spark, docs):
    """A million lines, half of them boilerplate and all different: linear time."""
    import time

    text = "\n".join(f"shared {k}" if k % 2 else f"own {k}" for k in range(1_000_000))
    rows = [(k, text if k == 0 else text.replace("own", f"own{k}"), "en", f"s{k}") for k in range(3)]
    began = time.time()
    got = line_dedup.remove_boilerplate(docs(rows), min_sites=3).select("doc_id", "n_lines", "n_removed_lines", F.length("text").alias("n")).collect()
    assert {(r.n_lines, r.n_removed_lines) for r in got} == {(1_000_000, 500_000)} and time.time() - began < 120
    own = "\n".join(f"own {k}" for k in range(0, 1_000_000, 2))
    assert {r.doc_id: r.n for r in got}[0] == len(own)


def test_rows_that_share_an_id(spark, docs):
    rows = [(k, f"x{k}\ncommon", "en", f"s{k}") for k in range(10)] + [(None, "common\na", "en", "s1"), (None, "b\ncommon\ncommon", "en", "s2"), (3, "common", "en", "s3"), (3, "common", "en", "s3")]
    got = line_dedup.remove_boilerplate(docs(rows)).select("doc_id", "text", "n_removed_lines").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text, r.n_removed_lines) for r in got) == sorted([((False, k), f"x{k}", 1) for k in range(10)] + [((True, 0), "a", 1), ((True, 0), "b", 2), ((False, 3), "", 1), ((False, 3), "", 1)])
