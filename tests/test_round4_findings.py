"""Inputs that the review of round 4 found."""

import duckdb
import numpy as np
import pandas as pd

from gramtide.functions import text
from gramtide.operators import lanczos, spectral
from gramtide.plans import catalog


def test_html_meta_knows_all_entities(spark, tmp_path):
    titles = ["a &copy; &#60;b&#x3e; &apos;&LT; &amp;lt;", "&notit; &acE; &#128; &#0; &#1; &#x110000; &#9999999999; &nosuch; &amp &", "&eacute;t&eacute;"]
    html = [f'<html lang="fr"><title>{t}</title>' for t in titles]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(html)), "html": html}))
    got = sorted(tuple(r) for r in catalog.QUERIES["html_meta"](spark, str(tmp_path)).collect())
    assert [r[1] for r in got] == ["a © <b> '< &lt;", "¬it; ∾̳ € �  � � &nosuch; &amp &", "été"] == [text.unescaped(t) for t in titles]
    assert got == sorted(con.sql(catalog.ORACLE["html_meta"]).fetchall())


def test_kernel_grid_widths_follow_the_median_distance(spark, tmp_path):
    rng = np.random.default_rng(5)
    z = 3 * rng.standard_normal((60, 4))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["kernel_grid"](spark, str(tmp_path)).orderBy("gamma").collect()
    middle = 1 / (2 * np.median(((z[11:] - z[:-11]) ** 2).sum(1)))
    assert np.allclose([r.gamma for r in got], middle * np.array([0.1, 0.25, 0.5, 1, 2, 4, 10, 30]))
    for r in got:
        k, h = np.exp(-r.gamma * ((z[:, None] - z[None]) ** 2).sum(-1)), np.eye(60) - 1 / 60
        cum = np.linalg.eigvalsh(h @ k @ h)[::-1].cumsum() / np.trace(h @ k @ h)
        assert (r.k50, r.k90, r.n) == (np.argmax(cum >= 0.5) + 1, np.argmax(cum >= 0.9) + 1, 60)


def test_kernel_summary_starts_near_the_leading_vectors(spark, monkeypatch):
    """Few products of the kernel are made, also where the basis is narrow, and the values are right."""
    z = np.random.default_rng(6).standard_normal((900, 24)) / 5
    df = spark.createDataFrame([(v.tolist(),) for v in z], "z array<double>")
    monkeypatch.setattr(spectral, "SPECTRUM_BLOCK", 300)
    monkeypatch.setattr(lanczos, "RESTART_BASIS", 900 * 50)
    made, real = [], spectral._kernel_product

    def counted(*args):
        product, trace = real(*args)
        return lambda panel: made.append(panel.shape[1]) or product(panel), trace

    monkeypatch.setattr(spectral, "_kernel_product", counted)
    got = [r.share for r in spectral.kernel_spectra(df, "z", [0.3], 10, panel=900 * 40).orderBy("rank").collect()]
    k, h = np.exp(-0.3 * ((z[:, None] - z[None]) ** 2).sum(-1)), np.eye(900) - 1 / 900
    want = np.linalg.eigvalsh(h @ k @ h)[::-1]
    assert np.allclose(got, want[:10] / want.sum(), rtol=0, atol=1e-10) and len(made) <= 14
