"""Language id: accuracy on pages of known language, and what each kind of evidence does."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.llm import language_id
from tripflow.llm.queries import op2_language_id

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.trigram_model(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_query_agrees_with_what_pages_declare(spark):
    got = op2_language_id(spark, SF_DIR).toPandas()
    assert len(got) == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    assert (got.lang == got.declared).mean() > 0.98
    assert (got.text_lang == got.declared).mean() > 0.9


def test_texts_held_out_of_the_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter(F.length("text") > 300)
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    own = language_id.trigram_model(docs.filter(seen))
    pages = docs.filter(~seen).select("doc_id", "lang", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"), F.lit(None).cast("string").alias("url"))
    got = language_id.languages(pages.withColumnRenamed("lang", "true_lang"), own, key="doc_id")
    both = got.join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").toPandas()
    assert (both.lang == both.true).mean() > 0.95


def page(i, html, url="https://a.example.com/x"):
    return (i, html, url, "k")


def test_declaration_and_host_decide_short_texts(spark, model):
    langs = {r.lang: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("length(text) > 2000").select("lang", "text").collect()}
    rows = [page(i, f'<html lang="de"><p>{langs["de"][:600]}</p></html>', "https://de.example.org/") for i in range(30)]
    rows += [page(100 + i, f"<html lang='fr'><p>{langs['fr'][:600]}</p>", "https://fr.example.net/") for i in range(30)]
    rows += [page(200, '<html lang="fr"></html>', "https://other.example.net/"), page(201, "", "https://de.example.org/imprint"),
             page(202, None, None), page(203, f'<html lang="fr"><p>{langs["de"][:900]}</p>', "https://de.example.org/"),
             page(204, "<script>var x = 'the and of';</script><!-- the -->", None), page(0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, lang string")
    got = language_id.languages(pages, model)
    assert got.columns == ["page_id", "lang", "confidence", "text_lang", "declared", "suffix", "host"]
    found = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert all(found[i].lang == "de" for i in range(30)) and all(found[100 + i].lang == "fr" for i in range(30))
    assert (found[200].lang, found[201].lang, found[203].lang) == ("fr", "de", "de")
    assert found[204].text_lang is None and found[202].declared is None
    assert found[202].lang in ("de", "fr") and 0.4 < found[202].confidence < 0.6


def plain(pages, model):
    """page row -> (lang, confidence), from the rows' own evidence by loops."""
    langs, table = model
    n = len(langs)

    def shrunk(sums, toward, strength):
        return (sums + strength * toward) / (sums.sum() + strength)

    rows = []
    for page_id, markup, url, _ in pages:
        at, counts = language_id.trigrams(language_id.visible_text(markup or ""))
        total = int(counts.sum())
        like = table[:, at] @ counts * min(1.0, language_id.HEARD / max(total, 1)) if total else np.zeros(n)
        weights = np.round(np.exp(like - like.max()) / np.exp(like - like.max()).sum(), 6)
        host = re.match(r"^[a-z]+://([^/:?#]+)", (url or "").lower())
        host = host[1] if host else None
        parts = (host or "").split(".")
        declared = re.search(r"<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", markup or "")
        rows.append((page_id, like, weights, total > 0, host, ".".join(parts[-2:]) if len(parts) > 1 else None,
                     parts[-1] if len(parts) > 1 else None, declared[1].lower() if declared else None))
    told = [r for r in rows if r[3]]
    overall = sum((r[2] for r in told), np.zeros(n))
    prior = (overall + 1) / (overall.sum() + n)
    sums = lambda i, v: sum((r[2] for r in told if r[i] == v), np.zeros(n))
    out = []
    for row in rows:
        own = row[2] if row[3] else np.zeros(n)
        domain = shrunk(sums(5, row[5]) - own if row[5] else np.zeros(n), prior, language_id.DOMAIN_PAGES)
        host = shrunk(sums(4, row[4]) - own if row[4] else np.zeros(n), domain, language_id.HOST_PAGES)
        score = row[1] + np.log(host)
        for i in (6, 7):
            if row[i] and any(r[i] == row[i] for r in told):
                score = score + np.log(shrunk(sums(i, row[i]), prior, language_id.SMOOTH) / prior)
        p = np.exp(score - score.max())
        p /= p.sum()
        out.append((row[0], langs[int(np.argmax(np.round(p, 6)))], float(p.max())))
    return out


def test_fusion_equals_loops(spark, model):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("length(text) > 500").select("lang", "text").limit(60).collect()
    rng = random.Random(6)
    rows = []
    for i in range(300):
        said, body = rng.choice(["", "de", "fr", "en", "xx"]), rng.choice(texts).text
        words = body.split()
        part = " ".join(words[: rng.choice([0, 1, 3, 30, len(words)])])
        host = rng.choice(["a.one.de", "b.one.de", "two.fr", "c.three.com", f"h{i}.net", "localhost"])
        rows.append((i, rng.choice([None, f"<html lang='{said}'><p>{part}</p>"]), rng.choice([None, "", f"http://{host}/{i}"]), "k"))
    rows += [(1000, "<p>" + texts[0].text * 100, "http://two.fr/long", "k"), rows[5]]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, lang string")
    got = sorted((r.page_id, r.lang, r.confidence) for r in language_id.languages(pages, model).collect())
    want = sorted(plain(rows, model))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 1e-5
    assert all(g[1] == w[1] for g, w in zip(got, want) if w[2] > 0.5001)


def test_empty_tables(spark, model):
    pages = spark.createDataFrame([], "page_id long, html string, url string")
    assert language_id.languages(pages, model).count() == 0
    none = language_id.trigram_model(spark.createDataFrame([], "doc_id long, text string, lang string"))
    pages = spark.createDataFrame([(1, "<html lang=de>x", "http://a.de"), (2, None, None)], "page_id long, html string, url string")
    got = {r.page_id: r for r in language_id.languages(pages, none).collect()}
    assert got[1].lang is None and got[1].declared == "de" and got[2].confidence is None
