"""Main text of pages, and the pipeline's stages."""

from __future__ import annotations

import html
import itertools
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from tandem.llm import decontaminate, html_text, pii, quality, simhash

TRAINING = [
    f'<html><head><title>t{i}</title></head><body><nav><ul><li><a href="/{i}">menu {i}</a></li><li><a href="/x">other</a></li></ul></nav>'
    f'<div class="ad">buy thing {i} now</div><article><h1>Head {i}</h1><p>First words of text {i}.</p><p>More text here {i}, and more.</p></article>'
    f'<div class="sidebar"><p>side {i} words of text.</p></div><div class="comments"><p>reader {i} said so.</p></div><footer>foot {i}</footer></body></html>'
    for i in range(30)]


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(TRAINING)], "page_id bigint, url string, html string")
    return html_text.train(pages)


def test_pages_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = {r.page_id: r for r in html_text.op6_html_text(spark, sf_dir).collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div)\b[^>]*>", " ", body))
        want = " ".join(html.unescape(body).split())
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def test_held_out_pages(model):
    """Pages of another build, without an article mark: the words of the body are kept, the rest is not."""
    page = ('<html><body><div class="menu"><a href="/">home</a></div><div class="content"><h1>Title</h1><p>Alpha beta gamma delta one.</p><p>Epsilon zeta eta theta.</p></div>'
            '<div class="cookie-notice">We use cookies</div><form><input value="q"><p>search here</p></form><div class="comments"><p>Nice one said a reader.</p></div></body></html>')
    text = html_text.main_text(page, model)
    assert "Epsilon zeta eta theta." in text and "Alpha beta" in text
    assert not any(x in text for x in ("home", "cookies", "search", "Nice"))


@pytest.mark.parametrize("page, want", [
    ("<article><p>a<b>b</b> c<br>d<p>e&amp;f &lt;g&gt;</article>", "ab c d e&f <g>"),
    ("<article><p>one<script>var t='</p>';</script> two<!-- gone --></p><style>p{}</style>three", "one two three"),
    ("<article><h1>x</h1><nav>menu</nav><p>y\n\t z</p></article><footer>f</footer>", "x y z"),
    ("plain &eacute; text", "plain é text"), ("", ""), (None, ""), ("<article></article>", ""), ("<p", "<p"), ("<article><p>unclosed <b>bold", "unclosed bold"),
])
def test_cases(model, page, want):
    assert html_text.main_text(page, model) == want


@pytest.mark.parametrize("piece", ["<a ", "<script ", "<!", "<a'", '<a "', "<a<a", "</p>", "<h1>", "<p><div><h1>", "<b", "<!--", "<title>", "<a x='>", "<? "])
def test_a_megabyte_of_one_piece(model, piece):
    """Pages that leave markup open are read in linear time."""
    began = time.process_time()
    html_text.parse(piece * (1_000_000 // len(piece)) + ' "')
    html_text.parse(piece * (500_000 // len(piece)) + "'>")
    assert time.process_time() - began < 20


def test_articles_by_their_neighbours_without_the_mark(model):
    """The model and not the mark finds the article: unmarked copies of pages that training did not see give the same text."""
    for i in range(100, 130):
        page = TRAINING[i % 30].replace(f" {i % 30}", f" {i}")
        bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(bare, model) == html_text.main_text(page, model) != ""


def test_given_pages_held_out_of_training(spark, sf_dir):
    """Trained on one half of the given pages, the other half comes out whole, with its article marks and without them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    half = html_text.train(pages.filter("page_id % 2 = 0"))
    rest = [r.html for r in pages.filter("page_id % 2 = 1").collect()]
    assert len(rest) >= 20
    for page in rest:
        body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div)\b[^>]*>", " ", body))
        bare = page.replace("<article", "<div").replace("</article", "</div")
        assert [html_text.main_text(x, half) for x in (page, bare)] == [" ".join(html.unescape(body).split())] * 2


def test_marginals_are_exact(model):
    """Sum-product on a small tree against the sum over all labellings."""
    nodes, _ = html_text.parse('<div><p>a b</p><ul><li><a href="x">c</a></li></ul></div><p>d</p>')
    own = [sum(model.weights[i] for i in f) - model.prior for f in html_text.features(nodes)]
    ties, total, each = np.exp(model.ties), 0.0, np.zeros(len(nodes))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        weight = np.exp(sum(np.clip(o, -30, 30) * y for o, y in zip(own, labels)))
        for i, node in enumerate(nodes[1:], 1):
            weight *= ties[labels[node.parent], labels[i]]
        total += weight
        each += weight * np.array(labels)
    assert model.marginals(nodes) == pytest.approx((each / total).tolist(), abs=1e-9)


def test_page_edges(spark):
    rows = [(1, "u", None, "z"), (None, None, "<p>x</p>", "z"), (2, "u", "<div>" * 3000 + "deep", "z"), (2, "u", "<p>y</p>", "z"), (2, "u", "<p>y</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_text.extract(pages, html_text.train(pages)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [(0, "x", 1), (1, "", 0), (2, "deep", 4), (2, "y", 1), (2, "y", 1)]
    empty = pages.limit(0)
    assert html_text.extract(empty, html_text.train(empty)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage against its operator, on what the stage before it kept."""
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    kept = {r.doc_id for r in quality.op7_quality_rules(spark, sf_dir).collect() if r.kept}
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir).cache()
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {r.component_id for r in simhash.near_duplicates(one).collect()}
    three = corpus_pipeline.benchmark_decontamination(spark, two, sf_dir).cache()
    bad = {r.doc_id for r in decontaminate.contaminated(two, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - bad
    four = corpus_pipeline.personal_data(spark, three, sf_dir).cache()
    assert four.columns == columns and four.count() == three.count()
    assert all(r.n_chars == len(r.text) for r in four.collect())
    assert pii.find(four).filter("size(base) > 0").count() == 0
    last = corpus_pipeline.sentencepiece_samples(spark, four, sf_dir).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in four.collect()} and all(r.decoded for r in last)
    assert len(last) == corpus_pipeline.run(spark, sf_dir).count()


def test_pipeline_stage_broadcasts_no_probes(spark, make, monkeypatch):
    """However small the documents that reach near_duplicates, the values it looks up do not pass through the driver."""
    plans, links = [], simhash.links
    spy = lambda prints: (found := links(prints), plans.append(found._jdf.queryExecution().executedPlan().toString()))[0]
    monkeypatch.setattr(simhash, "links", spy)
    given = [(i, f"text number {i} of a few that are kept here") for i in range(6)] + [(9, "text number 1 of a few that are kept here")]
    assert corpus_pipeline.near_duplicates(spark, make(given), "").count() == 6
    assert len(plans) == 1 and "Generate explode" in plans[0] and "BroadcastHashJoin" not in plans[0]
