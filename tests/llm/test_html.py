import html
import random
import re

import numpy as np

from tidebook.llm import html_extract as H
from tidebook.llm.html_blocks import blocks_of

from .conftest import SF


def test_blocks_decode_and_join_white_space():
    page = "<title>T</title><p>a &amp;&nbsp; b\n c<br>d <b>e</b>f<!-- no --><script>x('<p>')</script><p>g<ul><li>h<li>i</ul>tail"
    assert [b.text for b in blocks_of(page)] == ["T", "a & b c d ef", "g", "h", "i", "tail"]
    assert [b.path for b in blocks_of("<div class='ad box'><p id=x1>t")] == [("div", "c.ad", "c.box", "p", "i.x")]
    assert blocks_of("") == [] and blocks_of("<p") != [] and blocks_of("<style>p{}")  == []


def test_gradients_are_right():
    net = H.Labeller(dims=7, hidden=3, seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(4, 2, 7)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=bool)
    y = rng.integers(0, 2, (4, 2)) * mask

    def loss():
        s = net.scores(x, mask)
        return float(-(mask * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / mask.sum())

    grads = net.gradients(x, mask, y)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        old = v[at]
        v[at] = old + 1e-4
        up = loss()
        v[at] = old - 1e-4
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-4 - grads[k][at]) < 1e-3, k


def test_made_up_pages_it_has_not_seen():
    net, rng, right, total = H.trained(), random.Random(77), 0, 0
    for _ in range(150):
        blocks, labels = H.labelled_blocks(H.training_page(rng))
        if blocks:
            right += int((net.label([net.gates(H.features(blocks))])[0] == (labels > 0)).sum())
            total += len(labels)
    assert right >= 0.97 * total


def test_article_of_recorded_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["row"]["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert got[r["page_id"]] == expected


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (3, "u", "<p>" + "long " * 50_000), (4, "u", "no markup at all")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as __x")
    got = H.extract(df).collect()
    assert len(got) == 5 and all(r["text"] == "" for r in got if r["row"]["page_id"] in (1, 2))
    assert H.extract(df.limit(0)).count() == 0
