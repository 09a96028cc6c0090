"""Vector searches, archives and page texts on small tables with odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairway.llm import ann, cells, common, html, topk, warc


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, dim int")


def random_rows(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * np.exp(spread * rng.standard_normal((n, 1)))
    return [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(x)]


ODD = [(5000, None), (5001, [1.0, None, 2.0, 0.0]), (5002, [float("nan"), 0.0, 0.0, 0.0]), (5003, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (5020, [0.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("small", [False, True])
def test_top_k_against_brute_force(spark, monkeypatch, small):
    if small:  # many parts
        monkeypatch.setattr(cells, "CANDIDATES", 40)
        monkeypatch.setattr(cells, "QUERIES", 7)
    rows = random_rows(300, 4, 1) + [(1000 + i, [1.0, 0.5, 0.0, 0.0]) for i in range(50)] + ODD
    got = topk.top_k(topk.quantized(vectors(spark, rows)), F.pmod("id", F.lit(20)) == 0, 20).collect()
    whole = {i: np.floor(64 * np.array(v, np.float64)).astype(int) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:20]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    rows = rng.integers(-60, 60, (400, 6))
    queries = rows[:40] + rng.integers(-2, 3, (40, 6))
    scores = queries @ rows.T
    needed = np.sort(scores, axis=1)[:, -5].astype(float)
    for i, at, s, names in topk.search_cell(np.arange(40), queries, needed, np.arange(400), rows, 5):
        assert set(names[at[s >= needed[i]]]) == set(np.flatnonzero(scores[i] >= needed[i]))


def test_searches_of_empty_tables_and_few_rows(spark):
    for rows in ([], ODD[:5], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (1, [3.0, 4.0])]):
        v = cells.finite_vectors(vectors(spark, rows))
        n = 1 if len(rows) == 3 else 0
        assert ann.search(v, F.pmod("id", F.lit(100)) == 0, 10).count() == n
        assert topk.top_k(topk.quantized(vectors(spark, rows)), F.pmod("id", F.lit(20)) == 0, 20).count() == n


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 16)) * 3
    rows = [(i, [float(np.float32(c)) for c in centers[i % 12] + rng.standard_normal(16)]) for i in range(1500)] + [(3000, None), (3001, [0.0] * 16)]
    got = ann.search(cells.finite_vectors(vectors(spark, rows)), F.pmod("id", F.lit(20)) == 0, 10).collect()
    x = np.array([v for _, v in rows[:1500]])
    found = 0
    for q in range(0, 1500, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in own)
        found += len(set(np.argsort(d, kind="stable")[:10]) & {v for _, v, _ in own})
    assert found >= 0.9 * 750


def test_partitions_are_balanced():
    x = np.random.default_rng(4).standard_normal((500, 8))
    sizes = np.bincount(ann.partition(x, 8), minlength=8)
    assert sizes.max() - sizes.min() <= 1


PAGES = [
    (3, "http://a/x", "<p>" + "same " * 40), (1, "http://a/y", "<p>" + "same " * 40), (2, None, "<p>" + "same " * 40), (None, "http://b/", "<p>" + "same " * 40),
    (4, "http://c/", "short"), (5, "http://c/", "short"), (6, "http://c/\r\nEvil: 1", None), (7, "", ""), (8, "http://d/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n é" * 20), (9, "http://e/", "x" * 300_000), (4, "http://c/", "short"),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "k", "v") for p in PAGES], "page_id long, url string, html string, digest string, first string")
    path = common.fresh_path(spark, "warc-test")
    warc.write(pages, path)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(spark, path).collect())
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        first = min((p for p, _, g in PAGES if p is not None and (g or "") == (h or "")), default=None)
        again = len(data) >= 100 and first is not None and i != first
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want)
    nested = warc.assemble(warc.read(spark, path)).collect()
    assert len(nested) == len(PAGES) and all(r.request is not None and r.metadata is not None and (r.response.intact or r.response.type == "revisit") for r in nested)
    assert {r.response.payload for r in nested if r.response.type == "response"} == {(h or "").encode() for _, _, h in PAGES}


def test_warc_of_no_pages(spark):
    path = common.fresh_path(spark, "warc-empty")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(spark, path).count() == 0


def test_vectors_of_each_dimension_have_their_own_index(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.standard_normal(3 if i % 7 == 0 else 8)]) for i in range(210)] + [(1000, [1.0])]
    got = ann.search(cells.finite_vectors(vectors(spark, rows)), F.pmod("id", F.lit(20)) == 0, 10).collect()
    dims = {i: len(v) for i, v in rows}
    for q in range(0, 210, 20):
        mine = [r for r in got if r.query_id == q]
        assert sorted(r.rank for r in mine) == list(range(1, 11)) and all(dims[r.vec_id] == dims[q] for r in mine)
    assert not [r for r in got if 1000 in (r.query_id, r.vec_id)]


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = cells.finite_vectors(table)
    got = ann.search(v, F.pmod("id", F.lit(20)) == 0, 10).collect()
    data = {r.id: np.array(r.vec) for r in v.collect() if np.any(r.vec)}
    ids = np.array(sorted(data))
    x = np.array([data[i] for i in ids])
    found = total = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - data[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.argsort(d, kind="stable")[:10]].tolist())
        found += len(best & {r.vec_id for r in got if r.query_id == q})
        total += len(best)
    assert found >= 0.93 * total


def test_buckets_are_pruned(spark, monkeypatch):
    """Of vectors with very different lengths most cells are not searched, and the result is whole."""
    seen = []
    real = topk.alive

    def counted(queries, levels):
        out = real(queries, levels)
        seen.append((out.count(), queries.join(levels, "dim").agg(F.sum("parts")).first()[0]))
        return out

    monkeypatch.setattr(topk, "alive", counted)
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(6) * 2.0 ** (i % 12)]) for i in range(1200)]
    got = topk.top_k(topk.quantized(vectors(spark, rows)), F.pmod("id", F.lit(20)) == 0, 20).collect()
    whole = {i: np.floor(64 * np.array(v, np.float64)).astype(int) for i, v in rows}
    want = [(q, r + 1, c, -s) for q in whole if q % 20 == 0 for r, (s, c) in enumerate(sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:20])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert seen and seen[0][0] < 0.5 * seen[0][1]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</ul></nav>{body}<footer>&copy; x</footer></body></html>"


CASES = {
    page("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>four &lt;b&gt; <b>bold</b>er</article>"): "A & B\none two three\nfour <b> bolder",
    page("<article><p>text</p><div class='ad'>buy</div><aside>side</aside><section class='reader comments'><article><p>me too</p></article></section><form>name <input></form></article>"): "text",
    page("<main><p>a<!-- <p>b --></p><div>c<p>d</p>e</div><ul><li>f<li>g</ul></main>"): "a\nc\nd\ne\nf\ng",
    "<p>no article <i>here</i></p> tail": "no article here\ntail",
    "": "",
    None: "",
    '<html><body class="no-sidebar"><article class="post has-sidebar"><h1 class="header-title">Title</h1><div class="social-sciences">On society</div></article></body></html>': "Title\nOn society",
    "<!-- <article>old</article> --><script>'<article>'</script><p>body text</p>": "body text",
    "<article><header>x <div><h1>Head <i>line</i></h1></div><p>by me</p><nav>a</nav></header><p>text</p><footer>foot</footer></article>": "Head line\ntext",
    "<article><p>one</p></article><div class='comments'><article class='comment'><p>me too</p></article></div>": "one",
    "<article><p>one</p><article class='comment'><p>me too</p></article></article>": "one",
    "<article><div class='ad-banner'>buy</div><p>one</p><p role='note'>two</p></article>": "one\ntwo",
    "<p>before</p><aside><article>side</article></aside>": "before",
    "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
    "<script>never closed": "",
    "< not a tag & <a href=\"x>y\">z</a> &am &#233;": "< not a tag & z &am é",
}


def test_main_text(spark):
    rows = [(i, f"http://h{i}.org/", h, "t") for i, h in enumerate(CASES)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(CASES.values())


def test_template_of_a_site_goes_and_repeated_paragraphs_of_articles_stay(spark):
    site = lambda i: f"<div><span>Site slogan</span><div>Imprint and more</div></div><div><p>Story {i} is told</p></div>"
    rows = [(i, "http://s.org/" + str(i), site(i)) for i in range(20)] + [(100 + i, "http://t.org/", page("<article><p>The same line.</p><p>Own</p></article>")) for i in range(20)] + [(200, None, site(1))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is told" for i in range(20)) and all(got[100 + i] == "The same line.\nOwn" for i in range(20))
    assert "Site slogan" in got[200]


def test_recurrence_alone_finds_the_template_of_neutral_markup(spark):
    """No element, class, id or role tells what is what: menu, notice and imprint recur, the story does not."""
    parts = "<div><span>Home</span><span>News</span></div>", "<div>We use what we need to.</div>", "<div><div>Imprint</div><div>Contact us</div></div>"
    pages_ = [(i, f"http://n.org/{i}", f"<body>{parts[0]}{parts[1]}<div><div>Story {i}</div><div>It goes on {i * 7}.</div></div>{parts[2]}</body>") for i in range(40)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages_, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(40)] == [f"Story {i}\nIt goes on {i * 7}." for i in range(40)]
    alone = html.extract(spark.createDataFrame([(0, "http://other.org/", pages_[0][2])], "page_id long, url string, html string")).first().text
    assert "Imprint" in alone and "Home" in alone


def test_main_text_of_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
