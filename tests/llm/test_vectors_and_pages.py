"""Embeddings, pages and the pipeline against brute force."""

import hashlib
import html
import re
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from plazaflow.llm import decontaminate, embeddings, graph, pages, quality, secrets, simhash
from plazaflow.llm.common import table


def brute(rows):
    """{row: (links, component)} of (vec_id, vector, label) rows."""
    good = [i for i, (k, v, y) in enumerate(rows) if k is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    near = [(i, j) for i in good for j in good if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.93]
    root = {i: rows[i][0] for i in range(len(rows))}
    for _ in rows:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    count = [sum(i in p for p in near) for i in range(len(rows))]
    return sorted(((rows[i][0] is None, rows[i][0] or 0, count[i], root[i] or 0) for i in range(len(rows))))


def result(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(df).collect())


def test_embeddings_match_brute_force(spark, sf_dir, monkeypatch):
    df = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    assert result(df) == brute(rows)
    monkeypatch.setattr(embeddings, "BLOCK_NUMBERS", 16 * 64)
    monkeypatch.setattr(embeddings, "TILE", 5)
    assert result(df) == brute(rows)


def test_odd_vectors(spark):
    shared = [(1, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (9, [0.0, 1.0], 1), (7, [0.6, 0.8], 1)]
    df = spark.createDataFrame(shared, "vec_id long, embedding array<float>, label int")
    assert result(df) == [(False, 1, 1, 1), (False, 5, 1, 1), (False, 5, 1, 1), (False, 7, 0, 7), (False, 9, 1, 1)]
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (4, [1.0, float("nan")], 1), (5, [2.0, 4.0], 1), (6, [1.0, 2.0], None), (7, [1.0, 2.0, 0.0], 1), (9, [1.0, None], 1), (10, [float("inf"), 1.0], 1), (11, [-1.0, -2.0], 1), (12, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit(1))
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == []


def test_bounds_lose_nothing():
    r = np.random.default_rng(0)
    centers = r.standard_normal((20, 48))
    x = np.repeat(centers, 10, 0) + 0.25 * r.standard_normal((200, 48))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = embeddings.linked(x, x, axes, 0.93)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert set(zip(i.tolist(), j.tolist())) == {tuple(map(int, p)) for p in zip(*np.nonzero(u @ u.T >= 0.93))}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (40, 41)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 42)} | {101: 100, 102: 100}
    assert not graph.components(spark.createDataFrame([], "a long, b long")).collect()


def plain(page):
    body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", body)]
    return "\n".join(filter(None, blocks))


def test_pages_match_plain_reading(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    for r in df.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(spark):
    page = '<html><body><div class="top menu">M</div><form>F</form><main><h1>T &amp; U</h1><p>one<br>two &nbsp; three<p>four<div class="comments">no</div></main><aside>A</aside><footer>Z</footer>'
    rows = [(1, "http://a/x", page), (1, "http://a/x", page), (2, None, None), (3, "http://a/y", ""), (4, "nonsense", "just <b>text</b> &lt;here&gt;"), (None, "http://b/", "<p>x</p><script>var a='<p>no</p>'</script>"), (6, "http://c", "<table><tr><td>a<td>b</table>")]
    got = sorted(((r.page_id or 0, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert got == [(0, "x"), (1, "T & U\none two three\nfour"), (1, "T & U\none two three\nfour"), (2, ""), (3, ""), (4, "just text <here>"), (6, "a\nb")]
    assert not pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect()


def test_template_drops_what_all_pages_share(spark):
    text = [f"<html><body><div id=x><div><p>Story number {k} is about {k * 7} things and goes on for quite a while.</p><p>Share this on paper</p></div></div><div>Short {k}</div></body></html>" for k in range(8)]
    df = spark.createDataFrame([(k, f"http://h/{k}", t) for k, t in enumerate(text)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got[3] == "Story number 3 is about 21 things and goes on for quite a while."


def test_template_survives_odd_pages(spark):
    page = "<html><body><div id=x><div><p>Story number {k} is about {n} things and goes on for quite a while.</p>{note}<p>Share this on paper</p></div></div><div>Short {k}</div></body></html>"
    note = "<div class=strip><p>Prices are without tax</p></div>"
    html = [page.format(k=k, n=k * 7, note=note if k else "") for k in range(12)] + [None, "", "<p>Error 500"]
    df = spark.createDataFrame([(k, f"http://h/{k}", t) for k, t in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert all(got[k] == f"Story number {k} is about {k * 7} things and goes on for quite a while." for k in range(12))
    assert got[12] == got[13] == "" and got[14] == "Error 500"


def told(spark, rows, columns="page_id long, url string, html string"):
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, columns)).collect()}


def test_template_of_hosts_of_any_size(spark):
    page = "<html><body><div class=x><p>Story number {k} is about {n} things and goes on for quite a while.</p><p>Share this on paper</p></div><div class=y>Short {k}</div></body></html>"
    for number in (2, 3, 4, 6):
        got = told(spark, [(k, f"http://h/{k}", page.format(k=k, n=k * 7)) for k in range(number)])
        assert got == {k: f"Story number {k} is about {k * 7} things and goes on for quite a while." for k in range(number)}
        empty = ["\n".join(pages.slots(page.format(k=k, n=k * 7), pages.NO_TEMPLATE)) for k in range(number)]
        assert all(e != got[k] for k, e in enumerate(empty))  # without a template it can't be told


def test_main_text_is_not_what_names_say(spark):
    long = "A long paragraph {k} with plenty of words about matters of some weight, as articles have."
    page = "<body><div class=teasers><article class=card>Teaser {k}</article><article class=card>Other {k}</article></div><div class=story><h1>Head {k}</h1><div class=text><p>" + long + "</p><p class='share-prices'>Share prices rose {k}.</p><section class='related-work'><p>Related work {k}.</p></section><div class='share-buttons'>Tell {k}</div></div></div></body>"
    got = told(spark, [(k, f"http://h/{k}", page.format(k=k)) for k in range(5)])
    assert got[3] == f"Head 3\n{long.format(k=3)}\nShare prices rose 3.\nRelated work 3."
    two = "<body><main><h1>Head {k}</h1><article><p>" + long + "</p></article><article>Teaser {k}</article></main></body>"
    assert told(spark, [(k, f"http://h/{k}", two.format(k=k)) for k in range(3)])[1] == f"Head 1\n{long.format(k=1)}"
    copies = told(spark, [(k, f"http://h/{k}", "<body><div><p>The same text on either page, a copy.</p></div></body>") for k in range(2)])
    assert set(copies.values()) == {"The same text on either page, a copy."}


def test_article_text_that_a_host_repeats_stays(spark):
    """Near-copies, series, several articles, and words in class names that only mean something outside of an article."""
    first = "<h1>Head</h1><p>The first paragraph of the story, some words long.</p><p>And the second one, of as many words.</p>"
    told_ = "Head\nThe first paragraph of the story, some words long.\nAnd the second one, of as many words."
    for box in ("article", "main", "div"):
        page = f"<body><nav>Menu</nav><{box}>{{}}</{box}><footer>Foot</footer></body>"
        got = told(spark, [(1, "http://h/1", page.format(first)), (2, "http://h/2", page.format(first + "<p>Update: D.</p>"))])
        assert got == {1: told_, 2: told_ + "\nUpdate: D."}
    dated = "<body><div class=meta>Printed on {}</div><div class=story>" + first + "</div></body>"
    assert told_ in told(spark, [(k, f"http://h/{k}", dated.format(k)) for k in range(3)])[1]
    series = "<body><div class=note>No cookies.</div><article><h1>Daily report</h1><p>This series looks at the weather.</p><p>On day {k} there were {n} drops of rain, and some wind in the evening.</p><div class=strip><p>Prices are without tax.</p></div></article></body>"
    got = told(spark, [(k, f"http://h/{k}", series.format(k=k, n=k * 7)) for k in range(10)])
    assert all(got[k] == f"Daily report\nThis series looks at the weather.\nOn day {k} there were {k * 7} drops of rain, and some wind in the evening." for k in range(10))
    two = "<body><main><article><p>" + "Seven parts of it {k}. " * 7 + "</p></article><article><p>" + "Three parts of it {k}. " * 3 + "</p></article></main></body>"
    assert told(spark, [(k, f"http://h/{k}", two.format(k=k)) for k in range(3)])[2] == "\n".join(" ".join([f"{n} parts of it 2."] * m) for n, m in (("Seven", 7), ("Three", 3)))
    named = "<body><article><h1>Markets {k}</h1><div class='share'>Share price {k}</div><div class='search results'>Results {k}</div><section class='related'>Related {k}</section><div class='ad'>Buy {k}</div><div class='comments'>Nice {k}</div></article><div class='share'>Tell {k}</div></body>"
    assert told(spark, [(k, f"http://h/{k}", named.format(k=k)) for k in range(3)])[0] == "Markets 0\nShare price 0\nResults 0\nRelated 0"


def test_main_container_without_article_elements(spark):
    """Only the host's template tells which of two boxes holds the main text, and which text in it is a notice."""
    page = "<body><div class=a><p>Story number {k} is about {n} things and goes on for quite a while.</p><div class=b>Prices are without tax.</div></div><div class=c><p>By {k}</p></div></body>"
    html_ = [page.format(k=k, n=k * 7) for k in range(9)]
    got = told(spark, [(k, f"http://h/{k}", h) for k, h in enumerate(html_)])
    assert all(got[k] == f"Story number {k} is about {k * 7} things and goes on for quite a while." != "\n".join(pages.slots(html_[k], pages.NO_TEMPLATE)) for k in got)


def test_classes_are_nested():
    parent = {(k, p): a for p, a in ((1, 0), (2, 1), (3, 1)) for k in (pages.OPEN, pages.CLOSE)} | {(pages.TEXT, 9): 2}
    above, depth = {1: 0, 2: 1, 3: 1}, {1: 1, 2: 2, 3: 2}
    O, C, T = pages.OPEN, pages.CLOSE, pages.TEXT  # noqa: E741
    whole = [(O, 1), (O, 2), (T, 9), (C, 2), (O, 3), (C, 3), (C, 1)]
    assert pages.nested(whole, parent, above, depth) == whole
    crossed = [(O, 1), (O, 2), (O, 3), (T, 9), (C, 2), (C, 3), (C, 1)]  # 3 isn't closed where 2 is, and no place for a text of 2
    assert pages.nested(crossed, parent, above, depth) == [(O, 1), (O, 2), (C, 2), (C, 1)]
    token = lambda kind, path, place, n, v, **more: {"kind": kind, "token": path, "v1": v, "v2": 0, "v3": 0, "n_pages": n, "place": place, "tag": "div" if kind == O else None, "parent": parent[kind, path], "depth": depth.get(path, 0), "chars": 0, "heads": 0} | more
    found = pages.deduce([token(O, 1, 0.0, 9, 1, chars=90), token(C, 1, 9.0, 9, 1), token(O, 2, 1.0, 8, 2, chars=80), token(C, 2, 3.0, 8, 2), token(T, 9, 2.0, 8, 2, chars=10), token(O, 3, 4.0, 9, 3), token(C, 3, 5.0, 9, 3)])
    assert sorted(found.classes) == [(0, [(O, 1), (C, 1)]), (1, [(O, 2), (T, 9), (C, 2)]), (1, [(O, 3), (C, 3)])]
    assert found.texts == {9} and found.main == 2


def test_hostile_pages_take_linear_time(spark):
    made = ["<a b='c " * 130_000, "<a b='c " * 130_000 + ">", "<div>" * 100_000, "<div>x" * 50_000, "<b>" * 100_000 + "<p>x" * 1000, "<" * 500_000, "<li><p>x" * 50_000, "<!--" * 100_000, "</b>" * 100_000]
    began = time.perf_counter()
    for html_ in made:
        pages.slots(html_, pages.own_template(html_))
    assert time.perf_counter() - began < 60
    extra = spark.createDataFrame([(1, "http://h/1", "<p>x</p>", "a", 2, "t")], "page_id long, url string, html string, host string, page_key int, tokens string")
    assert [tuple(r) for r in pages.extract(extra).collect()] == [(1, "http://h/1", "x", 1)]


def test_pipeline_on_odd_documents(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows and columns whose names clash with what stages use inside."""
    docs = table(spark, sf_dir, "documents")
    names = ", ".join(f"{n} {t}" for n, t in docs.dtypes) + ", _leak_doc string, i int, row int, text_key int"
    long = "plain words that say something and go on for a while so that shingles are there to count in this text"
    rows = [(None, None), (1, None), (2, ""), (3, long), (3, long), (4, long), (None, long), (5, "word " * 60_000), (6, "ñ" * 300)]
    odd = spark.createDataFrame([(i, t, "en", "x", None, "a", 1, 2, 3) for i, t in rows], names)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        got = out.collect()
        assert name == "byte_level_bpe" or out.columns == odd.columns
        if name == "quality_classifier":
            assert {(r.doc_id, r.text) for r in got} <= set(rows)
        elif name == "simhash_near_dedup":  # 1, 2 and the null text are one group: no shingle
            assert sorted((r.doc_id, r.text is None) for r in got) == [(1, True), (3, False), (5, False), (6, False)]
        else:
            assert len(got) == len(rows)
        assert not stage(spark, odd.limit(0), sf_dir).collect()


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_dir)
        before = {r.doc_id: r.text for r in kept.collect()}
        if name == "quality_classifier":
            scores = {r.doc_id: r.predicted for r in quality.quality(kept, table(spark, sf_dir, "labels")).collect()}
            expected = {i: t for i, t in before.items() if scores[i]}
        elif name == "simhash_near_dedup":
            expected = {i: before[i] for i in {r.component_id for r in simhash.near_duplicates(kept).collect()}}
        elif name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontaminate.leaks(kept, table(spark, sf_dir, "benchmark")).collect()}
            expected = {i: t for i, t in before.items() if i not in bad}
        elif name == "secret_scan":
            expected = None
            after = {r.doc_id: r.text for r in out.collect()}
            assert after.keys() == before.keys()
            assert not any(re.search("AKIA[A-Z0-9]{16}", t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not any(re.search(r.pattern, t, re.I) for r in secrets.RULES))
        else:
            break
        assert out.columns == docs.columns
        if expected is not None:
            assert {r.doc_id: r.text for r in out.collect()} == expected
        kept = spark.createDataFrame(out.collect(), docs.schema)
    last = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert last == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept.collect()}
