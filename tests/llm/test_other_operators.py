"""Search, pages, archives, components and the pipeline against brute force."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline
from checkwise.llm import graph, html, minhash, packing, pii, quality, topk, warc
from pyspark.sql import functions as F


def test_topk_brute(spark):
    g = random.Random(3)
    rows = []
    for i in range(700):
        v = [g.gauss(0, 1) for _ in range(9)]
        if i % 3 == 0:
            v = [0.5] * 9  # one very common vector: ties
        rows.append((i, v, "x"))
    rows += [(700, None, "x"), (800, [1.0, None] + [0.0] * 7, "x"), (900, [math.inf] * 9, "x"), (901, [math.nan] * 9, "x"),
             (1000, [1.0, 2.0], "x"), (1001, [1.0, -2.0], "x"), (1100, [], "x"), (1101, [], "x"), (1200, [3.0], "x"),
             (None, [1.0] * 9, "x"), (5, [0.5] * 9, "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(7)
    back = [(r.vec_id, r.embedding) for r in df.collect()]
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in back
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 100 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good
                          if i != q and len(w) == len(v))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    for size in (topk.QUERY_BYTES, 100):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, query_bytes=size).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


PAGE = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>menu a</a></li></ul></nav><!-- ad --><div class=\"ad\">buy now</div>{main}"
        "<footer>&copy; host</footer></body></html>")


def test_html_lines():
    page = PAGE.replace("{main}", "<article><header><h1>Head</h1></header><p><b>Bold &lt;x&gt;.<br><p>Two\n words"
                                  "<form><input> send</form><aside>side</aside><p class='notice'>note<p>a<i>b</i>c "
                                  "<section id=\"comments\"><p>reader</p></section><p>end &am")
    # the text runs to the end of the article; the page's own footer is no part of it
    assert html.main_text(html.lines_of(page), []) == "Head Bold <x>. Two words abc end &am"


def test_html_differencing(spark):
    body = PAGE.replace("{main}", "<div>Site name</div><p>Story {i} of its own</p><div>About this site</div>")
    rows = [(i, f"https://h{i % 2}.example/en/{i // 2}", body.replace("{i}", str(i))) for i in range(40)]
    rows += [(90, "https://h0.example/en/5", None), (91, None, ""), (92, "https://alone.example/x", body),
             (93, "https://h1.example/en/3", "<article>kept &amp; <b>whole</b></article>"),
             (94, "bad url", "<p>" + "word " * 30_000), (94, "bad url", "a < b <p"), (None, "u", "<p>null id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = defaultdict(list)
    for r in html.extract(df).collect():
        got[r.page_id].append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    assert [got[i] for i in range(40)] == [[f"Story {i} of its own"] for i in range(40)]
    assert got[90] == [""] and got[91] == [""] and got[93] == ["kept & whole"] and got[None] == ["null id"]
    assert sorted(map(len, got[94])) == [5, 149_999]
    assert html.extract(df.limit(0)).collect() == []


def test_html_neighbours_beyond_copies_and_edges(spark):
    body = "<div>Site name</div><p>Story {i} of its own</p><div>About this site</div>"
    rows = [(i, f"https://two{i // 2}.example/{i}", body.replace("{i}", str(i))) for i in range(60)]  # hosts of two pages
    story = [0, 1, 1, 1, 1, 2]  # a run of copies
    rows += [(100 + i, f"https://copies.example/{i}", body.replace("{i}", f"c{k}")) for i, k in enumerate(story)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 7, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.page_id: r.text for r in html.extract(df).collect()}
            assert got == {i: f"Story {i} of its own" for i in range(60)} | {
                100 + i: f"Story c{k} of its own" for i, k in enumerate(story)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_html_differencing_inside_article():
    page = lambda i: html.lines_of(f"<article><p>Share this story<p>Story {i} of its own, longer than the rest</article>")
    assert html.main_text(page(1), [page(0), page(2)]) == "Story 1 of its own, longer than the rest"
    copy = html.lines_of("<article><p>Share this<p>Story 1 of its own, longer than the rest</article>")
    assert html.main_text(page(1), [copy, copy]) == "Share this story Story 1 of its own, longer than the rest"


@pytest.mark.parametrize("page", [
    "<article class='post no-comments'><p>the text</article>", "<main class='with-sidebar'><p>the text</main>",
    "<main class='sidebar'><p>the text</main>", "<div class='site right-sidebar'><p>the text</div>",
    "<div class='sidebar'><p>x<div>y</div><article><p>the text</article></div>",
    "<div class='site has-menu'><div class='ad'>buy</div><main><p>the text</main></div>",
    "<article><h2 id='search'>the</h2><p>text</article>"])
def test_html_hints_do_not_drop_the_page(page):
    assert html.main_text(html.lines_of(page), []) == "the text"


def test_html_hints_inside_article(spark):
    page = ("<article><p>Story {i} of its own<section id='related-work'><p>Work before {i}</section>"
            "<div class='share'>Share it<div>now</div></div><p>End {i}</article><div class='related'><article><p>Teaser</article></div>")
    rows = [(i, f"https://hints.example/{i}", page.replace("{i}", str(i))) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {
        i: f"Story {i} of its own Work before {i} End {i}" for i in range(5)}
    # without neighbours the hints decide
    assert html.main_text(html.lines_of(rows[0][2]), []) == "Story 0 of its own End 0"


def test_lcs():
    g = random.Random(2)
    for _ in range(300):
        a, b = ([g.choice("abcd") for _ in range(g.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        taken = [x for x, s in zip(a, html.shared(a, b), strict=True) if s]
        rest = iter(b)
        assert len(taken) == table[-1][-1] and all(x in rest for x in taken)


def test_warc_round_trip(spark):
    g = random.Random(4)
    rows = [(i, f"http://h/{i}", "é" * g.randint(0, 400)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nv", ""), (102, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (103, "u", "\r\n"),
             (104, "u", "".join(g.choice("abc\r\n") for _ in range(90_000))), (105, "u", rows[7][2]), (None, "u", "q"),
             (106, "u", "same"), (106, "u", "same"), (107, "v", "same"), (108, "w", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(3)).repartition(4)
    for min_bytes in (0, 40):
        first: dict[bytes, int] = {}
        for i, _, h in rows:
            if i is not None:
                b = (h or "").encode()
                first[b] = min(first.get(b, i), i)
        want = Counter()
        for i, _, h in rows:
            b = (h or "").encode()
            ref = first.get(b, i) if len(b) >= min_bytes and i is not None and first.get(b, i) < i else None
            want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                  "response" if ref is None else "revisit", ref)] += 1
        got = warc.archived(df, payloads=True, min_bytes=min_bytes, segment_bytes=1000).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert all(r.payload is None or len(r.payload) == r.payload_bytes for r in got)
        assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.archived(df.limit(0)).collect() == []


def test_warc_chunks():
    body = warc.chunked(b"x" * 9000)
    assert warc.dechunked(body) == b"x" * 9000
    with pytest.raises(ValueError):
        warc.dechunked(body.replace(b"\r\nx", b"\nx", 1))


def test_warc_missing_segment(spark):
    path = warc.shared_dir(spark, "warc")
    df = spark.createDataFrame([(1, "u", "z" * 5000)], "page_id long, url string, html string")
    warc.write_archives(df, path, segment_bytes=1000)
    lines = spark.read.option("lineSep", "\r\n\r\n").text(path).collect()
    raw = "".join(r.value + "\r\n\r\n" for r in lines)
    records = list(warc.Stream().feed(raw.encode().removesuffix(b"\r\n\r\n")))
    assert [f.get("WARC-Segment-Number") for f, _ in records] == [str(i + 1) for i in range(len(records))]
    assert warc.payload_of(b"".join(b for _, b in records)) == b"z" * 5000
    text = [f"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in f.items()) + "\r\n\r\n" + b.decode()
            for f, b in records if f.get("WARC-Segment-Number") != "3"]
    broken = warc.shared_dir(spark, "warc")
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(broken)
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_pages(spark, broken).collect()


def test_components(spark):
    g = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(g.randint(100, 300), g.randint(100, 300)) for _ in range(150)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in linked}
    assert len(got) == len(linked)


def test_pipeline_stages(spark, docs, sf_small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    df, last = docs, None
    for n in names[:-1]:
        out = stage[n](spark, df, sf_small)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before = [(r.doc_id, r.text, r.source) for r in df.collect()]
        after = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
        if n == "quality_rules":
            good = [(r.doc_id) for r in quality.judge(df).filter("kept").collect()]
            assert Counter(i for i, *_ in after) == Counter(good)
        elif n == "line_dedup":
            want = Counter((i, s) for i, _, _, s in brute.line_dedup([(i, t) for i, t, _ in before]))
            assert Counter((i, brute.sha(t)) for i, t, _ in after) == want
        elif n == "near_dedup":
            classes, _ = brute.near_classes(sorted({i: t for i, t, _ in before if i is not None}.items()))
            assert sorted({i for i, *_ in after if i is not None}) == sorted({c for c in classes.values()})
        else:
            assert all(not brute.pii_base(t) for _, t, _ in after)
            assert len(before) == len(after)
        assert all(c == len(t) for _, t, c in after if n in ("line_dedup", "pii"))
        df = spark.createDataFrame(out.collect(), docs.schema)
        last = [(r.doc_id, r.text) for r in df.collect()]
    rows = stage[names[-1]](spark, df, sf_small).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in last}


def test_pipeline_runs(spark, sf_small, registered):
    rows = registered["pipeline"](spark, sf_small).collect()
    assert rows and max(r.offset + r.length for r in rows) <= packing.SIZE


def test_pipeline_empty(spark, empty, sf_small):
    df = empty
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, df, sf_small)
        assert df.collect() == []
        df = empty


def test_unsettled_pairs_are_checked(spark):
    """Two members that match each other, but not the bucket's hub, are still linked."""
    words = [f"t{i}" for i in range(200)]
    a, b, c = words[:], words[:], words[:]
    a[::25] = [f"a{i}" for i in range(8)]  # far from b and c
    b[3] = "bb"
    c[180] = "cc"
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
    # one row a band and few bands: nearly everything shares buckets
    got = {r.doc_id: r.class_id for r in minhash.classes(df, bands=20, rows=1).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_mark_of_pii_kinds():
    assert list(pii.BASE) == ["email", "ip", "card", "phone"]
