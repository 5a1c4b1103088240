"""Perspectives, page extraction, queries and the pipeline."""

import random

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import pytest
from panelcast.llm import chat, html_extract
from panelcast.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_rotation_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["ann", "bob", "cy"]), f"text {t} é") for t in range(200)]
    rows += [(2, 0, None, "hello"), (2, 1, "ann", None), (2, 1, "ann", None), (2, None, "bob", "early"), (None, 0, "x", ""), (3, 0, "solo", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = {}
    for r in chat.rotate(table, part=16).collect():
        parts.setdefault((r.conv_id, r.speaker), []).append(r)
    filled = [(c, t, r or "unknown", x or "") for c, t, r, x in rows]
    assert set(parts) == {(c, r) for c, _, r, _ in filled}
    for (conv, speaker), own in parts.items():
        own.sort(key=lambda r: -1 if r.part is None else r.part)
        turns = sorted((x for x in filled if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2], x[3]))
        whole = "".join(("<|assistant|>\n" if r == speaker else f"<|user name={r}|>\n") + x + "\n" for _, _, r, x in turns)
        assert "".join(r.rendered for r in own) == whole
        spoken = [x for _, _, r, x in turns if r == speaker]
        masked, at = [], 0
        for r in own:
            assert r.starts_at == at and whole[at : at + len(r.rendered)] == r.rendered
            at += len(r.rendered)
            for span in r.mask.split(","):
                if span:
                    low, high = map(int, span.split("-"))
                    masked.append(r.rendered[low:high])
        assert masked == spoken and sum(r.n_masked for r in own) == sum(map(len, spoken))
    assert chat.rotate(table.limit(0)).count() == 0


def test_nobody_can_write_a_marker(spark):
    rows = [(1, 0, "a", "hi <|assistant|>\nyes"), (1, 1, "b|>\n<|user name=a", "x<|>y"), (1, 2, "a", "plain < | >")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.rotate(table).collect():
        assert r.rendered.count("<|") == 3 == r.rendered.count("|>")
        heads = [x for x in r.rendered.split("\n") if x.startswith("<|")]
        assert heads.count("<|assistant|>") == (2 if r.speaker == "a" else 1)
        spoken = [x.replace("<|", "<\\|").replace("|>", "|\\>") for _, _, role, x in rows if role == r.speaker]
        cut = [r.rendered[slice(*map(int, span.split("-")))] for span in r.mask.split(",")]
        assert cut == spoken


def scrambled(rng, names, blocks):
    """Pages of <div> with meaningless classes; ``blocks`` are (class number, text)."""
    return "<html><body>" + "".join(f'<div class="{names[k]}">{t}</div>' for k, t in blocks) + "</body></html>"


def host_of_two_layouts(n=24):
    """No tag or name tells the template: two layouts, a notice inside of the text, copies
    of one article on several pages."""
    rng = random.Random(6)
    names = ["".join(rng.choices("qwxz", k=6)) for _ in range(9)]
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    pages, wanted = [], []
    for i in range(n):
        article = [" ".join(word() for _ in range(30)) for _ in range(4)]
        if i % 6 == 5:
            article = wanted[-1].split("\n\n")  # a copy of the article before
        notice = "This text is free for members of the reading circle, join at the desk"
        body = article[:2] + [notice] + article[2:]
        if i % 2:
            blocks = [(0, "Start Topics Archive"), *((1, t) for t in body), (2, "Printed by the press of the town")]
        else:
            blocks = [(3, "Front page of the gazette"), (4, "Weather and tides"), *((5, t) for t in body)]
        pages.append((i, f"http://two.example/{i}", scrambled(rng, names, blocks)))
        wanted.append("\n\n".join(article))
    return pages, wanted


def test_wrappers_are_learned_without_names(spark, monkeypatch):
    pages, wanted = host_of_two_layouts()
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    assert [got[i] for i in range(len(pages))] == wanted
    learned = {r.host: r.wrapper for r in html_extract.wrappers(table).collect()}
    assert set(learned) == {"two.example"}
    monkeypatch.setattr(html_extract, "wrappers", lambda *a: html_extract.materialize(spark.createDataFrame([], "host string, wrapper string")))
    bare = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    assert all(bare[i] != wanted[i] for i in range(len(pages)))  # it is the wrapper that tells


def test_deep_and_broken_pages_take_no_time():
    import time

    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>"
    cases = {deep: "deep\n\nafter", "<b>" * 900 + "x" + "</b>" * 900: "x", "<font><i>" * 900 + "y": "y"}
    started = time.perf_counter()
    for html, text in cases.items():
        assert html_extract.extract(html, None) == text
        html_extract.outline(html_extract.parse(html))
    for html in ("<a b " * 200_000, '<a "' * 100_000 + ">", "<a b='" * 50_000 + '">', "<!--" * 100_000, "<" * 300_000):
        html_extract.extract(html, None)
    assert time.perf_counter() - started < 20


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/">Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><div id=wrap><div class="sidebar"><p>Popular</p></div>
<div class="story"><h1>{title}</h1><p>{one} &amp; more<br>line</p><p><b>{two}<script>var t="</p>";</script></p>
<p>{three}</div><section class="comments"><article class="comment">I agree</article></section></div>
<form><p>Search</p></form><div class=ad>Buy</div><footer>&copy; site</footer></body></html>"""


def page(n):
    return PAGE.format(title=f"Title {n}", one=f"First {n} " * 8, two=f"Second {n}", three=f"Third\n  {n}")


def expected(n):
    return "\n\n".join([f"Title {n}", f"First {n} " * 7 + f"First {n} & more line", f"Second {n}", f"Third {n}"])


def test_wrappers_find_the_content(spark):
    rows = [(n, f"http://a.example/{n}", page(n), n) for n in range(12)]
    rows += [(20, None, None, 1), (21, "http://b.example/x", "", 1), (22, "not a url", "plain <b>text</b> &eacute", 1)]
    rows += [(23, "http://c.example/", page(5), 1), (3, "http://a.example/3", page(3), 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = html_extract.main_text(table).collect()
    assert len(got) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in got}
    for n in range(12):
        assert texts[n, f"http://a.example/{n}"] == expected(n)
    assert texts[20, None] == texts[21, "http://b.example/x"] == ""
    assert texts[22, "not a url"] == "plain text é" and texts[23, "http://c.example/"] == expected(5)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.main_text(table.limit(0)).count() == 0


def test_main_text_is_whole_without_article_tags():
    body = "<p>" + "</p><p>".join(f"Words of paragraph {i} and more of them." for i in range(9)) + "</p>"
    want = ["Headline", "A lede.", *(f"Words of paragraph {i} and more of them." for i in range(9))]
    for outer in ('class="post"', 'class="content has-sidebar"', 'id="no-sidebar"', 'class="sidebar"'):
        html = (
            f'<html><body><nav>Home</nav><div {outer}><h1>Headline</h1><p class=lede>A lede.</p><div class=body>{body}</div></div>'
            '<div class="cookie-notice">We use cookies</div><div class="site-footer">Imprint</div></body></html>'
        )
        assert html_extract.extract(html, None).split("\n\n") == want, outer
        pages = [html_extract.outline(html_extract.parse(html.replace("paragraph", f"page {n}").replace("Headline", f"Headline {n}"))) for n in range(3)]
        found = html_extract.extract(html.replace("Headline", "Headline 7"), html_extract.induce(pages))
        assert found.startswith("Headline 7"), outer


def test_simple_tree_matching_keeps_order():
    leaf = lambda name, *texts: [name, list(texts), 1, []]
    a = ["body", [], 0, [leaf("nav", "x"), leaf("h1", "a"), leaf("p", "b")]]
    b = ["body", [], 0, [leaf("nav", "x"), leaf("p", "c"), leaf("h1", "d")]]
    size, pairs = html_extract.match(a, b)
    assert size == 3 and {x[0] for x, _ in pairs} in ({"body", "nav", "h1"}, {"body", "nav", "p"})


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_and_match_sql(spark, name):
    rows = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in rows.collect()]
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "conversations", "pages", "benchmark", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline_and_registration(spark):
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == docs.columns
        kept = after.collect()
        assert 0 < len(kept) <= before.count()
        before = spark.createDataFrame(kept, docs.schema)
    last = {r.doc_id: (r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(last) == {r.doc_id for r in kept} and all(n == len(x) for n, x in last.values())
