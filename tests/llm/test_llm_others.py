from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import clashing

from evidrill.llm import crf, html, licenses, quality_rules, revisits, tokens, urls

# --- licenses ---------------------------------------------------------------------------------------------------------


def test_licenses_whole_changed_and_absent(spark, make_docs):
    mit = dict(licenses.TEMPLATES)["mit-permission"]
    rows = [(1, f"Bla. {mit}. Bla"), (2, mit.replace("without restriction", "with few limits").upper()), (3, "All rights reserved. x all RIGHTS\nreserved"), (4, "the rights of all are not reserved"), (5, None), (6, ""), (None, "All rights reserved."), (7, "z " * 20000 + "Released under the MIT License.")]
    got = licenses.scan_licenses(clashing(make_docs(rows))).collect()
    by = Counter((r["doc_id"], r["license"]) for r in got)
    assert by == {(1, "mit-permission"): 1, (2, "mit-permission"): 1, (3, "all-rights-reserved"): 2, (None, "all-rights-reserved"): 1, (7, "mit-short"): 1}
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert text[r["doc_id"]][r["start"] : r["end"]].lower().split()[0] in ("permission", "all", "released")
        assert 0.8 <= r["coverage"] <= 1
    assert licenses.scan_licenses(make_docs(rows).limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0-short"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0-short"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3.0-short"}),
        ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0-short"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0-short"}),
        ("Licensed under CC BY-NC-SA 3.0.", {"cc-by-nc-sa-3.0-short"}),
        ("Licensed under the Apache License, Version 1.0.", {"apache-1.0-short"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0-short"}),
        ("Released under the BSD License.", {"bsd-short"}),
        ("Released under the MIT License.", {"mit-short"}),
        ("Released under the Foo License.", set()),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by-4.0"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa-4.0"}),
        (dict(licenses.TEMPLATES)["mit"], {"mit"}),
        (dict(licenses.TEMPLATES)["bsd-2-clause"], {"bsd-2-clause"}),
        (dict(licenses.TEMPLATES)["bsd-3-clause"], {"bsd-3-clause"}),
    ],
)
def test_the_right_licence_of_a_family_is_named(text, names):
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    assert {r[0] for r in index.scan(f"Some words before it, {text} and some after.")} == names


def test_places_equal_those_without_index_and_winnowing():
    rnd = random.Random(6)
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    filler = ["some", "words", "the", "software", "license", "version", "2", "4", "and", "of"]
    for _ in range(12):
        out = [rnd.choice(filler) for _ in range(15)]
        for name, text in rnd.sample([t for t in licenses.TEMPLATES if len(t[1]) < 500], 3):
            w = licenses.WORD.findall(text)
            for _ in range(rnd.choice([0, 1, 1, len(w) // 12])):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice([[], ["changed"], [w[at], "added"]])
            out += w + [rnd.choice(filler) for _ in range(rnd.randrange(12))]
        ids = [index.vocabulary.get(x.lower(), 0) for x in out]
        shares = lambda w, d: any(0 <= d + i and ids[d + i : d + i + 3] == w[i : i + 3] for i in range(max(1, len(w) - 2)))
        everywhere = {(t, d) for t in range(len(index.names)) for d in range(-len(index.words[t]), len(ids)) if shares(index.words[t], d)}
        want = index.places(everywhere, ids, licenses.MIN_COVERAGE)
        got = index.places(index.candidates(np.array(ids)), ids, licenses.MIN_COVERAGE)
        assert {(index.names[t], n) for t, n, *_ in got} == {(index.names[t], n) for t, n, *_ in want}


def test_alignment_equals_a_full_one_within_the_band():
    rnd = random.Random(2)
    index = licenses.LicenseIndex((("t", "a b c d e f g h i j"),))
    for _ in range(50):
        text = [rnd.randrange(0, 11) for _ in range(14)]

        def lcs(w, x):
            t = [[0] * (len(x) + 1) for _ in range(len(w) + 1)]
            for i, a in enumerate(w):
                for j, b in enumerate(x):
                    t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
            return t[-1][-1]

        index.band = 50
        assert index.align(0, text, 0)[0] == lcs(index.words[0], text)


def test_shared_runs_always_share_a_fingerprint():
    rnd = random.Random(4)
    w = [rnd.randrange(5) for _ in range(60)]
    grams = [tuple(w[i : i + licenses.GRAM]) for i in range(len(w) - licenses.GRAM + 1)]
    picked = set(licenses.winnow(grams))
    assert all(picked & set(range(i, i + licenses.WINNOW)) for i in range(len(grams) - licenses.WINNOW + 1))


# --- urls -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"),
        ("http://m.example.com/de/", "m.example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.org/fr/?q", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://h?q://z/net/", "h", "", None, "allow"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule, verdict):
    pages = clashing(spark.createDataFrame([(1, url, None)], "page_id long, url string, html string"))
    r = urls.filter_urls(pages, urls.page_edges(pages)).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    link = lambda u: f'<html><head><link rel="canonical" href="{u}"></head></html>'
    rows = [
        (1, "http://a.com/x", link("http://b.com/y")),
        (2, "https://b.com/y#top", "<META http-equiv='refresh' content='0; url=http://bad.net/z'>"),
        (3, "http://x.org/fr/1", link("http://b.com/y")),
        (4, "http://c.com/", "<p>canonical</p>"),
        (4, "http://c.com/", None),
        (5, "http://d.com/1", link("/2")),
        (6, "http://d.com/2", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["propagated"]) for r in urls.filter_urls(pages, urls.page_edges(pages)).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("allow", False), 6: ("allow", False)}
    assert urls.filter_urls(pages.limit(0), urls.page_edges(pages.limit(0))).collect() == []


LINKS = [
    ("http://a.com/x/y.html", '<link rel="canonical" href="c.html">', "http://a.com/x/c.html"),
    ("http://a.com/x/y.html?q=1", "<link rel=canonical href='?p=2&amp;r=3'>", "http://a.com/x/y.html?p=2&r=3"),
    ("http://a.com/x/y/z", '<LINK HREF="../net" REL="alternate Canonical">', "http://a.com/x/net"),
    ("http://a.com/x/y/z", '<link rel="canonical" href="./a/./b/..">', "http://a.com/x/y/a/"),
    ("http://a.com", '<link rel="canonical" href="../../k">', "http://a.com/k"),
    ("http://a.com/x", '<link rel="canonical" href="/k&#47;m&#x3F;a=1&#38;b=2">', "http://a.com/k/m?a=1&b=2"),
    ("https://a.com/x", '<link rel="canonical" href="//B.com/k">', "https://B.com/k"),
    ("http://a.com/x", '<!-- <link rel="canonical" href="http://bad.net/"> -->', None),
    ("http://a.com/x", "<script>var a = '<link rel=canonical href=http://bad.net/>'</script>", None),
    ("http://a.com/x", '<link rel="stylesheet" href="http://bad.net/">', None),
    ("http://a.com/x", '<link rel="canonical" href="mailto:x@y.z">', None),
    ("http://a.com/x", "<base href='/dir/'><meta http-equiv=refresh content=\"0; URL='n.html;v=1?a=b&amp;c=d'\">", "http://a.com/dir/n.html;v=1?a=b&c=d"),
    ("http://a.com/x", '<meta http-equiv="Refresh" content="5">', None),
    ("no scheme", '<link rel="canonical" href="c.html">', None),
    ("no scheme", '<link rel="canonical" href="http://c.com/">', "http://c.com/"),
    (None, '<link rel="canonical" href="c.html">', None),
]


def test_links_of_pages_are_resolved(spark):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(LINKS)] + [(99, "http://a.com/", None)], "page_id long, url string, html string")
    got = {(r["url"], r["target"]) for r in urls.page_edges(pages).collect()}
    assert got == {(u, t) for u, _, t in LINKS if t is not None}


def test_sql_agrees_where_pages_have_links(spark, tmp_path):
    import duckdb

    rnd = random.Random(8)
    hosts = ["a.com", "B.com", "x.org", "c.net", "example.net", "m.example.com"]
    url = lambda: f"http://{rnd.choice(hosts)}/{rnd.choice(['', 'en/', 'de/', 'fr/', 'q/'])}{rnd.randrange(6)}"
    rows = [(k, u, h) for k, (u, h, _) in enumerate(LINKS)]
    for k in range(100, 500):
        target = rnd.choice([url(), "../fr/1", "/de/2", "?x=1&#38;y=2", f"{rnd.randrange(6)}", "//c.net/3", "mailto:a"])
        html_ = rnd.choice(['<link rel="canonical" href="{}">', "<meta http-equiv='refresh' content='0;url={}'>", "<!--<link rel=canonical href={}>-->", "<p>{}</p>"]).format(target)
        rows.append((k, rnd.choice([url(), url(), None, "nourl"]), rnd.choice([html_, html_, None, ""])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "pages.parquet")
    pages.toPandas().to_parquet(path)
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, urls.page_edges(pages)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{path}'")
    want = sorted(db.execute(f"select page_id, host, path, rule, verdict from ({urls.SQL})").fetchall(), key=str)
    assert got == want
    assert sum(v == "block" and rule is None for *_, rule, v in got) > 10


# --- tokens -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, make_docs, tmp_path, name):
    P = pytest.importorskip("public_tokenizers")
    path = P.path(name)
    texts = ["Hello  world\n", None, "", "naïve ▁ <s> <|endoftext|> \u0000", "Hello  world\n", "wort " * 30_000, " lead", "😀"]
    count = tokens.load_encoder(path)
    want = [count([t or ""])[0] for t in texts]
    cache = str(tmp_path / "cache")
    docs = clashing(make_docs([*enumerate(texts), (None, " lead")]))
    for _ in range(2):
        got = {r["doc_id"]: r for r in tokens.token_counts(docs, path, cache).collect()}
        assert [got[i]["n_tokens"] for i in range(len(texts))] == want
        assert [got[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
        assert got[5]["over_limit"] and not got[0]["over_limit"] and got[None]["n_tokens"] == want[6]
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # distinct misses, once
    assert tokens.token_counts(docs.limit(0), path, str(tmp_path / "none")).collect() == []


def test_a_warm_cache_reads_no_texts(spark, make_docs, tmp_path, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    cache = str(tmp_path / "cache")
    texts = [f"text number {k}" for k in range(50)]
    first = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(make_docs(texts), path, cache).collect()}
    encoded = []
    encode = tokens._encode
    monkeypatch.setattr(tokens, "_encode", lambda p: encoded.append(p) or encode(p))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(make_docs(texts), path, cache).collect()} == first
    assert not encoded
    # more misses than are broadcast
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 1)
    more = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(make_docs([*texts, "new one", "new two", "new two"]), path, cache).collect()}
    assert encoded and {k: v for k, v in more.items() if k < 50} == first and more[51] == more[52]
    assert spark.read.parquet(cache).count() == 52


# --- html -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>Menu</a></nav></body></html>", ""),
        ("<article><h1>T &amp; t</h1><p>a\n  b&nbsp;c<p>d<br>e</article><footer>&copy; x</footer>", "T & t\na b c\nd e"),
        ("<article><p>One</p><div class='ad'>Buy</div><aside>side</aside><form><label>f</label></form><script>var a='<p>x</p>'</script><style>p{}</style><p>Two</p><section id=comments><p>me too</p></section></article>", "One\nTwo"),
        ("<div class='cookie-notice'><p>We use cookies to make all of this site work as well as it can, you see</p></div><main><p>The text.</p></main>", "The text."),
        ("<article><p>unclosed <b>bold <i>it", "unclosed bold it"),
        ("plain words without any tags that go on for a while, long enough to be taken for the text of a page", "plain words without any tags that go on for a while, long enough to be taken for the text of a page"),
        ("<article><p>x &lt;p&gt; y</p><!-- <p>no</p> --></article>", "x <p> y"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_without_marks_go_by_words_and_links():
    long = "This paragraph has quite a few words in it, as paragraphs of articles do, and not a single link. "
    page = f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><div><a href=3>Three</a></div><h2>Title here</h2><div>{long}</div><div>Short one.</div><div>{long * 2}</div><div><a href=4>Four</a></div><div><a href=5>Five</a></div>"
    assert html.main_text(page) == f"Title here\n{long.strip()}\nShort one.\n{(long * 2).strip()}"


LONG = "This paragraph has quite a few words in it, as paragraphs of articles do, and not a single link."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout has-sidebar"><article><p>{LONG}</p></article></div>', LONG),
        (f'<article class="post no-sidebar"><p>{LONG}</p></article>', LONG),
        (f'<section id="social-history"><p>{LONG}</p><p>{LONG}</p></section>', f"{LONG}\n{LONG}"),
        (f'<div id="notice-of-meeting"><p>{LONG}</p></div>', LONG),
        (f"<p title=Bob's>{LONG}</p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
        (f'<p>{LONG}</p><img alt="5" tall"><p>{LONG}</p>', f"{LONG}\n{LONG}"),
        (f'<article><p><a href="x">Read more here</a></p></article><div><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><ul>" + "".join(f"<li><a href={k}>Other page {k}</a></li>" for k in range(6)) + "</ul></article>", LONG),
        (f'<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><main><p>{LONG}</p></main><div class="site-footer"><p>Words of no interest to anybody at all</p></div>', LONG),
        (f'<article><p>{LONG}</p><div class="comments"><p>{LONG}</p></div></article><div class="sidebar-left"><p>{LONG}</p></div>', LONG),
        (f'<a title="a > b" href=\'x\'>x</a><p data-x="<p>no</p>">{LONG}</p>', LONG),
    ],
)
def test_names_and_odd_quotes_dont_lose_articles(page, text):
    assert html.main_text(page) == text


def test_the_tree_on_pages_it_hasnt_seen_and_by_what_it_decides():
    pages = html.training_pages()
    right = []
    for k in range(len(pages)):
        seen, new = html.labelled_table(pages[:k] + pages[k + 1 :]), html.labelled_table(pages[k : k + 1])
        tree = html.DecisionTree().fit(seen[:, :-1], seen[:, -1])
        right += ((tree.predict(new[:, :-1]) >= 0.5) == new[:, -1]).tolist()
    assert np.mean(right) > 0.93
    # of the blocks dropped from a page like the given ones, most go by words and links
    page = "<nav><ul>" + "".join(f"<li><a href={k}>Link</a></li>" for k in range(6)) + f"</ul></nav><div class=ad>Buy this now</div><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; somebody</footer>"
    x = html.features_of(html.blocks_of(page))
    dropped = html.block_tree().predict(x) < 0.5
    last = [html.FEATURES[p[-1]] for p, d in zip(html.block_tree().paths(x), dropped, strict=True) if d]
    assert len(last) == 8 and sum(f.startswith(("words", "density")) for f in last) == 6
    # without any mark in the markup the menu still goes, and without links too it stays
    x[:, html.FEATURES.index("mark")] = 0
    assert (html.block_tree().predict(x) < 0.5)[:6].all()
    x[:, [html.FEATURES.index(f) for f in ("density", "density_before", "density_after")]] = 0
    assert (html.block_tree().predict(x) >= 0.5)[:6].all()


@pytest.mark.parametrize("piece", ["<svg>", "<a href=\"", "<!--", "<p x='", "<title>", "<", "<div class=a", "</", "&amp"])
def test_time_is_linear_in_odd_pages(piece):
    import time

    def took(n):
        began = time.process_time()
        html.main_text(piece * n)
        return time.process_time() - began

    html.main_text(piece)
    assert took(40_000) < 12 * max(took(10_000), 0.02)


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>é</p></article>"), (None, None, None), (1, "u", "<article><p>é</p></article>"), (2, "v", "<article><p>" + "w " * 50_000 + "</p></article>")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html.extract_text(pages).collect()
    assert sorted(((r["page_id"] or 0), r["n_chars"]) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 99_999)]
    assert html.extract_text(pages.limit(0)).collect() == []


# --- quality rules ----------------------------------------------------------------------------------------------------


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force():
    rnd = random.Random(0)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", "é", "\u00a0", " ", " ", "\n", "\t", "#", "|", "\x0b", "\x1c"]) for _ in range(rnd.randrange(0, 120)))
        assert quality_rules.text_counts(text)[:5] == brute_counts(text)
    assert quality_rules.text_counts(None)[:5] == (0,) * 5
    assert quality_rules.text_counts("a b c " * 20_000)[4] == 60_000


def clean_and_junk(make_docs, n=400):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopq") for _ in range(rnd.randrange(2, 9)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(60, 200))]
        if i % 10 == 0:
            words = [w + rnd.choice(["###", "%%%", "&&&"]) for w in words]
        elif i % 10 == 1:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words), rnd.choice(["en", None]), rnd.choice(["a", "a", "b", None])))
    return rows


def test_outliers_are_rejected_and_clean_texts_kept(spark, make_docs):
    rows = clean_and_junk(make_docs)
    rows += [(1000, None, "en", "a"), (1001, "", None, None), (1002, "few words", "en", "a"), (1003, "same old words " * 60, "en", "a"), (None, rows[5][1], "en", "a")]
    # passes the base rules, but two fifths of it are repeated lines
    line = [rows[k][1] for k in (2, 3, 4)]
    half = "\n".join([" ".join(line[0].split()[:40]), " ".join(line[1].split()[:40]), *([" ".join(line[2].split()[:6])] * 9)])
    rows.append((1004, half, "en", "a"))
    docs = clashing(make_docs(rows))
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(not got[i]["kept"] for i in range(400) if i % 10 < 2)
    assert all(got[i]["kept"] for i in range(400) if i % 10 >= 2)
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (1000, 1001, 1002, 1003)) and got[None]["kept"]
    assert not got[1004]["base_failed"] and not got[1004]["kept"]
    kept = quality_rules.reject_outliers(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert quality_rules.judge(docs.limit(0)).collect() == []
    few = quality_rules.judge(make_docs(rows[2:8])).collect()  # too few for any estimate
    assert all(r["distance"] is None and r["kept"] for r in few)


def test_copies_of_one_text_dont_make_the_estimate(spark, make_docs):
    clean = [r for r in clean_and_junk(make_docs, 200) if r[0] % 10 >= 2]
    rows = [(i, t, "en", "a") for i, t, *_ in clean] + [(1000 + k, clean[0][1], "en", "a") for k in range(1500)]
    assert all(r["kept"] for r in quality_rules.judge(make_docs(rows)).collect())


def test_starts_find_the_least_determinant_of_all_halves():
    import itertools

    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(12, 2)) @ np.array([[1.0, 0.7], [0.0, 0.5]])
        x[:3] += 8
        cov = lambda rows: np.cov(rows.T, bias=True) + quality_rules.RIDGE * np.eye(2)
        want = min(np.linalg.slogdet(cov(x[list(c)]))[1] for c in itertools.combinations(range(12), 7))
        assert quality_rules.fast_starts(x, 200, 1)[0][2] == pytest.approx(want)


def test_consistency():
    assert quality_rules.consistency(1, 0.999999) == pytest.approx(1.0, abs=1e-3)
    assert quality_rules.consistency(2, 0.5) == pytest.approx(0.5 / (1 - 0.5 * (1 + np.log(2))), rel=1e-6)
    assert quality_rules.chi_squared_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def numpy_mcd(x, runs=300):
    """A plain one: many starts, concentration on the nearer half to a standstill, one reweighting."""
    n, p = x.shape
    rng, best = np.random.default_rng(9), None
    dist = lambda c, s: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
    for _ in range(runs):
        k = rng.choice(n, p + 1, replace=False)
        c, s = x[k].mean(0), np.cov(x[k].T) + 1e-6 * np.eye(p)
        for _ in range(30):
            k = np.argsort(dist(c, s))[: n // 2]
            c, s = x[k].mean(0), np.cov(x[k].T, bias=True)
        if best is None or np.linalg.det(s) < best[0]:
            best = (np.linalg.det(s), c, s * quality_rules.consistency(p, 0.5))
    k = dist(*best[1:]) <= quality_rules.chi_squared_quantile(0.975, p)
    return x[k].mean(0), np.cov(x[k].T, bias=True) * quality_rules.consistency(p, 0.975)


def test_estimates_equal_a_plain_one_and_groups_lean_on_their_parents(spark):
    rng = np.random.default_rng(0)
    p = len(quality_rules.STATISTICS)
    mix = np.tril(rng.uniform(0.2, 1.0, (p, p)))
    x = rng.normal(size=(2000, p)) @ mix.T
    x[:500] += 15
    tiny = rng.normal(size=(20, p)) * 0.1
    data = [("e", "s", [float(v) for v in r]) for r in x] + [("e", "t", [float(v) for v in r]) for r in tiny]
    rows = spark.createDataFrame(data, "lang string, source string, x array<double>")
    fits = quality_rules.fit_groups(rows)
    f = {(r["level"], r["g"]): r for r in fits.collect()}
    own = f[2, '{"lang":"e","source":"s"}']
    centre, cov = numpy_mcd(x)
    assert np.array(own["centre"]) == pytest.approx(centre, abs=0.1)
    assert np.array(own["cov"]).reshape(p, p) == pytest.approx(cov, rel=0.15, abs=0.15)
    g = {r["g"]: r for r in quality_rules.shrunk_groups(rows, fits).collect()}
    w = (20 - quality_rules.LEAST) / (20 - quality_rules.LEAST + quality_rules.SHRINK)
    t, e, a = f[2, '{"lang":"e","source":"t"}'], f[1, '{"lang":"e"}'], f[0, ""]
    we = (2020 - quality_rules.LEAST) / (2020 - quality_rules.LEAST + quality_rules.SHRINK)
    parent = we * np.array(e["centre"]) + (1 - we) * np.array(a["centre"])
    assert np.array(g['{"lang":"e","source":"t"}']["centre"]) == pytest.approx(w * np.array(t["centre"]) + (1 - w) * parent)


def test_the_covariance_decides(spark):
    """A vector that is usual in each statistic, but not for their correlation, goes; with the covariance's diagonal alone it stays."""
    p = len(quality_rules.STATISTICS)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, p))
    x[:, 2] = 0.97 * x[:, 1] + 0.24 * x[:, 2]
    x = np.vstack([x, [0, 2, -2, 0, 0, 0]])
    rows = spark.createDataFrame([("e", "s", [float(v) for v in r]) for r in x], "lang string, source string, x array<double>")
    fits = quality_rules.fit_groups(rows)
    diagonal = F.transform("cov", lambda v, i: F.when(i % (p + 1) == 0, v).otherwise(0.0))
    far = []
    for f in (fits, fits.withColumn("cov", diagonal)):
        g = quality_rules.shrunk_groups(rows, f)
        far.append(rows.where("x[1] = 2 and x[2] = -2").join(g, quality_rules.group_key("lang", "source") == F.col("g")).select(quality_rules._distance().alias("d")).first()["d"])
    assert far[0] > quality_rules.CUTOFF > far[1]


# --- line classifier --------------------------------------------------------------------------------------------------


def brute_marginals(field, x):
    n = len(x)
    odds = x @ field.weights
    total, good = 0.0, np.zeros(n)
    for path in range(2**n):
        y = [(path >> i) & 1 for i in range(n)]
        w = np.exp(sum(o * k for o, k in zip(odds, y, strict=True)) + sum(field.ties[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        field = crf.LineField(rng.normal(size=31), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 31)) * 0.5
        assert field.marginals(x) == pytest.approx(brute_marginals(field, x), abs=1e-9)


def test_training_climbs_to_the_maximum_and_repeats():
    rng = np.random.default_rng(2)
    docs = [(np.column_stack([rng.normal(y * 2 - 1, 1, (k, 1)), np.zeros((k, 29)), np.ones((k, 1))]), y) for y in (0, 1) for k in rng.integers(1, 8, 60)]
    a, b = crf.train(docs), crf.train(docs)
    assert np.array_equal(a.weights, b.weights) and a.weights[0] > 0.5 and a.ties[0, 0] + a.ties[1, 1] > a.ties[0, 1] + a.ties[1, 0]
    only = crf.train([docs[-1]])
    assert only.score("some words") > 0.9 and crf.train([]).score("x") == pytest.approx(0.5)


def test_classifier_learns_without_held_out_labels(spark, make_docs):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        lines = [" ".join((word() + ("###" if bad else "")) for _ in range(rnd.randrange(3, 15))) + "." for _ in range(rnd.randrange(1, 6))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = spark.createDataFrame([(i, q if i not in held else 1 - q, t) for i, q, t in labels] + [(None, 1, 0), (5, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(make_docs([*rows, (1000, None), (1001, ""), (None, "abc ab."), (1002, ("word " * 30 + ".\n") * 900)]))
    got = {r["doc_id"]: r for r in crf.classify(docs, wrong).collect()}
    truth = {i: q for i, q, _ in labels}
    assert np.mean([got[i]["predicted"] == truth[i] for i in range(300)]) > 0.97
    assert {i for i in range(300) if got[i]["held_out"]} == set(held)
    assert got[1000]["score"] == got[1001]["score"] == 0.0 and not got[None]["held_out"] and 0 <= got[1002]["score"] <= 1
    kept = crf.reject_bad(docs, wrong)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got.values())
    assert crf.classify(docs.limit(0), wrong).collect() == []
    assert len(crf.classify(docs, wrong.limit(0)).collect()) == docs.count()


# --- revisits ---------------------------------------------------------------------------------------------------------

RECORDS = "record_id long, url string, ts double, type string, headers map<string,string>"


def brute_resolve(rows):
    from urllib.parse import urlsplit

    def key(u):
        if u is None or "://" not in u:
            return None
        rest = u.split("://", 1)[1].split("#")[0]
        host = urlsplit("http://" + rest).netloc.lower()
        tail = rest[len(host) :] or "/"
        return host + tail

    out = {}
    for i, u, t, kind, h in rows:
        if kind != "revisit":
            continue
        best = None
        for j, v, s, other, g in rows:
            if other == "response" and key(u) is not None and key(v) == key(u) and t is not None and s is not None and (s, j) < (t, i):
                if best is None or (s, j) > best[:2]:
                    best = (s, j, g)
        tag = lambda m: (m or {}).get("etag", "").removeprefix("W/")
        out[i] = (None, "unmatched") if best is None else (best[1], "resolved" if tag(best[2]) == tag(h) else "mismatch")
    return out


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_revisits_equal_brute_force(spark, ranges):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        url = rnd.choice(["http://a.com/x", "https://A.com/x#f", "http://b.org/", "http://b.org", None, "nourl"])
        rows.append((i, url, rnd.choice([None, float(rnd.randrange(60))]) if rnd.random() < 0.1 else float(rnd.randrange(60)), rnd.choice(["response", "response", "revisit", "request"]), {"etag": rnd.choice(['"1"', 'W/"1"', '"2"'])}))
    df = clashing(spark.createDataFrame(rows, RECORDS))
    got = {r["record_id"]: (r["resolved_id"], r["status"]) for r in revisits.resolve_revisits(df, ranges).collect()}
    assert got == brute_resolve(rows)


def test_permitted_headers_are_merged(spark):
    rows = [(1, "http://a/x", 1.0, "response", {"ETag": '"v"', "Content-Length": "10", "X-Old": "1", "Date": "d1"}), (2, "http://a/x", 2.0, "revisit", {"etag": '"v"', "Content-Length": "0", "date": "d2", "X-New": "2"}), (3, "http://a/x", 3.0, "revisit", None), (3, "http://a/x", 3.0, "revisit", None)]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).orderBy("record_id").collect()
    assert got[0]["headers"] == {"content-length": "10", "date": "d2", "etag": '"v"', "x-new": "2", "x-old": "1"}
    assert len(got) == 3 and got[1]["status"] == "resolved"
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORDS)).collect() == []


def test_header_names_that_differ_in_case(spark):
    rows = [(1, "http://a/x", 1.0, "response", {"ETag": "a", "etag": "b", "Etag": "c", "X": "1"}), (2, "http://a/x", 2.0, "revisit", {"ETAG": "z", "etag": "b"})]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert [(r["status"], r["resolved_id"], r["headers"]) for r in got] == [("resolved", 1, {"etag": "b", "x": "1"})]


def test_a_burst_on_one_url_is_dealt_out(spark):
    rows = [(k, "http://hot/x", 5.0, "response" if k % 3 else "revisit", None) for k in range(2000)]
    df = spark.createDataFrame(rows, RECORDS)
    got = {r["record_id"]: r["resolved_id"] for r in revisits.resolve_revisits(df, 16).collect()}
    assert got == {k: (k - 1 if k else None) for k in range(0, 2000, 3)}
