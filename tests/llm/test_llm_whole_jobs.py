from __future__ import annotations

import random

import pytest

from evidrill.llm import quality_rules, urls


def test_duplicated_text_is_rejected_in_a_clean_group(spark):
    rnd = random.Random(3)
    text = lambda n: [" ".join("".join(rnd.choice("abcdefghijklmnopq") for _ in range(rnd.randrange(2, 9))) for _ in range(10)) for _ in range(n)]
    rows = [(i, "\n".join(text(rnd.randrange(8, 20)))) for i in range(300)]
    own = text(1)
    rows.append((901, "\n".join(text(12) + [" ".join(own[0].split()[:5])] * 20)))  # 59 % duplicate lines, 45 % of words repeated
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert not got[901]["base_failed"] and not got[901]["kept"]
    assert sum(got[i]["kept"] for i in range(300)) >= 297


@pytest.mark.parametrize(
    ("target", "full"),
    [("page2.html", "http://A.com/x/page2.html"), ("../a", "http://A.com/a"), ("?id=1", "http://A.com/x/y?id=1"), ("./../../b/./c/..?q=../z", "http://A.com/b/?q=../z"), ("mailto:a@b.c", None), ("go?to=http://z.net/", "http://A.com/x/go?to=http://z.net/")],
)
def test_relative_targets_are_resolved(spark, target, full):
    page = spark.createDataFrame([(1, "http://A.com/x/y?o=1#f", f'<link rel="canonical" href="{target}">')], "page_id long, url string, html string")
    got = [r["target"].lower() for r in urls.page_edges(page).collect()]
    assert got == ([] if full is None else [full.lower()])


def test_blocks_reach_relative_aliases(spark):
    refresh = "<meta http-equiv=refresh content='0;url=index2.html'>"
    pages = spark.createDataFrame([(1, "http://bad.net/z", "<meta http-equiv=refresh content='0;url=http://a.com/d/index2.html'>"), (2, "http://a.com/d/index.html", refresh)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, urls.page_edges(pages)).collect()} == {1: "block", 2: "block"}
