from __future__ import annotations

import hashlib
import random
import re

import pytest
from tests.llm.conftest import clashing

from evidrill.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = {}
    grams = [(k, tuple(w[i : i + n])) for k, t in items if (w := words(t)) for n in [min(13, len(w))] for i in range(len(w) - n + 1)]
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for k, g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(k))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize(("broadcast_windows", "broadcast_keys"), [(10_000, 0), (0, 10_000), (0, 0)])
def test_scan_equals_brute_force(spark, make_docs, broadcast_windows, broadcast_keys):
    rnd = random.Random(1)
    vocabulary = ["the", "Of", "ÉA", "b2", "naïve", "x", "tion", "re", "and"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "\n", ", ", "--", "\t"]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([30, 13, 14, 5, 2, 25, 12])] + [(50, None), (51, "..."), (52, "")]
    docs = [(k, text(rnd.randrange(1, 80)) + (items[k % 7][1].upper() if k % 3 == 0 else "") + text(rnd.randrange(0, 60))) for k in range(60)]
    docs += [(90, None), (91, ""), (92, "?!"), (93, items[0][1] + text(400)), (94, text(20000) + items[1][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontam.scan(clashing(make_docs(docs)), clashing(b), broadcast_windows=broadcast_windows, broadcast_keys=broadcast_keys).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == brute(docs, items)


def test_repeated_rows_nulls_and_empty_tables(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, passage), (1, passage), (1, "other"), (None, passage), (2, "clean words here")]
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontam.scan(make_docs(rows), b).collect())
    assert got == [(0, 20), (1, 0), (1, 20), (1, 20), (2, 0)]
    kept = decontam.decontaminate(clashing(make_docs(rows)), b)
    assert sorted(r["text"] for r in kept.collect()) == ["clean words here", "other"]
    assert decontam.scan(make_docs(rows).limit(0), b).count() == 0
    assert {r["n_hit"] for r in decontam.scan(make_docs(rows), b.limit(0)).collect()} == {0}


def test_spans_are_cut(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(14))
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = make_docs([(1, f"Before one {passage} after, TWO {passage}"), (2, "Left, as it is.")])
    got = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, b, remove="spans").collect()}
    assert got == {1: "before one after two", 2: "Left, as it is."}
