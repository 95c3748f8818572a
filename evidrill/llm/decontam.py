"""Benchmark decontamination with DataFrame functions only.

Windows of 13 normalised words of the benchmark make a broadcast hash set; token windows of the documents are looked up in
it. The set is keyed by each window's rarest word, so that a position of a document costs one probe with the word that is there; the window
around it that the set names is verified word by word. Hit positions are united
to covered words, and a document loses its covered spans or goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import cut, same, small

#: Words in a window.
WINDOW = 13
#: Windows up to which the set is broadcast with its words, if these have no more than BROADCAST_BYTES. Beyond, only the (key, offset, length) places of windows are, up to BROADCAST_KEYS of
#: some 50 bytes, and the positions that they find meet the windows in a shuffle.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20
BROADCAST_KEYS = 4_000_000

#: Words of a text that go through the search together.
CHUNK = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower case.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words: A-Z in lower case, runs of digits, letters a-z and all characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    # in a text of ASCII alone lower() does what translate() does, a byte at a time
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def word_count(text: Column) -> Column:
    """How many words() there are; letters need not be lowered for that."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_SEPARATORS), "")).cast("long")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, tokens): every window of every item, once an item. Shorter items are one window."""
    b = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - length)
    return b.select("item_id", length.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, length))).alias("tokens")).distinct()


def keyed_windows(windows: DataFrame) -> DataFrame:
    """(window_id, length, tokens, key, offset): each window once, with its rarest word and where that first stands.

    Rare is what few windows hold; of equals the longest word.
    """
    distinct = cut(windows.select("length", "tokens").distinct().withColumn("window_id", F.xxhash64("length", "tokens")))
    each = distinct.select("length", "tokens", F.posexplode("tokens").alias("offset", "key"))
    counts = each.groupBy("key").agg(F.count("*").alias("n"))
    rank = F.struct("n", (-F.length("key")).alias("short"), "key", "offset")
    best = each.join(counts, "key").groupBy("length", "tokens").agg(F.min(rank).alias("best"))
    return cut(best.select(F.xxhash64("length", "tokens").alias("window_id"), "length", "tokens", "best.key", "best.offset"))


def _positions(docs: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_key, word, pos, at, near) of each word of the documents: near has the words up to `reach` before and after a chunk of the text, the
    word itself at index at. Texts are cut into chunks first, so that no row carries more than a chunk with it, however long the text."""
    w = words(F.col("text"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), w.alias("w"))
    first = lambda s: F.greatest(s - F.lit(reach), F.lit(0))
    chunk = lambda s: F.struct(s.alias("s"), F.slice("w", first(s) + 1, s - first(s) + F.lit(CHUNK + reach)).alias("near"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(CHUNK)))
    chunks = base.select("doc_id", "text_key", F.explode(F.transform(starts, chunk)).alias("c"))
    chunks = chunks.select("doc_id", "text_key", "c.s", F.least("c.s", F.lit(reach)).alias("lead"), "c.near")
    each = chunks.select("doc_id", "text_key", "s", "lead", "near", F.posexplode("near").alias("at", "word"))
    own = (F.col("at") >= F.col("lead")) & (F.col("at") < F.col("lead") + F.lit(CHUNK))  # the others belong to a chunk of their own
    return each.where(own).select("doc_id", "text_key", "word", (F.col("s") - F.col("lead") + F.col("at")).alias("pos"), "at", "near")


def hit_windows(docs: DataFrame, windows: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, text_key, start, length, window_id) for every occurrence of a window in a document."""
    keyed = keyed_windows(windows)
    at = _positions(docs, window - 1)
    fits = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("length") <= F.size("near"))
    own = F.slice("near", F.greatest(F.col("at") - F.col("offset"), F.lit(0)) + 1, F.col("length"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    count, size = keyed.agg(F.count("*"), F.sum(F.octet_length(F.array_join("tokens", " ")))).first()
    if count <= broadcast_windows and (size or 0) <= BROADCAST_BYTES:  # all in one stage: only hits leave it
        hit = at.join(F.broadcast(keyed), F.col("word") == F.col("key")).where(fits & (own == F.col("tokens")))
        return hit.select("doc_id", "text_key", start, "length", "window_id")
    # the places of keys without the windows' words are few; what they find goes to the shuffle with its own words
    places = cut(keyed.select("key", "offset", "length").distinct())
    if places.count() <= broadcast_keys:
        places = F.broadcast(places)
    else:  # then each position is shuffled, with the words around it
        before = F.least(F.col("at"), F.lit(window - 1))
        at = at.select("doc_id", "text_key", "word", "pos", F.slice("near", F.col("at") - before + 1, before + window).alias("near"), before.alias("at"))
    found = at.join(places, F.col("word") == F.col("key")).where(fits)
    found = found.select("doc_id", "text_key", start, "length", own.alias("own")).withColumn("own_id", F.xxhash64("length", "own"))
    hit = found.join(keyed.select("window_id", "tokens"), (F.col("own_id") == F.col("window_id")) & (F.col("own") == F.col("tokens")))
    return hit.select("doc_id", "text_key", "start", "length", "window_id")


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted (start, end) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(spans, zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")), lambda s: s["n"])


def _merged(spans: Column) -> Column:
    """The union of sorted spans as disjoint spans, in order."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= last["end"]), longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, empty, add)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_key.

    n_hit counts the words inside any occurrence of a benchmark window, n_items the items with such a window;
    items_sha256 digests their ids, sorted as strings and joined by commas (of no ids: the digest of the empty text).
    contaminated: n_hit > 0 and min_share * n_hit >= n_words. spans are disjoint ranges of words, ends exclusive.

    Null and empty texts have no words and no hits. Benchmark items without words never hit; items with a null id are left
    out of n_items but still hit. Rows with the same doc_id and text each get their own, equal row. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    windows = cut(benchmark_windows(benchmark.select("item_id", "text"), window))
    found = hit_windows(docs, windows, window, broadcast_windows, broadcast_keys)
    # positions of one window in one document first meet in the map-side partial aggregate
    per = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"), F.collect_set("window_id").alias("ids"))
    per = cut(per)
    items = windows.select(F.xxhash64("length", "tokens").alias("window_id"), F.col("item_id").cast("string").alias("item")).distinct()
    who = per.select("doc_id", "text_key", F.explode("ids").alias("window_id")).join(items, "window_id").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    who = who.select(F.col("doc_id").alias("d2"), F.col("text_key").alias("k2"), "items")
    spans = per.select(F.col("doc_id").alias("d1"), F.col("text_key").alias("k1"), "spans")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("n_words"))
    out = base.join(spans, same(base["doc_id"], spans["d1"]) & (base["text_key"] == spans["k1"]), "left")
    out = out.join(who, same(out["doc_id"], who["d2"]) & (out["text_key"] == who["k2"]), "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "spans", "text_key")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", "text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, min_share: int = 20) -> DataFrame:
    """docs without contaminated documents (remove="documents") or with the covered words cut out of them ("spans").

    Cutting puts a document's remaining normalised words between the spans together again, one space apart; documents without hits keep
    their text as it is. All columns of docs come back. Rows are matched by doc_id and text, nulls with nulls.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = scan(docs, benchmark, window, min_share)
    if remove == "documents":
        bad = cut(found.where("contaminated").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct())
        return docs.join(small(bad), same(docs["doc_id"], F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__k")), "left_anti")
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), _merged(F.col("spans")).alias("__spans")).dropDuplicates(["__d", "__k"])
    joined = docs.join(hit, same(docs["doc_id"], hit["__d"]) & (F.xxhash64(docs["text"]) == hit["__k"]), "left")
    w = words(F.col("text"))
    ends = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["end"]))
    starts = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.size(w)))
    rest = F.flatten(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: F.slice(w, z["a"] + 1, z["b"] - z["a"])))
    return joined.select(*[F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(rest, " ")).alias("text") if c == "text" else docs[c] for c in docs.columns])


#: DuckDB SQL for the rows of scan(), by the contract's wording.
SCAN_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from {docs}),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as s from b where len(w) > 0)),
occ as (
  select d.rid, p.s, p.n, win.item_id
  from (select rid, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from win)) p
  join d on d.rid = p.rid join win on win.n = p.n and win.g = array_to_string(d.w[p.s : p.s + p.n - 1], ' ')),
hit as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(s, s + n)) as k from (select distinct rid, s, n from occ)) group by rid),
it as (select rid, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct rid, cast(item_id as varchar) as i from occ where item_id is not null) group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit.n_hit, 0) as bigint) as n_hit, cast(coalesce(it.n_items, 0) as bigint) as n_items,
  sha256(coalesce(it.ids, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 and 20 * coalesce(hit.n_hit, 0) >= len(d.w) as contaminated
from d left join hit using (rid) left join it using (rid)
"""
