"""Not-modified revisit resolution: an as-of join by canonical URL to the latest earlier full response.

A revisit record stands for a 304 answer: it has validators and a few headers but no content. The join finds, for
each revisit, the latest full response of the same canonical url that is earlier in (time, record id). Records are dealt out in ranges of
(url, time, id) of like size, so that neither a hot url, nor a long history, nor a burst within a second meets in one task: within a range a window carries
the latest response of a url forward; across ranges the latest response of earlier ones is carried over a table of one row a url and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.llm.common import cut, same
from evidrill.llm.urls import canonical_url

#: Headers that describe the stored content or the connection: a 304 answer may not change them.
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def lower_names(headers: Column) -> Column:
    """The map with lower-cased names; of names that meet, the value of the one that sorts last as written (maps have no order). A null map is empty."""
    h = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    entries = F.transform(F.array_sort(F.map_entries(h)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_headers(stored: Column, update: Column, not_updated: tuple[str, ...] = NOT_UPDATED) -> Column:
    """The stored headers, replaced and added to by the permitted ones of the 304 answer. Names are in lower case, in order."""
    fixed = F.array(*[F.lit(x) for x in not_updated])
    allowed = F.map_filter(update, lambda k, v: ~F.array_contains(fixed, k) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, allowed))))


def validators_agree(stored: Column, revisit: Column) -> Column:
    """Weak comparison of entity tags if both have one, else equality of last-modified; true if the revisit has neither."""

    def tag(h: Column) -> Column:
        return F.regexp_replace(F.trim(_header(h, "etag")), "^W/", "")

    etag, modified = tag(revisit), _header(revisit, "last-modified")
    both = etag.isNotNull() & tag(stored).isNotNull()
    return F.when(both, etag == tag(stored)).when(modified.isNotNull() & _header(stored, "last-modified").isNotNull(), modified == _header(stored, "last-modified")).otherwise(etag.isNull() & modified.isNull())


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """(record_id, url_key, ts, resolved_id, status, headers), one row for each revisit record.

    records: record_id, url, ts (seconds), type ('response' or 'revisit'), headers map<string,string>. resolved_id is the latest
    response with the same canonical url and a smaller (ts, record_id). status: 'resolved'; 'mismatch' if its validators
    differ from the revisit's (resolved_id is then the response that was looked at); 'unmatched' if there is none. headers: of a resolved revisit,
    the response's merged with the permitted ones of the revisit, else the revisit's own; names in lower case.

    Revisits with a null url, a url without :// or a null time are unmatched; such responses are never looked at. Equal times go by record_id,
    repeated records all stand; responses of one id, url and time are one. Null headers are empty; of header names that differ in case the one that sorts last counts. Other types of
    records are left out, extra columns ignored. ranges: into how many the records are dealt out; by default as many as there are shuffle partitions.
    """
    r = records.where(F.col("type").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("double").alias("ts"), "type", lower_names(F.col("headers")).alias("headers"))
    full = F.col("type") == "response"
    usable = r.where("url_key is not null and ts is not null")
    # the narrow join: only ids and times are sorted, headers follow by id; repeated records are settled once
    # at one time and id the revisit comes first: a response isn't earlier than itself
    order = [F.col("ts"), F.col("record_id").asc_nulls_first(), full.cast("int")]
    narrow = usable.select("record_id", "url_key", "ts", "type").distinct()
    by = [F.col("url_key"), *order]
    dealt = narrow.repartitionByRange(ranges, *by) if ranges else narrow.repartitionByRange(*by)
    # cut, so that a task that runs again can't draw other ranges
    narrow = cut(dealt.withColumn("bucket", F.spark_partition_id()))
    within = Window.partitionBy("url_key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    response = F.when(full, F.struct("ts", "record_id"))
    lasts = narrow.groupBy("url_key", "bucket").agg(F.max(response).alias("last"))
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("url_key").alias("k"), F.col("bucket").alias("b"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    seen = narrow.withColumn("here", F.last(response, ignorenulls=True).over(within)).where(~full)
    found = seen.join(carried, (F.col("url_key") == F.col("k")) & (F.col("bucket") == F.col("b"))).select("record_id", "url_key", "ts", F.coalesce("here", "carried").alias("at"))
    found = cut(found.select(F.col("record_id").alias("i"), F.col("url_key").alias("u"), F.col("ts").alias("t"), "at").distinct())
    mine = r.where(~full).select("record_id", "url_key", "ts", "headers")
    out = mine.join(found, same(mine["record_id"], found["i"]) & same(mine["url_key"], found["u"]) & same(mine["ts"], found["t"]), "left").drop("i", "u", "t")
    stored = usable.where(full).select(F.col("record_id").alias("sid"), F.col("url_key").alias("su"), F.col("ts").alias("st"), F.col("headers").alias("stored")).dropDuplicates(["sid", "su", "st"])
    out = out.join(stored, same(out["at.record_id"], stored["sid"]) & same(out["url_key"], stored["su"]) & same(out["at.ts"], stored["st"]) & F.col("at").isNotNull(), "left")
    agree = validators_agree(F.col("stored"), F.col("headers"))
    status = F.when(F.col("at").isNull(), "unmatched").when(agree, "resolved").otherwise("mismatch")
    out = out.select("record_id", "url_key", "ts", F.col("at.record_id").alias("resolved_id"), status.alias("status"), "headers", "stored")
    merged = F.when(F.col("status") == "resolved", merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers"))
    return out.select("record_id", "url_key", "ts", "resolved_id", "status", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records for each row of pages: its full response, and the revisit of a crawl a day later.

    The table has no crawl log, so the log is derived: the response of page p is dated p seconds after the first, its entity tag is a digest of its
    html; the revisit carries the tag that a crawler would have stored, which is stale (another page's) where the digest
    ends in 0, and a newer date header. Spellings of the revisit's url differ in scheme and fragment, as re-crawled links do.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.md5(html.cast("binary"))
    p = pages.select(F.col("page_id").alias("id"), "url", tag.alias("tag"), F.octet_length(html).cast("string").alias("len"))
    response = F.struct((F.col("id") * 2).alias("record_id"), F.col("url").alias("url"), F.col("id").cast("double").alias("ts"), F.lit("response").alias("type"), F.create_map(F.lit("ETag"), F.concat(F.lit('"'), "tag", F.lit('"')), F.lit("Content-Length"), F.col("len"), F.lit("Date"), F.col("id").cast("string")).alias("headers"))
    stale = F.when(F.col("tag").endswith("0"), F.reverse("tag")).otherwise(F.col("tag"))
    other = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https:", "http:"), F.lit("#again"))
    revisit = F.struct((F.col("id") * 2 + 1).alias("record_id"), other.alias("url"), (F.col("id") + 86400).cast("double").alias("ts"), F.lit("revisit").alias("type"), F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), stale, F.lit('"')), F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("id") + 86400).cast("string")).alias("headers"))
    return p.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


#: DuckDB SQL for op10: the same log, resolved by a window over each canonical url.
QUERY_SQL = r"""
with p as (select page_id as id, url, md5(coalesce(html, '')) as tag, octet_length(encode(coalesce(html, ''))) as len from pages),
log as (
  select id * 2 as record_id, url, cast(id as double) as ts, true as is_full, tag as etag, cast(len as varchar) as len, cast(id as varchar) as date from p
  union all
  select id * 2 + 1, regexp_replace(regexp_replace(url, '#.*$', ''), '^https:', 'http:') || '#again', cast(id + 86400 as double), false, case when suffix(tag, '0') then reverse(tag) else tag end, '0', cast(id + 86400 as varchar) from p),
k as (
  select *, case when instr(url, '://') > 0 then
      regexp_replace(translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '') ||
      (case when rest = '' then '/' when rest[1] = '?' then '/' || rest else rest end) end as url_key
  from (select *, regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^#]*)', 1) as rest from log)),
w as (
  select *, last_value(case when is_full then struct_pack(id := record_id, etag := etag, len := len, date := date) end ignore nulls)
      over (partition by url_key order by ts, record_id rows between unbounded preceding and 1 preceding) as prior
  from k where url_key is not null and ts is not null)
select record_id, url_key, ts, prior.id as resolved_id, case when prior is null then 'unmatched' when prior.etag = etag then 'resolved' else 'mismatch' end as status,
  case when prior is not null and prior.etag = etag then date || '|' || prior.len || '|W/"' || etag || '"' else date || '|0|W/"' || etag || '"' end as headers
from w where not is_full
union all
select record_id, url_key, ts, null, 'unmatched', date || '|0|W/"' || etag || '"' from k where not is_full and (url_key is null or ts is null)
"""
