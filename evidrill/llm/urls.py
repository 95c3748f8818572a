"""URL filters with redirect equivalence.

Rules on host and path judge the urls they fit, the longest rule first. Redirects and canonical links make
urls aliases of each other: connected components over these edges propagate a block to all urls without a rule of their own;
an explicit allow takes precedence over what is propagated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import cut, packed
from evidrill.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host or a parent domain and starts the path; else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    picked: Column | None = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        picked = F.when(fits, value) if picked is None else picked.when(fits, value)
    return picked if picked is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def canonical_url(url: Column) -> Column:
    """The key under which spellings of one url meet: lower-cased scheme-less host, path, query; no fragment, no port of the scheme."""
    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    rest = F.when(rest == "", F.lit("/")).when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(_after_scheme(url).isNotNull(), F.concat(host, rest))


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_TAG = re.compile(r"<(link|meta|base)\b([^>]*)>", re.I)
_VALUE = re.compile(r"""[\s"'](rel|href|http-equiv|content)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_REFRESH_URL = re.compile(r"""^[\s0-9.]*[;,]\s*url\s*=\s*['"]?([^'"\s]+)""", re.I)
#: What a browser reads no elements in: comments, scripts, styles, titles, text areas.
HIDDEN = r"(?is)<!--.*?(-->|\z)|<(script|style|title|textarea)\b.*?(</(script|style|title|textarea)\s*>|\z)"
_HIDDEN = re.compile(HIDDEN.replace(r"\z", r"\Z"))


def _without_dots(path: str) -> str:
    """An absolute path with its . and .. segments resolved (RFC 3986, 5.2.4)."""
    parts = path.split("/")[1:]
    kept: list[str] = []
    for x in parts:
        if x == "..":
            kept = kept[:-1]
        elif x != ".":
            kept.append(x)
    return "/" + "/".join(kept) + ("/" if parts[-1] in (".", "..") and kept else "")


def resolved(url: str, target: str) -> str | None:
    """target as an absolute url, seen from url (RFC 3986, 5.2). None for other schemes, and for relative targets of a url without ://."""
    scheme = _SCHEME.match(target)
    if scheme:
        return target if target.startswith("//", scheme.end()) else None
    if "://" not in url:
        return None
    head, rest = url.split("://", 1)
    if target.startswith("//"):
        return f"{head}:{target}"
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    path = path or "/"
    own, tail = re.match(r"([^?#]*)(.*)", target, re.S).groups()
    if own:
        return f"{head}://{host}{_without_dots(own if own[0] == '/' else path[: path.rindex('/') + 1] + own)}{tail}"
    if target.startswith("?"):
        return f"{head}://{host}{path}{target}"
    return url.split("#", 1)[0] + target if target else url


def links_of(url: str, html: str) -> list[str]:
    """The absolute targets of a page's canonical links and refresh redirects, relative ones seen from its url or its first <base href>."""
    base, found = None, []
    for m in _TAG.finditer(_HIDDEN.sub("", html)):
        values: dict[str, str] = {}
        for name, value in _VALUE.findall(m[2]):
            values.setdefault(name.lower(), unescape(value[1:-1] if value[0] in "\"'" else value).strip())
        tag = m[1].lower()
        if tag == "base":
            base = base or values.get("href")
        elif tag == "link" and "canonical" in values.get("rel", "").lower().split():
            found.append(values.get("href", ""))
        elif tag == "meta" and values.get("http-equiv", "").lower() == "refresh":
            to = _REFRESH_URL.match(values.get("content", ""))
            found.append(to[1] if to else "")
    seen_from = (resolved(url, base) if base else None) or url
    return [to for x in found if x and (to := resolved(seen_from, x)) is not None]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(u, to) for u, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for to in links_of(u, h.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["url", "target"])


def page_edges(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and refresh redirects in the html of pages, as absolute urls.

    Links in comments, scripts and the like are none. Pages without links, with a null url or a null html give no row. Only pages that
    name one of the two leave the JVM.
    """
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    return some.select("url", "html").mapInArrow(_edges, "url string, target string")


def filter_urls(pages: DataFrame, edges: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component, propagated), one row for each row of pages.

    pages: page_id, url. edges: (url, target), redirects and canonical links. A url that a rule fits has the rule's
    verdict. Others are blocked if a url of their component is blocked by a rule and allowed otherwise; propagated
    marks the ones blocked that way. An explicit allow never changes by propagation, and it doesn't lift the
    block of its aliases. component is the smallest canonical url of the component, null for urls without edges. Null urls and urls without ://
    have an empty host and path, no rule and no aliases, and are allowed. Null ends of edges are ignored.
    """
    # few pages have edges: they are cut first, so that finding them and bringing them to their form are two plans of a compilable size
    edges, _ = packed(edges.select("url", "target").where("url is not null and target is not null"))
    links = edges.select(canonical_url(F.col("url")).alias("a"), canonical_url(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    components = cut(connected_components(links))
    key = F.concat(F.lit("http://"), F.col("node"))
    judged = components.select("node", "component", rule_of(host_of(key), path_of(key), rules).alias("r"))
    blocked = judged.where("r.verdict = 'block'").select(F.col("component").alias("bad")).distinct()
    fate = judged.join(blocked, F.col("component") == F.col("bad"), "left").select("node", "component", F.col("bad").isNotNull().alias("blocked"))
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("__key"))
    p = p.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    out = p.join(fate, F.col("__key") == F.col("node"), "left")
    moved = F.col("__r").isNull() & F.coalesce("blocked", F.lit(False))
    return out.select("page_id", "url", "host", "path", F.col("__r.rule").alias("rule"), F.when(moved, "block").otherwise(F.coalesce(F.col("__r.verdict"), F.lit("allow"))).alias("verdict"), "component", moved.alias("propagated"))


def _rule_sql(host: str, path: str, rules: tuple[tuple[str, str, str], ...], value: int) -> str:
    cases = [f"when ({host} = '{r[1]}' or {host} like '%.{r[1]}') and starts_with({path}, '{r[2]}') then '{r[1] + r[2] if value == 0 else r[0]}'" for r in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return f"case {' '.join(cases)} end"


_HOST = "coalesce(translate(case when instr({u}, '://') > 0 then regexp_extract(substr({u}, instr({u}, '://') + 3), '^([^/?#]*)', 1) end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(case when instr({u}, '://') > 0 then regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) end, '')"
_REST = "regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^#]*)', 1)"
_KEY = f"case when instr({{u}}, '://') > 0 then regexp_replace({_HOST}, ':(80|443)$', '') || (case when {_REST} = '' then '/' when {_REST}[1] = '?' then '/' || {_REST} else {_REST} end) end"

#: Character references that the SQL decodes, besides numeric ones.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_NAME = "[A-Za-z][A-Za-z0-9+.-]*"


def _attribute_sql(tag: str, name: str) -> str:
    raw = f"""regexp_extract({tag}, '(?is)[\\s"'']{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1)"""
    bare = f"""(case when {raw}[1] in ('"', '''') then {raw}[2 : len({raw}) - 1] else {raw} end)"""
    parts = f"string_split({bare}, '&')"
    code = "coalesce(try_cast(nullif(regexp_extract(x, '^#0*([0-9]{1,7});', 1), '') as bigint), try_cast('0x' || nullif(regexp_extract(x, '^#[xX]0*([0-9a-fA-F]{1,6});', 1), '') as bigint), 0)"
    rest = "regexp_extract(x, '(?s)^[^;]*;(.*)$', 1)"
    named = " ".join(f"when starts_with(x, '{n};') then '{c.replace(chr(39), chr(39) * 2)}' || {rest}" for n, c in NAMED.items())
    one = f"case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr(cast({code} as int)) || {rest} {named} else '&' || x end"
    return f"trim({parts}[1] || array_to_string(list_transform({parts}[2:], lambda x: {one}), ''))"


def _without_dots_sql(path: str) -> str:
    parts = f"string_split({path}, '/')[2:]"
    kept = f"list_reduce([[]::varchar[]] || list_transform({parts}, lambda x: [x]), lambda s, x: case when x[1] = '..' then s[1 : len(s) - 1] when x[1] = '.' then s else s || x end)"
    return f"'/' || array_to_string({kept}, '/') || case when {parts}[-1] in ('.', '..') and len({kept}) > 0 then '/' else '' end"


def _resolved_sql(u: str, t: str) -> str:
    scheme, host, path = f"regexp_extract({u}, '^([^:]+)://', 1)", _HOST.format(u=u), _PATH.format(u=u)
    path = f"(case when {path} = '' then '/' else {path} end)"
    own, rest = f"regexp_extract({t}, '(?s)^([^?#]*)', 1)", f"regexp_extract({t}, '(?s)^[^?#]*(.*)$', 1)"
    to = f"(case when starts_with({own}, '/') then {own} else regexp_extract({path}, '(?s)^(.*/)', 1) || {own} end)"
    relative = f"case when {own} <> '' then {scheme} || '://' || {host} || {_without_dots_sql(to)} || {rest} when starts_with({t}, '?') then {scheme} || '://' || {host} || {path} || {t} when starts_with({t}, '#') then regexp_extract({u}, '(?s)^([^#]*)', 1) || {t} else {u} end"
    return f"case when regexp_matches({t}, '^{_NAME}://') then {t} when regexp_matches({t}, '^{_NAME}:') or instr({u}, '://') = 0 then null when starts_with({t}, '//') then {scheme} || ':' || {t} else {relative} end"


_TAGS = "regexp_extract_all(h, '(?is)<{}\\b[^>]*>')"
_CANONICAL = f"list_transform(list_filter({_TAGS.format('link')}, lambda y: regexp_matches(lower({_attribute_sql('y', 'rel')}), '(^|\\s)canonical(\\s|$)')), lambda y: {_attribute_sql('y', 'href')})"
_REFRESH = f"""list_transform(list_filter({_TAGS.format('meta')}, lambda y: lower({_attribute_sql('y', 'http-equiv')}) = 'refresh'), lambda y: regexp_extract({_attribute_sql('y', 'content')}, '(?is)^[\\s0-9.]*[;,]\\s*url\\s*=\\s*[''"]?([^''"\\s]+)', 1))"""
_BASE = f"list_filter(list_transform({_TAGS.format('base')}, lambda y: {_attribute_sql('y', 'href')}), lambda y: y <> '')[1]"

#: DuckDB SQL for op4.
SQL = f"""
with recursive h0 as (select url, regexp_replace(html, '{HIDDEN}', '', 'g') as h from pages where url is not null and regexp_matches(html, '(?i)canonical|http-equiv')),
t0 as (select url, {_BASE} as base, unnest({_CANONICAL} || {_REFRESH}) as target from h0),
t1 as (select url, case when base is null then url else coalesce({_resolved_sql('url', 'base')}, url) end as seen, target from t0 where target <> ''),
t as (select url, {_resolved_sql('seen', 'target')} as target from t1),
l as (select distinct {_KEY.format(u="url")} as a, {_KEY.format(u="target")} as b from t where instr(url, '://') > 0 and instr(target, '://') > 0),
e as (select a as x, b as y from l union all select b, a from l),
r as (select x as node, x as o from e union select r.node, e.y from r join e on r.o = e.x),
bad as (select distinct node from r where {_rule_sql("(" + _HOST.format(u="('http://' || o)") + ")", "(" + _PATH.format(u="('http://' || o)") + ")", RULES, 1)} = 'block'),
p as (select page_id, {_HOST.format(u="url")} as host, {_PATH.format(u="url")} as path, {_KEY.format(u="url")} as k from pages)
select page_id, host, path, {_rule_sql("host", "path", RULES, 0)} as rule,
  coalesce({_rule_sql("host", "path", RULES, 1)}, case when k in (select node from bad) then 'block' else 'allow' end) as verdict
from p
"""
