"""DuckDB SQL for the operators that SQL can express, on the tables as they are."""

from __future__ import annotations

from quillspark.llm import mixing, quality, urls
from quillspark.llm.common import PRIME

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x != '')"


def _near(n: int) -> str:
    shingle = "coalesce(array_to_string(w[i:i + {m}], ' '), '')".format(m=n - 1)
    return rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x != '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < {n} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {n - 2}), lambda i: {shingle}) end) as s from d),
n as (select doc_id, len(s) as n_shingles, s from s),
u as (select doc_id, unnest(s) as g, n_shingles from n),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n_shingles) as na, any_value(b.n_shingles) as nb from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
e as (select a as x, b as y from l union all select b, a from l),
r as (select doc_id as x, doc_id as y from n union select r.x, e.y from r join e on r.y = e.x),
k as (select x as doc_id, min(y) as component_id from r group by x)
select n.doc_id, cast(n_shingles as bigint) as n_shingles, component_id, n.doc_id = component_id as kept from n join k using (doc_id)
"""


_CLASS_SUMS = ", ".join(f"sum(c[{i + 1}])" for i in range(len(quality.CLASSES) + 2))
_QUALITY = rf"""
with w as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, {_WORDS} as w from documents),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
rep as (select doc_id, count(*) as n from (select distinct doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
f as (select w.doc_id, lang, cast(length(t) as bigint) as n_chars, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')))) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
  [cast(length(regexp_replace(t, '[^A-Z]+', '', 'g')) as bigint), length(regexp_replace(t, '[^0-9]+', '', 'g')), length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')), length(regexp_replace(t, '[^aeiou]+', '', 'g')), length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')), length(t) - length(array_to_string(w, ''))] as c,
  list_transform(case lang {" ".join(f"when '{k}' then {v.split()}" for k, v in quality.COMMON.items())} else [] end, lambda k: cast(len(list_filter(w, lambda x: x = k or x = upper(k[1]) || k[2:])) as bigint)) as h
  from w left join rep using (doc_id)),
per as (select lang, sum(n_chars) as chars, sum(n_words) as words, [{_CLASS_SUMS}] as c, [{", ".join(f"sum(h[{i + 1}])" for i in range(quality.N_COMMON))}] as h from f group by lang having count(*) >= {quality.MIN_REFERENCE}),
every as (select sum(n_chars) as chars, [{_CLASS_SUMS}] as c from f),
j as (select f.*, coalesce(per.chars, every.chars) as rchars, coalesce(per.c, every.c) as rc, per.words as rwords, per.h as rh from f left join per using (lang) cross join every),
q as (select *, list_transform(c || [n_chars - list_sum(c)], lambda x: x / n_chars) as p1, list_transform(rc || [rchars - list_sum(rc)], lambda x: x / rchars) as q1,
  list_transform(h || [n_words - list_sum(h)], lambda x: x / n_words) as p2, list_transform(rh || [rwords - list_sum(rh)], lambda x: x / rwords) as q2 from j),
v as (select *, round(sqrt(greatest(list_sum(list_transform(list_zip(p1, q1), lambda z: (case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end + case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end) / 2)), 0)), 6) as d1,
  round(sqrt(greatest(list_sum(list_transform(list_zip(p2, q2), lambda z: (case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end + case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end) / 2)), 0)), 6) as d2 from q),
g as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, case when n_chars >= {quality.MIN_CHARS_FOR_CLASSES} then d1 end as class_distance,
  case when n_words >= {quality.MIN_WORDS_FOR_WORDS} and len(h) > 0 and rwords is not null then d2 end as word_distance from v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(class_distance, 0) <= {quality.MAX_CLASS_DISTANCE} and coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} as kept, class_distance, word_distance from g
"""

_MIXING = rf"""
with d as (select doc_id, source, cast(len({_WORDS}) as bigint) as size from documents),
s as (select source, sum(size)::bigint as source_size, cast(count(*) as bigint) as n from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w, source_size * {float(mixing.MOST)} as cap, (sum(source_size) over ())::double * {mixing.SHARE} as every from s),
l as (select *, (every - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) as level from w window o as (order by cap / w, source nulls last)),
t as (select source, source_size, least(cap, coalesce((select arg_min(level, cap / w) from l where level * w <= cap) * w, cap)) as target from l),
c as (select d.*, cast(floor(8 * log2(size + 1.0)) as integer) as class from d),
b as (select *, cast(ceil(count(*) over (partition by source, class) / 1000.0) as bigint) as blocks from c),
r as (select b.*, row_number() over (partition by source order by class, ((((coalesce(doc_id, 0) % {PRIME}) + {PRIME}) % {PRIME}) * 48271 + (size % {PRIME}) * 69621) % {PRIME} % blocks, doc_id nulls first, size) as rank from b),
x as (select r.doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate, rank from r join t on r.source is not distinct from t.source)
select doc_id, size, source_size, target, cast((floor(rank * rate + {mixing.offset()!r}) - floor((rank - 1) * rate + {mixing.offset()!r})) * size as bigint) as taken from x
"""

_SUBSTRINGS = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
t as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from g) where c > 1),
m as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 35)) as p from t) group by doc_id),
k as (select d.doc_id, cast(unnest(range(1, len(w) + 1)) as bigint) as p, unnest(w) as x from d),
z as (select k.doc_id, string_agg(x, ' ' order by p) as kept from k where not exists (select 1 from (select doc_id, unnest(gone) as p from m) q where q.doc_id = k.doc_id and q.p = k.p) group by k.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join m using (doc_id) left join z using (doc_id)
"""

_WARC = """
with p as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(encode(coalesce(html, ''))) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest) as last from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type, case when payload_bytes >= 1000 and page_id < last then last end as refers_to from m
"""

def _shrunk(source: str, mean: str, name: str) -> str:
    """The groups of a table (n, bad, the prior's mean), with the posterior mean and the prior's weight."""
    share = f"sum((bad - n * {mean}) * (bad - n * {mean}) - n * {mean} * (1 - {mean})) / nullif(sum(n * (n - 1) * {mean} * (1 - {mean})), 0)"
    weight = f"select round(coalesce(case when s is null then {urls.UNKNOWN} when s <= {1 / (1 + urls.MOST)!r} then {urls.MOST} else greatest({urls.LEAST}, 1 / s - 1) end, {urls.UNKNOWN}), 6) as k from (select {share} as s from {source})"
    return f"select g.*, k as {name}_weight, round((bad + k * {mean}) / (n + k), 9) as {name} from {source} g, ({weight})"


def _urls() -> str:
    fits = [(v, r, *r.partition("/")) for v, r in urls.RULES]
    rules = ", ".join(f"('{v}', '{r}', '{h}', '{s}{p}', {len(r)})" for v, r, h, s, p in fits)
    two = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
    return rf"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urls.LOWER[0]}', '{urls.LOWER[1]}') as host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
l as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null and toxic is not null then 0 end) as bad from labels group by doc_id),
p as (select u.*, l.bad from u left join l on page_id = doc_id),
c as (select host, cast(count(bad) as bigint) as n, cast(coalesce(sum(bad), 0) as bigint) as bad from p group by host),
b as (select *, regexp_replace(host, '^.*@|:[0-9]*$|\.+$', '', 'g') as bare, string_split(regexp_replace(host, '^.*@|:[0-9]*$|\.+$', '', 'g'), '.') as a from c),
h0 as (select host, n, bad, case when regexp_full_match(bare, '[0-9.]+') then bare when array_to_string(a[-2:], '.') in ({two}) then array_to_string(a[-3:], '.') else array_to_string(a[-2:], '.') end as domain,
  case when regexp_full_match(bare, '[0-9.]+') then bare when array_to_string(a[-2:], '.') in ({two}) then array_to_string(a[-2:], '.') else a[-1] end as suffix from b),
d0 as (select domain, suffix, sum(n) as n, sum(bad) as bad from h0 group by all),
s0 as (select suffix, sum(n) as n, sum(bad) as bad from d0 group by all),
s1 as (select s0.*, (select round((coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2), 9) from s0) as all_rate from s0),
s2 as ({_shrunk("s1", "all_rate", "suffix_rate")}),
d1 as (select d0.*, suffix_rate from d0 join (select suffix, suffix_rate from s2) using (suffix)),
d2 as ({_shrunk("d1", "suffix_rate", "domain_rate")}),
h1 as (select h0.*, domain_rate from h0 join (select domain, domain_rate from d2) using (domain)),
h2 as ({_shrunk("h1", "domain_rate", "bad_rate")}),
h3 as (select host, n as n_labelled, bad as n_bad, round(bad_rate, 6) as bad_rate, round(bad_rate - {urls.Z} * sqrt(bad_rate * (1 - bad_rate) / (n + bad_rate_weight + 1)), 6) as bound from h2),
r(verdict, rule, host, path, size) as (values {rules}),
f as (select k.host, k.path, arg_max(r.rule, size) as rule, arg_max(r.verdict, size) as verdict from (select distinct host, path from p) k join r on (k.host = r.host or ends_with(k.host, '.' || r.host)) and starts_with(k.path, r.path) group by all)
select page_id, p.host, p.path, f.rule, coalesce(f.verdict, case when bound > {urls.MAX_BAD} then 'block' else 'allow' end) as verdict, n_labelled, n_bad, h3.bad_rate, bound
from p join h3 using (host) left join f on p.host = f.host and p.path = f.path
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    step = "xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end)"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint)), lambda c, x: list_reduce(range(8), lambda a, i: {step}, xor(c, x)), 4294967295::bigint), 4294967295)"


_TRIE = f"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, {_crc32("cast(conv_id as varchar)")} % 9 as h from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as own, i, role, text from c join t on t.conv_id = c.base and i <= h union all select c.conv_id, 1, i, role, text from c join t using (conv_id) where i > h),
p as (select conv_id, row_number() over (partition by conv_id order by own, i) as d, md5(length(role) || ':' || role || text) as k, octet_length(encode(text)) as bytes from r),
w as (select conv_id, d, bytes, string_agg(k, '') over (partition by conv_id order by d) as path from p union all select conv_id, 0, 0, '' from c),
l as (select conv_id, max(d) as len from w group by conv_id),
n as (select path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from w group by all),
e as (select path, sha256(string_agg(cast(w.conv_id as varchar), ',' order by w.conv_id)) as ends from w join l on w.conv_id = l.conv_id and d = len group by path),
k as (select path[:32 * (depth - 1)] as up, count(*) as n_children from n where depth > 0 group by up),
z as (select n.*, coalesce(n_children, 0) as n_children from n left join k on n.path = k.up),
s as (select a, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * bytes) as saved from (select z.*, unnest(list_transform(range(0, depth + 1), lambda j: path[:32 * j])) as a from z) group by a)
select z.conv_id, cast(z.depth as bigint) as depth, q.conv_id as parent_conv_id, n_convs, cast(z.n_children as bigint) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from z join s on z.path = s.a left join e on z.path = e.path left join (select path as up, depth + 1 as depth, conv_id from n) q on q.depth = z.depth and q.up = z.path[:32 * (z.depth - 1)]
"""


ORACLES: dict[str, str] = {"op2_neardup": _near(2), "op6_substrings": _SUBSTRINGS, "op7_mixing": _MIXING, "op9_quality": _QUALITY, "op10_warc": _WARC, "op11_urls": _urls(), "op12_trie": _TRIE}
