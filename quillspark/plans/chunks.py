"""Chunking of documents and of marked-up pages, and the SQL that says it: sections, tables, paragraphs, cuts at each separator, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking as C
from quillspark.plans.catalog import query, table

_MARKS = "||".join(f"chr({ord(c)})" for c in C.MARKS)
_java = lambda pattern: pattern.replace("(?md)", "(?m)")
_strip = lambda x: f"regexp_replace({x}, '^{T.SPACES}+|{T.SPACES}+$', '', 'g')"
_lit = lambda s: "||".join("chr(10)" if c == "\n" else f"'{c}'" for c in s)


def _level(k: int, separator: str) -> str:
    """What is open and has the separator: lengths of its parts, the places of the chunks that they make, and these as rows, numbered below their text's path."""
    has, sep = f"open and contains(t, {_lit(separator)})", _lit(separator)
    start = "{'st': []::bigint[], 'e': 0::bigint, 'o': []::struct(a bigint, b bigint, o boolean)[]}"
    one = "case when len(s.st) > 0 then [{'a': s.st[1], 'b': s.e, 'o': false}] else [] end"
    fold = f"""{{'st': case when n >= {C.SIZE} then [] when len(s.st) > 0 and s.e - s.st[1] + n > {C.SIZE} then list_append(list_filter(s.st, lambda v: v >= s.e - least({C.OVERLAP}, {C.SIZE} - n)), s.e) else list_append(s.st, s.e) end, 'e': s.e + n,
'o': case when n >= {C.SIZE} then list_concat(list_concat(s.o, {one}), [{{'a': s.e, 'b': s.e + n, 'o': true}}]) when len(s.st) > 0 and s.e - s.st[1] + n > {C.SIZE} then list_concat(s.o, {one}) else s.o end}}"""
    return f"""r{k} as materialized (select r, i, k, path, t, list_reduce(list_transform(list_filter(string_split(replace(t, {sep}, chr(1) || {sep}), chr(1)), lambda x: x <> ''), lambda x: length(x)), lambda s, n: {fold}, {start}) as s from l{k - 1} where {has}),
u{k} as (select r, i, k, path, t, unnest(o) as x, generate_subscripts(o, 1) as n from (select *, list_concat(s.o, {one}) as o from r{k})),
l{k} as materialized (select * from l{k - 1} where not ({has}) union all select * from (select r, i, k, list_append(path, n), x.o, case when x.o then substr(t, x.a + 1, x.b - x.a) else {_strip("substr(t, x.a + 1, x.b - x.a)")} end as t from u{k}) where t <> '')"""


def sql(pages: str) -> str:
    """SQL of ``chunking.chunk`` over pages, a query that gives (doc_id, page, text)."""
    body, n = f"case when headed then {_strip('body')} else body end", len(C.SEPARATORS)
    table_ = "i % 2 = 0 and contains(p, chr(6))"
    step = C.SIZE - C.OVERLAP
    para = f"""list_reduce(list_filter(list_transform(regexp_split_to_array(rest, '\\n{T.SPACES}*\\n'), lambda p: {_strip('p')}), lambda p: p <> ''), lambda s, p: case when s.now is null then {{'o': s.o, 'now': p, 'n': length(p)}} when s.n + length(p) > {C.SIZE} then {{'o': list_append(s.o, s.now), 'now': p, 'n': length(p)}} else {{'o': s.o, 'now': s.now || chr(10) || chr(10) || p, 'n': s.n + length(p)}} end, {{'o': []::varchar[], 'now': null::varchar, 'n': 0::bigint}})"""
    return f"""with pg as materialized (select *, row_number() over (order by doc_id, page, text) as r from ({pages})),
c as (select r, string_split(regexp_replace(translate(coalesce(text, ''), {_MARKS}, ''), '{_java(C.HEADING)}', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) as p from pg),
s as (select r, len(p) > 1 as headed, unnest(p) as p, generate_subscripts(p, 1) as i from c),
h as (select r, headed, i, strpos(p, chr(2)) - 1 as level, case when i = 1 then '' else {_strip("split_part(split_part(p, chr(3), 1), chr(2), 2)")} end as title, case when i = 1 then p else substr(p, strpos(p, chr(3)) + 1) end as body from s),
a as (select r, list({{'i': i, 'level': level, 'title': title}} order by i) as hs from h where i > 1 group by r),
b as (select r, i, headed, title as section, case when i = 1 then '' else array_to_string(list_transform(list_filter(hs, lambda x: x.i <= h.i and len(list_filter(hs, lambda y: y.i > x.i and y.i <= h.i and y.level <= x.level)) = 0), lambda x: x.title), ' > ') end as breadcrumb, {body} as body from h left join a using (r)),
p as (select *, regexp_split_to_array(replace(regexp_replace(body, '{_java(C.TABLE_ROW)}', chr(4) || '\\0' || chr(5), 'g'), chr(5) || chr(4), chr(6)), '[\\x04\\x05]') as ps from b where {_strip('body')} <> ''),
f as (select *, list_filter(list_transform(list_filter(ps, lambda p, i: {table_}), lambda p: {_strip("replace(p, chr(6), '')")}), lambda p: length(p) > {C.TABLE_CHARS}) as found from p),
e as (select *, case when len(found) > 0 then {_strip(f"array_to_string(list_transform(ps, lambda p, i: case when {table_} then chr(10) || chr(10) else p end), '')")} else body end as rest from f),
g as (select *, {para} as grouped from e),
k as (select r, i, section, breadcrumb, list_concat(list_transform(found, lambda t: {{'kind': 'table', 't': t}}), case when {_strip('rest')} = '' then [] when length(rest) <= {C.SIZE} then [{{'kind': case when headed then 'section' else 'page' end, 't': rest}}]
else list_transform(list_concat(grouped.o, list_filter([grouped.now], lambda x: x is not null)), lambda t: {{'kind': 'paragraph', 't': t}}) end) as ks from g),
m as materialized (select r, i, section, breadcrumb, unnest(ks) as x, generate_subscripts(ks, 1) as k from k),
l0 as materialized (select r, i, k, []::bigint[] as path, length(x.t) > {C.SIZE} as open, x.t as t from m),
{", ".join(_level(j + 1, s) for j, s in enumerate(C.SEPARATORS))},
z as (select r, i, k, path, 0 as n, t from l{n} where not open union all select * from (select r, i, k, path, n, {_strip(f"substr(t, n * {step} + 1, {C.SIZE})")} as t from (select *, unnest(range(case when length(t) <= {C.SIZE} then 1 else cast(ceil((length(t) - {C.SIZE}) / {step}.0) as bigint) + 1 end)) as n from l{n} where open)) where t <> ''),
q as (select doc_id, page, row_number() over (partition by doc_id order by page, r, z.i, z.k, path, n) - 1 as chunk_index, section, breadcrumb, x.kind as chunk_type, t as text from z join pg using (r) join m using (r, i, k))
select doc_id, page, chunk_index, sha256(concat_ws(':', coalesce(cast(doc_id as varchar), '-'), coalesce(cast(page as varchar), '-'), chunk_index))[1:32] as chunk_id, cast(length(text) as integer) as chunk_chars, section, breadcrumb, chunk_type, text from q"""


@query(sql("select doc_id, cast(1 as bigint) as page, text from documents"))
def chunk_documents(spark, sf_dir):
    """Whole documents, a page each."""
    return C.chunk(table(spark, sf_dir, "documents"))


@query(sql("""select source as doc_id, doc_id as page, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s, i: case when (doc_id + i) % 7 = 0 then repeat('#', 1 + cast((doc_id + i) // 7 % 4 as integer)) || ' ' || s[1:30] when (doc_id + i) % 7 in (2, 3) then '| ' || s || ' |' when (doc_id + i) % 7 = 5 then s || chr(10) else s end), chr(10)) as text from documents"""))
def chunk_pages(spark, sf_dir):
    """The documents of a source as pages of one, with headings, rows of tables and blank lines among their lines."""
    d = table(spark, sf_dir, "documents")
    at = lambda i: F.col("doc_id") + i + 1
    line = lambda s, i: F.when(at(i) % 7 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(at(i) / 7) % 4 + 1).cast("int")), F.lit(" "), F.left(s, F.lit(30)))).when((at(i) % 7).isin(2, 3), F.concat(F.lit("| "), s, F.lit(" |"))).when(at(i) % 7 == 5, F.concat(s, F.lit("\n"))).otherwise(s)
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return C.chunk(d.select("source", F.col("doc_id").alias("page"), text.alias("text")).withColumnRenamed("source", "doc_id"), "page")
