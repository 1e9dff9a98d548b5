"""DuckDB equivalents of the queries of this subpackage that SQL can express on whole tables."""

ORACLE: dict[str, str] = {}

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_STRIP = "regexp_replace({0}, '^" + _WS.replace("{", "{{").replace("}", "}}") + "+|" + _WS.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"

ORACLE["p2_found"] = f"""
with d as (select doc_id, full_text t, chunk_size n from documents join index_meta using (index_name)
           where length(full_text) > chunk_size and chunk_size > 0),
s as (select doc_id, n,
        list_max(list_transform(regexp_split_to_array(t, '\\n{_WS}*\\n'), lambda x: length({_STRIP.format("x")}))) p,
        list_max(list_transform(string_split(t, chr(10)), lambda x: length({_STRIP.format("x")}))) l,
        list_max(list_transform(regexp_split_to_array(t, '{_WS}+'), lambda x: length(x))) w
      from d)
select doc_id, case when p <= n then 'paragraph' when l <= n then 'line' when w <= n then 'word' else 'none' end as boundary from s
"""

ORACLE["p5_found"] = """
with v as (select "rowid" id, embedding::double[] e from vec_index where embedding is not null and list_inner_product(embedding::double[], embedding::double[]) > 0),
s as (select a.id x, b.id y, list_cosine_similarity(a.e, b.e) c from v a join v b on a.id <> b.id),
r as (select x, y, c, row_number() over (partition by x order by round(c, 9) desc, y) n from s)
select distinct least(x, y) as rowid_a, greatest(x, y) as rowid_b from r where n <= 5 and c >= 0.9
"""

ORACLE["p6_found"] = f"""
with w as (select doc_id, list_filter(regexp_split_to_array(lower(full_text), '{_WS}+'), lambda x: x <> '') ws from documents),
k as (select doc_id, ws from w where len(ws) >= 40),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') g from k, unnest(range(1, len(ws) - 3)) u(i)),
n as (select doc_id, count(*) n from s group by 1),
o as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
select x as doc_id_a, y as doc_id_b from o join n p on p.doc_id = x join n q on q.doc_id = y where 2 * c >= p.n + q.n - c
"""

ORACLE["p5_nearest"] = """
with v as (select "rowid" id, embedding::double[] e from vec_index where embedding is not null and list_inner_product(embedding::double[], embedding::double[]) > 0),
s as (select a.id x, b.id y, list_cosine_similarity(a.e, b.e) c from v a join v b on a.id <> b.id where a.id % 20 = 0),
r as (select x, y, c, row_number() over (partition by x order by round(c, 9) desc, y) n from s)
select x as query, y as neighbour, round(c, 6) as similarity, n::int as rank from r where n <= 10
"""
