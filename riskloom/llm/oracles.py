"""DuckDB SQL for the operators whose results are exact: what they must find, by plain windows, sets and pairs."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
windows as (select r, i, array_to_string(w[i:i + 34], ' ') as k from d, unnest(range(1, len(w) - 33)) as t(i)),
hits as (select r, i from windows where k in (select k from windows group by k having count(*) > 1)),
covered as (select distinct r, j from hits, unnest(range(i, i + 35)) as t(j)),
words as (select r, doc_id, j, w[j] as word from d, unnest(range(1, len(w) + 1)) as t(j)),
kept as (select words.r, count(*) as n, count(covered.j) as gone, coalesce(string_agg(word, ' ' order by words.j) filter (where covered.j is null), '') as text from words left join covered on covered.r = words.r and covered.j = words.j group by 1)
select doc_id, coalesce(n, 0)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (r)
"""

#: Components of ``links`` (a, b; both directions): the least node reachable.
REACH = "reach as (select a as node, a as root from links union select links.b, reach.root from reach join links on links.a = reach.node)"

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as k from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.k = y.k and x.doc_id < y.doc_id group by 1, 2),
p as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
links as (select a, b from p union all select b, a from p), {REACH},
least as (select node, min(root) as root from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(root, d.doc_id) as component_id, coalesce(root, d.doc_id) = d.doc_id as kept from d left join n using (doc_id) left join least on node = d.doc_id
"""

NEAR_VECTORS = rf"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.95), {REACH},
least as (select node, min(root) as root from reach group by 1), degree as (select a, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept, 1.0::double as audit_recall from embeddings left join least on node = vec_id left join degree on a = vec_id
"""

#: crc32 bit by bit over the bytes of ``id:run``, and words as texts of one byte a letter (capitals, digits and signs stand for
#: the letters above ASCII), so that the library's distance, which counts bytes, counts letters.
VARIANTS = rf"""
with recursive r as (select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) as run from documents),
d as (select id, run, count(*) as c, [ord(x) for x in string_split(id || ':' || run, '')] as points from r group by id, run),
b as (select id, run, c, flatten([case when p < 128 then [p] else [192 + (p >> 6), 128 + (p & 63)] end for p in points]) as bytes from d),
h as (select run, c, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, flatten([[(x >> k) & 1 for k in range(8)] for x in bytes])::bigint[]), lambda s, bit: xor(s >> 1, 3988292384 * (xor(s, bit) & 1)))) as h from b),
w as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, c from h),
n as (select word, sum(c)::bigint as n, translate(word, '{"".join(map(chr, range(192, 256)))}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_|~') as k from w where length(word) >= 6 group by word having sum(c) >= 5),
near as (select x.word, y.word as other, y.n as m, x.n from n x join n y on length(y.k) between length(x.k) - 1 and length(x.k) + 1 and x.k <> y.k and levenshtein(x.k, y.k) = 1),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m, any_value(n) as n from near group by word),
form as (select word, n_near, case when m >= 5 * n then other end as form, case when m >= 5 * n then m end as form_n from best),
ways as (select word as start, word as last, 0 as step from n union all select start, form, step + 1 from ways join form on form.word = ways.last where form is not null)
select word, n, coalesce(n_near, 0)::bigint as n_near, form, form_n::bigint as form_n, root from n left join form using (word) join (select start as word, arg_max(last, step) as root from ways group by start) using (word)
"""

INFILL = r"""
with h as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, 'null')) as s from documents),
g as (select doc_id, t, length(t) as n, [list_reduce([instr('0123456789abcdef', x) - 1 for x in string_split(substr(s, 1 + 8 * i, 8), '')], lambda a, x: 16 * a + x) for i in range(4)] as v from h),
c as (select *, least(v[1] % (n + 1), v[2] % (n + 1)) as a, greatest(v[1] % (n + 1), v[2] % (n + 1)) as b, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or v[3] % 100 >= 90 then 'plain' when v[4] % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, substr(t, 1, a::bigint) as x, substr(t, a::bigint + 1, (b - a)::bigint) as y, substr(t, b::bigint + 1) as z from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a::bigint end as prefix_chars, case when form <> 'plain' then (b - a)::bigint end as middle_chars, sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256 from p
"""
