"""What the queries of this subpackage give, as SQL that DuckDB runs on the same tables, where SQL can say it."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ROWS = f"d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, {WORDS} as words from documents)"

QUALITY = rf"""with {ROWS},
w as (select r, unnest(range(1, len(words) - 6)) as i, words from d where len(words) >= 8),
k as (select r, i, md5(array_to_string(words[i : i + 7], ' ')) as win from w),
t as (select r, i from (select *, count(*) over (partition by r, win) as n from k) where n > 1),
c as (select r, count(distinct j) as n_repeat_words from (select r, unnest(range(i, i + 8)) as j from t) group by r),
b as (select d.r, doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d left join c using (r)),
f as (select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b),
h as (select source, count(*)::double as n, count(case when base_failed then 1 end)::double as k from f group by source),
s as (select count(*) as h, sum(n) as n, sum(k) / sum(n) as m, sum(n * n) as nn, sum(k * k / n) as kk from h),
p as (select m, case when v > 0 then least(greatest((kk - n * m * m - m * (1 - m) * (h - 1)) / v, 1 / (n + 1)), 0.999) else 1 / (n + 1) end as share from (select *, m * (1 - m) * (n - nn / n - (h - 1)) as v from s)),
q as (select greatest(m * (1 / share - 1), 1e-9) as a, greatest((1 - m) * (1 / share - 1), 1e-9) as b from p),
l as (select a, b, least(0.5, a / (a + b) + 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) as top from q),
g as (select source, top, k + a as x, n - k + b as y from h, l),
z as (select source, x / (x + y) as host_failure, x / (x + y) - 2 * sqrt(x * y / ((x + y) * (x + y) * (x + y + 1))) as host_low, top from g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_low <= top as kept, round(host_failure, 9) as host_failure, round(host_low, 9) as host_low, host_low <= top as host_kept
from f left join z on f.source is not distinct from z.source"""

SUFFIX = r"""with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select r, unnest(range(0, length(h) // 2)) as i, h from d),
w as (select r, i, substr(h, 2 * i + 1, 2) as byte, case when i <= length(h) // 2 - 200 then md5_number(substr(h, 2 * i + 1, 400)) end as win from b),
n as (select *, win is not null and count(*) over (partition by win) > 1 as twice from w),
m as (select *, bool_or(twice) over (partition by r order by i rows between 199 preceding and current row) as gone from n),
e as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) as begins from m),
k as (select r, count(*) as n_bytes, count(case when gone then 1 end) as n_removed, count(case when begins then 1 end) as n_spans, coalesce(string_agg(case when not gone then byte end, '' order by i), '') as kept from e group by r)
select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join k using (r)"""

SUBSTRING = rf"""with {ROWS},
u as (select r, coalesce(doc_id, 9223372036854775807) as id, unnest(range(1, len(words) + 1)) as i, words from d),
w as (select r, id, i, words[i] as word, case when i <= len(words) - 19 then md5_number(array_to_string(words[i : i + 19], ' ')) end as win from u),
n as (select *, win is not null and (id, i) > min((id, i)) over (partition by win) as later from w),
m as (select *, bool_or(later) over (partition by r order by i rows between 19 preceding and current row) as gone from n),
k as (select r, count(*) as n_words, count(case when gone then 1 end) as n_removed, coalesce(string_agg(case when not gone then word end, ' ' order by i), '') as kept from m group by r)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)"""

NEAR = rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
u as (select doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) as i from d),
s as (select distinct doc_id, md5_number(array_to_string(words[i : i + 2], ' ')) as item from u),
n as (select doc_id, count(*) as n from s group by doc_id),
t as (select md5(string_agg(item::varchar, ' ' order by item)) as set_key, doc_id from s group by doc_id),
y as (select set_key, min(doc_id) as rep from t group by set_key),
v as (select doc_id, item from s where doc_id in (select rep from y)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from v a join v b on a.item = b.item and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n z on z.doc_id = b where 100 * both_ >= 85 * (x.n + z.n - both_)),
g as (select a, b from e union all select b, a from e),
c(node, component) as (select rep, rep from y union select g.b, c.component from c join g on g.a = c.node),
l as (select t.doc_id, min(c.component) as component_id from t join y using (set_key) join c on c.node = y.rep group by t.doc_id)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept from d left join n using (doc_id) left join l using (doc_id)"""


def _filled(c: str) -> str:
    return rf"case when regexp_matches({c}, '[^\x20\x09-\x0D]') then {c} end as {c}"


def _first(value: str, origin: str, order: str, name: str) -> str:
    """The value and the client_id of the first row of each cluster whose value is not null."""
    return f"{name} as (select c, {value}, client_id as {origin} from (select *, row_number() over (partition by c order by {order}, {value} desc) as k from t where {value} is not null) where k = 1)"


RECENT = "updated_at desc nulls last, trust, client_id nulls last"
GOLDEN = rf"""with r as (select coalesce(master_id, client_id) as c, client_id, updated_at, nation_id, balance, {", ".join(_filled(x) for x in ("source", "name", "email", "city", "segment"))} from clients),
l as (select c, max(updated_at) as latest, count(*) as n_records from r group by c),
t as (select r.*, case source when 'store' then 1 when 'crm' then 2 when 'partner' then 3 when 'web' then 4 else 5 end as trust, coalesce(updated_at < latest - interval 240 hour, true) as stale from r join l on r.c is not distinct from l.c),
{_first("segment", "segment_from", RECENT, "sg")}, {_first("email", "email_from", "stale, trust, " + RECENT, "em")}, {_first("name", "name_from", "length(name) desc, stale, trust, " + RECENT, "nm")},
b as (select c, balance, client_id as balance_from from (select t.*, row_number() over (partition by t.c order by t.segment is distinct from sg.segment, {RECENT}, balance desc) as k from t left join sg on t.c is not distinct from sg.c where balance is not null) where k = 1),
a as (select c, city, nation_id, case when city is not null or nation_id is not null then client_id end as address_from from (select *, row_number() over (partition by c order by (city is not null)::int + (nation_id is not null)::int desc, {RECENT}, city desc nulls last, nation_id desc nulls last) as k from t) where k = 1),
s as (select c, count(*) filter (stale) as n_stale from t group by c)
select l.c as cluster_id, n_records, n_stale, name, email, segment, city, nation_id, case when abs(balance) < 9e16 then floor(100 * balance + 0.5)::bigint end as balance_cents, case when isnan(balance) then null else balance end as balance, name_from, email_from, segment_from, balance_from, address_from
from l left join sg on l.c is not distinct from sg.c left join em on l.c is not distinct from em.c left join nm on l.c is not distinct from nm.c left join b on l.c is not distinct from b.c left join a on l.c is not distinct from a.c left join s on l.c is not distinct from s.c"""

CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"""
TRIE = rf"""with s as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select c, row_number() over (partition by c order by turn nulls first, d) - 1 as i, d, n from (select c, turn, md5(length(role) || ':' || role || text) as d, length(text)::bigint as n from s)),
q as (select c, {CRC} % 6 as h from (select distinct c from t)),
o as (select q.c, 0 as own, b.i, b.d, b.n from q join t b on b.c = q.c - q.c % 100 and b.i < q.h union all select t.c, 1, t.i, t.d, t.n from t join q using (c) where t.i >= q.h),
p as (select c, row_number() over w as depth, n, string_agg(d, '') over w as path from o window w as (partition by c order by own, i rows unbounded preceding) union all select c, 0, 0, '' from q),
n as (select path, any_value(depth) as depth, min(c) as conv_id, count(*) as n_convs, any_value(n) as size from p group by path),
e as (select path, string_agg(c::varchar, ',' order by c) as ends from (select c, arg_max(path, depth) as path from p group by c) group by path),
k as (select left(path, 32 * (depth - 1)::int) as path, count(*) as n_children from n where depth > 0 group by 1),
u as (select left(n.path, 32 * j::int) as path, sum((n_convs - 1) * size) as saved, count(*) filter (n_children is null) as n_leaves from (select *, unnest(range(0, depth + 1)) as j from n) n left join k using (path) group by 1)
select n.conv_id, n.depth, m.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from n join u using (path) left join k using (path) left join e using (path) left join n m on n.depth > 0 and m.path = left(n.path, 32 * (n.depth - 1)::int)"""

BY_QUERY = {"op2_quality_rules": QUALITY, "op5_suffix_dedup": SUFFIX, "op6_substring_index": SUBSTRING, "op7_superminhash_dedup": NEAR, "op11_prefix_trie": TRIE, "op13_golden_record": GOLDEN}
