"""Oracles that are too long to stand over their queries."""

FOLD = r"""regexp_replace(translate(nfc_normalize(replace({0}, '․', '·')), '‘’“”–—−―∼〜ㆍ•…‥', {1}), '[:：「」『』〈〉《》녂녃\[\]{{}}''"\s]', '', 'g')"""
INSTEAD = "chr(39) || chr(39) || '\"\"----~~··..'"

NORMS = rf"""with m as (select item_id, text, replace(replace(regexp_replace('| **' || text || '** |', '^[|]', ''), '|', ' '), '*', '') as t from benchmark),
l as (select item_id, text, regexp_replace(regexp_replace(replace(regexp_replace(t, '\[\^[0-9]+\]', ' ', 'g'), '<br>', ' '), '^[-*•·▪◦>]\s*', ''), '^\(([a-zA-Z]{{1,4}}|[0-9]{{1,2}})\)[\s.]*', '') as t from m)
select item_id, {FOLD.format("text", INSTEAD)} as norm, {FOLD.format("t", INSTEAD)} as line from l"""

NORM = r"regexp_replace(replace({0}, '*', ''), '\s', '', 'g')"
LEVELS = rf"""with e as (select item_id as ord, array_to_string(string_split(text, ' ')[1:3], ' ') as term, 'DOC::' || item_id as source_id, {NORM.format("array_to_string(string_split(text, ' ')[1:3], ' ')")} as norm from benchmark),
en as (select *, row_number() over (partition by norm order by ord) = 1 as head from e), a as (select distinct string_split(term, ' ')[(1 + ord % 3)::int] as raw from e), q as (select raw, {NORM.format("raw")} as q from a),
h as (select raw, q, en.*, case when term = raw then 1 when norm = q then 2 when length(q) >= 2 and head and list_contains(list_transform(regexp_split_to_array(term, '\s+'), lambda w: replace(w, '*', '')), q) then 3 when length(q) >= 2 and contains(norm, q) then 4 end as level from q join en on contains(norm, q) or term = raw),
b as (select raw, level, norm from (select *, row_number() over (partition by raw order by level, case when level > 2 then length(norm) else 0 end, ord) as k from h where level is not null) where k = 1)
select b.raw, b.level, x.term, x.ord, x.source_id from b join en x on case when b.level = 1 then x.term = b.raw else x.norm = b.norm end"""


def injected(hits: str) -> str:
    return rf"""with h as ({hits}), te as (select substr(regexp_replace(text, '\s+', '', 'g'), 1, (3 + item_id % 20)::int) as term, min(item_id) as ord from benchmark group by 1),
q as (select item_id, term from benchmark join te on contains(regexp_replace(text, '\s+', '', 'g'), term) and length(term) >= 2), own as (select * from q where not exists (select 1 from q g where g.item_id = q.item_id and length(g.term) > length(q.term) and contains(g.term, q.term))),
r as (select item_id, regexp_replace(string_agg(text, ' ' order by rank), '\s+', '', 'g') as t from h join documents using (doc_id) group by 1),
c as (select item_id, term, ord, ((length(t) - length(replace(t, term, ''))) // length(term))::bigint as cnt from r join te on contains(t, term)),
f as (select c.*, row_number() over (partition by item_id order by cnt desc, length(term) desc, ord) as k, (select count(*) from own where own.item_id = c.item_id) as spent from c where not exists (select 1 from own where own.item_id = c.item_id and contains(own.term, c.term)))
select item_id, term, cnt from f where k <= greatest(1, 10 - spent)"""


LABELS = """with c as (select conv_id, turn::int as pos, turn % 3 as k, sum(case when turn % 3 = 0 then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as a from conversations)
select conv_id, pos, case k when 0 then a || '.' when 1 then a || '.a' else a || '.a.1' end as label from c"""

COLON = r"""with d as (select doc_id, replace(text, '.', ':') as text from documents)
select doc_id, regexp_replace(substr(text, 1, strpos(text, ':') - 1), '^\s+|\s+$', '', 'g') as term, sha256(regexp_replace(substr(text, strpos(text, ':') + 1), '^\s+|\s+$', '', 'g')) as digest from d where strpos(text, ':') > 0"""
