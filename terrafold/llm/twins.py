"""SQL of the queries that DuckDB can run on whole tables. The others have brute-force tests."""

LINE_DEDUP = r"""
with lines as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as content
  from documents where text is not null),
worded as (
  select doc_id, line, list_filter(regexp_split_to_array(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from lines),
candidates as (select doc_id, line, list_sort(list_distinct(w)) as s from worded where len(w) >= 1),
sets as (select s, min((doc_id, line)) as head, row_number() over (order by min((doc_id, line))) as id from candidates group by s),
tokens as (select id, len(s) as n, unnest(s) as t from sets),
frequency as (select t, count(*) as f from tokens group by t),
prefix as (
  select id, n, t from (select id, n, t, row_number() over (partition by id order by f, t) as r from tokens join frequency using (t))
  where r <= n - ceil(n * 4 / 5.0) + 1),
pairs as (select distinct a.id as late, b.id as early from prefix a join prefix b on a.t = b.t and b.id < a.id
          where 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
near as (
  select late, min(b.head) as head from pairs join sets a on a.id = late join sets b on b.id = early
  where 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) group by late),
cutoffs as (select sets.s, least(sets.head, coalesce(near.head, sets.head)) as cutoff from sets left join near on near.late = sets.id),
gone as (select doc_id, line from candidates join cutoffs using (s) where (doc_id, line) > cutoff),
numbers as (select doc_id, count(*) as n, string_agg(line::varchar, ',' order by line) as removed from gone group by doc_id),
rest as (
  select doc_id, string_agg(content, chr(10) order by line) as text from lines
  where (doc_id, line) not in (select (doc_id, line) from gone) group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(numbers.n, 0) as n_removed,
  coalesce(numbers.removed, '') as removed_lines, case when d.text is null then null else coalesce(rest.text, '') end as text
from documents d left join numbers using (doc_id) left join rest using (doc_id)
"""

CHAT = r"""
with t as (
  select conv_id, cast(turn as bigint) as turn, role, replace(coalesce(text, ''), '<|im_', '< |im_') as text,
    coalesce(cast(floor(turn / 64) as bigint), -1) as block from conversations),
p as (select *, row_number() over (partition by conv_id, block order by turn nulls first, role nulls first, text) - 1 as r from t),
s as (select distinct conv_id, role as speaker from conversations where role is not null and role <> 'system'),
m as (
  select p.conv_id, speaker, block, r // 64 as piece, r, coalesce(role = speaker, false) as own,
    '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then 'system'
      else 'user' || coalesce(' name=' || role, '') end || chr(10) as head, text || '<|im_end|>' as body
  from p join s on p.conv_id is not distinct from s.conv_id),
q as (
  select *, sum(length(head) + length(body) + 1) over (partition by conv_id, speaker, block, piece order by r) - length(body) - 1 as start from m)
select conv_id, speaker, block, piece, count(*) as n_turns, string_agg(head || body || chr(10), '' order by r) as rendered,
  coalesce(string_agg(case when own then cast(start as bigint) || '-' || cast(start + length(body) as bigint) end, ',' order by r), '') as mask,
  cast(coalesce(sum(case when own then length(body) end), 0) as bigint) as n_target_chars
from q group by conv_id, speaker, block, piece
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as o
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs where 100 * o >= 80 * (n + m - o)),
reach as (select doc_id as a, doc_id as b from sets union select reach.a, links.b from reach join links on reach.b = links.a)
select sets.doc_id, len(any_value(s)) as n_shingles, min(reach.b) as component_id
from sets join reach on reach.a = sets.doc_id group by sets.doc_id
"""

WARC = r"""
with p as (select page_id, coalesce(html, '') as payload from pages),
k as (select page_id, payload, sha1(payload) as hex, min(page_id) over (partition by payload) as head from p)
select page_id, strlen(payload) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast(concat('0x', substr(hex, cast(1 + 5 * (i // 4) as int), 5)) as int) >> cast(15 - 5 * (i % 4) as int)) & 31 as int) + 1, 1)), '')
    as payload_digest,
  case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id <> head then head end as refers_to
from k
"""

QUALITY = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as word from (
  select doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as x from d)),
g as (select doc_id, i, word, concat(word, ' ', lead(word, 1) over o, ' ', lead(word, 2) over o) as gram, lead(word, 2) over o as last
  from w window o as (partition by doc_id order by i)),
m as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g where last is not null) where n > 1),
r as (select doc_id, count(distinct i) as n from (select doc_id, unnest([i, i + 1, i + 2]) as i from m) group by doc_id),
c as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars from w group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
n as (select doc_id, count(*) filter (where regexp_matches(line, '[^\x20\x09-\x0D]'))
    - count(distinct line) filter (where regexp_matches(line, '[^\x20\x09-\x0D]')) as dup,
    count(*) filter (where trim(line) <> '') as filled, count(*) filter (where rtrim(line) like '%...') as dots from l group by doc_id),
b as (
  select d.doc_id, text, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
    filled, dots, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as capitals,
    length(regexp_replace(text, '[^!?]+', '', 'g')) as marks
  from d left join c using (doc_id) left join n using (doc_id) left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 14 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 5 * filled
    or 10 * letters < 6 * word_chars or 10 * capitals > 6 * word_chars or 10 * marks > 3 * n_words or 10 * dots > 3 * filled) as kept
from f
"""

MIXING = r"""
with recursive d as (
  select doc_id, source, coalesce(text, '') as text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size
  from documents),
s as (
  select source, sum(size) as source_size, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight
  from d group by source),
level as (
  select cast(0 as double) as x, 0 as step
  union all
  select (select (sum(source_size) * 150 / 100.0 - coalesce(sum(2 * source_size) filter (where weight * level.x >= 2 * source_size), 0))
          / nullif(sum(weight) filter (where weight * level.x < 2 * source_size), 0) from s), step + 1
  from level where level.x is not null and step < 60),
t as (select source, source_size, least(2.0 * source_size, weight * (select max(x) from level)) as target from s),
r as (
  select doc_id, d.source, size, source_size, target, cast(floor(target + 0.5) as bigint) as words,
    sum(size) over (partition by d.source order by cast(concat('0x', substr(md5(concat(coalesce(cast(doc_id as varchar), ''), ':', text)), 1, 15)) as bigint),
                    text rows unbounded preceding) - size as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, cast(source_size as bigint) as source_size, cast(target as double) as target,
  cast(case when size = 0 then 0 else words // cast(source_size as bigint) * size
    + least(greatest(words % cast(source_size as bigint) - before, 0), size) end as bigint) as taken, source
from r
"""

HARD_NEGATIVES = r"""
with e as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from e where vec_id % 100 = 0),
s as (
  select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2])) as score
  from a join e on a.vec_id <> e.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id,
  cast(positive_score as bigint) as positive_score, cast(score as bigint) as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""

SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP, "op5_ngram_jaccard_join": NGRAM_JOIN, "op6_chat_formatting": CHAT, "op9_warc": WARC,
                       "op10_quality_rules": QUALITY, "op11_source_mixing": MIXING, "op13_hard_negatives": HARD_NEGATIVES}
