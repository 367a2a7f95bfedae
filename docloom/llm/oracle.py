"""The same queries as DuckDB SQL, where SQL can express them."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_line_dedup"] = """
with keyed as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null
),
starts as (
  select doc_id, lines, unnest(range(greatest(len(lines) - 3, 0) + 1)) as pos from keyed
),
windows as (
  select doc_id, pos, lines[pos + 1:pos + 3] as w from starts
),
told as (
  select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as nth
  from windows where trim(array_to_string(w, '')) <> ''
),
covered as (
  select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as line from told where nth > 1
),
numbered as (
  select doc_id, unnest(lines) as value, unnest(range(len(lines))) as line from keyed
),
kept as (
  select n.doc_id,
    coalesce(string_agg(n.value, chr(10) order by n.line) filter (c.line is null), '') as text,
    count(*) as n_lines,
    count(c.line) as n_removed
  from numbered n left join covered c on n.doc_id = c.doc_id and n.line = c.line
  group by n.doc_id
)
select doc_id, text, n_lines, n_removed from kept
union all
select doc_id, text, 0, 0 from documents where text is null
"""

ORACLE_SQL["op10_decontamination"] = f"""
with doc_words as (select doc_id, {_WORDS} as words from documents),
item_words as (
  select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as words from benchmark
),
item_windows as (
  select distinct item, size, array_to_string(words[pos:pos + size - 1], ' ') as w
  from (
    select item, words, least(len(words), 10) as size,
      unnest(range(1, len(words) - least(len(words), 10) + 2)) as pos
    from item_words where len(words) > 0
  )
),
sizes as (select distinct size from item_windows),
doc_windows as (
  select doc_id, pos, size, array_to_string(words[pos:pos + size - 1], ' ') as w
  from (
    select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as pos
    from doc_words cross join sizes where len(words) >= size
  )
),
found as (
  select d.doc_id, d.pos, d.size, i.item from doc_windows d join item_windows i on d.size = i.size and d.w = i.w
),
places as (
  select doc_id, count(distinct place) as n_hit
  from (select doc_id, unnest(range(pos, pos + size)) as place from (select distinct doc_id, pos, size from found))
  group by doc_id
),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item from found) group by doc_id
)
select d.doc_id, len(d.words) as n_words, coalesce(p.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from doc_words d left join places p on d.doc_id = p.doc_id left join items i on d.doc_id = i.doc_id
"""

ORACLE_SQL["op11_filter_audit"] = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
),
firsts as (select t, min(doc_id) as least from texts group by t),
facts as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
),
told as (
  select x.part, coalesce(f.good, 0) as good, coalesce(f.toxic, 0) as toxic,
    case when len(words) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * (length(x.t) - length(regexp_replace(x.t, '[A-Z]', '', 'g'))) > 3 * length(x.t) then 'C' else '' end
    || case when regexp_matches(x.t, '[#$%&*|]') then 'D' else '' end
    || case when x.doc_id > l.least then 'E' else '' end as fails
  from texts x join firsts l on x.t = l.t left join facts f on x.doc_id = f.doc_id
),
counts as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from told group by part, fails
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
replayed as (
  select part, filter_order, fails, n, good, toxic,
    coalesce(list_min([instr(filter_order, f) for f in string_split(fails, '') if f <> '']), 6) as gone_at
  from counts cross join orders
),
steps as (
  select part, filter_order, s.step, filter_order[s.step] as letter,
    sum(n) filter (gone_at > s.step) as kept,
    sum(n) filter (gone_at = s.step) as removed,
    sum(n) filter (gone_at < s.step and contains(fails, filter_order[s.step])) as redundant,
    sum(n) filter (fails = filter_order[s.step]) as unique_fails,
    sum(good) filter (gone_at = s.step) as good_lost,
    sum(toxic) filter (gone_at = s.step) as toxic_lost
  from replayed cross join (select unnest(range(1, 6)) as step) s
  group by part, filter_order, s.step
)
select part, filter_order, cast(step as integer) as step,
  cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(sum(coalesce(removed, 0)) over (partition by part, letter) as bigint) as shapley
from steps
"""

ORACLE_SQL["op12_mixing"] = r"""
with recursive sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
    [3, 1, 2][1 + cast((row_number() over (order by source nulls last) - 1) % 3 as integer)] as weight
  from sized group by source
),
total as (select 1.5::double * sum(source_size)::double as given, sum(weight)::double as weight from sources),
levels as (
  select 0 as round, given / weight as level, cast(-1 as bigint) as stopped, cast(0 as bigint) as now from total
  union all
  select round + 1,
    coalesce((select (any_value(t.given) - coalesce(sum(2 * s.source_size) filter (s.weight * level > 2.0 * s.source_size), 0)::double)
      / nullif(sum(s.weight) filter (not s.weight * level > 2.0 * s.source_size), 0)::double from sources s cross join total t), level),
    now,
    (select count(*) from sources s where s.weight * level > 2.0 * s.source_size)
  from levels where stopped <> now
),
final as (select level from levels order by round desc limit 1),
targets as (
  select source, source_size, least(source_size * 2.0::double, weight * level) as target from sources cross join final
),
units as (
  select d.doc_id, d.size, t.source, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size * 1073741824.0::double + 0.5::double)::bigint else 0 end as u,
    row_number() over (partition by t.source order by d.size desc, d.doc_id nulls first) as place
  from sized d join targets t on d.source is not distinct from t.source
),
placed as (
  select *, (place - 1) * u + ((('0x' || substr(md5('11:' || coalesce(source, '')), 1, 8))::bigint) >> 2) as start from units
)
select doc_id, size, source_size, target,
  cast(size * (((start + u) >> 30) - (start >> 30)) as bigint) as taken
from placed
"""

ORACLE_SQL["op13_spelling"] = r"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents where text is not null
),
lowered as (
  select coalesce(cast(doc_id as varchar), '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run,
    count(*) as k
  from runs group by all
),
bytes as (select id, run, k, hex(encode(id || ':' || run)) as digits from lowered),
bits as (
  select id, run, k,
    flatten([[(('0x' || substr(digits, 2 * i + 1, 2))::bigint >> j) & 1 for j in range(8)] for i in range(len(digits) // 2)]) as bit
  from bytes
),
hashed as (
  select run, k, xor(list_reduce(list_concat([4294967295::bigint], bit),
    lambda c, b: xor(c >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint) as h
  from bits
),
noisy as (
  select case when h % 97 = 0
    then substr(run, 1, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) as integer) + 2) else run end as word, k
  from hashed
),
vocab as (
  select word, cast(sum(k) as bigint) as n from noisy where length(word) >= 5 group by word having sum(k) >= 3
),
gaps as (
  select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail
  from (select word, n, unnest(range(1, length(word) + 1)) as i from vocab)
),
replaced as (
  select a.word as a, b.word as b, b.n as n from gaps a join gaps b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
),
shortened as (select distinct g.word as longer, g.n as longer_n, v.word as shorter, v.n as shorter_n from gaps g join vocab v on g.head || g.tail = v.word),
near as (
  select a as word, b as other, n from replaced
  union all select longer, shorter, shorter_n from shortened
  union all select shorter, longer, longer_n from shortened
),
best as (
  select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by word
),
forms as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near,
    case when b.other_n >= 2 * v.n then b.other end as form, case when b.other_n >= 2 * v.n then b.other_n end as form_n
  from vocab v left join best b on v.word = b.word
),
chains as (
  select word, word as root, 0 as hop from forms
  union all
  select c.word, f.form, c.hop + 1 from chains c join forms f on c.root = f.word where f.form is not null
),
lasts as (select word, arg_max(root, hop) as root from chains group by word)
select f.word, f.form, l.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from forms f join lasts l on f.word = l.word
"""
