"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from folioscope.llm import licences

STATEMENTS: dict[str, str] = {}

STATEMENTS["op7_chat"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as idx from turns
), counted as (
  select *, idx = 0 and role = 'system' as is_system, len(regexp_extract_all(text, '[^ \t\n\r]{1,6}')) + 2 as tokens,
    length(concat('<turn ', idx, ' ', role, '>', chr(10))) + 8
      + length(replace(replace(replace(text, '\', '\\'), '</turn', '<\/turn'), '<turn', '<\turn')) as block
  from numbered
), walked as (
  select *, coalesce(sum(case when is_system then 0 else tokens end)
        over (partition by conv_id order by idx rows between unbounded preceding and 1 preceding), 0) as prefix,
    greatest(1024 - 192 - max(case when is_system then tokens else 0 end) over c
      - max(case when is_system then 0 else tokens end) over c, 1) as stride,
    sum(case when is_system then block else 0 end) over c as system_block,
    lag(tokens, 1) over i as t1, lag(block, 1) over i as b1, lag(is_system, 1) over i as s1,
    lag(tokens, 2) over i as t2, lag(block, 2) over i as b2, lag(is_system, 2) over i as s2
  from counted window c as (partition by conv_id), i as (partition by conv_id order by idx)
), placed as (
  select *, case when is_system then 0 else cast(floor(prefix / stride) as bigint) end as win from walked
), sized as (
  select *, case when win > 0 and idx = min(idx) over (partition by conv_id, win) then system_block
      + case when t1 is null or s1 or t1 > 192 then 0
             when t2 is null or s2 or t1 + t2 > 192 then b1 else b1 + b2 end else 0 end as context
  from placed
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by idx)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by idx) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(block + context) as bigint) as formatted_chars
from sized group by conv_id
"""

# the states: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after a pair
STATEMENTS["op13_repair"] = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
        string_split(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')), ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))),
      4294967295::bigint) % 20 as damage
  from conversations
), turns as (
  select conv_id, turn, case damage when 4 then 'user' else role end as role,
    case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from src, unnest(range(case damage when 3 then 2 else 1 end)) where damage <> 0
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as inner_text from turns
), told as (
  select *, left(role, 1) as initial, inner_text = '' as blank,
    row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
    right(inner_text, 1) not in ('.', '!', '?') as cut,
    lag(left(role, 1)) over (partition by conv_id order by i) as before
  from numbered
), rows_ as (
  select *, blank or seen as lost, not blank and not seen and cut as truncated from told
), steps(source, initial, target) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), names(initial, named) as (values ('u', 'user:'), ('a', 'assistant:')
), inserts(source, target, letters, inserted) as (
  values (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', 'user:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'),
    (1, 2, 'I', 'user:'), (1, 3, 'II', 'user:' || chr(10) || 'assistant:'), (2, 3, 'I', 'assistant:'), (3, 2, 'I', 'user:')
), edits as (
  select conv_id, i, s.source, s.target, 'K' as letter, truncated::int as price, role || ':' || text as made
  from rows_ join steps s using (initial) where not lost
  union all
  select conv_id, i, s.source, s.target, 'R', 2 + truncated::int, named || text from rows_, steps s join names using (initial) where not lost
  union all
  select conv_id, i, s, s, 'D', 3, '' from rows_, unnest(range(4)) u(s)
), moves as (
  select conv_id, i, e.source, n.target, e.letter || n.letters as letters, price + 2 * length(n.letters) as price,
    concat_ws(chr(10), nullif(made, ''), nullif(inserted, '')) as made
  from edits e join inserts n on n.source = e.target
), best as (
  select conv_id, i, source, target, min(struct_pack(price := price, letters := letters, made := made)) as m from moves group by all
), walk as (
  select distinct conv_id, 0::bigint as i, target as state, struct_pack(cost := 2 * length(letters), audit := letters, made := inserted) as w
  from rows_, inserts where source = 0
  union all
  select w.conv_id, w.i + 1, b.target, min(struct_pack(cost := (w.w).cost + (b.m).price, audit := (w.w).audit || (b.m).letters,
      made := concat_ws(chr(10), nullif((w.w).made, ''), nullif((b.m).made, ''))))
  from walk w join best b on b.conv_id is not distinct from w.conv_id and b.i = w.i + 1 and b.source = w.state
  group by w.conv_id, w.i, b.target
), counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (blank) as blank, count(*) filter (not blank and seen) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
  from rows_ group by conv_id
), ends as (
  select w.conv_id, min(w.w) as w from walk w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i
  where state in (0, 3) group by w.conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce((w).cost, 0)::bigint as cost,
  coalesce((w).audit, '') as audit, sha256(coalesce((w).made, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
  left join counts c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
"""


def _licence_statement() -> str:
    """All places of all phrases by comparing word lists, then templates by their keys' implied starts; no index."""

    def words(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    keys = licences.keys_of(licences.PHRASES, licences.TEMPLATES)
    key_rows = ", ".join(f"({n}, '{k.label}', {words(k.words)}, {k.template}, {k.offset})" for n, k in enumerate(keys))
    bodies = [licences.words_of(t.text) for t in licences.TEMPLATES]
    body_rows = ", ".join(
        f"({t}, '{x.label}', {words(b)}, {licences.slack(b)}, {len(x.keys)})" for t, (x, b) in enumerate(zip(licences.TEMPLATES, bodies))
    )
    return f"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licences.WORD}') as words from documents
), keys(k, label, words, template, place) as (values {key_rows}
), bodies(template, label, words, room, n_keys) as (values {body_rows}
), word as (
  select r, unnest(words) as w, generate_subscripts(words, 1) - 1 as pos from docs
), places as (
  select word.r, k, label, template, pos, pos - place as start
  from word join keys on word.w = keys.words[1] join docs using (r)
  where docs.words[pos + 1 : pos + len(keys.words)] = keys.words
), vocabulary as (
  select distinct unnest(words) as w from (select words from keys union all select words from bodies)
), weight as (
  select w, ln(((select count(*) from docs) + 1) / (count(distinct r) + 1)) + 1 as idf from vocabulary left join word using (w) group by w
), buckets as (
  select distinct r, p.template, k, cast(floor(start / room) as bigint) - back as b
  from places p join bodies using (template), unnest(range(2)) u(back)
), common as (
  select r, template, b from buckets join bodies using (template) group by r, template, b, n_keys having count(*) = n_keys
), windows as (
  select r, template, label, words, greatest(b * room, 0) as first, b * room + 2 * room + len(words) as stop from common join bodies using (template)
), totals as (
  select template, sum(idf) as total from (select template, unnest(list_distinct(words)) as w from bodies) join weight using (w) group by template
), shares as (
  select r, label, first, sum(idf) / any_value(total) as share
  from (select distinct v.r, v.template, v.label, v.first, w from windows v join word on word.r = v.r and pos >= v.first and pos < v.stop where list_contains(v.words, w))
    join weight using (w) join totals using (template)
  group by r, label, template, first
), seen as (
  select r, list(distinct label) as labels, max(share) as share from shares where share >= {licences.LEAST_SHARE} group by r
), base as (
  select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels
  from places where template < 0 group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(seen.labels, [])))), ','), '') as labels,
  round(case when n_base > 0 then 1.0::double else least(coalesce(share, 0.0::double), 1.0::double) end, 6)::double as score
from docs left join base using (r) left join seen using (r)
"""


STATEMENTS["op11_licences"] = _licence_statement()
