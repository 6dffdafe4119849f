"""The DuckDB equivalent of the full scan: all stages, their resolution, the fuzzy budget, scores and summaries in one statement."""

from __future__ import annotations

from ..functions import chars
from . import registry as rg
from .registry import ORACLE_SQL, sql_messages, sql_pieces, sql_places

DISGUISES = (("thing", "th1ng"), (" the ", " t.h.e "))
_FOUND = "message_id, {ord} as ord, word, base_score, {start}::int as start, {end}::int as \"end\""

#: Repeated letters, over each message (6) and over what is left of it without other characters (8).
_RUNS = f"""l as (select message_id, ord, n, list_filter(range(1, length(n) + 1), lambda i: {rg._KEEP_TWO}) as p2, list_filter(range(1, length(n) + 1), lambda i: {rg._KEEP_ONE}) as p1 from v),
c as (select message_id, ord, n, p2, p1, array_to_string(list_transform(p2, lambda i: n[i::int]), '') as c2, array_to_string(list_transform(p1, lambda i: n[i::int]), '') as c1 from l where len(p2) < length(n)),
two as (select message_id, c.ord, word, base_score, p2 as places, unnest({sql_places('c2', 'word')}) as p from c, w where contains(c2, word)),
one as (select message_id, c.ord, word, base_score, p1 as places, list_min({sql_places('c1', 'word')}) as p from c, w where c1 <> c2 and contains(c1, word) and (message_id, c.ord, word) not in (select (message_id, ord, word) from two)),
runs as (select message_id, ord + 1 as ord, word, base_score, (case when p = 0 then 0 else places[p::int] end)::int as start, (places[(p + length(word))::int] - 1)::int as "end" from (select * from two union all select * from one))"""

_STAGES = f"""exact as (select {_FOUND.format(ord=2, start='p', end='p + length(word)')} from (select *, unnest({sql_places('n', 'word')}) as p from m, w where contains(n, word))),
alike as (select {_FOUND.format(ord=3, start='p', end='p + length(word)')} from (select *, unnest({sql_places('v', 'word')}) as p from (select *, {rg._LOOK} as v from m), w where v <> n and contains(v, word))),
spans as (select message_id, t.start as base, t.piece as span, regexp_replace(t.piece, '[^a-zA-Z0-9]', '', 'g') as v from (select message_id, unnest({sql_pieces('n', '^' + chars.SPACE, chars.ALNUM)}) as t from m) where regexp_matches(t.piece, '\\p{{L}}')),
held as (select *, unnest({sql_places('v', 'word')}) as p, list_filter(range(0, length(span)), lambda i: regexp_matches(span[i::int + 1], '[{chars.ALNUM}]')) as places from spans, w where contains(v, word)),
separated as (select {_FOUND.format(ord=4, start='base + coalesce(places[p::int + 1], 0)', end='base + coalesce(places[(p + length(word))::int] + 1, length(span) - 1)')} from held),
v as (select message_id, 5 as ord, n from m union all select message_id, 7 as ord, {rg._CLEAN} as n from m where {rg._CLEAN} <> n),
tokens as (select message_id, ord, t.start as spot, t.piece as token, translate(t.piece, '{chars.LEET_FROM}', '{chars.LEET_TO}') as likely from (select message_id, ord, unnest({sql_pieces('n', rg._LEET, rg._LEET)}) as t from v) where regexp_matches(t.piece, '[{chars.LEET_CLASS}]')),
greedy as (select message_id, tokens.ord, word, base_score, spot::int as start, (spot + length(token))::int as "end" from tokens, w where contains(likely, word)),
o as (select * from tokens where regexp_matches(token, '[1|&]') and not exists (select 1 from w where contains(likely, word))),
x(token, rest, reading, k) as (select distinct token, token, '', 0::bigint from o union all select token, rest[2:], reading || letters[j::int], k * len(letters) + j - 1 from (select *, unnest(range(1, len(letters) + 1)) as j from (select *, {rg._LETTERS} as letters from x where rest <> ''))),
best as (select token, arg_min((word, base_score), (length(word), k, strpos(reading, word) + length(word), word)) as b from x, w where rest = '' and contains(reading, word) group by token),
unlikely as (select message_id, ord, b[1] as word, b[2] as base_score, spot::int as start, (spot + length(token))::int as "end" from o join best using (token)),
{_RUNS},
every as (select * from exact union all select * from alike union all select * from separated union all select * from greedy union all select * from unlikely union all select * from runs)"""

_RESOLVED = """sizes as (select m.message_id, coalesce(sum("end" - start), 0) >= greatest(length(any_value(n)), 1) as covered from m left join exact using (message_id) group by 1),
kept as (select message_id, ord, word, base_score, start, "end", null::int as distance from (select every.*, covered, min(ord) over (partition by message_id, word) as earliest from (select * from every where ord = 2 or message_id in (select message_id from sizes where not covered)) every join sizes using (message_id)) where ord = earliest)"""

_FUZZY = f"""t as (select message_id, t.start as start, t.piece as token from (select message_id, unnest({sql_pieces('n', chars.ALNUM, chars.ALNUM)}) as t from m where message_id in (select message_id from sizes where not covered)) where length(t.piece) >= 4 and (message_id, t.piece) not in (select (message_id, word) from kept)),
{rg._BUDGET},
near as (select message_id, word, base_score, start, token, levenshtein(regexp_replace(token, '[^\\x00-\\x7F]', '?', 'g'), word) as distance, ord from b, w where checks <= 500 and abs(length(word) - length(token)) <= 2),
fuzzy as (select message_id, 9 as ord, word, base_score, start::int as start, (start + length(token))::int as "end", distance::int as distance from (select *, row_number() over (partition by message_id, start order by distance, length(word), ord) as nth from near where distance <= 2 and distance / length(word) <= 0.25) where nth = 1)"""

_SCORED = f"""found as (select * from kept union all select * from fuzzy),
words as (select message_id, len(list_filter(regexp_split_to_array(text, '[{chars.SPACE}]+'), lambda x: x <> '')) as wc from m),
scores as (select f.message_id, word, ord, start, "end", least(1.0::double, least(1.0::double, base_score + case when ord = 2 then 0.0::double when ord = 3 then 0.1::double when ord in (4, 5, 7) then 0.2::double when ord in (6, 8) then 0.15::double else 0.05::double * coalesce(nullif(distance, 0), 1) end) * case when wc > 0 then least(1.5::double, 1.0::double + n::double / greatest(1, wc)) else 1.0::double end) as score from found f join words using (message_id) join (select message_id, count(distinct lower(word)) as n from found group by 1) using (message_id)),
summed as (select message_id, count(*)::int as total_detections, count(distinct lower(word))::int as distinct_words, max(score) as top, round((list_sum(list(score order by ord, "end", start, word)) / count(*))::varchar::decimal(38, 20), 4) as mean from scores group by 1)"""

ORACLE_SQL["full_scan"] = f"""with recursive {sql_messages(*DISGUISES)}, {_STAGES}, {_RESOLVED}, {_FUZZY}, {_SCORED}
select message_id, coalesce(total_detections, 0)::int as total_detections, coalesce(distinct_words, 0)::int as distinct_words, round(coalesce(top, 0), 9) as highest_score, coalesce(mean, 0)::double as average_score, {rg._TIER.format(x='coalesce(top, 0)')} as tier, {rg._ACTION.format(x='coalesce(top, 0)')} as action from m left join summed using (message_id)"""
