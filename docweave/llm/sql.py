"""DuckDB SQL for those queries of the numbered operators, or those columns of them, that SQL can express."""

from __future__ import annotations

from docweave.llm import secrets
from docweave.plans.extraction_queries import matches_sql

MIXING = """
with recursive sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents
), sums as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), sources as (
  select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from sums
), rounds as (
  select 0 as i, (select cast(sum(source_size) as double) / sum(weight) from sources) as share
  union all
  select i + 1, (select (sum(source_size) - coalesce(sum(3 * source_size) filter (weight * r.share > 3 * source_size), 0)) / sum(weight) filter (weight * r.share <= 3 * source_size) from sources)
  from rounds r where i < (select count(*) from sources)
), targets as (
  select *, least(weight * (select share from rounds order by i desc limit 1), cast(3 * source_size as double)) as target from sources
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, cast(round(t.target) as bigint) as take,
    cast(coalesce(sum(s.size) over (partition by s.source order by md5(coalesce(cast(s.doc_id as varchar), '')), s.size rows between unbounded preceding and 1 preceding), 0) as bigint) as here
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(greatest(0, least(here + size, take) - here) + greatest(0, least(source_size + here + size, take) - source_size - here) + greatest(0, least(2 * source_size + here + size, take) - 2 * source_size - here) as bigint) as taken
from placed
"""

#: All pairs of documents that share a shingle, and what can be reached over links.
NEAR_COPIES = """
with recursive worded as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), shingled as (
  select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from worded
), sizes as (
  select doc_id, count(*) as n from shingled group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from shingled a join shingled b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * c >= 80 * (x.n + y.n - c)
), ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reach r join ways l on r.b = l.a
), roots as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d join roots r on d.doc_id = r.doc_id left join sizes s on s.doc_id = d.doc_id
"""


WORDS = "[^\\x20\\x09-\\x0D]+"


def crc32(blob: str) -> str:
    """CRC-32 of a blob: a fold over its bits; each byte is met by eight shifts."""
    byte = f"list_transform(range(1, octet_length({blob}) + 1), lambda i: cast('0x' || substring(hex({blob}), 2 * i - 1, 2) as bigint))"
    steps = f"flatten(list_transform({byte}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]::bigint[]))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {steps}), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384::bigint * (a & 1)) end), 4294967295::bigint)"


def _little(n: str) -> str:
    """Hexadecimal digits of a number below 2 ** 32, little end first."""
    return f"printf('%02x%02x%02x%02x', ({n}) & 255, (({n}) >> 8) & 255, (({n}) >> 16) & 255, (({n}) >> 24) & 255)"


#: Stored calls: a WAV header of mu-law at 8 kHz before the padded bytes.
PAYLOADS = f"""
with raw as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), padded as (
  select doc_id, octet_length(b) as n_bytes, b || repeat('\\xFF'::blob, case when octet_length(b) = 0 then 576 else (576 - octet_length(b) % 576) % 576 end) as p from raw
), stored as (
  select *, octet_length(p) as n, unhex('52494646' || {_little('50 + octet_length(p)')} || '57415645' || '666d7420' || '12000000' || '07000100' || '401f0000' || '401f0000' || '01000800' || '0000'
    || '66616374' || '04000000' || {_little('octet_length(p)')} || '64617461' || {_little('octet_length(p)')}) || p as media from padded
)
select doc_id, n_bytes, n as payload_bytes, sha256(p) as payload_sha256, {crc32("unhex(right(hex(p), 64))")} as tail_crc32, octet_length(media) as media_bytes, sha256(media) as media_sha256 from stored
"""

#: Statistics of the base rules.
RULES = f"""
with worded as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORDS}')) as l from documents
), windows as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from worded)
), again as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, s) > 1
), covered as (
  select doc_id, count(distinct i + j) as n from again, range(5) r(j) group by doc_id
), counted as (
  select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from worded d left join covered c on c.doc_id = d.doc_id
)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted
"""

#: Unigram scores from the training texts.
UNIGRAMS = f"""
with worded as (
  select doc_id, {crc32('encode(cast(doc_id as varchar))')} % 7 = 2 as held_out,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'), [' ']) as w from documents
), tokens as (
  select doc_id, held_out, unnest(w) as t from worded
), counts as (
  select t, count(*) as c from tokens where not held_out group by t
), total as (
  select sum(c) as n, count(*) as v from counts
)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, cast(max(n) as bigint) as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1.0 * (v + 1)))), 6) as base_score
from tokens left join counts using (t), total group by doc_id, held_out
"""


def _spans(text: str, pattern: str, group: int = 0) -> str:
    return matches_sql(text, pattern, group)


def _digits(x: str) -> str:
    return f"list_reverse(regexp_extract_all({x}, '[0-9]'))"


_LUHN = "list_sum(list_transform({0}, lambda d, i: case when i % 2 = 1 then d::int when d::int >= 5 then 2 * d::int - 9 else 2 * d::int end)) % 10 = 0"

#: Spans of the four patterns of personal data.
PERSONAL = f"""
with t as (
  select doc_id, coalesce(text, '') as x from documents
), hits as (
  select doc_id, 0 as k, 'email' as kind, unnest({_spans('x', "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+")}) as m from t
  union all select doc_id, 1, 'ip', unnest({_spans('x', "[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)")}) from t
  union all select doc_id, 2, 'card', unnest({_spans('x', "[0-9]([ -]?[0-9])+")}) from t
  union all select doc_id, 3, 'phone', unnest({_spans('x', "[+][0-9][ ().0-9-]+[0-9]")}) from t
), good as (
  select * from hits where case k when 1 then len(list_filter(string_split(m.found, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(p as bigint), 999) > 255)) = 0
    when 2 then len({_digits('m.found')}) between 14 and 19 and {_LUHN.format(_digits('m.found'))} when 3 then len({_digits('m.found')}) between 10 and 15 else true end
)
select t.doc_id, count(*) filter (k = 0) as n_email, count(*) filter (k = 1) as n_ip, count(*) filter (k = 2) as n_card, count(*) filter (k = 3) as n_phone,
  sha256(coalesce(string_agg(kind || ':' || m.start || ':' || m.stop, ',' order by m.start, k), '')) as base_sha256
from t left join good g on g.doc_id = t.doc_id group by t.doc_id
"""

_CANDIDATE = f"[A-Za-z0-9+/_=-]{{{secrets.WINDOW},}}"
_LIMIT = "case when not regexp_matches(c, '[A-Za-z]') then -1 when regexp_matches(c, '^[0-9A-Fa-f]+$') then {hex} when regexp_matches(c, '[0-9]') then {mixed} when regexp_matches(c, '[a-z]') and regexp_matches(c, '[A-Z][a-z]*[A-Z]') then {letters} else -1 end"
_LIMIT = _LIMIT.format(**{k: secrets.most(v) for k, v in secrets.BITS.items()})


def _blanked(name: str, source: str, spans: str) -> str:
    """A table (doc_id, x) of the texts of `source` with what `spans` (doc_id, start, stop) covers made spaces."""
    return f"""{name} as (select c.doc_id, string_agg(case when s.p is not null then ' ' else ch end, '' order by c.p) as x
    from (select doc_id, unnest(range(length(x))) as p, unnest(regexp_extract_all(x, '(?s).')) as ch from {source}) c left join (select distinct doc_id, unnest(range(start, stop)) as p from {spans}) s on s.doc_id = c.doc_id and s.p = c.p group by c.doc_id)"""


#: All spans of secrets; windows are counted afresh.
SECRETS = f"""
with t as (
  select doc_id, coalesce(text, '') as x from documents
), base as (
  select doc_id, 0 as k, 'assign' as kind, m.start as start, m.stop as stop from (select doc_id, unnest({_spans('x', secrets.ASSIGN, 1)}) as m from t) where length(m.found) >= 12
  union all select doc_id, 1, 'access', m.start, m.stop from (select doc_id, unnest({_spans('x', 'AKIA[A-Z0-9]{14,}')}) as m from t) 
  union all select doc_id, 2, 'hex', m.start, m.stop from (select doc_id, unnest({_spans('x', '[0-9a-f]{16,}')}) as m from t)
), few as (
  select * from t where regexp_matches(x, '{_CANDIDATE}')
), {_blanked('cleared', 'few', 'base')}, known as (
  select doc_id, m.start as start, m.stop as stop from (select doc_id, unnest({_spans('x', secrets.ALLOWED)}) as m from cleared)
), {_blanked('left_over', 'cleared', 'known')}, candidates as (
  select doc_id, m.start as start, m.stop as stop, m.found as c from (select doc_id, unnest({_spans('x', _CANDIDATE)}) as m from left_over)
), classed as (
  select *, {_LIMIT} as most from candidates
), windows as (
  select doc_id, start, stop, most, i, substring(c, i + j, 1) as ch from (select *, unnest(range(1, length(c) - {secrets.WINDOW - 2})) as i from classed where most >= 0), range({secrets.WINDOW}) r(j)
), weights as (
  select doc_id, start, stop, most, i, sum(round(n * log2(n) * 1000000)) as w from (select doc_id, start, stop, most, i, ch, count(*) as n from windows group by all) group by all
), every as (
  select * from base union all select distinct doc_id, 3, 'entropy', start, stop from weights where w <= most
)
select t.doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) filter (k < 3), '')) as base_sha256, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k), '') as spans
from t left join every e on e.doc_id = t.doc_id group by t.doc_id
"""

_H = [f"cast('0x' || substring(h, {8 * k + 1}, 8) as bigint)" for k in range(4)]

#: Texts cut between their units at two seeded places; whatever the order, the text comes back.
MIDDLES = f"""
with units as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as h from documents
), seeded as (
  select *, len(u) as n, least({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) as a, greatest({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {_H[2]} % 100 >= 90 then 'plain' when {_H[3]} % 100 < 20 then 'spm' else 'psm' end as form from units
), parts as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from seeded
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from parts
"""
