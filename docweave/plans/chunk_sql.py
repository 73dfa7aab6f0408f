"""The chunker in DuckDB SQL, for any table of texts: walks over lines, regions, units and passages as recursive queries."""

from __future__ import annotations

from docweave.operators.chunking import FENCE, ITEM, LEAST, OVERLAP, SIZE

_SHAPE = r"""regexp_matches(b, '^#{1,6}\s+.') or regexp_matches(b, '^[0-9]+(\.[0-9]+)*[.)]?\s+.') or regexp_matches(b, '(?i)^[IVXLCDM]+[.)]\s+.') or regexp_matches(b, '(?i)^(section|chapter|part|appendix)\s+[0-9IVXLCDMA]+[\s:].')"""
_ITEM = ITEM.replace("'", "''")


def lines(source: str) -> str:
    """given (doc_id, text) -> lined, titles, spans of fences, regions."""
    return rf"""given_lines as (select doc_id, unnest(range(len(p))) as n, unnest(p) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from {source})),
lined as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as off, lead(line) over (partition by doc_id order by n) as after, trim(line) as b from given_lines),
judged as (select *, b <> '' and length(b) <= 200 and not regexp_matches(b, '[.!?;:]$') and ({_SHAPE} or (upper(b) = b and lower(b) <> b and length(b) > 3)) as head from lined),
titles as (select doc_id, cast(off as bigint) as off, b as title from judged where head or (b <> '' and coalesce(regexp_matches(after, '^[=-]+\s*$'), false))),
marks as (select doc_id, n, left(b, 1) as sign, length(regexp_extract(b, '{FENCE}', 1)) as size, length(b) as width, row_number() over (partition by doc_id order by n) as k from lined where regexp_matches(b, '{FENCE}')),
fence_walk as (
  select distinct doc_id, 0::bigint as k, -1::bigint as opened, '' as sign, 0::bigint as size, -1::bigint as first, -1::bigint as last from marks
  union all
  select m.doc_id, m.k, case when w.opened < 0 then m.n when m.sign = w.sign and m.width >= w.size then -1 else w.opened end, case when w.opened < 0 then m.sign else w.sign end, case when w.opened < 0 then m.size else w.size end,
    case when w.opened >= 0 and m.sign = w.sign and m.width >= w.size then w.opened else -1 end, m.n from fence_walk w join marks m on m.doc_id = w.doc_id and m.k = w.k + 1
),
spans as (select doc_id, first, last from fence_walk where first >= 0 union all select doc_id, opened, 2147483647 from fence_walk f where opened >= 0 and k = (select max(k) from marks m where m.doc_id = f.doc_id)),
kinds as (select j.*, s.first as code, case when s.first is not null then 'code' when b = '' then 'blank' when regexp_matches(b, '^(-{{3,}}|\*{{3,}}|_{{3,}})\s*$') then 'break' when regexp_matches(b, '^\|.+\|$') then 'table'
  when regexp_matches(b, '{_ITEM}') then 'list' when head then 'heading' else 'paragraph' end as type from judged j left join spans s on s.doc_id = j.doc_id and j.n between s.first and s.last),
islands as (select *, case when lag(type) over w is null or type <> lag(type) over w or type in ('heading', 'break') or coalesce(code = n, false) then 1 else 0 end as begins from kinds window w as (partition by doc_id order by n)),
numbered as (select *, sum(begins) over (partition by doc_id order by n) as region from islands),
regions as (select doc_id, cast(region as bigint) as region, type, case when type in ('heading', 'break') then trim(string_agg(line, chr(10) order by n)) else string_agg(line, chr(10) order by n) end as content, cast(min(off) as bigint) as off
  from numbered where type <> 'blank' group by doc_id, region, type)"""


def pieces(name: str, source: str, size: int = SIZE, overlap: int = OVERLAP) -> str:
    """source (key, content) -> `name` (key, piece, start, content): pieces of a long paragraph."""
    most, share = 4 * size, 4 * overlap
    n = name
    return rf"""{n}_lines as (select key, content, string_split(content, chr(10)) as l from {source}),
{n}_fit as (select *, len(list_filter(l, lambda s: length(s) > {most})) = 0 as fits from {n}_lines),
{n}_units as (select key, fits, case when fits then l else flatten(list_transform(regexp_split_to_array(content, '[ \n]'), lambda w: list_transform(range(0, greatest((length(w) - 1) // {most}, 0) + 1), lambda i: substring(w, i * {most} + 1, {most})))) end as u from {n}_fit),
{n}_sums as (select key, fits, u, len(u) as m, list_prepend(0, list_transform(range(1, len(u) + 1), lambda i: list_sum(list_transform(u[1:i], lambda x: length(x))))) as s from {n}_units where len(u) <= 64
  union all select key, any_value(fits), list(x order by i), count(*), list_prepend(0, list(c order by i)) from (select key, fits, i, x, sum(length(x)) over (partition by key order by i) as c from (select key, fits, unnest(range(len(u))) as i, unnest(u) as x from {n}_units where len(u) > 64)) group by key),
{n}_walk as (
  select key, 0::bigint as step, 0::bigint as a, coalesce(list_filter(range(0, m), lambda j: s[j + 2] > s[j + 1])[1], m)::bigint as base, coalesce(list_filter(range(0, m), lambda j: s[j + 2] > s[j + 1])[1], m)::bigint as i, -1::bigint as ea, -1::bigint as eb, false as done from {n}_sums
  union all
  select key, step + 1, case when o is null then a else again end, case when o is null then base when again < o or length(u[o + 1]) > 0 then again else coalesce(list_filter(range(o, m), lambda j: s[j + 2] > s[j + 1])[1], m) end,
    case when o is null then i else greatest(o, case when again < o or length(u[o + 1]) > 0 then again else coalesce(list_filter(range(o, m), lambda j: s[j + 2] > s[j + 1])[1], m) end) end, a, case when o is null then m - 1 else o - 1 end, o is null
  from (select *, coalesce(list_filter(range(a + 1, o), lambda k: s[o + 1] - s[k + 1] + (o - 1 - k) <= {share} and s[o + 1] - s[k + 1] + (o - 1 - k) + 1 + length(u[o + 1]) <= {most})[1], o) as again
    from (select w.key, w.step, w.a, w.base, w.i, q.u, q.m, q.s, list_filter(range(w.i + 1, q.m), lambda j: q.s[j + 2] - q.s[w.base + 1] + (j - w.base) > {most})[1] as o from {n}_walk w join {n}_sums q on q.key = w.key where not w.done))
),
{n}_found as (select w.key, w.step, s[ea + 1] + ea as start, case when fits then array_to_string(u[ea + 1:eb + 1], chr(10)) else array_to_string(u[ea + 1:eb + 1], ' ') end as content from {n}_walk w join {n}_sums q on q.key = w.key where ea >= 0),
{n} as (select key, row_number() over (partition by key order by step) - 1 as piece, cast(start as bigint) as start, content from {n}_found where trim(content) <> '')"""


def passages(size: int = SIZE, least: int = LEAST) -> str:
    """regions -> packed (doc_id, place, off, content) -> chunks (doc_id, chunk_index, off, content)."""
    return rf"""counted as (select *, (length(content) + 3) // 4 as tokens, row_number() over (partition by doc_id order by region) as j from regions),
pack_walk as (
  select distinct doc_id, 0::bigint as j, 0::bigint as no, 0::bigint as held, false as open_, -1::bigint as at_no, false as alone from counted
  union all
  select c.doc_id, c.j, case when type in ('break', 'heading') then no + open_::int when held + tokens <= {size} then no else no + 1 end,
    case when type = 'break' then 0 when type = 'heading' then tokens when held + tokens <= {size} then held + tokens when not open_ then 0 else tokens end, case when type = 'break' then false when type = 'heading' or held + tokens <= {size} then true else open_ end,
    case when type = 'break' then -1 when type = 'heading' then no + open_::int when held + tokens <= {size} or not open_ then no else no + 1 end, type = 'paragraph' and held + tokens > {size} and not open_
  from pack_walk w join counted c on c.doc_id = w.doc_id and c.j = w.j + 1
),
placed as (select c.*, w.at_no, w.alone from counted c join pack_walk w on w.doc_id = c.doc_id and w.j = c.j where w.at_no >= 0),
cut_up as (select doc_id || ':' || at_no as key, doc_id, at_no, off, content from placed where alone), {pieces("part", "cut_up", size)},
whole as (select doc_id, at_no, 0::bigint as piece, min(off) as off, string_agg(content, chr(10) || chr(10) order by region) as content from placed where not alone group by doc_id, at_no
  union all select c.doc_id, c.at_no, p.piece, c.off + p.start, p.content from cut_up c join part p on p.key = c.key),
packed as (select doc_id, row_number() over (partition by doc_id order by at_no, piece) - 1 as place, cast(off as bigint) as off, content from whole),
merge_walk as (
  select distinct doc_id, -1::bigint as place, -1::bigint as into_, 0::bigint as held from packed
  union all
  select doc_id, place, case when joins then into_ else place end, case when joins then held + 1 + size_ else size_ end
  from (select p.doc_id, p.place, w.into_, w.held, length(p.content) as size_, w.into_ >= 0 and (length(p.content) + 3) // 4 < {least} and (w.held + 3) // 4 + (length(p.content) + 3) // 4 <= {size} as joins from merge_walk w join packed p on p.doc_id = w.doc_id and p.place = w.place + 1)
),
once as (select p.doc_id, w.into_, min(p.off) as off, string_agg(p.content, chr(10) order by p.place) as content from packed p join merge_walk w on w.doc_id = p.doc_id and w.place = p.place group by p.doc_id, w.into_),
nexts as (select *, row_number() over v as no, lead(content) over v as next_ from once window v as (partition by doc_id order by into_)),
joining as (select *, no = 1 and next_ is not null and (length(content) + 3) // 4 < {least} and (length(content) + 3) // 4 + (length(next_) + 3) // 4 <= {size} as joins from nexts),
kept as (select doc_id, off, case when joins then content || chr(10) || next_ else content end as content from (select *, coalesce(lag(joins) over (partition by doc_id order by into_), false) as gone from joining) where not gone),
chunks_ as (select doc_id, row_number() over (partition by doc_id order by off) - 1 as chunk_index, count(*) over (partition by doc_id) as total, off, (length(content) + 3) // 4 as tokens, content from kept)"""
