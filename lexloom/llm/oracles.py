"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# Fixed values of op3_mixing: weights by path, share of all tokens, epochs and seed.
_MIX = """
with docs as (
  select doc_id, lang, source, coalesce(lang, '') as l1, coalesce(source, '') as l2,
    case when try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int) < 5 then 'web'
         when try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int) < 10 then 'books'
         when try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int) < 15 then 'news'
         else 'forum' end as l0,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens,
    concat_ws('|', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, ''))) as k
  from documents),
leaves as (select l0, l1, l2, sum(tokens)::hugeint as total from docs group by all),
room2 as (select *, total * 4 as room,
    case when l0 = 'books' and l1 = 'en' and l2 = 'src5' then 3 else 1 end as w from leaves),
room1 as (select l0, l1, sum(room)::hugeint as room,
    case when l0 = 'web' and l1 = 'en' then 4 when l0 = 'web' and l1 = 'de' then 2
         when l0 = 'books' and l1 = 'en' then 2 when l0 = 'news' and l1 = 'fr' then 2
         else 1 end as w from room2 group by l0, l1),
room0 as (select l0, sum(room)::hugeint as room,
    case l0 when 'web' then 2 when 'books' then 3 else 1 end as w from room1 group by l0),
top as (select least((select sum(room) from room0)::hugeint,
                     (select sum(total) from leaves)::hugeint * 3 // 4) as budget),
{levels}
plan as (select l0, l1, l2, given // total as whole, given - (given // total) * total as rest
         from given2 where given > 0),
keyed as (select d.*, p.whole, p.rest, md5(concat_ws('|', '17', cast(p.whole as varchar), d.k)) as o
          from docs d join plan p using (l0, l1, l2)),
run as (select *, coalesce(sum(tokens) over (partition by l0, l1, l2 order by o
          rows between unbounded preceding and 1 preceding), 0) as before from keyed)
select doc_id, lang, source, e as epoch, tokens as tokens_taken
from keyed, unnest(range(cast(whole as bigint))) as t(e)
union all
select doc_id, lang, source, cast(whole as bigint), cast(least(tokens, rest - before) as bigint)
from run where before < rest and tokens > 0
"""


def _share(depth: int) -> str:
    """A level's budgets: full siblings first, then the rest by weight with exact rounding."""
    own = [f"l{i}" for i in range(depth + 1)]
    parent = f"partition by {', '.join(own[:-1])}" if depth else ""
    source = (f"select r.*, p.given as budget from room{depth} r join given{depth - 1} p"
              f" using ({', '.join(own[:-1])}) where r.room > 0" if depth else
              "select r.*, budget from room0 r, top where r.room > 0")
    extra = ", total" if depth == 2 else ""
    return f"""
s{depth} as (select *, coalesce(sum(room) over (o rows between unbounded preceding and 1 preceding), 0)
      as ahead, sum(w) over (o rows between current row and unbounded following) as behind
    from ({source}) window o as ({parent} order by room::double / w::double, {own[-1]})),
f{depth} as (select *, room * behind + ahead * w <= budget * w as f from s{depth}),
u{depth} as (select *, budget - coalesce(sum(case when f then room end) over ({parent}), 0) as left_over,
      case when f then 0 else w end as ow,
      sum(case when f then 0 else w end) over ({parent}) as aw from f{depth}),
v{depth} as (select *, sum(ow) over ({parent} order by room::double / w::double, {own[-1]}
      rows between unbounded preceding and current row) as upto from u{depth}),
given{depth} as (select {', '.join(own)}{extra}, (case when f then room else
      (left_over * upto) // aw - (left_over * (upto - ow)) // aw end)::hugeint as given from v{depth}),"""


_TOPK = """
with v as (
  select row_number() over () as n, vec_id,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.n, q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and q.n <> c.n)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
where rank <= 5
"""

# Fixed values of op5_chat_format: budget 1024, history 192, regions of 64 budgets; four tokens for
# the marks of a turn; 23 characters of marks for each turn, 7 for each window.
_CHAT = """
with recursive given as (
  select conv_id, turn, role, text from conversations union all
  select -1, i, case when i = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]'
  from range(2) t(i)),
turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as seq
  from given),
sized as (
  select *, seq = 0 and role = 'system' as sys,
    4 + len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')) as size,
    23 + length(text) + length(text) - length(replace(text, '\\', ''))
       + len(regexp_extract_all(text, '</?s>|<\\|(?:turn|text|end)\\|>|\\[/?INST\\]'))
       + length(role) + length(role) - length(replace(role, '\\', ''))
       + len(regexp_extract_all(role, '</?s>|<\\|(?:turn|text|end)\\|>|\\[/?INST\\]')) as chars
  from turns),
summed as (
  select conv_id, seq, sys, chars, case when sys then 0 else size end as counted,
    max(case when sys then size else 0 end) over (partition by conv_id) as system_size,
    coalesce(sum(case when sys then 0 else size end) over (partition by conv_id order by seq
      rows between unbounded preceding and 1 preceding), 0) as start from sized),
placed as (
  select *, greatest(0, least(192, (1024 - system_size) // 2)) as repeat from summed),
begins as (
  select conv_id, seq as first, start from placed where seq = 0
  union all
  select p.conv_id, min(p.seq), min(p.start)
  from begins b join placed p on p.conv_id = b.conv_id
    and p.seq > b.first + case when b.first = 0 and p.system_size > 0 then 1 else 0 end
    and (p.start + p.counted > b.start + 1024 - p.system_size - case when b.first = 0 then 0 else p.repeat end
         or p.start // 65536 > b.start // 65536)
  group by p.conv_id, b.first),
bounds as (
  select *, lead(first) over (partition by conv_id order by first) as next from begins),
spans as (
  select b.conv_id, b.first, b.start, sum(p.chars) as own_chars,
    greatest(0, least(max(p.repeat), 1024 - max(p.system_size) - sum(p.counted))) as repeat
  from bounds b join placed p on p.conv_id = b.conv_id and p.seq >= b.first
    and (b.next is null or p.seq < b.next) group by b.conv_id, b.first, b.start),
extra as (
  select s.conv_id, s.first, sum(c.chars) as chars from spans s join placed c on s.conv_id = c.conv_id
  where c.seq < s.first and (c.sys or c.start >= s.start - s.repeat) group by s.conv_id, s.first),
lengths as (
  select conv_id, cast(sum(7 + own_chars + coalesce(chars, 0)) as bigint) as formatted_chars
  from spans left join extra using (conv_id, first) group by conv_id),
said as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by seq) as said,
         coalesce(string_agg(case when role = 'assistant' then text end, '' order by seq), '') as learned
  from turns group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, cast(length(learned) as bigint) as loss_chars,
       sha256(learned) as loss_sha256, formatted_chars
from said join lengths using (conv_id)
"""

# Fixed values of op8_warc_fixity: the header of a record, archives of 1000 pages, and the damage.
_WARC = """
with made as (
  select page_id, 'pages-' || cast(floor(page_id / 1000) as bigint) as archive, coalesce(url, '') as url,
    'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
    || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g') || e
    || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e
    || coalesce(html, '') as record
  from pages, (select chr(13) || chr(10) as e)),
placed as (
  select *, strlen(record) + 4 as length,
    coalesce(sum(strlen(record) + 4) over (partition by archive order by page_id, url, record
      rows between unbounded preceding and 1 preceding), 0) as start from made),
damage as (
  select *, substr(md5(archive), 1, 1) in ('2', 'b') and page_id % 1000 >= 950 as gone,
    substr(md5(cast(page_id as varchar)), 1, 2) = '3f' and right(record, 1) <> '~' as hurt from placed)
select page_id, archive, cast(start as bigint) as "offset", length,
  case when not gone and hurt then strlen(left(record, length(record) - 1) || '~') + 4 end
    as replica_length,
  case when gone then 'missing' when hurt then 'changed' else 'same' end as status
from damage
"""

# Fixed values of op11_vector_codes: 8 parts, 16 entries, floor(4096 x).
_CODES = """
with v as (
  select row_number() over (order by vec_id nulls last, embedding) as n, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * cast(x as double))) as e
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (
  select n, part, list_slice(e, part * len(e) // 8 + 1, (part + 1) * len(e) // 8) as x
  from v, (select unnest(range(8)) as part)),
b0 as (select part, n - 1 as k, x from p where n <= 16),
{rounds}
final as (select n, string_agg(printf('%02x', k), '' order by part) as code, cast(sum(d) as bigint) as error
          from a6 group by n),
said as (select sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by part, k, j)) as codebooks_sha256
         from (select part, k, unnest(x) as y, generate_subscripts(x, 1) as j from b6))
select vec_id, code, error,
       cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from final join v using (n), said
"""


def _code_round(i: int) -> str:
    """Assignment ``a`` to codebook ``b`` number i and, but for the last, the next codebook."""
    step = f"""a{i} as materialized (
  select n, part, x, best.d as d, best.k as k from (
    select n, p.part, p.x, min({{'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x)
      + list_inner_product(b.x, b.x), 'k': b.k}}) as best
    from p join b{i} b on p.part = b.part group by n, p.part, p.x)),"""
    if i == 6:
        return step
    return step + f"""
m{i} as (select part, k, j, sum(cast(y as hugeint)) as s, count(*) as c
  from (select part, k, unnest(x) as y, generate_subscripts(x, 1) as j from a{i}) group by all),
n{i} as (select part, k, list(cast((s - ((s % c) + c) % c) // c as double) order by j) as x
  from m{i} group by part, k),
b{i + 1} as materialized (
  select part, k, coalesce(n{i}.x, b{i}.x) as x from b{i} left join n{i} using (part, k)),"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": _MIX.replace("{levels}", "".join(map(_share, range(3)))),
        "op4_topk": _TOPK,
        "op5_chat_format": _CHAT,
        "op8_warc_fixity": _WARC,
        "op11_vector_codes": _CODES.replace("{rounds}", "\n".join(map(_code_round, range(7)))),
    }
