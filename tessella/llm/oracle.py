"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_MINHASH_NEAR_DEDUP = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id
), pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), link as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), ends as (select a, b from link union all select b, a from link
), reach as (
  select doc_id as root, doc_id as node from n union select root, b from reach join ends on a = node
), low as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(low.component_id, d.doc_id) as component_id,
  d.doc_id = coalesce(low.component_id, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join low on low.node = d.doc_id
"""

OP4_SUBSTRING_DEDUP = rf"""
with w as (select doc_id, {_WORDS} as ws from documents
), win as (
  select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) as h
  from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)
), own as (select h, min(doc_id) as owner from win group by h
), hit as (select distinct win.doc_id, i from win join own using (h) where win.doc_id > owner
), word as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w where doc_id in (select doc_id from hit)
), marked as (
  select word.doc_id, word.i, word, max(hit.i) over (partition by word.doc_id order by word.i rows between 49 preceding and current row) is not null as gone
  from word left join hit on hit.doc_id = word.doc_id and hit.i = word.i
), cut as (
  select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from marked group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, array_to_string(ws, ' '))) as kept_sha256
from w left join cut on cut.doc_id = w.doc_id
"""

OP2_SOURCE_MIXING = rf"""
with d as (
  select doc_id, source, len({_WORDS})::bigint as size,
    0.25::double + 0.75::double * case when length(text) > 0
      then length(translate(text, '0123456789%&$#*|@=<>{{}}[]()!~^_+/\', ''))::double / length(text) else 0.0::double end as w from documents
), k as (
  select *, -ln((('0x' || substr(md5('42:' || doc_id::varchar), 1, 13))::ubigint::double + 0.5::double) / 4503599627370496.0::double) / w as key from d
), s as (select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as rk from k group by source
), wt as (select *, 1 + (rk - 1) % 3 as weight, source_size * 3 as lim from s
), o as (select *, row_number() over (order by lim::double / weight, rk) as ahead, lim::double / weight as ratio from wt
), f as (
  select *, ((sum(source_size) over () - coalesce(sum(lim) over (order by ahead rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by ahead rows between current row and unbounded following))::double) as share from o
), st as (select min(ahead) as open_at from f where ratio > share
), t as (
  select source, source_size, case when open_at is null or ahead < open_at then lim::double
    else (select share from f x where x.ahead = open_at) * weight end as target from f, st
), p as (
  select k.doc_id, k.size, t.source_size, t.target,
    coalesce(sum(k.size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead,
    case when t.source_size > 0 then floor(target)::bigint // t.source_size else 0 end as epochs
  from k join t on k.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - ahead)))::bigint as taken from p
"""

OP3_CHAT_PERSPECTIVES = r"""
with m as (
  select conv_id, coalesce(turn, 9223372036854775807) as turn,
    regexp_replace(replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), '[\r\n]', ' ', 'g') as speaker,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') as content from conversations
), p as (select distinct conv_id, speaker as perspective from m where speaker <> 'system'
), r as (
  select m.conv_id, perspective, turn, speaker, content,
    case when speaker = 'system' then '<|im_start|>system' || chr(10) when speaker = perspective then '<|im_start|>assistant' || chr(10)
      else '<|im_start|>user name=' || speaker || chr(10) end as head from m join p on m.conv_id is not distinct from p.conv_id
), o as (
  select *, coalesce(sum(length(head) + length(content) + 11) over w, 0) + length(head) as start,
    row_number() over (partition by conv_id, perspective order by turn, speaker, content) as i from r
  window w as (partition by conv_id, perspective order by turn, speaker, content rows between unbounded preceding and 1 preceding)
)
select conv_id, perspective, string_agg(head || content || '<|im_end|>' || chr(10), '' order by i) as text,
  coalesce(string_agg(start::bigint || ':' || (start + length(content) + 10)::bigint, ',' order by i) filter (speaker = perspective), '') as mask,
  count(*) as n_messages, coalesce(sum(length(content) + 10) filter (speaker = perspective), 0)::bigint as n_trained
from o group by conv_id, perspective
"""

OP9_LEGACY_ARCHIVE = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f on f.payload_digest = p.payload_digest and payload_bytes >= 100
"""
