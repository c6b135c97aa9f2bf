"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from pathglow.llm import embedding_dedup as embedding
from pathglow.llm import license_scan as licences
from pathglow.llm import periodic_runs as periods
from pathglow.llm import quality_rules as quality
from pathglow.llm import secret_scan as secrets

WORDS = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    """A word lies in a repeat of k words or more exactly if it lies in a window of k words found twice."""

    def windows(k: int) -> str:
        return f"""select rid, p from (
    select rid, p, count(*) over (partition by rid, array_to_string(ws[p : p + {k - 1}], ' ')) as c
    from places join split using (rid) where p + {k - 1} <= len(ws)) where c > 1"""

    return f"""
with texts as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), split as (
  select *, regexp_extract_all(t, '{WORDS}') as ws from texts
), places as (
  select rid, unnest(range(1, len(ws) + 1)) as p from split
), short as (
  {windows(quality.WINDOW)}
), long as (
  {windows(quality.MIN_REPEAT)}
), too_long as (
  select distinct rid from ({windows(quality.MAX_LONGEST + 1)})
), n_short as (
  select rid, count(distinct q) as n_repeat_words from (select rid, unnest(range(p, p + {quality.WINDOW})) as q from short) group by rid
), n_long as (
  select rid, count(distinct q) as covered_words from (select rid, unnest(range(p, p + {quality.MIN_REPEAT})) as q from long) group by rid
), counted as (
  select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')))))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(covered_words, 0)::bigint as covered_words, too_long.rid is not null as longest_exceeded
  from split left join n_short using (rid) left join n_long using (rid) left join too_long using (rid)
), failed as (
  select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from counted
)
select *, not base_failed and not (covered_words > {quality.MAX_COVERED} * n_words or longest_exceeded) as kept from failed
"""


def _warc() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select *, sha1(h) as x, max(page_id) over (partition by h) as original from p
)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{letters}',
    (((('0x' || substr(x, (5 * (i // 4))::int + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when original is null or page_id = original then 'response' else 'revisit' end as record_type,
  case when original is not null and page_id is distinct from original then original end as refers_to
from d
"""


def _licences() -> str:
    word = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
    spots = []
    for phrase, label in licences.PHRASES.items():
        parts = phrase.split(" ")
        spots.append(f"select rid, i, '{label}' as label from w where " + " and ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(parts)))
    rows = ", ".join(f"('{label}', {sorted(words)!r}, {window})" for label, words, window in licences.templates())
    sizes = sorted({window for *_, window in licences.templates()})
    return f"""
with texts as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') as ws from documents
), w as (
  select rid, ws, unnest(range(1, len(ws) + 1)) as i from texts
), places as (
  {' union all '.join(spots)}
), base as (
  select rid, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, list_sort(list_distinct(list(label))) as base from places group by rid
), blocks as (
  select rid, n, ws[s + 1 : s + n] as b from (select rid, ws, n, unnest(range(0, greatest(len(ws) - n // 2, 0) + 1, n // 2)) as s from texts, (select unnest({sizes}) as n))
), templates(label, t, n) as (
  values {rows}
), met as (
  select rid, label, len(list_intersect(b, t)) / len(t) as containment from blocks join templates using (n) where len(list_intersect(b, t)) >= {licences.CONTAINMENT} * len(t) - 1e-9
), extra as (
  select rid, list(label) as extra, max(containment) as containment from met group by rid
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(coalesce(base, []), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(extra, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(containment, 0.0)::double end as score
from texts left join base using (rid) left join extra using (rid)
"""


def _embeddings() -> str:
    """Reach over links, from every vector; only rows with distinct ids are told apart."""
    return f"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
), able as (
  select *, sqrt(list_dot_product(e, e)) as norm from v
  where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), pairs as materialized (
  select a.vec_id as a, b.vec_id as b from able a join able b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {embedding.THRESHOLD}
), reach(a, c) as (
  select vec_id, vec_id from v union select p.b, r.c from reach r join pairs p on p.a = r.a
), least as (
  select a as vec_id, min(c) as component_id from reach group by a
), counted as (
  select a as vec_id, count(*) as n_links from pairs group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v left join counted using (vec_id) join least using (vec_id)
"""


def _search() -> str:
    word = r"[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
    found = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"
    return f"""
with d as (
  select row_number() over () as rid, doc_id, {found} as ws from documents
), held as (
  select rid, doc_id, len(ws)::bigint as n from d where len(ws) > 0
), total as (
  select count(*)::bigint as docs, sum(n)::bigint as terms from held
), tf as (
  select rid, term, count(*)::bigint as tf from (select rid, unnest(ws) as term from d) group by rid, term
), df as (
  select term, count(*)::bigint as df from tf group by term
), q as (
  select qid, item_id, unnest(list_distinct(ws)) as term from (select row_number() over () as qid, item_id, {found} as ws from benchmark)
), scored as (
  select qid, any_value(item_id) as item_id, rid, sum(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::bigint as score
  from q join tf using (term) join df using (term) join held using (rid), total group by qid, rid
), ranked as (
  select item_id, row_number() over (partition by qid order by score desc, doc_id asc nulls last)::int as rank, doc_id, score from scored join held using (rid) where score > 0
)
select * from ranked where rank <= 10
"""


def _periods(octaves: int = 15) -> str:
    """In a run, a stretch of 2^k words no shorter than the period comes again after exactly the period, and not before.

    Stretches are told apart by 64-bit hashes; periods up to 2^(octaves - 1) are found.
    """
    levels, islands = ["level0 as (select rid, i, hash(w) as h from word)"], []
    for k in range(1, octaves):
        levels.append(f"level{k} as (select rid, i, hash(h, x) as h from (select *, lead(h, {1 << k - 1}) over (partition by rid order by i) as x from level{k - 1}) where x is not null)")
    for k in range(octaves):
        islands.append(f"""select rid, p, min(i) as s, max(i) + p + {1 << k} as e from (
    select rid, i, p, i - row_number() over (partition by rid, p order by i) as island from (
      select rid, i, lead(i) over (partition by rid, h order by i) - i as p from level{k}) where p <= {1 << k} and 2 * p > {1 << k}) group by rid, p, island""")
    bit = "list_reduce(list_prepend({}, range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda c, x: " + bit.format("xor(c, x)") + "), 4294967295)"
    return f"""
with texts as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as ws, {crc} as h from documents
), planned as (
  select *, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from texts
), periodic as (
  select *, 1 + (len(ws) - a) // (3 + (h // 10) % 8) as m from planned
), word as materialized (
  select rid, i, ws[(case when i >= a then a + (i - a) % m else i end) + 1] as w from (select *, unnest(range(len(ws))) as i from periodic)
), {", ".join(x.replace(" as (", " as materialized (", 1) for x in levels)}, stretch as (
  {" union all ".join(islands)}
), run as materialized (
  select rid, s, e - s as l, p from stretch where e - s >= greatest({periods.LEAST_WORDS}, {periods.LEAST_TIMES} * p)
), listed as (
  select rid, count(*) as n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' order by s, p) as lines,
    arg_min({{'start': s, 'length': l, 'period': p}}, {{'times': -(l::double / p), 's': s, 'p': p}}) as best from run group by rid
), gone as (
  select distinct rid, i from (select rid, unnest(range(s + p, s + l)) as i from run)
), kept as (
  select rid, string_agg(w, ' ' order by i) as words from word anti join gone using (rid, i) group by rid
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
  (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from texts left join listed using (rid) left join kept using (rid)
"""


def _secrets() -> str:
    """Places of findings from the lengths of what lies between them; the models from counts of pairs of characters."""
    size = secrets.SIZE

    def spans(kind: int, form: str) -> str:
        pattern = form.replace("'", "''").replace("\\x20", " ")
        return f"""select rid, {kind} as kind, gaps, hits from (select rid, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as hits from d) where len(hits) > 0"""

    value = secrets.ASSIGN.replace("'", "''").replace("\\x20", " ")
    token = secrets.TOKEN
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    return f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), forms as (
  {spans(0, secrets.ASSIGN)} union all {spans(1, secrets.ACCESS)} union all {spans(2, secrets.HEX)} union all {spans(3, secrets._LONG.pattern)}
), each as (
  select rid, kind, unnest(range(1, len(hits) + 1)) as i, gaps, hits from forms
), placed as (
  select rid, kind, hits[i] as hit, (list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0))::bigint as s from each
), found as (
  select rid, kind, s, s + length(hit) as e, case when kind = 0 then regexp_extract(hit, '^{value}', 2) else hit end as v from placed
), base as (
  select * from found where kind < 3 and (kind > 0 or length(v) >= {secrets.LEAST_VALUE})
), samples as (
  select 1 as random, unnest(regexp_extract_all(v, '{token}+')) as w, 1 as n from base
  union all
  select 0, w, count(*) from (select unnest(regexp_extract_all(t, '{token}+')) as w from d where rid not in (select rid from base)) group by w
), pairs as (
  select random, substr(w, i, 1) as a, substr(w, i + 1, 1) as b, sum(n) as n from (select *, unnest(range(1, length(w))) as i from samples) group by all
), chars as (
  select unnest(string_split('{secrets.CHARACTERS}', '')) as c
), cells as (
  select x.c as a, y.c as b, coalesce(r.n, 0) + 1 as r, coalesce(o.n, 0) + 1 as o
  from chars x cross join chars y left join (from pairs where random = 1) r on r.a = x.c and r.b = y.c left join (from pairs where random = 0) o on o.a = x.c and o.b = y.c
), model as (
  select a, b, floor(1000 * (ln(r::double / sum(r) over (partition by a)) - ln(o::double / sum(o) over (partition by a))) + 0.5)::bigint as w from cells
), long as (
  select rid, s, e, v, unnest(range(1, length(v))) as i from found f where kind = 3 and not exists (select 1 from base b where b.rid = f.rid and b.s < f.e and f.s < b.e)
), random as (
  select rid, 3 as kind, s, e from long join model on a = substr(v, i, 1) and b = substr(v, i + 1, 1) group by rid, s, e having sum(w) >= {secrets.LEAST_RATIO}
), every as (
  select rid, kind, s, e from base union all from random
), listed as (
  select rid, list([{names}][kind + 1] || ':' || s || ':' || e order by s, kind) as spans, list([{names}][kind + 1] || ':' || s || ':' || e order by s, kind) filter (kind < 3) as base,
    count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex from every group by rid
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(array_to_string(coalesce(base, []), ',')) as base_sha256, array_to_string(coalesce(spans, []), ',') as spans
from d left join listed using (rid)
"""


ORACLES = {"op1_embedding_near_dedup": _embeddings(), "op2_quality_rules": _quality(), "op6_warc": _warc(), "op7_license_scan": _licences(), "op11_periodic_runs": _periods(), "op12_secret_scan": _secrets(), "op13_lexical_search": _search()}
