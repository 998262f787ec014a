"""SQL that gives the rows of the queries SQL can express."""

from rowloom.llm.line_rules import MAX_REPEAT_PERCENT, MIN_DOCS, MIN_LEFT_PERCENT, MIN_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

# Targets, buckets and boundaries as in rowloom.llm.mixing: 24 bits a unit, 3 copies at most.
MIXING_PARTS = f"""
sized as (
  select *, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as mix_size,
         case when source is null then 'null' else '=' || source end as mix_key,
         md5(coalesce(doc_id::varchar, 'null')) as mix_digest
  from docs
),
sources as (
  select source, mix_key, sum(mix_size)::hugeint as words,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from sized group by source, mix_key
),
opened as (
  select *, words * 3 as cap,
         sum(words) over () - coalesce(sum(words * 3) over before, 0) as open_words,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as open_weight
  from sources
  window before as (order by (words * 3)::double / weight, source nulls last
                    rows between unbounded preceding and 1 preceding)
),
flagged as (select *, open_words * weight > cap * open_weight as capped from opened),
rested as (
  select *, sum(words) over () - sum(case when capped then cap else 0 end) over () as rest,
         sum(case when capped then 0 else weight end) over () as rest_weight
  from flagged
),
targets as (
  select mix_key, words, case when capped then cap::double
         else weight::double * rest::double / rest_weight::double end as target
  from rested
),
stepped as (
  select *, case when words > 0 then least(floor(target / words * 16777216.0)::bigint, 50331648) else 0 end as step,
         ('0x' || substr(md5('mix|' || mix_key), 1, 6))::bigint as mix_offset
  from targets
),
placed as (
  select sized.*, words, target, step, mix_offset, row_number() over (
           partition by sized.mix_key
           order by length(bin(mix_size)) * 8 + ((mix_size >> greatest(length(bin(mix_size)) - 4, 0)) & 7),
                    mix_digest, doc_id, mix_size) as place
  from sized join stepped using (mix_key)
),
mixed as (
  select *, case when mix_size > 0 then
           ((mix_offset + place * step) >> 24) - ((mix_offset + (place - 1) * step) >> 24) else 0 end as copies
  from placed
)
"""

OP9 = f"""
with docs as (select doc_id, source, text from documents), {MIXING_PARTS}
select doc_id, mix_size as size, words::bigint as source_size, target, (copies * mix_size)::bigint as taken from mixed
"""

OP10 = f"""
with texts as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
lists as (select *, regexp_extract_all(t, '{_WORD}') as w, string_split(t, chr(10)) as ls from texts),
windows as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from lists where len(w) > 2)
),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from windows) where n > 1),
covered as (select rid, count(distinct i + k) as n_repeat from twice, (values (0), (1), (2)) as s(k) group by rid),
lines as (select rid, doc_id, source, unnest(ls) as line from lists),
worded as (
  select rid, doc_id, source, line, regexp_extract_all(line, '{_WORD}') as w
  from lines where regexp_matches(line, '{_WORD}')
),
dups as (select rid, count(*) - count(distinct line) as n_dup from worded group by rid),
normal as (
  select rid, doc_id, source, sum(len(w)) as words,
         regexp_replace(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[0-9]+', '0', 'g') as line
  from worded group by rid, doc_id, source, 5
),
frequent as (
  select source, line from normal group by source, line
  having count(distinct doc_id) + count(*) filter (where doc_id is null) > {MIN_DOCS}
),
removed as (
  select rid, sum(words) as n_removed from normal n
  join frequent f on n.source is not distinct from f.source and n.line = f.line group by rid
),
counts as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words,
         coalesce(n_removed, 0)::bigint as n_removed_words
  from lists left join dups using (rid) left join covered using (rid) left join removed using (rid)
),
judged as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counts
)
select *, not base_failed and 100 * (n_words - n_removed_words) >= {MIN_LEFT_PERCENT} * n_words as kept from judged
"""

# CRC-32 of the decimal digits of the id, bit by bit.
_ID_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(doc_id::varchar, '.'),
 lambda c: ascii(c)::ubigint)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[],
 lambda d, z: xor(d >> 1, (d & 1) * 3988292384::ubigint))), 4294967295::ubigint)"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(concat({}))".format(
        ", ".join(f"case when {f} is null then '-' else concat(strlen(({f})::varchar), ':', {f}) end" for f in fields)
    )


OP13 = f"""
with recursive rows as (
  select *, case when source is null then 'null' else '=' || source end as g,
         case when doc_id is not null and {_ID_CRC} % 2 = 0 then replace(text, chr(10), '') else text end as found
  from documents),
leaves as (
  select doc_id, source, g, leaf, seen, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos
  from (select *, {_leaf("text")} as leaf, {_leaf("found")} as seen from rows) r),
low as (
  select g, 0 as level, pos as idx, count(*) over (partition by g) as n, leaf as node from leaves
  union all
  select g, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from low
  where n > 1 group by g, level, idx // 3, n),
subroots as (
  select g, node as subroot, row_number() over (order by source nulls first) - 1 as place
  from low join (select distinct g, source from leaves) s using (g) where n = 1),
high as (
  select 0 as level, place as idx, count(*) over () as n, subroot as node from subroots
  union all
  select level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from high
  where n > 1 group by level, idx // 3, n),
beside as (
  select 0 as part, a.g, a.level, a.idx, string_agg(b.node, '' order by b.idx) filter (b.idx < a.idx) as l,
         string_agg(b.node, '' order by b.idx) filter (b.idx > a.idx) as r
  from low a join low b on a.g = b.g and a.level = b.level and a.idx // 3 = b.idx // 3 where a.n > 1 group by 1, 2, 3, 4
  union all
  select 1, '', a.level, a.idx, string_agg(b.node, '' order by b.idx) filter (b.idx < a.idx),
         string_agg(b.node, '' order by b.idx) filter (b.idx > a.idx)
  from high a join high b on a.level = b.level and a.idx // 3 = b.idx // 3 where a.n > 1 group by 1, 2, 3, 4),
steps as (
  select leaves.g, pos, part, level, coalesce(l, '') as l, coalesce(r, '') as r
  from leaves join beside b on part = 0 and b.g = leaves.g and b.idx = pos // power(3, level)::bigint
  union all
  select leaves.g, pos, part, level, coalesce(l, ''), coalesce(r, '')
  from leaves join subroots using (g) join beside b on part = 1 and b.idx = place // power(3, level)::bigint),
paths as (
  select g, pos, string_agg(concat(l, r), '' order by part, level) as siblings,
         list(concat(l, '|', r) order by part, level) as path
  from steps group by 1, 2),
done as (
  select doc_id, leaf, subroot, (select node from high where n = 1) as root, sha256(coalesce(siblings, '')) as proof_sha256,
         list_reduce(list_prepend(seen, coalesce(path, [])),
                     lambda node, x: sha256(concat(split_part(x, '|', 1), node, split_part(x, '|', 2)))) as folded_root
  from leaves join subroots using (g) left join paths using (g, pos))
select *, folded_root = root as verified from done
"""

def _assigned(book: str) -> str:
    """Nearest entry of each part, ties to the lower index."""
    return f"""(select vec_id, label, part, c, arg_min(entry, d * 64 + entry) as entry, min(d) as d from (
  select p.*, b.entry, list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from parts p join {book} b on p.part = b.part) x group by vec_id, label, part, c)"""


def _moved(book: str) -> str:
    """Floors of the means of the parts that go to each entry."""
    return f"""(select part, entry, coalesce(m.c, b.c) as c from {book} b left join (
  select part, entry, list(mean order by i) as c from (
    select part, entry, i, floor(sum(c[i])::double / count(*))::bigint as mean
    from {_assigned(book)} a, range(1, len(c) + 1) r(i) group by part, entry, i) y group by part, entry) m using (part, entry))"""


OP11 = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (
  select vec_id, label, p::int as part, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) as c
  from kept, range(16) r(p)),
book0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, c from parts
  where vec_id in (select vec_id from kept order by vec_id limit 64)),
book1 as {_moved("book0")},
book2 as {_moved("book1")},
coded as (
  select vec_id, label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, sum(d)::bigint as error
  from {_assigned("book2")} a group by vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
 (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from book2) as codebooks_sha256
from coded
"""

ORACLE = {"op9_mixing": OP9, "op10_line_rules": OP10, "op11_product_codes": OP11, "op13_merkle_manifest": OP13}
