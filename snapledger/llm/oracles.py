"""The SQL that the queries of this subpackage are checked against."""

from __future__ import annotations

from .merkle import UPPER
from .quality_rules import LADDER, RULES, SYMBOLS, Risk

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quality_rules() -> str:
    risk = Risk()
    rate = risk.max_false_rejection / len(RULES)
    level = risk.error / (len(RULES) * (len(risk.strata) + 1))
    strata = ", ".join(f"'{s}'" for s in risk.strata)
    share = lambda part, whole: f"coalesce((1000 * {part}) // nullif({whole}, 0), 0)"
    union = " union all ".join(
        f"select stratum, '{r}' as rule, {share(*parts)} as v from held" for r, parts in RULES.items()
    )
    judged = " and ".join(
        f"not coalesce({share(*parts)} > (select cutoff from chosen c where c.stratum = s.stratum"
        f" and c.rule = '{r}'), false)"
        for r, parts in RULES.items()
    )
    ladder = ", ".join(f"({step}, {c})" for step, c in enumerate(LADDER))
    return rf"""
with d as (
    select row_number() over () as rid, doc_id, lang, coalesce(text, '') as body, {WORDS} as w from documents
), grams as (
    select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from d, unnest(range(1, len(w) - 1)) as t(i)
), again as (
    select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from grams) where n > 1
), covered as (
    select rid, count(distinct i + k) as n from again, unnest([0, 1, 2]) as t(k) group by rid
), lines as (
    select rid, count(*) as n, count(distinct line) as u
    from (select rid, unnest(string_split(body, chr(10))) as line from d)
    where length(translate(line, {BLANK}, '')) > 0 group by rid
), m as (
    select d.rid, doc_id, lang, len(w) as n_words, length(translate(body, {BLANK}, '')) as word_chars,
        length(body) - length(translate(body, '{SYMBOLS}', '')) as n_symbols,
        coalesce(l.n - l.u, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
        coalesce(l.n, 0) as n_lines, length(body) - length(replace(body, '!', '')) as n_shouts,
        case when lang in ({strata}) then lang else 'other' end as stratum
    from d left join covered c on c.rid = d.rid left join lines l on l.rid = d.rid
), s as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
), held as (
    select * from s where not base_failed and doc_id in (
        select doc_id from labels where quality is not null group by doc_id having min(quality) = 1)
), v as ({union}),
ladder(step, cutoff) as (values {ladder}),
counts as (
    select stratum, rule, step, cutoff, count(*) as total, count(*) filter (v > cutoff) as wrong
    from v, ladder group by all
), tested as (
    select *, case when wrong <= {rate} * total then list_sum(list_transform(range(0, wrong + 1), lambda i:
        exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln({rate}) + (total - i) * ln(1 - {rate}))
        )) <= {level} else false end as passed
    from counts
), chosen as (
    select t.stratum, t.rule, min(cutoff) as cutoff
    from tested t where step < coalesce((select min(step) from tested f
        where f.stratum = t.stratum and f.rule = t.rule and not f.passed), 1000000)
    group by 1, 2
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
    not base_failed and {judged} as kept
from s
"""


def ngram_join() -> str:
    words = WORDS.replace("text", f"translate(text, '{UPPER}', '{UPPER.lower()}')")
    return rf"""
with recursive w as (
    select row_number() over () as rid, doc_id, {words} as w from documents
), s as (
    select distinct rid, array_to_string(w[i : i + 3], ' ') as g from w, unnest(range(1, len(w) - 2)) as t(i) where len(w) >= 4
    union all select rid, array_to_string(w, ' ') || ' ' from w where len(w) between 1 and 3
), n as (select rid, count(*) as n from s group by rid),
shared as (select a.rid as a, b.rid as b, count(*) as k from s a join s b on a.g = b.g and a.rid < b.rid group by 1, 2),
links as (
    select a, b from shared join n x on x.rid = a join n y on y.rid = b where 100 * k >= 85 * (x.n + y.n - k)
), edges as (select a, b from links union all select b, a from links),
reach as (select a, b from edges union select reach.a, edges.b from reach join edges on edges.a = reach.b),
least as (select a, min(doc_id) as m from reach join w on w.rid = reach.b group by a)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from w left join n on n.rid = w.rid left join least on least.a = w.rid
"""


def syncmers() -> str:
    return rf"""
with d as (
    select doc_id, coalesce(text, '') as body,
        coalesce(lead(coalesce(text, '')) over (order by doc_id), first(coalesce(text, '')) over (order by doc_id)) as nxt
    from documents
), e as (
    select doc_id, body, length(body) as n,
        substring(body, 1, length(body) - length(body) // 4) || substring(nxt, 1, length(body) // 4) as edited, nxt from d
), texts as (
    select doc_id, 0 as which, body as t from e union all select doc_id, 1, edited from e union all select doc_id, 2, nxt from e
), p as (
    select doc_id, which, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts
), q as (
    select doc_id, which, list_concat(list_concat(['', '', '', '', '', '', ''], w), ['', '', '', '', '', '', '']) as w
    from p where len(w) > 0
), k as (
    select doc_id, which, w, list_transform(range(1, len(w)), lambda i: md5(w[i] || ' ' || w[i + 1])) as s from q
), a as (
    select doc_id, which, list_transform(
        list_filter(range(1, len(s) - 5), lambda i: least(s[i], s[i + 6]) = list_min(s[i : i + 6])),
        lambda i: left(md5(array_to_string(w[i : i + 7], ' ')), 8)) as f from k
), f as (
    select e.doc_id, e.n, e.edited, coalesce(x.f, []) as x, coalesce(y.f, []) as y, coalesce(z.f, []) as z
    from e left join a x on x.doc_id = e.doc_id and x.which = 0 left join a y on y.doc_id = e.doc_id and y.which = 1
    left join a z on z.doc_id = e.doc_id and z.which = 2
), g as (select *, list_distinct(x) as xs, list_distinct(y) as ys, list_distinct(z) as zs from f)
select doc_id, n::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(x, '') as fingerprint,
    array_to_string(y, '') as edited_fingerprint,
    case when len(xs) + len(ys) = 0 then 1.0::double
        else (2 * len(list_intersect(xs, ys)))::double / (len(xs) + len(ys)) end as near_edited,
    case when len(xs) + len(zs) = 0 then 1.0::double
        else (2 * len(list_intersect(xs, zs)))::double / (len(xs) + len(zs)) end as near_next
from g
"""


def crc32_of(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    return (
        f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), lambda r, b:"
        " list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(r, b)), 4294967295::bigint),"
        " 4294967295::bigint)"
    )


def tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs ``{name}_top`` and ``{name}_path`` over leaves (tree, rid, place, digest, other).

    A path has the leaf's proof and what its other digest folds to; levels beyond the root change nothing.
    """
    parts = [
        f"{name}_n0 as (select tree, place, digest from {leaves})",
        f"{name}_p0 as (select tree, rid, place, '' as proof, other as folded from {leaves})",
    ]
    for k in range(levels):
        run = "partition by tree, place // 8 order by place rows between"
        parts += [
            f"{name}_t{k} as (select *, count(*) over (partition by tree) > 1 as up from {name}_n{k})",
            f"{name}_n{k + 1} as (select tree, place // 8 as place, case when any_value(up) then"
            f" sha256(string_agg(digest, '' order by place)) else any_value(digest) end as digest from {name}_t{k} group by 1, 2)",
            f"{name}_s{k} as (select tree, place, up,"
            f" coalesce(string_agg(digest, '') over ({run} unbounded preceding and 1 preceding), '') as before,"
            f" coalesce(string_agg(digest, '') over ({run} 1 following and unbounded following), '') as after from {name}_t{k})",
            f"{name}_p{k + 1} as (select p.tree, p.rid, p.place // 8 as place,"
            " case when s.up then p.proof || s.before || s.after else p.proof end as proof,"
            " case when s.up then sha256(s.before || p.folded || s.after) else p.folded end as folded"
            f" from {name}_p{k} p join {name}_s{k} s on s.tree is not distinct from p.tree and s.place = p.place)",
        ]
    parts += [
        f"{name}_top as (select tree, digest from {name}_n{levels})",
        f"{name}_path as (select tree, rid, proof, folded from {name}_p{levels})",
    ]
    return ",\n".join(parts)


def merkle_manifest(levels: int = 8) -> str:
    """As many levels as 8 ** ``levels`` rows of a language need."""
    value = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    # What a row's found leaf folded to inside its group folds on through the groups' siblings.
    start = "c0 as (select p.rid, g.place, p.folded from a_path p join g on g.rid is not distinct from p.tree)"
    step = (
        "c{1} as (select c.rid, c.place // 8 as place,"
        " case when s.up then sha256(s.before || c.folded || s.after) else c.folded end as folded"
        " from c{0} c join b_s{0} s on s.place = c.place)"
    )
    chain = ",\n".join([start, *[step.format(k, k + 1) for k in range(levels)]])
    return rf"""
with d as (
    select row_number() over () as rid, *, coalesce({crc32_of("doc_id::varchar")} % 3 = 0, false) as hit from documents
), e as (
    select *, case when hit then translate(text, '{UPPER}', '{UPPER.lower()}') else text end as found from d
), h as (
    select rid, doc_id, lang as tree, {leaf("text")} as digest, {leaf("found")} as other from e
), l as (
    select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as place from h
), {tree_sql("a", "l", levels)},
g as (
    select 0 as tree, tree as rid, digest, digest as other, row_number() over (order by tree nulls first) - 1 as place from a_top
), {tree_sql("b", "g", levels)},
{chain}
select l.doc_id, l.digest as leaf, t.digest as subroot, b_top.digest as root, sha256(p.proof || q.proof) as proof_sha256,
    f.folded as folded_root, f.folded = b_top.digest as verified
from l join a_path p on p.rid = l.rid join a_top t on t.tree is not distinct from l.tree
join b_path q on q.rid is not distinct from l.tree join c{levels} f on f.rid = l.rid, b_top
"""


def periodic_runs(least: int = 16) -> str:
    """Places that share ``least`` words with a later one, as any run's do, stretched to both sides."""
    return rf"""
with d as (
    select row_number() over () as rid, doc_id, {WORDS} as w, {crc32_of("doc_id::varchar")} as h from documents
), e as (
    select *, len(w) as n, (h // 10) % len(w) as a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) as p from d
), f as (
    select rid, doc_id, n, case when h % 10 = 0 and n > 0
        then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w from e
), grams as (
    select rid, i, array_to_string(w[i + 1 : i + {least}], ' ') as g from f, unnest(range(n - {least} + 1)) as t(i)
), pairs as (
    select x.rid, x.i, y.i - x.i as q from grams x join grams y on x.rid = y.rid and x.g = y.g and x.i < y.i
), islands as (
    select rid, q, i, i - row_number() over (partition by rid, q order by i) as island from pairs
), stretches as (
    select rid, q, min(i) as start, max(i) - min(i) + {least} + q as length from islands group by rid, q, island
), runs as (
    select rid, start, length, min(q) as period from stretches where length >= greatest(24, 3 * q) group by 1, 2, 3
), listed as (
    select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
    from runs group by rid
), best as (
    select *, row_number() over (partition by rid order by length::double / period desc, start, period) as k from runs
), dropped as (
    select distinct rid, t.i from runs, unnest(range(start + period, start + length)) as t(i)
), kept as (
    select f.rid, string_agg(w[t.i + 1], ' ' order by t.i) as body
    from f, unnest(range(n)) as t(i) left join dropped x on x.rid = f.rid and x.i = t.i where x.i is null group by f.rid
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length,
    b.period::bigint as period, (1000 * b.length // b.period)::bigint as exponent_milli,
    sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.body, '')) as collapsed_sha256
from f left join listed using (rid) left join best b on b.rid = f.rid and b.k = 1 left join kept on kept.rid = f.rid
"""


ORACLES = {
    "op1_ngram_join": ngram_join(),
    "op2_quality_rules": quality_rules(),
    "op8_syncmers": syncmers(),
    "op11_merkle_manifest": merkle_manifest(),
    "op12_periodic_runs": periodic_runs(),
}
