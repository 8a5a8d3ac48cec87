"""SQL for the operators that it can express, for tables of test size."""

from __future__ import annotations

from quern.llm import quality

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NGRAM_JACCARD = f"""
with recursive w as (select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
g as (select a, b from e union select b, a from e),
r as (select doc_id as id, doc_id as c from documents union select g.b, r.c from r join g on g.a = r.id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.c) as component_id from documents d left join n using (doc_id) join r on r.id = d.doc_id group by 1, 2
"""


def quality_rules() -> str:
    """Base rules, and the concentration steps one after the other."""
    vector = ", ".join(f"{v} as {k}" for k, v in quality.VECTOR.items())
    xs = ", ".join(quality.VECTOR)
    pairs = [(i, j) for i in range(1, 5) for j in range(1, i + 1)]
    flat, signs, sign_moments = (", ".join(x) for x in (quality.FLAT, quality.SIGNS, quality.SIGN_MOMENTS))
    columns = ", ".join(["unit", "start", *[f"m{i}" for i in range(1, 5)], *[f"l{i}{j}" for i, j in pairs]])
    medians = ", ".join(f"quantile_disc(x{i}, 0.5) as m{i}" for i in range(1, 5))
    moments, cholesky, distance = (", ".join(x) for x in (quality.MOMENTS, quality.CHOLESKY, quality.DISTANCE))
    parts = [
        f"w as (select doc_id, lang, source, coalesce(text, '') as t, {WORDS.format(text="coalesce(text, '')")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents)",
        "win as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2)",
        "rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from win) where n > 1)",
        "cov as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from rep) group by 1)",
        "st as (select w.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,"
        " len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words from w left join cov using (doc_id))",
        f"v as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed, {vector} from st)",
        "sz as (select lang, source, count(*) as n from v where not base_failed group by 1, 2)",
        f"pl as (select lang, sum(n) as pooled from sz where n < {quality.MIN_GROUP} group by 1)",
        f"un as (select sz.lang, sz.source, case when n >= {quality.MIN_GROUP} then sz.lang || '/' || sz.source when pooled >= {quality.MIN_GROUP} then sz.lang else 'pool' end as unit from sz left join pl using (lang))",
        "ro as (select v.*, unit from v left join un using (lang, source))",
        f"go as (select unit, {xs} from ro where not base_failed)",
        f"md as (select unit, {medians} from go group by unit)",
        f"sg as (select unit, {', '.join(f'm{i}' for i in range(1, 5))}, {signs} from (select *, {quality.NORM} as norm from go join md using (unit)))",
        f"e0 as (select {columns} from (select *, 0 as start, {flat} from md) union all select {columns} from (select *, 1 as start, {cholesky} from (select unit, {moments} from go group by unit))"
        f" union all select {columns} from (select *, 2 as start, {cholesky} from (select unit, {sign_moments} from sg group by unit)))",
    ]
    for k in range(quality.STEPS):
        parts += [
            f"b{k} as (select *, {quality.BIN} as bin from (select e{k}.start, go.*, {distance} from go join e{k} using (unit)))",
            f"c{k} as (select unit, start, min(bin) as last from (select unit, start, bin, sum(n) over (partition by unit, start order by bin) as upto, sum(n) over (partition by unit, start) as total"
            f" from (select unit, start, bin, count(*) as n from b{k} group by 1, 2, 3)) where upto >= {quality.SHARE} * total group by 1, 2)",
            f"e{k + 1} as (select *, {cholesky} from (select unit, start, {moments} from b{k} join c{k} using (unit, start) where bin <= last group by unit, start))",
        ]
    parts.append(f"es as (select * from e{quality.STEPS} qualify row_number() over (partition by unit order by {quality.DETERMINANT}, start) = 1)")
    final = f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2 <= {quality.CUT}, true) as kept from (select ro.*, {distance} from ro left join es using (unit))"
    return "with " + ",\n".join(parts) + "\n" + final
