"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from meshwright.llm.quality_rules import Rules

SPACE = r"\x20\x09-\x0D"


def repetition_coverage(rules: Rules) -> str:
    """The figures and the verdict of the repetition rules."""
    lengths = sorted({3, *rules.lengths})
    grams = "\n".join(
        f""", k{n} as (select r, i, chars, string_agg(word, ' ') over (partition by r order by i rows between current row and {n - 1} following) as gram, lead(i, {n - 1}) over (partition by r order by i) is not null as whole from w),
g{n} as (select r, i, chars, whole and count(*) filter (whole) over (partition by r, gram) > 1 as twice from k{n}),
c{n} as (select r, chars, coalesce(bool_or(twice) over (partition by r order by i rows between {n - 1} preceding and current row), false) as inside from g{n}),
s{n} as (select r, sum(chars * inside::int)::bigint as chars, sum(inside::int)::bigint as words from c{n} group by 1)"""
        for n in lengths
    )
    joins = " ".join(f"left join s{n} on d.r = s{n}.r" for n in lengths)
    shares = ", ".join(f"coalesce(s{n}.chars, 0) / greatest(word_chars, 1)::double as coverage_{n}" for n in rules.lengths)
    over = " and ".join([f"line_coverage <= {rules.line_coverage}", *(f"coverage_{n} <= {most}" for n, most in rules.coverage)])
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') as ws from documents),
w as (select *, length(word) as chars from (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from d)),
t as (select r, sum(chars)::bigint as chars from w group by 1)
{grams},
lines as (select r, line, k, length(regexp_replace(line, '[{SPACE}]+', '', 'g')) as chars from (select r, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from d)),
later as (select r, chars, row_number() over (partition by r, line order by k) > 1 as again from lines where chars > 0),
l as (select r, sum(again::int)::bigint as n, sum(chars * again::int)::bigint as chars from later group by 1),
f as (select doc_id, len(ws)::bigint as n_words, coalesce(t.chars, 0) as word_chars,
  length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, d.r from d left join t on d.r = t.r),
m as (select d.doc_id, n_words, word_chars, n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(s3.words, 0) as n_repeat_words,
  coalesce(l.chars, 0) / greatest(word_chars, 1)::double as line_coverage, {shares}
  from f d left join l on d.r = l.r {joins})
select *, (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_words_percent} * n_words) as base_failed,
  not (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_words_percent} * n_words) and {over} as kept from m"""


VECTOR_LINKS = """
with recursive l as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id != b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.93),
n as (select a, count(*) as n from l group by 1),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, l.b from reach join l on reach.b = l.a)
select reach.a as vec_id, coalesce(max(n), 0)::bigint as n_links, min(b) as component_id, min(b) = reach.a as kept from reach left join n on reach.a = n.a group by reach.a"""
