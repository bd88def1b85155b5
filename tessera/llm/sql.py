"""The quality rules and the Merkle manifest in DuckDB's SQL."""

from __future__ import annotations

from .quality_rules import ALPHA, DELTA, PARTS, RULES

#: crc32 of the decimal doc_id, bit by bit.
CRC = (
    "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(n: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n, "text"))) + ")"


def _tree(name: str, base: str) -> str:
    """All levels of the trees of base (g, nodes)."""
    above = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    return f"{name}(g, lvl, nodes) as (select g, 0, nodes from ({base}) union all select g, lvl + 1, {above} from {name} where len(nodes) > 1)"


_STEP = "case when nodes[(xor(pos >> lvl, 1)) + 1] is null then '' when (pos >> lvl) % 2 = 1 then 'L' || nodes[pos >> lvl] else 'R' || nodes[(pos >> lvl) + 2] end"
_FOLD = "list_reduce(list_concat([coalesce(tampered, leaf)], p), lambda h, s: case when s = '' then sha256(h) when s[1] = 'L' then sha256(s[2:] || h) else sha256(h || s[2:]) end)"
_MERKLE = f"""with recursive h as (select doc_id, lang, {_leaf('n_chars')} leaf, case when n_chars is not null and {CRC} % 7 = 0 then {_leaf('(n_chars::hugeint + 1)')} end tampered from documents),
d as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos from h),
{_tree('t', 'select lang g, list(leaf order by pos) nodes from d group by all')},
s as (select g lang, lvl depth, nodes[1] subroot, row_number() over (order by g nulls first) - 1 place from t where len(nodes) = 1),
{_tree('u', 'select 0 g, list(subroot order by place) nodes from s')},
lower as (select d.doc_id, d.leaf, d.pos, d.tampered, d.lang, coalesce(list({_STEP} order by lvl) filter (where len(nodes) > 1), []) p from d join t on d.lang is not distinct from t.g group by all),
upper as (select lang, subroot, (select nodes[1] from u where len(nodes) = 1) root, coalesce(list({_STEP} order by lvl) filter (where len(nodes) > 1), []) p from (select *, place pos from s), u group by all),
e as (select doc_id, leaf, tampered, subroot, root, list_concat(lower.p, upper.p) p from lower join upper on lower.lang is not distinct from upper.lang),
f as (select *, {_FOLD} folded_root from e)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x[2:]), '')) proof_sha256, folded_root, folded_root = root verified from f"""

_WORD = r"[^\x20\x09-\x0D]"
_CUTOFFS = ", ".join(f"({r}, {i}, {c}::double)" for r, rule in enumerate(RULES) for i, c in enumerate(rule.cutoffs))
_SCORES = ", ".join(f"({r.score})::double" for r in RULES)
_A = ALPHA / len(RULES)
_TAIL = f"case when n = 0 or k >= {_A} * n then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_A}) + (n - j) * ln(1 - {_A})))) end"
_RULES = rf"""with w as (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') w from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
again as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct i + o) n from again, (values (0), (1), (2)) o(o) group by all),
lines as (select doc_id, lang, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) l from w),
m as (select doc_id, lang, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
 (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, len(l)::bigint n_lines,
 len(regexp_extract_all(t, '[A-Z]'))::bigint n_capitals, len(regexp_extract_all(t, '[!?]'))::bigint n_marks from lines left join rep using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, [{_SCORES}] scores from m),
y as (select doc_id, max(quality) y from labels where quality in (0, 1) group by all),
c(rule, i, cutoff) as (values {_CUTOFFS}),
x as (select lang, y, {CRC} % {PARTS} = 0 learns, scores from f join y using (doc_id) where not base_failed),
tried as (select lang, rule, i, cutoff, sum((y = 1 and not learns)::int)::bigint n, sum((y = 1 and not learns and coalesce(scores[rule + 1] > cutoff, false))::int)::bigint k,
 sum(case when learns and coalesce(scores[rule + 1] > cutoff, false) then 1 - 2 * y else 0 end)::bigint gain from x, c group by all),
chains as (select count(distinct (lang, rule)) chains from tried where n > 0),
tails as (select *, {_TAIL} tail from tried where n > 0),
cert as (select lang, rule, cutoff, gain, i, coalesce(max((tail > {DELTA} / chains)::int) over (partition by lang, rule order by i), 0) failed from tails, chains),
best as (select lang, rule, arg_max(cutoff, gain * 1000 - i) cutoff from cert where failed = 0 and gain > 0 group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not exists (select 1 from best b where b.lang is not distinct from f.lang and f.scores[b.rule + 1] > b.cutoff) kept from f"""

SQL = {"op11_quality_rules": _RULES, "op13_merkle_manifest": _MERKLE}
