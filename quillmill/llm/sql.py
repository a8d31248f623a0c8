"""SQL of the queries that SQL can state over whole tables: plain, quadratic, for checking."""

from __future__ import annotations

#: Distinct records and their scene and question.
_TASKS = r"""t as (select distinct task_no, split, list_filter(sft_messages, lambda m: m.role = 'user')[-1].content as su,
  list_filter(teacher_messages, lambda m: m.role = 'user')[-1].content as tu, metadata.source_row.content as c from sft_task)"""
_SCENE = r"regexp_extract({u}, '(?s)(?:^|\n)(?:#+ *Context|Context:|Scene:)\s*(.*?)\s*\n(?:#+ *Question|Question:|Q:)', 1)"
_QUESTION = r"regexp_extract({u}, '(?s)\n(?:#+ *Question|Question:|Q:)\s*(.*?)\s*(?:\n\n|\n#+ *Instructions|$)', 1)"
_WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"

_SHINGLES = """w as (select no, side, {words} as w from x where {text} is not null),
s as (select distinct no, side, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i:i+2])) as g from w where len(w) > 2),
n as (select no, side, count(*) as n from s group by all)"""

_P2 = (
    f"with {_TASKS}, x as (select task_no as no, case when split = 'train' then 't' else 'e' end as side, {_SCENE.format(u='su')} || ' ' || {_QUESTION.format(u='su')} as text from t where split in ('train', 'val', 'test')), "
    + _SHINGLES.format(words=_WORDS.format(x="text"), text="text")
    + """, p as (select a.no as a, b.no as b, count(*) as k from s a join s b on a.g = b.g and a.side = 't' and b.side = 'e' group by 1, 2),
q as (select a, b from p join n na on na.no = a join n nb on nb.no = b where k * 2 >= na.n + nb.n - k)"""
)
P2 = _P2 + " select least(a, b) as task_no_a, greatest(a, b) as task_no_b from q"
P2_OVERLAP = (
    _P2
    + r""", k as (select task_no, min(split) as split, min(regexp_replace(replace(lower(trim(source_dataset)), '-', '_'), '\.jsonl$', '')) as source_dataset from sft_task where split in ('val', 'test') group by 1),
f as (select b as task_no, count(*) as pairs from q group by 1)
select split, source_dataset, count(*) as records, count(pairs) as overlapping, coalesce(sum(pairs), 0)::bigint as pairs from k left join f using (task_no) group by 1, 2"""
)
P2_COVERAGE = (
    _P2
    + """, r as (select distinct no, side, i, w[i:i+2] as g from (select no, side, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
c as (select a, b, count(distinct p) as covered from (select q.a, q.b, unnest([r.i, r.i + 1, r.i + 2]) as p from q join r on r.no = q.b and r.side = 'e' join s on s.no = q.a and s.side = 't' and s.g = r.g) group by 1, 2)
select b as task_no, count(*) as pairs, max(covered) as covered from c group by 1"""
)

P5 = (
    f"with recursive {_TASKS}, x as (select task_no as no, '' as side, coalesce({_SCENE.format(u='tu')}, c) as text from t), "
    + _SHINGLES.format(words=_WORDS.format(x="text"), text="text")
    + """, p as (select a.no as a, b.no as b, count(*) as k from s a join s b on a.g = b.g and a.no <> b.no group by 1, 2),
e as (select a, b from p join n na on na.no = a join n nb on nb.no = b where k * 2 >= na.n + nb.n - k),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
select a as task_no, least(a, min(b)) as group_no from r group by a"""
)
P5_SIZES = f"select tasks, count(*) as groups from (select count(*) as tasks from ({P5}) group by group_no) group by 1"

P8 = f"""with d as (select doc_id, {_WORDS.format(x='text')} as w from documents where text is not null),
i as (select item_id, {_WORDS.format(x='passage')} as w from bench_item where passage is not null),
gi as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: w[k:k+11])) as g from i where len(w) >= 12),
gd as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: w[k:k+11])) as g from d where len(w) >= 12)
select distinct doc_id, item_id from gd join gi using (g)"""

_DS = r"regexp_replace(replace(lower(trim(source_dataset)), '-', '_'), '\.jsonl$', '')"
_DOMAIN = r"nullif(array_to_string(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: regexp_full_match(w, '\p{{L}}+')), ' '), '')"

P6 = f"""with recursive seed as (select seed_no, {_DS} as ds, id, {_DOMAIN.format(x='domain_text')} as dom from domain_seed),
k as (select distinct task_no, {_DS} as ds, metadata.source_row.domain_index as id, {_DOMAIN.format(x='metadata.source_row.domain_seed')} as own,
  nullif(trim(regexp_replace(lower(metadata.source_row.content), '\\s+', ' ', 'g')), '') as pas from sft_task where metadata.source_row is not null),
m as (select ds, id, min(dom) as dom from seed group by 1, 2),
t as (select task_no, coalesce(m.dom, own) as dom, pas from k left join m using (ds, id)),
pd as (select distinct pas, dom from t where pas is not null and dom is not null),
e as (select distinct a.dom as a, b.dom as b from pd a join pd b using (pas)),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
dd as (select dom as a, dom as b from t where dom is not null union select a, b from r),
g as (select a as dom, min(seed_no) as group_no from dd join seed on seed.dom = dd.b group by 1),
q as (select task_no, coalesce(t.dom, pd.dom) as dom from t left join (select pas, min(dom) as dom from pd group by 1) pd using (pas))
select task_no, min(group_no) as group_no from q join g using (dom) group by 1"""


def _minus(c: str) -> str:
    return f"(length(text) - length(replace(text, {c}, '')))"


_ENCODINGS = {
    "chars": "length(text)",
    "utf8": "strlen(text)",
    "utf16": r"length(text) + length(regexp_replace(text, '[\x{0}-\x{ffff}]', '', 'g'))",
    "entities": "length(text) + 4 * {} + 3 * ({} + {}) + 5 * ({} + {})".format(*[_minus(f"chr({n})") for n in (38, 60, 62, 34, 39)]),
    "json": "length(text) + {} + {} + {} + {} + {}".format(*[_minus(f"chr({n})") for n in (34, 10, 92, 9, 13)]),
    "crlf": f"length(text) + {_minus('chr(10)')}",
}

P3_LIMITS = f"""with x as (select backend as source, raw_output as text from audit_result where raw_output <> '' union all select backend, raw_output from judge_result where raw_output <> ''),
m as ({' union all '.join(f"select source, '{k}' as encoding, ({v})::int as length from x" for k, v in _ENCODINGS.items())}),
c as (select source, encoding, length, count(*) as n from m group by all),
e as (select *, (sum(n) over (partition by source, encoding order by length range between 20 preceding and 20 following) - n) / 40.0::double as expected from c)
select source, encoding, length, n, expected from e where n > expected + 6.0 * sqrt(expected) + 6"""
