"""DuckDB SQL for the queries that SQL can express, over the same tables."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
n as (select item_id, w, least(10, len(w)) as k from b where len(w) > 0),
windows as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from n)),
sizes as (select distinct k from windows),
places as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)),
found as (select doc_id, item_id, i, k from places join windows using (k, s)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
b3 as (select b, j, array_to_string(w[j : j + 2], ' ') as s from (select row_number() over () as b, w, unnest(range(1, len(w) - 1)) as j from b where len(w) > 2)),
d3 as (select doc_id, i, array_to_string(w[i : i + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
m as (select doc_id, b, i - j as diagonal, i from d3 join b3 using (s)),
r as (select *, i - row_number() over (partition by doc_id, b, diagonal order by i) as run from m),
runs as (select doc_id, count(*) + 2 as n, min(i) - 1 as start from r group by doc_id, b, diagonal, run),
best as (select doc_id, max(n) as n, arg_min(start, (-n, start)) as start from runs group by doc_id),
names as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(best.n, 0)::bigint as longest_match, best.start::bigint as longest_start
from d left join hits using (doc_id) left join names using (doc_id) left join best using (doc_id)
"""

def _op1() -> str:
    from panelyard.llm.licences import TEMPLATES, places_needed

    rows = ", ".join(f"({k}, '{label}', '{text}', {a}, {b}, {str(base).lower()}, {', '.join(map(str, places_needed(len(text.split()))))})" for k, (label, text, a, b, base) in enumerate(TEMPLATES))
    return rf"""
with d as (select doc_id, {_WORDS} as w from documents),
t as (select k, label, string_split(text, ' ') as tw, a, b, base, n, need from (values {rows}) v(k, label, text, a, b, base, n, need)),
tp as (select k, unnest(range(0, len(tw))) as p, unnest(tw) as word, n from t),
df as (select word, count(distinct doc_id) as c from (select doc_id, unnest(list_distinct(w)) as word from d) where word in (select word from tp) group by word),
posted as (select k, p, word from tp left join df using (word) qualify row_number() over (partition by k order by coalesce(c, 0), word, p) <= n),
spots as (select doc_id, unnest(range(0, len(w))) as i, unnest(w) as word from d),
found as (select doc_id, k, i - p as start from spots join posted using (word) join t using (k) group by doc_id, k, start, need having count(*) >= need),
places as (
    select doc_id, label, base, start, list_sum(list_transform(range(0, len(tw)), lambda p: if(start + p >= 0 and w[start + p + 1] = tw[p + 1], 1, 0))) / len(tw) as share,
           start + a >= 0 and w[start + a + 1 : start + b] = tw[a + 1 : b] as ok
    from found join d using (doc_id) join t using (k)),
g as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
      string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) filter (ok) as labels, max(share) as score
      from places group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join g using (doc_id)
"""


OP1 = _op1()

_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The patterns of the secret scan in RE2, letters spelled out in either case; the value, where it is not the whole match, is
#: what a group holds that is put in for the braces.
_ASSIGN = f"""(?:{_KEYWORDS})["'']?\\x20*[:=]\\x20*["'']?{{}}"""
_VALUE = "[A-Za-z0-9+/_.=-]+"


def _op4() -> str:
    from panelyard.llm.secrets import _PLAIN_WORDS, COPIED_OWNERS, KINDS, LEAST_DISTINCT, LIVE_CHARACTERS, MOST_DISTINCT, RUN

    parts = []
    for k, (name, pattern, _, _, least) in enumerate(KINDS):
        plain, grouped = (_ASSIGN.format(_VALUE), _ASSIGN.format(f"({_VALUE})")) if name == "assign" else (pattern, f"({pattern})")
        found = f"regexp_extract_all(text, '{plain}') as m, regexp_extract_all(text, '{grouped}', 1) as v, string_split_regex(text, '{plain}') as gaps"
        parts.append(f"select row_id, {k} as k, '{name}' as kind, {least} as least, {found} from d")
    places = " union all ".join(parts)
    steps = lambda by: f"len(list_filter(d, lambda x: x in (0, {by}))) >= {RUN} * len(d)"
    plain = "[" + ", ".join(f"'{w}'" for w in sorted(_PLAIN_WORDS)) + "]"
    return rf"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, coalesce(source, '') || '/' || coalesce(lang, '') as repository from documents),
p as ({places}),
u as (select row_id, k, kind, least, unnest(range(0, len(m))) as i, m, v, gaps from p where len(m) > 0),
s as (select row_id, k, kind, v[i + 1] as value, m[i + 1] as whole, least,
      (list_sum(list_transform(gaps[1 : i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i], lambda x: length(x))), 0))::bigint as a from u),
f as (select *, a + length(whole) as b from s where length(value) >= least),
n as (select row_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
      string_agg(kind || ':' || a || ':' || b, ',' order by a, k) filter (k < 3) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, k) as spans from f group by row_id),
e as (select distinct row_id, value, b - length(value) as at from f),
o as (select value, count(distinct owner) as owners from e join d using (row_id) group by value),
v as (select value, lower(value) as low, string_split(lower(value), '') as ch, list_transform(regexp_extract_all(regexp_replace(value, '([A-Z][a-z])', ' \1', 'g'), '[A-Z]?[a-z]+|[A-Z]+'), lambda x: lower(x)) as words, owners from o),
steps as (select *, list_transform(range(1, len(ch)), lambda i: ascii(ch[i + 1]) - ascii(ch[i])) as d from v),
judged as (select value, owners, case when starts_with(value, '-----BEGIN ') then len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS}
      else not (len(list_distinct(ch)) < least({MOST_DISTINCT}, {LEAST_DISTINCT} * len(ch)) or {steps(1)} or {steps(-1)} or instr(substr(low || low, 2), low) < len(ch)
      or (len(words) > 0 and (list_contains({plain}, trim(low, '._-=/+')) or list_has_all({plain}, words)) and len(regexp_replace(low, '[^0-9]', '', 'g')) <= 4)) end as live from steps),
c as (select row_id, count(*) filter (owners >= {COPIED_OWNERS}) as n_copied, count(*) filter (owners < {COPIED_OWNERS} and live) as n_live, max(owners) as max_owners
      from e join judged using (value) group by row_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_copied, 0)::bigint as n_copied, coalesce(n_live, 0)::bigint as n_live, coalesce(max_owners, 0)::bigint as max_owners
from d left join n using (row_id) left join c using (row_id)
"""


OP4 = _op4()

OP5 = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
      length('<|turn|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\|turn\|>|\|end\|>|s>|/s>|INST\]|/INST\])')) + length('<|end|>') + 1 as chars from c),
p as (select *, sum(chars) over (partition by conv_id order by k) as upto, sum(chars) over (partition by conv_id) as whole from n)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       (coalesce(sum(upto) filter (role = 'assistant'), 0) + max(whole) - coalesce(max(upto) filter (role = 'assistant'), 0))::bigint as formatted_chars,
       count(*) filter (role = 'assistant') as n_examples
from p group by conv_id
"""

#: Sums are doubles here, so scores agree with the operator's up to 2**53 and are clipped as there.
OP7 = """
with w as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: 256.0 * x::double) as w from embeddings where vec_id is not null and embedding is not null),
v as (select r, vec_id, list_transform(w, lambda x: floor(x)) as v from w where len(list_filter(w, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, greatest(least(list_inner_product(q.v, c.v), 9223372036854774784.0), -9223372036854774784.0)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.r <> q.r)
select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 5
"""

_BLANKS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
OP10 = rf"""
with recursive d as (select doc_id, {_BLANKS} as w from documents),
s as (select distinct doc_id, unnest(if(len(w) >= 5, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')), if(len(w) > 0, [array_to_string(w, ' ')], []))) as g from d),
h as (select doc_id, hash(g) as g from s),
n as (select doc_id, count(*) as n from h group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from h a join h b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edge as (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from edge union select reach.a, edge.b from reach join edge on reach.b = edge.a),
least as (select a, min(b) as m from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, doc_id = least(doc_id, coalesce(m, doc_id)) as kept
from d left join n using (doc_id) left join least on a = doc_id
"""


def _op12(levels: int = 12) -> str:
    """Both trees level by level, each up to 3**levels nodes: a run's digests as a list, their node, and every leaf's way up."""
    crc, table = 4294967295, []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ 0xEDB88320 * (b & 1)
        table.append(b)
    value = lambda x: f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(value(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    parts = [
        rf"""crc as (select {table} as t),
d as (select coalesce('=' || source, '') as tree, doc_id, {leaf("text")} as leaf, {leaf("replace(text, chr(10), '')")} as other,
      xor({crc}, list_reduce(list_prepend({crc}::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]::bigint))) as crc from documents, crc),
a0 as (select tree, doc_id, leaf, if(crc % 2 = 0, other, leaf) as f, '' as proof, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as p from d),
s0 as (select tree, p, leaf as h, count(*) over (partition by tree) as c from a0)"""
    ]

    def rise(nodes: str, ways: str) -> tuple[str, str]:
        for k in range(levels):
            parts.append(rf"""{nodes}r{k} as (select tree, p // 3 as p, list(h order by p) as hs, c from {nodes}{k} group by tree, p // 3, c),
{nodes}{k + 1} as (select tree, p, if(c = 1, hs[1], sha256(array_to_string(hs, ''))) as h, (c + 2) // 3 as c from {nodes}r{k}),
{ways}{k + 1} as (
    select w.* replace (w.p // 3 as p, if(c = 1, f, sha256(array_to_string(hs[1 : w.p % 3], '') || f || array_to_string(hs[w.p % 3 + 2 :], ''))) as f,
           proof || if(c = 1, '', array_to_string(hs[1 : w.p % 3], '') || array_to_string(hs[w.p % 3 + 2 :], '')) as proof)
    from {ways}{k} w join {nodes}r{k} r on w.tree = r.tree and w.p // 3 = r.p)""")
        return f"{nodes}{levels}", f"{ways}{levels}"

    subroots, ways = rise("s", "a")
    parts.append(rf"""n as (select tree as name, h, row_number() over (order by tree) - 1 as p from {subroots}),
t0 as (select '' as tree, p, h, count(*) over () as c from n),
b0 as (select '' as tree, doc_id, leaf, f, proof, n.p, n.h as subroot from {ways} w join n on w.tree = n.name)""")
    roots, ways = rise("t", "b")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from {ways} w, {roots} r"


OP12 = _op12()

OP13 = rf"""
with d as (select coalesce(lang, 'und') as lang, {_LOW} as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as s from d),
w as (select lang, regexp_extract_all(s, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest(range(1, 6)) as k))),
f as (select lang, k, phrase, count(*) as a from g group by lang, k, phrase having count(*) >= 100),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select c.*, j, array_to_string(w[1 : j], ' ') as x, array_to_string(w[j + 1 :], ' ') as y from (select c.*, unnest(range(1, k)) as j from c) c),
s as (select cuts.lang, cuts.phrase, cuts.a, j, l.a as l, r.a as r, n, (1000::hugeint * cuts.a * n // (l.a::hugeint * r.a))::bigint as score
      from cuts join n using (lang) join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select distinct lang, a, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 :], ' ')]) as phrase from c where k > 2)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best anti join inside using (lang, a, phrase)
qualify rank <= 2000
"""
