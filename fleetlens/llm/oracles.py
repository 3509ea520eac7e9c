"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from fleetlens.llm.mixing import LEVELS, WEIGHTS

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
BLANKS = r"'[\x20\x09-\x0D]+'"

OP2 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
x as (select *, {WORDS} as ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, array_to_string(ws[i:i + 4], chr(1)) as w from x, unnest(range(1, len(ws) - 3)) as u(i)),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from (select *, count(*) over (partition by r, w) as k from win) q where k > 1) z group by r),
l as (select r, host, line, lower(trim(regexp_replace(line, {BLANKS}, ' ', 'g'))) as norm from (select r, host, unnest(lines) as line from x) q),
lim as (select host, greatest(8.0::double, count(*) * 0.1::double) as most from x group by host),
com as (select l.host, norm from l join lim using (host) group by l.host, norm, most having count(distinct r) > most),
gone as (select r, count(*) as n, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as words from l join com on com.host = l.host and com.norm = l.norm group by r),
f as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed_lines, coalesce(gone.words, 0)::bigint as n_removed_words
      from x left join rep using (r) left join gone using (r))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_removed_words >= 10 and 2 * n_removed_words <= n_words as kept
from f"""


def _weight(level: str) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.get(level, {}).items())
    return f"case {level} {cases} else 1 end" if cases else "1"


def _level(depth: int) -> str:
    """One level of water-filling: node grants given{depth + 1} from given{depth}."""
    names, parents = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
    part, level = parents or "1", LEVELS[depth]
    join = f"join given{depth} using ({parents})" if parents else "cross join given0"
    return f"""
n{depth} as (select n.*, given from (select {names}, sum(supply) * 2 as cap, {_weight(level)} as w from leaf group by {names}) n {join}),
a{depth} as (select *, coalesce(sum(cap) over (partition by {part} order by cap::double / w, {level} rows between unbounded preceding and 1 preceding), 0) as b,
    sum(w) over (partition by {part} order by cap::double / w, {level} rows between current row and unbounded following) as rest from n{depth}),
b{depth} as (select *, min(case when cap * rest <= (given - b) * w then 1 else 0 end) over (partition by {part} order by cap::double / w, {level}) as filled from a{depth}),
c{depth} as (select *, given - sum(case when filled = 1 then cap else 0 end) over (partition by {part}) as more, sum(case when filled = 1 then 0 else w end) over (partition by {part}) as allw,
    sum(case when filled = 1 then 0 else w end) over (partition by {part} order by cap::double / w, {level}) as upto from b{depth}),
given{depth + 1} as (select {names}, case when filled = 1 then cap else (more * upto) // allw - (more * (upto - w)) // allw end as given from c{depth})"""


OP1 = f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, len({WORDS.replace("text", "coalesce(text, '')")})::bigint as n_tokens,
    case when regexp_matches(coalesce(source, ''), '^src[0-9]{{1,9}}$') then 'd' || (substr(source, 4)::bigint % 4)::varchar else 'other' end as domain from documents),
leaf as (select domain, lang, source, sum(n_tokens) as supply from d group by all),
given0 as (select least(sum(supply) * 2, sum(supply) * 3 // 4) as given from leaf),{",".join(_level(k) for k in range(3))},
plan as (select domain, lang, source, given // greatest(supply, 1) as epochs, given - given // greatest(supply, 1) * supply as rest from leaf join given3 using (domain, lang, source)),
o as (select d.*, epochs, rest, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5(concat_ws(':', '17', epochs::bigint::varchar, doc_id::varchar)), doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before
      from d join plan using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens, epochs::bigint as epochs, greatest(0, least(n_tokens, rest - before))::bigint as last_tokens, (epochs * n_tokens + greatest(0, least(n_tokens, rest - before)))::bigint as taken from o"""

_CHECK = "(v % 2147483629 * 1103515245 % 268435399)"


def _sketch(name: str, source: str) -> str:
    return f"""
{name}_p as (select doc_id, v, unnest(range(3)) as t from {source}),
{name}_c as (select doc_id, (v >> (20 * t)::int & 1048575) % 8 + t * 8 as cell, count(*) as n, bit_xor(v) as k, bit_xor({_CHECK}) as h from {name}_p group by all),
{name} as (select d.doc_id, string_agg(coalesce(n, 0)::varchar || ':' || coalesce(k, 0)::varchar || ':' || coalesce(h, 0)::varchar, ';' order by g.cell) as fp
           from d cross join (select unnest(range(24)) as cell) g left join {name}_c using (doc_id, cell) group by d.doc_id)"""


def _digests(name: str, text: str, table: str) -> str:
    return f"{name} as (select distinct doc_id, ('0x' || substr(md5(p), 1, 15))::bigint as v from (select doc_id, unnest(string_split({text}, chr(10))) as p from {table}) q)"


OP9 = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
o as (select *, lead(doc_id) over (order by doc_id desc) as nx, first_value(doc_id) over (order by doc_id desc) as f from d),
e as (select o.doc_id, o.text, coalesce(nx, f) as nx, length(o.text)::bigint as n_chars, substr(o.text, 1, length(o.text) - length(o.text) // 2) || substr(n.text, 1, length(o.text) // 2) as edited from o join d n on n.doc_id = coalesce(nx, f)),
{_digests("da", "text", "e")},
{_digests("db", "edited", "e")},
dc as (select e.doc_id, da.v from e join da on da.doc_id = e.nx),{_sketch("fa", "da")},{_sketch("fb", "db")},
na as (select doc_id, count(*) as n from da group by doc_id), nb as (select doc_id, count(*) as n from db group by doc_id), nc as (select doc_id, count(*) as n from dc group by doc_id),
ib as (select da.doc_id, count(db.v) as n from da left join db on db.doc_id = da.doc_id and db.v = da.v group by da.doc_id),
ic as (select da.doc_id, count(dc.v) as n from da left join dc on dc.doc_id = da.doc_id and dc.v = da.v group by da.doc_id),
rm as (select doc_id, string_agg(v::varchar, ',' order by v) as l from da anti join db using (doc_id, v) group by doc_id), ad as (select doc_id, string_agg(v::varchar, ',' order by v) as l from db anti join da using (doc_id, v) group by doc_id)
select e.doc_id, n_chars, sha256(edited) as edited_sha256, fa.fp as fingerprint, fb.fp as edited_fingerprint, na.n as n_paragraphs, coalesce(rm.l, '') as removed, coalesce(ad.l, '') as added,
       (2 * ib.n)::double / (2 * (na.n + nb.n - ib.n))::double as near_edited, (2 * ic.n)::double / (2 * (na.n + nc.n - ic.n))::double as near_next
from e join fa using (doc_id) join fb using (doc_id) join na using (doc_id) join nb using (doc_id) join nc using (doc_id) join ib using (doc_id) join ic using (doc_id) left join rm using (doc_id) left join ad using (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
with i as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item, least(len(w), 10) as size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as words from i, unnest(range(1, len(w) - least(len(w), 10) + 2)) as u(k) where len(w) > 0),
d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
place as (select r, k, size, array_to_string(w[k:k + size - 1], ' ') as words from d, (select distinct size from win) z, unnest(range(1, len(w) - size + 2)) as u(k)),
hit as (select r, k, size, item from place join win using (size, words)),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + size)) as p from hit) q group by r),
x as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit where item is not null) q group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join x using (r)"""

OP12 = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWER} as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*)::hugeint as m from t group by lang, term having count(distinct r) >= 30),
l as (select lang, count(*)::hugeint as v, sum(m)::hugeint as lang_total from k group by lang),
c as (select lang, source, term, count(*)::hugeint as n from t join k using (lang, term) group by all),
s as (select lang, source, sum(n)::hugeint as total from c group by all),
g as (select lang, source, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total, coalesce(total, 0) as total from (select distinct lang, source from d) q left join l using (lang) left join s using (lang, source)),
p as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v) as p, 1 + (1000000000::hugeint * (m + 5)) // (lang_total + 5 * v) as q
      from g join k using (lang) left join c using (lang, source, term)),
pair as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
         left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
term as (select lang, source, term as item, (p - q)::bigint as value, row_number() over (partition by lang, source order by p - q desc, term) as rank from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
union all select lang, source, 'term', item, value, rank::int from term where rank <= 50"""

ORACLE: dict[str, str] = {"op1_mixing": OP1, "op2_quality_rules": OP2, "op9_fingerprints": OP9, "op11_decontamination": OP11, "op12_source_divergence": OP12}
