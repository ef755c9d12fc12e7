"""SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from . import divergence, jaccard, license_scan, merkle, repeats, sharding, topk, url_filter

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sharding_sql() -> str:
    table = ",".join(map(str, sharding.lookup_table()))
    slot = f"(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS})"
    return f"select doc_id, {slot} as slot, ([{table}])[{slot} + 1]::int as shard from documents"


def top_k_sql() -> str:
    return f"""
with whole as (
    select vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), part as (
    select row_number() over () as n, vec_id, v from whole
), cell as (
    select n, vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from part
), asked as (
    select vec_id, min(v) as v from part where vec_id % {topk.EVERY} = 0 group by vec_id
), scored as (
    select q.vec_id as query_id, c.n, c.vec_id, sum(q.x * c.x)::bigint as score
    from (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from asked) q join cell c on c.d = q.d and c.vec_id <> q.vec_id group by all
), ranked as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored
)
select * from ranked where rank <= {topk.K}"""


def jaccard_sql(size: int = jaccard.SHINGLE, percent: int = jaccard.PERCENT) -> str:
    return f"""
with recursive word as (
    select row_number() over () as n, doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents
), shingled as (
    select n, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {size} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) end) as s from word
), sized as materialized (
    select n, doc_id, len(s)::bigint as k, s from shingled
), one as materialized (
    select n, k, unnest(s) as g from sized
), near as materialized (
    select a.n as a, b.n as b from one a join one b on a.g = b.g and a.n <> b.n
    where least(a.k, b.k) * 100 >= greatest(a.k, b.k) * {percent}
    group by a.n, b.n, a.k, b.k having 100 * count(*) >= {percent} * (a.k + b.k - count(*))
), met as (
    select n, n as root from sized union select near.b, met.root from met join near on near.a = met.n
)
select s.doc_id, s.k as n_shingles, min(r.doc_id) as component_id
from sized s join met on met.n = s.n join sized r on r.n = met.root group by s.n, s.doc_id, s.k"""


def repeats_sql(length: int = repeats.LENGTH) -> str:
    return f"""
with raw as materialized (
    select row_number() over () as n, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), start as (
    select n, h, unnest(range(0, length(h) // 2 - {length - 1})) as i from raw where length(h) >= {2 * length}
), hashed as materialized (
    select n, i, md5_number(substr(h, 2 * i + 1, {2 * length})) as m from start
), several as (
    select m from hashed group by m having count(*) > 1
), hit as (
    select n, i, lag(i) over (partition by n order by i) as p from hashed where m in (select m from several)
), run as (
    select n, i, sum(case when p is null or i > p + {length} then 1 else 0 end) over (partition by n order by i) as r from hit
), span as (
    select n, r, min(i) as a, max(i) + {length} as b from run group by n, r
), gap as (
    select n, a, b, coalesce(lag(b) over (partition by n order by a), 0) as f from span
), cut as (
    select g.n, sum(b - a)::bigint as gone, count(*)::bigint as spans, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept
    from gap g join raw using (n) group by g.n
)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from raw left join cut using (n)"""


def license_sql() -> str:
    templates = license_scan.BASE + license_scan.NOTICES
    words = ", ".join(f"({t}, {p}, {_quoted(w)})" for t, x in enumerate(templates) for p, w in enumerate(x.words))
    kinds = ", ".join(f"({t}, {_quoted(x.label)}, {str(x.base).lower()})" for t, x in enumerate(templates))
    phrases = ", ".join(f"({t}, {a}, {b}, [{', '.join(map(_quoted, x.words[a:b]))}])" for t, x in enumerate(templates) for a, b in x.phrases)
    return f"""
with tw(t, p, word) as (values {words}), kind(t, label, base) as (values {kinds}), phrase(t, a, b, w) as (values {phrases}),
doc as materialized (
    select row_number() over () as n, doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), place as (
    select n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from doc
), known as materialized (
    select * from place where word in (select word from tw)
), spread as (
    select word, count(distinct n) as files from known group by word
), rare as (
    select t, word from (select t, word, row_number() over (partition by t order by coalesce(files, 0), word) as k from (select distinct t, word from tw) left join spread using (word)) where k <= {license_scan.RARE}
), posting as (
    select t, p, word from tw join rare using (t, word)
), whole as (
    select t, label, base, count(*) as total from posting join kind using (t) group by all
), found as (
    select n, t, i - p as s, count(*) as agreed from known join posting using (word) group by all
), verified as materialized (
    select f.n, f.t, f.s, label, base, agreed / total as share
    from found f join whole using (t) join doc using (n) join phrase h using (t)
    where f.s >= 0 and agreed >= case when base then total else ceil({license_scan.AGREE} * total) end
    group by f.n, f.t, f.s, label, base, agreed, total having bool_and(doc.w[f.s + h.a + 1:f.s + h.b] = h.w)
), summed as (
    select n, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word, count(*) filter (not base) as n_notices, max(share) as score,
        string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels from verified group by n
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels,
    coalesce(labels, '') as labels, coalesce(score, 0)::double as score, coalesce(n_notices, 0)::bigint as n_notices
from doc left join summed using (n)"""


def url_filter_sql() -> str:
    u = url_filter
    rest = "(case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end)"
    split = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{u.UPPER}', '{u.LOWER}') as host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) as path"

    def grams(text: str, by: tuple[int, ...]) -> str:
        hashed = " + ".join(f"unicode(c[i + {k}])::bigint * {m}" for k, m in enumerate(by))
        cut = f"string_split('^' || {text} || '$', '')"
        return f"flatten(list_transform([{cut}], lambda c: case when len(c) < {u.N} then [0] else list_transform(range(1, len(c) - {u.N} + 2), lambda i: (1 + ({hashed}) % {u.BUCKETS - 1})::int) end))"

    buckets = f"list_distinct(list_concat([0], list_concat({grams('host', u.HOST)}, {grams('path', u.PATH)})))"
    chance = lambda total: f"floor({u.ONE}::double / (1.0::double + exp(-({total})::double / {u.ONE}::double)))::bigint"
    listed = ", ".join(f"({_quoted(url)}, {y})" for y, urls in ((1, u.BLOCKED), (0, u.ALLOWED)) for url in urls)
    ruled = sorted(u.RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = {_quoted(r.host)} or ends_with(host, {_quoted('.' + r.host)})) and starts_with(path, {_quoted(r.path)})"
    pick = lambda field: "case " + " ".join(f"when {fits(r)} then {_quoted(getattr(r, field))}" for r in ruled) + " end"
    return f"""
with recursive given(url, y) as (values {listed}), known as materialized (
    select row_number() over () as n, y::bigint as y, {buckets} as b from (select y, {split} from given)
), entry as materialized (
    select n, unnest(b) as x from known
), used as materialized (
    select x, row_number() over (order by x) as slot, list(n order by n) as p from entry group by x
), shape as materialized (
    select (select list(y order by n) from known) as y, (select list(d order by n) from (select e.n, list(slot) as d from entry e join used using (x) group by e.n)) as b, (select list(p order by slot) from used) as p
), fold(k, w) as (
    select 0, list_transform(p, lambda v: 0::bigint) from shape
    union all
    select k + 1, list_transform(range(1, len(w) + 1), lambda v: (w[v] + (floor(list_sum(list_transform(p[v], lambda i: err[i]))::double / {u.RATE}) - floor(w[v]::double / {u.DECAY}))::bigint))
    from (select k, w, p, list_transform(range(1, len(y) + 1), lambda i: y[i] * {u.ONE} - {chance("list_sum(list_transform(b[i], lambda d: w[d]))")}) as err from fold, shape where k < {u.STEPS})
), weight as materialized (
    select x, w[slot] as w from used, (select w from fold where k = {u.STEPS})
), page as materialized (
    select row_number() over () as n, page_id, {split} from pages
), summed as (
    select n, coalesce(sum(w), 0) as z from (select n, unnest({buckets}) as x from page) left join weight using (x) group by n
)
select page_id, host, path, {pick('name')} as rule, coalesce({pick('verdict')}, case when {chance('z')} * 2 > {u.ONE} then 'block' else 'allow' end) as verdict, {chance('z')}::double / {u.ONE}::double as score
from page join summed using (n)"""


def merkle_sql() -> str:
    m, fields = merkle, ("doc_id", "source", "lang", "n_chars")
    shown = lambda v: f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')"
    head = " || ".join(map(shown, fields))
    table = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    crc = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda ch: unicode(ch)::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
    fold = f"lambda h, s: sha256(substr(s, 2, {m.HEX} * substr(s, 1, 1)::int) || h || substr(s, 2 + {m.HEX} * substr(s, 1, 1)::int))"

    def levels(name: str, first: str) -> str:
        """Every level of each tree, as lists of digests."""
        above = f"list_transform(range((len(nodes) + {m.ARITY - 1}) // {m.ARITY}), lambda k: sha256(array_to_string(nodes[{m.ARITY} * k + 1:{m.ARITY} * k + {m.ARITY}], '')))"
        return f"{name} as ({first} union all select tree, level + 1, {above} from {name} where len(nodes) > 1)"

    def steps(name: str, tree: str) -> str:
        """The steps of a node's path, from its index (from 0) in the lowest level."""
        at = f"(i // ({m.ARITY} ** level)::bigint)"
        run = f"nodes[{at} - {at} % {m.ARITY} + 1:{at} - {at} % {m.ARITY} + {m.ARITY}]"
        others = f"array_to_string(list_concat({run}[1:{at} % {m.ARITY}], {run}[{at} % {m.ARITY} + 2:]), '')"
        return f"select n, list(({at} % {m.ARITY})::varchar || {others} order by level) as steps from {name} join {tree} using (tree) where len(nodes) > 1 group by n"

    return f"""
with recursive crc_table as materialized (select {table} as t), raw as materialized (
    select row_number() over () as n, doc_id, coalesce('=' || source, '') as tree, {head} as head, text, case when doc_id is not null and {crc} % 2 = 0 then replace(text, chr(10), '') else text end as changed from documents, crc_table
), hashed as materialized (
    select n, doc_id, tree, sha256(head || {shown('text')}) as leaf, sha256(head || {shown('changed')}) as shown from raw
), leaf as materialized (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i from hashed
), {levels('low', "select tree, 0 as level, list(leaf order by i) as nodes from leaf group by tree")}, sub as materialized (
    select tree as name, nodes[1] as subroot, '' as tree, row_number() over (order by tree) - 1 as i, row_number() over (order by tree) as n from low where len(nodes) = 1
), {levels('high', "select tree, 0 as level, list(subroot order by i) as nodes from sub group by tree")}, lower_part as materialized (
    {steps('leaf', 'low')}
), upper_part as materialized (
    {steps('sub', 'high')}
), way as materialized (
    select l.doc_id, l.leaf, l.shown, s.subroot, (select nodes[1] from high where len(nodes) = 1) as root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) as steps
    from leaf l join sub s on s.name = l.tree left join lower_part a on a.n = l.n left join upper_part b on b.n = s.n
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: substr(s, 2)), '')) as proof_sha256,
    list_reduce(list_concat([shown], steps), {fold}) as folded_root, list_reduce(list_concat([shown], steps), {fold}) = root as verified
from way"""


def divergence_sql() -> str:
    d = divergence
    share = lambda n, size: f"(1 + ({d.ONE}::hugeint * ({n} + 1)) // ({size} + kinds))::hugeint"
    gap = "(((p - q) * (p - q)) // q)"
    return f"""
with raw as materialized (
    select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_FOLDED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents
), one as materialized (
    select n, lang, source, unnest(w) as term from raw
), kept as materialized (
    select lang, term, count(*) as total from one group by lang, term having count(distinct n) >= {d.LEAST_DOCS}
), groups as materialized (
    select lang, source from raw group by lang, source
), counted as materialized (
    select lang, source, term, count(*) as c from one join kept using (lang, term) group by all
), sizes as (
    select lang, source, sum(c) as size from counted group by all
), langs as materialized (
    select lang, count(*) as kinds, sum(total) as lang_size from kept group by lang
), dense as materialized (
    select g.lang, g.source, k.term, coalesce(c.c, 0) as c, {share("coalesce(c.c, 0)", "coalesce(s.size, 0)")} as p, {share("k.total", "lang_size")} as q
    from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term left join sizes s on s.lang = g.lang and s.source = g.source
), pair as (
    select g.lang, g.source, h.source as item from groups g join groups h on h.lang = g.lang and h.source <> g.source
), apart as (
    select lang, source, item, sum({gap}) as value from (select a.lang, a.source, b.source as item, a.p, b.p as q from dense a join dense b on b.lang = a.lang and b.term = a.term and b.source <> a.source) group by all
), found as (
    select lang, source, 'pair' as part, item, coalesce(value, 0) as value from pair left join apart using (lang, source, item)
    union all select lang, source, 'term', term, {gap} from dense where c > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found
)
select lang, source, part, item, value::bigint as value, rank from ranked where part = 'pair' or rank <= {d.RANKS}"""
