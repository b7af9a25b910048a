"""SQL of the longer checks, as DuckDB runs it. Patterns and word lists come from the lexicon; sequential rules are recursive
tables over (document, item)."""

from __future__ import annotations

from ..functions import lexicon as L
from . import adapters as A

STRIP = A.STRIP
HINTS = "['陆沉','苏晚','顾长风','林小满']"
NARRATOR = "陆沉"
FORMS = lambda r: f"list_filter([{r}, case when len({r}) >= 3 then right({r}, 2) end, case when len({r}) >= 4 then right({r}, 3) end], lambda f: f is not null)"
DISTINCT = lambda x: f"list_filter({x}, lambda s, i: list_position({x}, s) = i)"


def re2(pattern: str) -> str:
    """A pattern of the lexicon as an SQL text."""
    return pattern.replace("(?md)", "(?m)").replace("(?U)", "").replace("'", "''")


def texts(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---- text ----


def _rules(source: str) -> str:
    """rule0(doc_id, t), rule1 ..., each with the hits of its rule as h<i>."""
    out = [f"rule0 as (select doc_id, replace(text, '祂', chr(57344) || 'PRESERVE_0' || chr(57345)) as t from {source})"]
    for i, (_, kind, old, new, _) in enumerate(sorted(L.DEFAULT_RULES, key=lambda r: -r[4]), 1):
        if kind == "regex":
            hits, text = f"len(regexp_extract_all(t, '{re2(old)}'))", f"regexp_replace(t, '{re2(old)}', '{new}', 'g')"
        else:
            hits, text = f"(len(t) - len(replace(t, '{old}', ''))) // {len(old)}", f"replace(t, '{old}', '{new}')"
        out.append(f"rule{i} as (select * exclude (t), ({hits})::bigint as h{i}, {text} as t from rule{i - 1})")
    return ",\n".join(out)


_LAST_RULE = len(L.DEFAULT_RULES)
_RULE_IDS = [r[0] for r in sorted(L.DEFAULT_RULES, key=lambda r: -r[4])]
_CLEAN = STRIP("replace(replace(t, chr(57344) || 'PRESERVE_0' || chr(57345), '祂'), chr(13) || chr(10), chr(10))")


def preprocess_rules() -> str:
    at = {n: i + 1 for i, n in enumerate(_RULE_IDS)}
    return f"""with {A.SQL_PROSE},
raw as (select doc_id, '祂' || replace(text, '看见', '彷佛瞭解') || '姊 反覆' as text from docs),
{_rules('raw')}
select doc_id, {_CLEAN} as text, h{at['phrase_fangfo_01']} as phrase_hits, h{at['phrase_liaojie']} as known_hits, h{at['char_jie']} as char_hits
from rule{_LAST_RULE}"""


def rule_hits() -> str:
    each = " union all ".join(f"select '{n}' as rule, sum(h{i + 1})::bigint as hits from rule{_LAST_RULE}" for i, n in enumerate(_RULE_IDS))
    return f"with {A.SQL_PROSE}, {_rules('docs')} {each}"


HTML = """select page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as html from pages"""


# ---- splitting ----


def _packed(name: str, source: str, keys: str, fresh: str, joint: int, closed: str) -> str:
    """{name}(keys, g, content): paragraphs of source.content in greedy groups; np is the paragraph that is looked at."""
    return f"""
{name}_p as (select {keys}, list_filter(list_transform(regexp_split_to_array(content, '\\n\\s*\\n'), lambda x: {STRIP('x')}), lambda x: x <> '') as ps from {source}),
{name}_i as (select {keys}, generate_subscripts(ps, 1) as pno, unnest(ps) as np from {name}_p),
{name}_r as (
  select {keys}, pno, np, 0 as g, len(np) as size, {closed.format(size='len(np)')} as closed from {name}_i where pno = 1
  union all
  select {keys}, pno, np, case when fresh then g + 1 else g end, size, {closed.format(size='size')}
  from (
    select {keys}, pno, np, g, fresh, case when fresh then len(np) else size + len(np) + {joint} end as size
    from (select {keys}, n.pno, n.np, r.g, r.size, r.closed or {fresh} as fresh from {name}_r r join {name}_i n using ({keys}) where n.pno = r.pno + 1)
  )
),
{name} as (select {keys}, g, string_agg(np, chr(10) || chr(10) order by pno) as content from {name}_r group by {keys}, g)"""


def _paragraphs(name: str, source: str, keys: str, target: int, most: int) -> str:
    turn = "(regexp_matches(np, '[”\"」』]$') or not regexp_matches(np, '^[“\"「『]'))"
    return _packed(name, source, keys, f"size + len(n.np) + 2 > {most}", 2, f"({{size}} >= {target} and {turn})")


def paragraph_pack(target: int = 600, most: int = 1200) -> str:
    return f"""with recursive {A.SQL_BOOKS}, src as (select doc_id, text as content from books), {_paragraphs('pk', 'src', 'doc_id', target, most)}
select doc_id, g::int as chunk_idx, '块 ' || (g + 1) as chunk_title, content from pk"""


def _chapters(name: str, source: str, pattern: str, title: str) -> str:
    return f"""{A.sql_spans(f'{name}_h', source, re2(pattern))},
{name}_n as (select *, coalesce(lead(s) over (partition by doc_id order by pos), len(text)) as nx from {name}_h),
{name}_t as (select doc_id, pos, {title} as title, {STRIP('substr(text, e + 1, (nx - e)::int)')} as content from {name}_n),
{name} as (select doc_id, (row_number() over (partition by doc_id order by pos))::int as i, title, content from {name}_t where content <> '')"""


def chunk_split(most: int = 800) -> str:
    return f"""with recursive {A.SQL_BOOKS}, norm as (select doc_id, {A.NORMALISE('text')} as text from books),
{_chapters('ch', 'norm', L.CHAPTER_LINE, STRIP('raw'))},
chunk as (
  select doc_id, i - 1 as chunk_idx, title, content from ch
  union all select doc_id, 0, '全文', text from norm where text <> '' and doc_id not in (select doc_id from ch)
),
big as (select * from chunk where len(content) > {most}),
{_packed('pk', 'big', 'doc_id, chunk_idx, title', f'size + len(n.np) > {most}', 0, 'false')}
select doc_id, chunk_idx, g::int as part_idx, title || '（第' || (g + 1) || '部分）' as title, content from pk
union all select doc_id, chunk_idx, 0, title, content from chunk where len(content) <= {most}"""


def _lines(source: str, most: int = 160) -> str:
    """lines(doc_id, chunk_idx, line_no, start, text) of source(doc_id, chunk_idx, content)."""
    sentence = f"[\\s\\S]*?(?:{re2(L.SENTENCE_END)})|[\\s\\S]+\\z"
    before = "rows between unbounded preceding and 1 preceding"
    return f"""
ln_a as (select doc_id, chunk_idx, string_split(content, chr(10)) as rs from {source}),
ln_b as (select doc_id, chunk_idx, generate_subscripts(rs, 1) as raw_no, unnest(rs) as raw from ln_a),
ln_c as (select *, coalesce(sum(len(raw) + 1) over (partition by doc_id, chunk_idx order by raw_no {before}), 0) as off0 from ln_b),
ln_d as (select doc_id, chunk_idx, raw_no, off0 + len(raw) - len(regexp_replace(raw, '^\\s+', '')) as base, {STRIP('raw')} as line from ln_c where {STRIP('raw')} <> ''),
ln_e as (select *, case when len(line) <= {most} then [line] else regexp_extract_all(line, '{sentence}') end as ss from ln_d),
ln_f as (select doc_id, chunk_idx, raw_no, base, generate_subscripts(ss, 1) as i, unnest(ss) as s from ln_e),
ln_r as (
  select doc_id, chunk_idx, raw_no, base, i, s, 1 as piece, len(s) as size from ln_f where i = 1
  union all
  select doc_id, chunk_idx, raw_no, n.base, n.i, n.s, case when r.size >= {most} then piece + 1 else piece end, case when r.size >= {most} then len(n.s) else r.size + len(n.s) end
  from ln_r r join ln_f n using (doc_id, chunk_idx, raw_no) where n.i = r.i + 1
),
ln_g as (select doc_id, chunk_idx, raw_no, piece, any_value(base) as base, string_agg(s, '' order by i) as text from ln_r group by doc_id, chunk_idx, raw_no, piece),
lines as (
  select doc_id, chunk_idx, (row_number() over (partition by doc_id, chunk_idx order by raw_no, piece))::int as line_no,
    (base + coalesce(sum(len(text)) over (partition by doc_id, chunk_idx, raw_no order by piece {before}), 0))::int as start, text
  from ln_g
)"""


_BOOK_CHUNKS = f"{A.SQL_BOOKS}, src as (select doc_id, 0 as chunk_idx, text as content from books)"
_PROSE_CHUNKS = f"{A.SQL_PROSE}, src as (select doc_id, 0 as chunk_idx, text as content from docs)"


def numbered_lines() -> str:
    return f"""with recursive {_BOOK_CHUNKS}, {_lines('src')}
select doc_id, chunk_idx, line_no, 'L' || line_no as line_id, start, (start + len(text))::int as "end", text from lines"""


def _budget(most_chars: int, most_lines: int) -> str:
    return f"""
bg as (
  select doc_id, chunk_idx, line_no, 0 as part, 1 as n, greatest(1, len(text)) as size from lines where line_no = 1
  union all
  select doc_id, chunk_idx, line_no, case when full_ then part + 1 else part end, case when full_ then 1 else n + 1 end, case when full_ then s else size + s end
  from (
    select doc_id, chunk_idx, l.line_no, b.part, b.n, b.size, greatest(1, len(l.text)) as s, b.n >= {most_lines} or b.size + greatest(1, len(l.text)) > {most_chars} as full_
    from bg b join lines l using (doc_id, chunk_idx) where l.line_no = b.line_no + 1
  )
)"""


def line_budget(most_chars: int = 900, most_lines: int = 12) -> str:
    return f"with recursive {_BOOK_CHUNKS}, {_lines('src')}, {_budget(most_chars, most_lines)} select doc_id, chunk_idx, line_no, part from bg"


def line_slices(most_chars: int = 900, most_lines: int = 12) -> str:
    return f"""with recursive {_BOOK_CHUNKS}, {_lines('src')}, {_budget(most_chars, most_lines)},
p as (
  select doc_id, chunk_idx, part, min(start) as a, max(start + len(text)) as b, list('L' || line_no order by line_no) as line_ids,
    string_agg('L' || line_no || ': ' || text, chr(10) order by line_no) as numbered_text
  from bg join lines using (doc_id, chunk_idx, line_no) group by doc_id, chunk_idx, part
)
select doc_id, chunk_idx, part, 't（第' || (part + 1) || '部分）' as title, {STRIP('substr(content, a + 1, b - a)')} as content, line_ids, numbered_text from p join src using (doc_id, chunk_idx)"""


def _structure(target: int, most: int) -> str:
    """units(doc_id, method, heading_pattern, chapter_count, title, content, i, j, k) of clean(doc_id, text)."""
    votes = " union all ".join(f"select doc_id, '{n}' as pattern, len(regexp_extract_all(text, '{re2(p)}')) as hits, {w} as w, {i} as i from clean" for i, (n, p, w) in enumerate(L.HEADINGS))
    title = STRIP(f"regexp_replace({STRIP('raw')}, '^#+', '')")
    heads = ",\n".join(f"pat{i} as (select doc_id, text from clean join best using (doc_id) where pattern = '{n}'), {_chapters(f'ch{i}', f'pat{i}', p, title)}" for i, (n, p, _) in enumerate(L.HEADINGS))
    scenes = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '{re2(L.SCENE_BREAK)}'), lambda x: {STRIP('x')}), lambda x: x <> '')"
    return f"""
votes as ({votes}),
best as (select doc_id, pattern from (select *, row_number() over (partition by doc_id order by hits * w desc, i) as p from votes where hits >= 2) where p = 1),
{heads},
chapters as ({' union all '.join(f'select * from ch{i}' for i in range(len(L.HEADINGS)))}),
counted as (select doc_id, count(*) as n from chapters group by doc_id),
loose as (select doc_id, text, {scenes('text')} as ps from clean where doc_id not in (select doc_id from counted)),
u0 as (
  select doc_id, 'heading' as method, pattern as heading_pattern, n::int as chapter_count, i, title, content, false as loose from chapters join counted using (doc_id) join best using (doc_id)
  union all
  select doc_id, 'scene_break', 'none', 0, generate_subscripts(ps, 1)::int, '段落 ' || generate_subscripts(ps, 1), unnest(ps), false from loose where len(ps) >= 2
  union all
  select doc_id, 'paragraph', 'none', 0, 1, '全文', text, true from loose where len(ps) < 2
),
u1a as (select *, case when method = 'heading' and len(content) > {most} then {scenes('content')} else [] end as ps from u0),
u1 as (
  select doc_id, method, heading_pattern, chapter_count, i, 1 as j, title, content, loose from u1a where len(ps) < 2
  union all
  select doc_id, method, heading_pattern, chapter_count, i, generate_subscripts(ps, 1)::int, title || ' ' || generate_subscripts(ps, 1), unnest(ps), false from u1a where len(ps) >= 2
),
wide as (select * from u1 where loose or len(content) > {most}),
{_paragraphs('pk', 'wide', 'doc_id, i, j', target, most)},
units as (
  select doc_id, method, heading_pattern, chapter_count, i, j, 0 as k, title, content from u1 where not (loose or len(content) > {most})
  union all
  select doc_id, method, heading_pattern, chapter_count, i, j, g, title || ' ' || (g + 1), pk.content from pk join (select * exclude (content) from wide) using (doc_id, i, j)
)"""


def _clean_books() -> str:
    return f"{A.SQL_BOOKS}, {_rules('books')}, clean as (select doc_id, {_CLEAN} as text from rule{_LAST_RULE} where {_CLEAN} <> '')"


def detect_structure(target: int = 600, most: int = 1200) -> str:
    return f"""with recursive {_clean_books()}, {_structure(target, most)}
select doc_id, method, heading_pattern, chapter_count, (row_number() over (partition by doc_id order by i, j, k) - 1)::int as chunk_idx, title, content from units"""


# ---- chapters of quotes ----

_OFFSETS = A.sql_spans("off", "norm", re2(L.CHAPTER_OFFSET))


def _chaptered(source: str = "q") -> str:
    """inch(doc_id, quote_id, quote_no, chapter_idx, batch_no, batch_pos)."""
    return f"""{_OFFSETS},
inch0 as (select doc_id, quote_id, quote_no, (select count(*) from off where off.doc_id = {source}.doc_id and off.s <= {source}.start)::int as chapter_idx from {source}),
inch1 as (select *, row_number() over (partition by doc_id, chapter_idx order by quote_no) - 1 as place from inch0),
inch as (select doc_id, quote_id, quote_no, chapter_idx, (place // 10)::int as batch_no, (place % 10)::int as batch_pos from inch1)"""


def quote_batches() -> str:
    return f"with {A.SQL_QUOTES}, {_chaptered()} select doc_id, quote_id, chapter_idx, batch_no, batch_pos from inch"


def _openings() -> str:
    """told(doc_id, chapter_idx, heading, opening, shifted)."""
    others = f"list_filter({HINTS}, lambda r: r <> '{NARRATOR}')"
    own = f"我[是叫就为—]{{0,2}}{NARRATOR}|{NARRATOR}[就是—]{{0,2}}我"
    return f"""{_OFFSETS},
op0 as (
  select doc_id, text, pos as chapter_idx, s as pl, coalesce(lead(s) over (partition by doc_id order by pos), len(text)) as nx from off
  union all
  select n.doc_id, any_value(n.text), 0, -1, coalesce(min(s), len(any_value(n.text))) from norm n left join off using (doc_id) group by n.doc_id
),
op1 as (select *, case when substr(text, pl + 1, 1) = chr(10) then pl + 1 else pl end as b, strpos(substr(text, pl + 1), chr(10)) as k1 from op0),
op2 as (select *, strpos(substr(text, b + 1), chr(10)) as k2, case when k1 > 0 then pl + k1 - 1 else pl end as st from op1),
op3 as (
  select doc_id, chapter_idx::int as chapter_idx,
    case when pl < 0 then '' when k2 > 0 then {STRIP('substr(text, b + 1, k2 - 1)')} else {STRIP('substr(text, b + 1, 80)')} end as heading,
    case when pl < 0 then left(text, least(400, nx)) else substr(text, st + 1, greatest(least(st + 400, nx) - st, 0)::int) end as opening
  from op2
),
told as (
  select *, (contains(regexp_replace(opening, '「[^」]*」', '', 'g'), '{NARRATOR}') and not regexp_matches(regexp_replace(opening, '「[^」]*」', '', 'g'), '{own}'))
    or len(list_filter({others}, lambda r: len(list_filter({FORMS('r')}, lambda f: contains(heading, f || '的故事') or contains(heading, f || '的物語'))) > 0)) > 0 as shifted
  from op3
)"""


def perspective_chapters() -> str:
    return f"with {A.SQL_PROSE}, {_openings()} select doc_id, chapter_idx, heading, opening, shifted from told"


def perspective_stats() -> str:
    return f"with {A.SQL_PROSE}, {_openings()} select doc_id, count(*) as chapters, count(*) filter (shifted) as shifted from told group by doc_id"


# ---- candidates ----

#: The distance of a name to a quote: characters before it, or after it.
DISTANCE = (
    "least(case when contains(context_before, name) then position(reverse(name) in reverse(context_before)) + len(name) - 1 else 10000 end, "
    "case when contains(context_after, name) then position(name in context_after) - 1 else 10000 end)"
)
GROUP_CUE = f"({'|'.join(L.GROUP_NAMES)})\\s*(?:齐声|一齐|同时)?\\s*(?:{L.GROUP_CUE_VERBS})"

CAND = f"""
cx as (select *, context_before || chr(10) || context_after as ctx from q),
hn as (select unnest({HINTS}) as role), kn as (select role, row_number() over (order by encode(role)) as i from hn),
n1 as (select doc_id, quote_id, role as name, i as ord from cx, kn where len(list_filter({FORMS('role')}, lambda f: contains(ctx, f))) > 0),
n2a as (select doc_id, quote_id, regexp_extract_all(ctx, '{GROUP_CUE}', 1) as gs from cx),
n2 as (select doc_id, quote_id, unnest(gs) as name, 1000 + generate_subscripts(gs, 1) as ord from n2a),
na as (select * from n1 union all select * from n2),
rl as (select cx.doc_id, cx.quote_id, count(*) filter (list_contains({HINTS}, na.name)) as n from cx left join na using (doc_id, quote_id) group by all),
nb as (select * from na union all select doc_id, quote_id, role, 5000 + i from rl, kn where n = 0),
nc as (
  select * from nb
  union all
  select cx.doc_id, cx.quote_id, '{NARRATOR}', 9000 from cx where not exists (select 1 from nb where nb.doc_id = cx.doc_id and nb.quote_id = cx.quote_id and nb.name = '{NARRATOR}')
),
g as (select doc_id, quote_id, name, count(*) as c, min(ord) as o from nc group by all),
s as (select g.*, {DISTANCE} as d from g join cx using (doc_id, quote_id))"""
RANKED = f"ranked as (select doc_id, quote_id, list_concat(list(name order by d, -c, o), {texts(L.FALLBACK_CANDIDATES)})[1:{L.MAX_CANDIDATES}] as candidates from s group by all)"


def _cut_ends(x: str, suffixes, least: int) -> str:
    return f"list_reduce(list_concat([{x}], {texts(suffixes)}), lambda a, s: case when ends_with(a, s) and len(a) >= len(s) + {least} then left(a, len(a) - len(s)) else a end)"


def candidates_without_hints() -> str:
    name = "trim(raw, ' ，,。:：')"
    name = f"list_reduce(list_concat([{name}], {texts(L.DIRTY_PREFIXES)}), lambda a, s: case when starts_with(a, s) then substr(a, len(s) + 1) else a end)"
    name = f"regexp_extract({name}, '^[^对向冲从]*')"
    name = _cut_ends(_cut_ends(name, ["齐声", "一齐", "同时"], 0), L.CANDIDATE_SUFFIXES, 1)
    cue = f"({L.NAME})\\s*(?:{L.SPEECH_VERBS}|{L.ACTION_CUES})"
    found = lambda pattern, source, first: f"select doc_id, quote_id, unnest(regexp_extract_all(ctx, '{pattern}', 1)) as raw, '{source}' as source, {first} + generate_subscripts(regexp_extract_all(ctx, '{pattern}', 1), 1) as ord from cx"
    return f"""with {A.SQL_QUOTES}, cx as (select *, context_before || chr(10) || context_after as ctx from q),
raws as ({found(GROUP_CUE, 'group_cue', 0)} union all {found(cue, 'rule_cue', 1000)} union all {found(f'({L.TITLES})', 'title', 5000)}),
nm as (select doc_id, quote_id, source, ord, {STRIP(f"case when source = 'rule_cue' then {name} else raw end")} as name from raws),
ok as (select * from nm where name <> '' and not list_contains({texts(L.STOP_CANDIDATES)}, name) and len(name) <= 8 and not regexp_matches(name, '{'|'.join(L.DIRTY_FRAGMENTS)}')),
g as (select doc_id, quote_id, name, count(*) as c, min(ord) as o from ok group by all),
tg0 as (select doc_id, quote_id, name, source, min(ord) as o from ok group by all),
tg as (select doc_id, quote_id, name, string_agg(source, '+' order by o) as tags from tg0 group by all),
s as (select g.*, {DISTANCE} as d from g join cx using (doc_id, quote_id)),
l as (select cx.doc_id, cx.quote_id, coalesce(list(s.name order by d, -c, o) filter (s.name is not null), []) as names from cx left join s using (doc_id, quote_id) group by all),
c as (select doc_id, quote_id, {DISTINCT(f"list_concat(names, {texts(L.FALLBACK_CANDIDATES)})")}[1:{L.MAX_CANDIDATES}] as candidates from l),
e as (select doc_id, quote_id, candidates, unnest(candidates) as name, generate_subscripts(candidates, 1) as k from c)
select doc_id, quote_id, candidates, list(name || '=' || coalesce(tags, 'fallback') order by k) as sources, list_filter(candidates, lambda n: not list_contains({texts(L.FALLBACK_CANDIDATES)}, n)) as scene_characters
from e left join tg using (doc_id, quote_id, name) group by doc_id, quote_id, candidates"""


# ---- prompts ----

BLOCKS = f"""
db0 as (select doc_id, quote_no, quote_id, coalesce(raw_start - lag(raw_end) over (partition by doc_id order by quote_no) > {L.DIALOGUE_GAP}, true) as apart from q),
db1 as (select *, sum(apart::int) over (partition by doc_id order by quote_no) as block from db0),
db2 as (select *, row_number() over (partition by doc_id, block order by quote_no) as p, count(*) over (partition by doc_id, block) as n from db1),
db as (select doc_id, quote_id, block::int as block, p::int as block_pos, n::int as block_size, case when n = 1 then '' else '对话块#' || block::int || ' 第' || p || '/' || n || '句' end as hint from db2)"""

WARN = f"""
wn0 as (select doc_id, quote_id, regexp_extract(right(context_before, 120), '{L.ADDRESSEE_ANYWHERE}', 1) as nm, {STRIP(f"regexp_extract(right(context_before, 120), '{L.ADDRESSEE_ANYWHERE}', 0)")} as cue from q),
wn as (
  select doc_id, quote_id, case when nm <> '' and len(list_filter({HINTS}, lambda h: ends_with(h, nm) or starts_with(h, nm))) > 0
    then '⚠️注意：前文「' || cue || '」中「' || nm || '」是受话对象，不是说话人' else '' end as warning
  from wn0
)"""


def prompt_batch() -> str:
    return f"""with {A.SQL_QUOTES}, {CAND}, {RANKED}, {BLOCKS}, {WARN}, {_chaptered()},
it as (
  select doc_id, chapter_idx, batch_no, batch_pos, quote_id, '--- ' || (batch_pos + 1) || ' | ' || quote_id || ' | '
    || case when len(nf) > 0 then array_to_string(nf, '、') else array_to_string({HINTS}, '、') end || case when hint <> '' then ' | ' || hint else '' end
    || ' ---' || chr(10) || '前: ' || right(context_before, 200) || chr(10) || '近: ' || right(right(context_before, 200), 40) || chr(10) || '句: ' || text
    || chr(10) || '后: ' || left(context_after, 200) || case when warning <> '' then chr(10) || warning else '' end as item
  from (select *, list_filter(candidates, lambda n: not list_contains({texts(L.FALLBACK_CANDIDATES)}, n)) as nf
        from q join ranked using (doc_id, quote_id) join db using (doc_id, quote_id) join wn using (doc_id, quote_id) join (select * exclude (quote_no) from inch) using (doc_id, quote_id))
)
select doc_id, chapter_idx, batch_no, list(quote_id order by batch_pos) as quote_ids, string_agg(item, chr(10) order by batch_pos) as prompt from it group by doc_id, chapter_idx, batch_no"""


_CHOICES = f"""
opt as (select doc_id, quote_id, {DISTINCT("list_concat(candidates, ['未知'])")}[1:26] as names from ranked),
chs as (select doc_id, quote_id, list_transform(names, lambda n, i: chr((64 + i)::int) || '. ' || n) as options, list_position(names, '{NARRATOR}') as gold from opt)"""


def prompt_choice() -> str:
    return f"""with {A.SQL_QUOTES}, {CAND}, {RANKED}, {_CHOICES}, x as (select *, strpos(substr(context_after, 2), '「') as second from q)
select doc_id, quote_id, options, right(context_before, 220) as task_before, left(case when second > 0 then left(context_after, second) else context_after end, 220) as task_after
from x join chs using (doc_id, quote_id)"""


def choice_training_rows() -> str:
    return f"""with {A.SQL_QUOTES}, {CAND}, {RANKED}, {_CHOICES}
select doc_id, quote_id, options, '{NARRATOR}' as gold_speaker, case when gold > 0 then chr((64 + gold)::int) end as gold_label from chs"""


# ---- replies ----


def chunk_plan_decode() -> str:
    return f"""with recursive {_PROSE_CHUNKS}, {_lines('src')}
select doc_id, chunk_idx, line_no as part_no, 't' || line_no as title, {STRIP('text')} as content, true as ok from lines"""


def rewrite_decode() -> str:
    return f"""with recursive {_PROSE_CHUNKS}, {_lines('src')},
g as (select *, coalesce(lag(start + len(text)) over (partition by doc_id, chunk_idx order by line_no), 0) as f, case when line_no % 2 = 0 then '改写' || line_no else text end as new from lines),
p as (select doc_id, chunk_idx, string_agg(substr(content, f + 1, start - f) || new, '' order by line_no) as body, max(start + len(text)) as reach, any_value(content) as content from g join src using (doc_id, chunk_idx) group by doc_id, chunk_idx)
select doc_id, chunk_idx, {STRIP('body || substr(content, reach + 1)')} as content, true as ok from p"""


def compact_decode() -> str:
    return f"""with recursive {_PROSE_CHUNKS}, {_lines('src')},
t as (
  select doc_id, chunk_idx, line_no, 1 as k, '{NARRATOR}' as speaker, 'male adult' as style, 'neutral' as emotion, {STRIP('left(text, 5)')} as text from lines
  union all
  select doc_id, chunk_idx, line_no, 2, '旁白', 'female moderate pitch', 'cold', {STRIP('substr(text, 6)')} from lines
)
select doc_id, chunk_idx, (row_number() over (partition by doc_id, chunk_idx order by line_no, k))::int as seq, speaker, style, emotion, 'high' as confidence_label, text, 'L' || line_no as line_id
from t where text <> ''"""


# ---- speech planning ----


def volume_pack_by_bytes(most: int = 1_200_000) -> str:
    return f"""with recursive {A.SQL_CLIPS},
c as (select "out", idx, frames * channels * {L.SAMPLE_BYTES} as b, (sample_rate * {L.SILENCE_MS} // 1000) * channels * {L.SAMPLE_BYTES} as gap from clips),
v as (
  select "out", idx, 1 as volume, 1 as n, b as bytes from c where idx = 1
  union all
  select "out", idx, case when full_ then volume + 1 else volume end, case when full_ then 1 else n + 1 end, case when full_ then b else ahead end
  from (select "out", c.idx, v.volume, v.n, c.b, v.bytes + c.b + c.gap as ahead, v.n >= {L.VOLUME_ITEMS} or v.bytes + c.b + c.gap > {most} as full_ from v join c using ("out") where c.idx = v.idx + 1)
)
select "out", idx, volume::int as volume from v"""


# ---- information about a text ----


def preprocess_info() -> str:
    hits = ", ".join(f"case when h{i + 1} > 0 then '{n}=' || h{i + 1} end" for i, n in enumerate(_RULE_IDS))
    return f"""with {A.SQL_PROSE}, {_rules('docs')}
select d.doc_id, {_CLEAN} as text, {_CLEAN} <> {STRIP('d.text')} as applied, len(d.text)::int as original_chars, len({_CLEAN})::int as processed_chars,
  false as html_unescape_changed, concat_ws(',', {hits}) as rule_hits
from rule{_LAST_RULE} r join docs d using (doc_id)"""


def structure_info(target: int = 600, most: int = 1200) -> str:
    return f"""with recursive {_clean_books()}, {_structure(target, most)},
per as (select doc_id, any_value(method) as method, any_value(heading_pattern) as heading_pattern, any_value(chapter_count) as chapter_count, count(*)::int as n from units group by doc_id)
select b.doc_id, coalesce(method, 'empty') as method, coalesce(heading_pattern, 'none') as heading_pattern, coalesce(chapter_count, 0) as chapter_count, coalesce(n, 0) as seed_chunk_count,
  c.text is not null and best.pattern is null as used_llm_detection, case when c.text is not null and best.pattern is null then 'md_heading' else 'none' end as llm_pattern,
  {target} as target_chars, {most} as max_chars, len(b.text)::int as original_chars, len(coalesce(c.text, ''))::int as processed_chars, coalesce(c.text, '') <> {STRIP('b.text')} as applied
from books b left join clean c using (doc_id) left join per using (doc_id) left join best using (doc_id)"""


def context_groups(target: int = 600, most: int = 1200) -> str:
    return f"""with recursive {_clean_books()}, {_structure(target, most)},
n as (select doc_id, (row_number() over (partition by doc_id order by i, j, k) - 1)::int as chunk_idx, {STRIP("string_split(title || ' - x', ' - ')[1]")} as key from units),
l as (select *, lag(key) over (partition by doc_id order by chunk_idx) as p from n)
select doc_id, chunk_idx, (sum(case when p = key then 0 else 1 end) over (partition by doc_id order by chunk_idx))::int as group_no from l"""


def heading_split() -> str:
    pattern = next(p for n, p, _ in L.HEADINGS if n == "chapter_en")
    title = STRIP(f"regexp_replace({STRIP('raw')}, '^#+', '')")
    return f"""with {A.SQL_BOOKS}, {_chapters('ch', 'books', pattern, title)}
select doc_id, (i - 1)::int as chapter_idx, title, content from ch
union all select doc_id, 0, '全文', text from books where regexp_matches(text, '{re2(pattern)}') and doc_id not in (select doc_id from ch)"""


def coerced_chunks() -> str:
    return f"""with c as (
  select conv_id as doc_id, case when turn % 3 = 0 then '题' || turn end as title, case when turn % 4 = 1 then '' else {STRIP("coalesce(text, '')")} end as content,
    row_number() over (partition by conv_id order by turn, text) as i
  from conversations where conv_id is not null and turn is not null
)
select doc_id, (row_number() over (partition by doc_id order by i))::int as part_no, coalesce(title, '章 - 第' || i || '块') as title, content from c where content <> ''"""


# ---- names and replies ----


def alias_inference() -> str:
    return f"""with {A.SQL_SEGMENTS},
n as (
  select doc_id, list(case when seq % 3 = 0 then left(speaker, 1) || '公子' when seq % 5 = 0 then left(speaker, 2) || '先生' else speaker end order by seq) as obs from seg group by doc_id
),
o as (select doc_id, list_filter({DISTINCT('obs')}, lambda x: not list_contains({texts(L.ALIAS_SKIP_NAMES)}, x)) as fr from n),
c as (select doc_id, unnest(list_distinct(list_concat(fr, ['顾长风', '林小满']))) as canon from o),
a as (select doc_id, unnest(fr) as alias from o),
b as (select *, list_filter({texts(L.ALIAS_TITLE_SUFFIXES)}, lambda s: ends_with(alias, s) and len(alias) > len(s))[1] as suf from a),
m as (
  select b.doc_id, alias, list(canon) as cs from b join c on b.doc_id = c.doc_id and canon <> alias and starts_with(canon, left(alias, len(alias) - len(suf)))
  where suf is not null and len(canon) > 1 group by all
)
select doc_id, alias, cs[1] as canonical from m where len(cs) = 1"""


def alias_groups_decode() -> str:
    return f"with {A.SQL_SEGMENTS} select doc_id, speaker as canonical, 'a' || seq as alias from seg union all select doc_id, speaker, 'b' from seg"


def fixes_decode() -> str:
    return f"""with {A.SQL_SEGMENTS}, n as (select doc_id, max(seq) as n from seg group by doc_id), w as (select doc_id, unnest(range(0, n, 15)) as st from n)
select seg.doc_id, w.st::int as window_start, (seq - 1 - w.st)::int as local_index, speaker from seg join w on seg.doc_id = w.doc_id and seq - 1 >= w.st and seq - 1 < w.st + 20"""


_TTS = lambda x: STRIP(
    "regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(" + x + ", chr(13) || chr(10), chr(10)), '【', '“'), '】', '”'), '（', '，'), '）', '，'), '[', '【'), ']', '】'), "
    "'\\n{3,}', chr(10) || chr(10), 'g'), '([^\\n。！？!?；;：:])\\n([^\\n])', '\\1。' || chr(10) || '\\2', 'g')"
)
_SIZED = "n as (select doc_id, chunk_idx, max(line_no) as n, max(start + len(text)) as reach from lines group by doc_id, chunk_idx)"
_PLANNED = f"""{_SIZED},
planned as (
  select src.doc_id, src.chunk_idx, content, n, case when src.doc_id % 2 = 0 and n >= 3 then 2 else 1 end as parts,
    (select max(start + len(text)) from lines l where l.doc_id = src.doc_id and l.line_no = 2) as e2, (select min(start) from lines l where l.doc_id = src.doc_id and l.line_no = 1) as s1,
    (select min(start) from lines l where l.doc_id = src.doc_id and l.line_no = 3) as s3, reach
  from src join n using (doc_id, chunk_idx)
),
cutup as (
  select doc_id, chunk_idx, 1 as part_no, case when parts = 2 then '头' else 't' end as title, case when parts = 2 then {STRIP('substr(content, s1 + 1, e2 - s1)')} else content end as content from planned
  union all
  select doc_id, chunk_idx, 2, '尾', {STRIP('substr(content, s3 + 1, reach - s3)')} from planned where parts = 2
)"""


def chunk_planning() -> str:
    return f"with recursive {_PROSE_CHUNKS}, {_lines('src')}, {_PLANNED} select doc_id, chunk_idx, part_no, title, content from cutup"


def plan_then_rewrite() -> str:
    return f"""with recursive {_PROSE_CHUNKS}, {_lines('src')}, {_PLANNED}
select doc_id, (row_number() over (partition by doc_id order by chunk_idx, part_no) - 1)::int as chunk_idx, title, {_TTS('content')} as content from cutup"""


def chunk_rewriting() -> str:
    return f"""with recursive {_PROSE_CHUNKS}, {_lines('src')}, {_SIZED}, one as (select doc_id, chunk_idx, start, len(text) as k from lines where line_no = 1)
select doc_id, chunk_idx, 't' as title, case when doc_id % 2 = 0 and n >= 2 then {STRIP("left(content, start) || '新' || substr(content, start + k + 1)")}
  when n = 1 and doc_id % 2 = 1 then {STRIP('content')} else {_TTS('content')} end as content
from src join n using (doc_id, chunk_idx) join one using (doc_id, chunk_idx)"""


def presplit_chunks(most_chars: int = 1500, most_lines: int = 20) -> str:
    return f"""with recursive {_BOOK_CHUNKS}, {_lines('src')},
size as (select doc_id, chunk_idx, count(*) as n, sum(len('L' || line_no) + 3 + len(text)) as c from lines group by doc_id, chunk_idx),
{_budget(most_chars, most_lines)},
p as (select doc_id, chunk_idx, part, min(start) as a, max(start + len(text)) as b from bg join lines using (doc_id, chunk_idx, line_no) group by doc_id, chunk_idx, part)
select doc_id, chunk_idx, part, 't（第' || (part + 1) || '部分）' as title, {STRIP('substr(content, a + 1, b - a)')} as content
from p join src using (doc_id, chunk_idx) join size using (doc_id, chunk_idx) where n >= {most_lines} or c > {most_chars}
union all
select doc_id, chunk_idx, 0, 't', content from src left join size using (doc_id, chunk_idx) where not coalesce(n >= {most_lines} or c > {most_chars}, false)"""


def single_choice() -> str:
    return f"""with {A.SQL_QUOTES}, {CAND}, {RANKED},
opt as (select doc_id, quote_id, {DISTINCT("list_concat(candidates, ['未知'])")}[1:26] as names from ranked),
x as (select doc_id, quote_id, case when quote_no % 7 <> 6 then names[(quote_no % 5) + 1] end as name from opt join q using (doc_id, quote_id))
select doc_id, quote_id, coalesce(name, '未知') as speaker, case when name is null then 0.2::double else 0.8::double end as confidence, case when name is null then 'unknown' else 'implicit' end as attribution_type from x"""


#: Shapes of a reply around its array: thoughts with brackets, prose with arrays, a fence, a thought cut short, a fence that does
#: not parse, stray brackets behind, nothing but nested numbers, no array that closes.
REPLY_SHAPES = [
    ("<think>maybe [1, 2] or [{</think>", ""), ("first [1,2] then ", " end."), ("see [3]\n```json\n", "\n```\nand [9]"), ("so ", "<think>[[["),
    ("```\n[1, oops]\n``` again ", ""), ("", " ] [oops"), ("[1, [2, 3]] instead of (", ")]"), ("[[ (", ")"),
]


def noisy_replies() -> str:
    """noisy(doc_id, n, answers, response): an answer a segment, in one of the shapes."""
    before, after = (texts([s[i] for s in REPLY_SHAPES]).replace("\n", "' || chr(10) || '") for i in (0, 1))
    return f"""
noisy_a as (
  select doc_id, max(seq) as n, '[' || string_agg('{{"id": "' || case when seq % 2 = 0 then seq::varchar else 'q' || seq end || '", "speaker": "' || speaker || '", "confidence": 0.' || (seq % 10) || '}}', ', ' order by seq) || ']' as answers
  from seg group by doc_id
), noisy as (
  select doc_id, n, answers, {before}[(doc_id % {len(REPLY_SHAPES)}) + 1] || case when doc_id % {len(REPLY_SHAPES)} < 6 then answers else replace(replace(answers, '[', ''), ']', '') end || {after}[(doc_id % {len(REPLY_SHAPES)}) + 1] as response
  from noisy_a
)"""


def recovered_arrays() -> str:
    """found(doc_id, n, json): brackets paired by depth, the candidate furthest to the right that parses."""
    return f"""{noisy_replies()},
thought as (select doc_id, n, {STRIP("regexp_replace(regexp_replace(response, '<think>.*?</think>', '', 'gs'), '<think>.*$', '', 's')")} as text from noisy),
{A.sql_spans('bk', 'thought', '[\\[\\]]')},
lv as (select doc_id, text, s, e, raw, sum(case raw when '[' then 1 else -1 end) over (partition by doc_id order by s) + (raw = ']')::int as level from bk),
nx as (select *, lead(raw) over w as raw2, lead(e) over w as e2 from lv window w as (partition by doc_id, level order by s)),
cand as (select doc_id, s, substr(text, s + 1, e2 - s) as piece from nx where raw = '[' and raw2 = ']'),
fence as (select doc_id, n, regexp_extract(text, '(?s)```(?:json)?\\s*(\\[.*?\\])\\s*```', 1) as f from thought),
best as (select doc_id, arg_max(piece, s) as json from cand where json_valid(piece) group by doc_id),
found as (select doc_id, n, case when f <> '' and json_valid(f) then f else json end as json from fence left join best using (doc_id))"""


def json_array_answers() -> str:
    return f"""with {A.SQL_SEGMENTS}, {recovered_arrays()},
items as (select doc_id, n, unnest(from_json(json, '["JSON"]')) as x from found where json is not null),
said as (select doc_id, n, x->>'id' as i, x->>'speaker' as speaker, (x->>'confidence')::double as confidence from items where json_type(x) = 'OBJECT')
select doc_id as batch_id, case when starts_with(i, 'q') then i else 'q' || i end as quote_id, speaker, confidence, 'implicit' as attribution_type, '' as evidence from said"""


#: What a recorded call of a range ended with, from the document and the range alone; one expression in both dialects.
CALL_KIND = """case when doc_id % 5 = 0 and last - first >= 6 then 'Request timed out' when doc_id % 5 = 0 and first % 9 = 0 then 'read timeout'
when doc_id % 5 = 1 and (last - first >= 4 or first % 8 = 0) then 'finish_reason=length' when doc_id % 5 = 2 and mod(first + 3, 7) <= last - first and last - first > 0 then 'blocked by content_filter'
when doc_id % 5 = 2 and first % 7 = 4 then 'blocked by content_filter' when doc_id % 5 = 3 and first % 6 = 0 then '503 try again' end"""
CALL_UNREADABLE = "doc_id % 5 = 3 and (last - first >= 5 or first % 11 = 0)"


def _resplit(budget: int, most_lines: int) -> str:
    from ..operators.resplit import limits

    by = {k: limits(k, budget, most_lines) for k in ("timeout", "decode", "length", "filter")}
    pick = lambda kind, i: f"case {kind} when 'timeout' then {by['timeout'][i]} when 'decode' then {by['decode'][i]} when 'length' then {by['length'][i]} else {by['filter'][i]} end"
    owners = lambda chars, count: (
        f"list_reduce(list_concat([{{'g': 0, 'n': 0, 'z': 0, 'o': []::int[]}}], list_transform(sizes[first:last], lambda s: {{'g': 0, 'n': 0, 'z': s, 'o': []::int[]}})), lambda a, x: "
        f"case when a.n > 0 and (a.n >= {count} or a.z + x.z > {chars}) then {{'g': a.g + 1, 'n': 1, 'z': x.z, 'o': list_append(a.o, a.g + 1)}} else {{'g': a.g, 'n': a.n + 1, 'z': a.z + x.z, 'o': list_append(a.o, a.g)}} end).o"
    )
    parts = lambda o: f"list_transform(range(0, {o}[-1] + 1), lambda g: {{'first': (first + list_position({o}, g) - 1)::int, 'last': (first + list_position({o}, g) + len(list_filter({o}, lambda y: y = g)) - 2)::int, 'title': title || '（第' || (g + 1) || '部分）'}})"
    asked = lambda source: f"""(
      select *, {parts('own')} as parts from (
        select *, case when tried = 'timeout' and own0[-1] = 0 then 'decode' else tried end as kind, case when tried = 'timeout' and own0[-1] = 0 then {owners(by['decode'][0], by['decode'][1])} else own0 end as own from (
          select *, {owners("lc", "ln")} as own0 from (
            select *, {pick('tried', 0)} as lc, {pick('tried', 1)} as ln from (
              select *, case when error like '%timed out%' or error like '%timeout%' then 'timeout' when error like '%content_filter%' then 'filter' when error like '%finish_reason=length%' then 'length' when error is not null or unreadable then 'decode' end as tried from (
                select p.*, sz.sizes, {CALL_KIND} as error, {CALL_UNREADABLE} as unreadable from {source} p join sz using (doc_id)))))))"""  # noqa: E731
    return f"""
sz as (select doc_id, list(greatest(1, len(text)) order by line_no) as sizes, sum(len('L' || line_no) + 2 + len(text) + 1) - 1 as shown from lines group by doc_id),
s0 as (select doc_id, sizes, shown, 1 as first, len(sizes)::int as last, 't' as title from sz),
s1 as (select *, {owners(budget, most_lines)} as own from s0),
s2 as (select doc_id, first, last, title, case when (last > {most_lines} or shown > {2 * budget}) and own[-1] > 0 then {parts('own')} else [{{'first': first, 'last': last, 'title': title}}] end as parts from s1),
rec as (
  select doc_id, x.first, x.last, x.title from (select doc_id, unnest(parts) as x from s2)
  union all
  select doc_id, x.first, x.last, x.title from (select doc_id, unnest(parts) as x from {asked('rec')} where kind is not null and len(parts) > 1)
),
visited as (select doc_id, first, last, title, kind, error, len(parts) as n from {asked('rec')})"""


def chunk_analysis(budget: int = 1000, most_lines: int = 40) -> str:
    return f"""with recursive {_PROSE_CHUNKS}, {_lines('src')}, {_resplit(budget, most_lines)},
placed as (select v.*, unnest(range(first, last + 1)) as line_no from visited v where kind is null or n < 2),
segs as (
  select p.doc_id, p.line_no, p.first, case kind when 'filter' then 'content_filter' when 'length' then 'finish_reason_length' when 'decode' then 'compact_decode_failed' end as skip_reason,
    case when kind is null and p.line_no = first then '旁白' when kind is null then '{NARRATOR}' else 'UNKNOWN' end as speaker,
    case when kind is null and p.line_no = first then 'female moderate pitch' when kind is null then 'male adult' else 'female, moderate pitch' end as style,
    case when kind is null and p.line_no = first then 'cold' else 'neutral' end as emotion, case when kind is null and p.line_no = first then 'medium' when kind is null then 'high' else 'low' end as confidence_label,
    text, 'L' || p.line_no as line_id, kind is not null as needs_review, case when kind is not null then title end as source_title, coalesce(error, 'empty compact reply') as detail
  from placed p join lines using (doc_id, line_no)
)
select doc_id, 0 as chunk_idx, (row_number() over (partition by doc_id order by line_no))::int as seq, speaker, style, emotion, confidence_label, text, line_id, needs_review, skip_reason, source_title,
  case when skip_reason is not null then source_title || ' ' || line_id || ' 触发 ' || skip_reason || '，已保留原文并跳过 LLM 角色归属。' || detail end as evidence
from segs"""


def resplit_events(budget: int = 1000, most_lines: int = 40) -> str:
    return f"""with recursive {_PROSE_CHUNKS}, {_lines('src')}, {_resplit(budget, most_lines)}
select doc_id, 0 as chunk_idx, case kind when 'filter' then 'content_filter' else kind end || case when n > 1 then '_split' else '_skip' end as event, title, first, last, (case when n > 1 then n else 0 end)::int as parts
from visited where kind is not null"""
