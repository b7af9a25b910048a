"""SQL of sequential attribution: a recursive query that takes the next quote of every document and carries the list of speakers
so far. The registered queries fold in Spark; both follow the same rules."""

from __future__ import annotations

from ..functions import lexicon as L
from . import adapters as A
from .oracles import DISTINCT, FORMS, GROUP_CUE, NARRATOR, STRIP, re2, texts

_KNOWN = texts(sorted(A.NAMES, key=str.encode))
_GROUPS, _FALLBACK = texts(L.GROUP_NAMES), texts(L.FALLBACK_CANDIDATES)
_LOOK = "(?:" + "|".join(L.OBSERVE_VERBS) + ")"
_CANON = lambda x: f"case when {x} = '长风' then '顾长风' else {x} end"
_ADMITTED = lambda n: (
    f"({n} <> '' and len({n}) <= 8 and not list_contains({texts(L.STOP_CANDIDATES)}, {n}) and not regexp_matches({n}, '{'|'.join(L.DIRTY_FRAGMENTS)}')"
    f" and (list_contains({_KNOWN}, {n}) or list_contains({_GROUPS}, {n}) or list_contains({_FALLBACK}, {n})))"
)


def _answer(who: str, confidence: str, why: str, kind: str = "'implicit'", to: str = "null::varchar") -> str:
    return f"{{'sp': {who}, 'cf': {confidence}::double, 'ev': {why}, 'ty': {kind}, 'ad': {to}}}"


def decided(self_sql: str, narrator_sql: str, explicit_sql: str) -> str:
    """CTEs up to rec(doc_id, quote_no, recent, d, cands): one row a quote; row 0 of a document starts it."""
    distance = (
        "least(case when contains(context_before, n) then position(reverse(n) in reverse(context_before)) + len(n) - 1 else 10000 end, "
        "case when contains(context_after, n) then position(n in context_after) - 1 else 10000 end)"
    )
    unknown = _answer(f"'{L.UNKNOWN}'", "0.20", "'未发现显式说话人，等待复核'", "'unknown'")
    return f"""
{A.SQL_QUOTES},
si as ({self_sql}), na as ({narrator_sql}), ex as ({explicit_sql}),
y as (
  select q.doc_id, q.quote_no, q.quote_id, q.text, context_before, context_after, context_before || chr(10) || context_after as ctx,
    list_filter(list_transform(regexp_split_to_array({STRIP('context_before')}, '[。！？!?\\n]'), lambda s: {STRIP('s')}), lambda s: s <> '') as sentences,
    regexp_split_to_array(context_before, '{_LOOK}') as g,
    case when si.speaker is not null then {_answer('si.speaker', 'si.confidence', 'si.evidence', 'si.attribution_type')}
      when na.speaker is not null then {_answer('na.speaker', 'na.confidence', "'一人称代词「我」→叙述者锚点'")}
      when ex.speaker is not null then {_answer('ex.speaker', 'ex.confidence', 'ex.evidence', 'ex.attribution_type', "nullif(ex.addressee, '')")} end as sure
  from q left join si on q.doc_id = si.doc_id and q.quote_id = si.quote_id left join na on q.doc_id = na.doc_id and q.quote_id = na.quote_id left join ex on q.doc_id = ex.doc_id and q.quote_id = ex.quote_id
),
x as materialized (
  select doc_id, quote_no, context_before, context_after, sure,
    list_filter({_KNOWN}, lambda r: len(list_filter({FORMS('r')}, lambda f: contains(ctx, f))) > 0) as hinted, regexp_extract_all(ctx, '{GROUP_CUE}', 1) as others,
    case when regexp_matches(sentences[-1], '{_LOOK}') then regexp_split_to_array(sentences[-1], '{_LOOK}')[1] end as looking,
    list_transform(list_transform(range(1, len(g)), lambda k: list_sum(list_transform(g[1:k], lambda s: len(s)))::bigint + 2 * k), lambda e: {{'at': e, 'text': substr(context_before, e + 1, 24)}}) as sights
  from y
),
rec as (
  select distinct doc_id, 0 as quote_no, []::varchar[] as recent, null::struct(sp varchar, cf double, ev varchar, ty varchar, ad varchar) as d, []::varchar[] as cands from x
  union all
  select doc_id, quote_no, case when list_contains({_FALLBACK}, d.sp) then recent else list_concat(recent, [d.sp]) end as recent, d, cands from (
    select doc_id, quote_no, recent, cands,
      case when sure is not null and sure.sp in ('他', '她') and prev is not null then {_answer('prev', 'least(sure.cf, 0.72)', "sure.ev || '；代词承接最近说话人'", 'sure.ty', 'sure.ad')}
        when sure is not null then sure
        when len(watching) > 0 then {_answer('watching[1].n', '0.56', "'观察者动作启发式'")}
        when len(usable) = 1 then {_answer('usable[1]', '0.62', "'候选集中只有一个非旁白角色'")}
        when len(usable) = 0 then {unknown}
        when prev is null then {_answer('usable[1]', '0.42', "'首轮候选排序启发式'")}
        when len(seen) > 0 and seen[1].n <> prev then {_answer('seen[1].n', '0.60', "'观察目标轮替启发式'")}
        when len(list_filter(usable, lambda n: n <> prev)) > 0 then {_answer('list_filter(usable, lambda n: n <> prev)[1]', '0.58', "'连续双人对话轮替启发式'")}
        else {unknown} end as d
    from (
      select *, list_reverse_sort(list_transform(list_filter(usable, lambda n: contains(looking, n)), lambda n, i: {{'l': len(n), 'i': -i, 'n': n}})) as watching,
        list_reverse_sort(flatten(list_transform(sights, lambda s: list_transform(list_filter(usable, lambda n: contains(s.text, n)), lambda n: {{'at': s.at + position(n in s.text) - 1, 'l': len(n), 'n': n}})))) as seen
      from (
        select *, list_filter(cands, lambda n: not list_contains({texts(L.LOW_VALUE)}, n)) as usable from (
          select *, {DISTINCT(f"list_concat(list_transform(list_sort(keyed), lambda k: k.n), {_FALLBACK})")}[1:case when bare then greatest({L.MAX_CANDIDATES}, {len(A.NAMES)} + 2) else {L.MAX_CANDIDATES} end] as cands from (
            select *, list_transform({DISTINCT('names')}, lambda n, i: {{'d': {distance}, 'm': -len(list_filter(names, lambda o: o = n)), 'i': i, 'n': n}}) as keyed from (
              select *, case when list_contains(named, '{NARRATOR}') then named else list_concat(named, ['{NARRATOR}']) end as names from (
                select *, case when bare then list_concat(base, list_filter(list_transform(recent, lambda o: {_CANON('o')}), lambda o: {_ADMITTED('o')}), {_KNOWN}) else base end as named from (
                  select *, len(list_filter(base, lambda n: not list_contains({_GROUPS}, n) and not list_contains({_FALLBACK}, n))) = 0 as bare from (
                    select x.*, rec.recent, rec.recent[-1] as prev, list_concat(hinted, list_filter(list_transform(rec.recent[-{L.RECENT}:], lambda o: {_CANON('o')}), lambda o: {_ADMITTED('o')}), others) as base
                    from rec join x on x.doc_id = rec.doc_id and x.quote_no = rec.quote_no + 1)))))))))
)"""


def implicit_classic(self_sql: str, narrator_sql: str, explicit_sql: str) -> str:
    return f"""with recursive {decided(self_sql, narrator_sql, explicit_sql)}
select doc_id, quote_no::int as quote_no, d.sp as speaker, d.cf as confidence, d.ev as evidence, d.ty as attribution_type, d.ad as addressee, cands as candidates,
  list_filter(cands, lambda n: not list_contains({_FALLBACK}, n)) as scene_characters
from rec where quote_no > 0"""


def parse_novel(self_sql: str, narrator_sql: str, explicit_sql: str, passes) -> str:
    """`passes` turns the name of a table of segments into (CTEs, name of the corrected table)."""
    steps, last = passes("cast_")
    return f"""with recursive {decided(self_sql, narrator_sql, explicit_sql)},
cast_ as (
  select doc_id, quote_no as seq, d.sp as speaker, d.cf as confidence, d.ev as evidence, d.ty as attribution_type, context_before,
    list_filter(cands, lambda n: not list_contains({_FALLBACK}, n)) as scene_characters
  from rec join (select doc_id, quote_no, context_before from x) using (doc_id, quote_no)
), {steps}
select p.doc_id, p.seq::int as seq, quote_id, p.speaker, q.text, p.confidence, p.attribution_type, p.confidence < {L.REVIEW_THRESHOLD} as review
from {last} p join q on q.doc_id = p.doc_id and q.quote_no = p.seq"""
