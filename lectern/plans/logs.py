"""Registered queries over logs: attempts of calls, feeds of progress, and what a batch's prompt says of the batch before."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import calls, quotes, service
from . import adapters as A, oracles as O
from .registry import query

#: Microseconds since 1970 of a time without zone, whatever the session's zone is.
_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

# ---- attempts ----

_ERRORS = ["timed out", "HTTP 429", "finish_reason=length 500", "bad json", "Connection reset", "content_filter"]
_TASKS = ["segment", "optimize", "analyze", "general", "other"]


def _log(spark, sf_dir):
    """A call is a user's week; its events are attempts in order of time, three a profile."""
    e = A._table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select("event_id", "user_id", "event_type", "value", F.expr(_MICROS).alias("at"))
    call = F.col("user_id") * 10 + F.floor((F.col("at") / 1_000_000 - 1_704_067_200) / 604_800)
    placed = e.withColumn("call_id", call.cast("long"))
    n = F.row_number().over(Window.partitionBy("call_id").orderBy("at", "event_id")) - 1
    numbered = placed.withColumns({"profile": (F.floor(n / 3) + 1).cast("int"), "attempt": (F.pmod(n, F.lit(3)) + 1).cast("int")})
    failed = F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(8))
    error = F.when(failed < 6, F.get(T.strings(_ERRORS), failed.cast("int")))
    log = numbered.select("call_id", "profile", "attempt", F.when(error.isNull(), F.concat(F.lit("r"), "event_id")).alias("response"), error.alias("error"))
    users = placed.groupBy("call_id").agg(F.max("user_id").alias("u"))
    task = F.get(T.strings(_TASKS), F.pmod("u", F.lit(5)).cast("int"))
    profiles = calls.retry_profiles(task, F.col("u") % 3 != 0, (F.col("u") % 4) * 300, F.when(F.col("u") % 7 != 0, (F.col("u") % 7) * 500), (F.col("u") % 2) * 20, F.when(F.col("u") % 6 > 0, F.col("u") % 6 - 2))
    return log, users.select("call_id", (F.col("u") % 4 == 1).alias("plain"), profiles.alias("profiles"))


def _profiles_sql() -> str:
    """pf(call_id, plain, profile, max_tokens, ctx_tokens, batch_size, gpu_layers)."""
    first = "select call_id, plain, 1 as profile, tokens::int as max_tokens, ctx::int as ctx_tokens, batch::int as batch_size, layers::int as gpu_layers from cf"
    rest = []
    for i in (0, 1):
        tokens = "case task " + " ".join(f"when '{k}' then {v[i]}" for k, v in calls.TASK_TOKENS.items()) + f" else {calls.TASK_TOKENS['general'][i]} end"
        limit = lambda j: f"case when task = 'segment' then {calls.CUTTING[i][j]} else {calls.OTHER[i][j]} end"
        rest.append(f"select call_id, plain, {i + 2}, least(coalesce(nullif(tokens, 0), {tokens}), {tokens})::int, least(coalesce(nullif(ctx, 0), 4096), {limit(0)})::int, least(coalesce(nullif(batch, 0), 128), {limit(1)})::int, least(case when layers is null or layers = -1 then 16 else layers end, {limit(2)})::int from cf where inner_")
    names, errors = O.texts(_TASKS), O.texts(_ERRORS)
    return f"""
ev as (select event_id, user_id, user_id * 10 + floor((epoch_us(ts) / 1000000.0 - 1704067200) / 604800)::bigint as call_id, ts from events where user_id is not null and ts is not null),
nb as (select *, row_number() over (partition by call_id order by ts, event_id) - 1 as n, {errors}[(event_id * 7 + user_id) % 8 + 1] as error from ev),
log as (select call_id, (n // 3 + 1)::int as profile, (n % 3 + 1)::int as attempt, case when error is null then 'r' || event_id end as response, error from nb),
us as (select call_id, max(user_id) as u from ev group by call_id),
cf as (
  select call_id, u % 4 = 1 as plain, {names}[u % 5 + 1] as task, u % 3 <> 0 as inner_, (u % 4) * 300 as tokens, case when u % 7 <> 0 then (u % 7) * 500 end as ctx, (u % 2) * 20 as batch, case when u % 6 > 0 then u % 6 - 2 end as layers
  from us
), pf as ({first} union all {' union all '.join(rest)})"""


_CALLS = f"""
with {_profiles_sql()},
pn as (select call_id, any_value(plain) as plain, case when any_value(plain) then 1 else max(profile) end as n from pf group by call_id),
us_ as (select log.*, plain, n from log join pn using (call_id) where profile <= n and attempt <= {calls.RETRIES}),
st as (select *, error is null or (plain and not regexp_matches(error, 'timed out|429|Connection')) as stops from us_),
md as (select *, coalesce(bool_or(stops) over (partition by call_id order by profile, attempt rows between unbounded preceding and 1 preceding), false) as gone from st),
pz as (select *, lead(profile) over (partition by call_id order by profile, attempt) as nx from md where not gone),
per as (
  select call_id, arg_max({{'profile': profile, 'attempt': attempt, 'response': response, 'error': error, 'stops': stops, 'n': n}}, profile * 10 + attempt) as e, count(*)::int as attempts,
    sum(case when nx is null then 0 when nx = profile then attempt * {calls.DELAY_MS} else {calls.DELAY_MS} end)::bigint as waited_ms
  from pz group by call_id
), rs as (
  select pn.call_id, e, attempts, waited_ms, case when e is null then 'open' when e.error is null then 'ok' when e.stops then 'stopped' when e.profile = pn.n and e.attempt = {calls.RETRIES} then 'exhausted' else 'open' end as outcome
  from pn left join per using (call_id)
)
select rs.call_id, outcome, case when outcome = 'ok' then e.response end as response, e.error as error,
  case when e.error = 'timed out' then 'timeout' when e.error = 'content_filter' then 'filter' when e.error like 'finish_reason=length%' then 'length' when e.error in ('HTTP 429', 'Connection reset') then 'transient' when e.error is not null then 'decode' end as kind,
  e.profile as profile, max_tokens, coalesce(attempts, 0)::int as attempts, coalesce(waited_ms, 0)::bigint as waited_ms
from rs left join pf on pf.call_id = rs.call_id and pf.profile = rs.e.profile"""


@query(_CALLS)
def service_calls(spark, sf_dir):
    """What came out of each call, after which attempts and pauses."""
    return calls.resolve_attempts(*_log(spark, sf_dir))


@query(f"with {_profiles_sql()} select call_id, profile, max_tokens, ctx_tokens, batch_size, gpu_layers from pf")
def retry_profiles(spark, sf_dir):
    """The settings that a call's attempts may use."""
    return _log(spark, sf_dir)[1].select("call_id", F.explode("profiles").alias("p")).select("call_id", "p.*")


# ---- progress ----


@query("""
with e as (
  select epoch_us(ts) // 3600000000 as run, epoch_us(ts) as "at", event_id, case when event_type = 'error' then 'error' when event_type = 'purchase' and event_id % 5 = 0 then 'complete' else 'progress' end as event
  from events where ts is not null
), s as (select *, coalesce(bool_or(event <> 'progress') over (partition by run order by "at", event_id rows between unbounded preceding and 1 preceding), false) as gone from e),
k as (select run, "at", event, lead("at") over (partition by run order by "at", event_id) as nx from s where not gone)
select run, "at", event from k
union all
select run, unnest(range("at" + 25000000, nx, 25000000)) as "at", 'ping' as event from k where nx is not null""")
def progress_pings(spark, sf_dir):
    """An hour's events as a feed: pings while nothing comes, nothing after its end."""
    e = A._table(spark, sf_dir, "events").where("ts is not null").withColumn("at", F.expr(_MICROS))
    kind = F.when(F.col("event_type") == "error", "error").when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "complete").otherwise("progress")
    return calls.progress_feed(e.select(F.floor(F.col("at") / 3_600_000_000).alias("run"), "at", F.col("event_id").alias("seq"), kind.alias("event")))


# ---- batches and the batch before ----

_SAID = A.NAMES + list(L.FALLBACK_CANDIDATES)


@query(f"""
with {A.SQL_QUOTES}, {O._chaptered()},
pl as (select doc_id, chapter_idx, quote_no, quote_id, row_number() over (partition by doc_id, chapter_idx order by quote_no) - 1 as n from inch),
sp as (select *, (n // 2)::int as batch_no, (n % 2)::int as batch_pos, {O.texts(_SAID)}[(doc_id + chapter_idx + (n // 2) * 2 + (n % 2) * 3) % {len(_SAID)} + 1] as speaker from pl),
nm as (
  select a.doc_id, a.chapter_idx, a.batch_no, list(b.speaker order by b.quote_no) filter (b.speaker not in ('旁白', '未知')) as names
  from (select distinct doc_id, chapter_idx, batch_no from sp) a left join sp b on a.doc_id = b.doc_id and a.chapter_idx = b.chapter_idx and b.batch_no < a.batch_no group by all
)
select doc_id, chapter_idx, batch_no, batch_pos, quote_id, speaker,
  case when batch_pos = 0 then coalesce(names[-4:][-1], '（批次首条）') else coalesce(names[-4:][batch_pos], '未知') end as previous
from sp join nm using (doc_id, chapter_idx, batch_no)""")
def batch_previous(spark, sf_dir):
    """Who spoke before, as each prompt of a batch says it, over recorded replies to batches of two."""
    text = quotes.normalised(A.prose(spark, sf_dir))
    found = quotes.extract_quotes(text)
    items = quotes.chapter_of_quotes(text, found, "quote_no").select("doc_id", "chapter_idx", "quote_no", "quote_id")
    placed = quotes.quote_batches(items, 2)
    who = lambda i: F.get(T.strings(_SAID), F.pmod(F.col("doc_id") + F.col("chapter_idx") + F.col("batch_no") * 2 + i * 3, F.lit(len(_SAID))).cast("int"))
    row = lambda i: F.concat(F.lit(f"{i + 1}|"), who(i), F.lit("|0.9|im|x"))
    replies = placed.select("doc_id", "chapter_idx", "batch_no").distinct().select("doc_id", "chapter_idx", "batch_no", F.concat_ws("\n", row(0), row(1)).alias("response"))
    said = service.attribute_batches(items, replies, 2).select("doc_id", "quote_no", "speaker")
    return quotes.previous_speakers(placed.join(said, ["doc_id", "quote_no"], "left")).select("doc_id", "chapter_idx", "batch_no", "batch_pos", "quote_id", "speaker", "previous")
