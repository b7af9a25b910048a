"""Logs of calls: which attempts were made under the retry rules, how long they waited, what came out; and feeds of progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col
from .service import FAILURES, failure_kinds

#: Attempts a profile, the first pause in milliseconds, seconds without an event before a ping.
RETRIES, DELAY_MS, IDLE_SECONDS = 3, 1200, 25.0
#: Fixed values of the narrower profiles (first, second): tokens of a reply by task, then context, batch and layers for cutting a
#: text and for any other task.
TASK_TOKENS = {"segment": (384, 256), "optimize": (768, 512), "analyze": (1024, 768), "general": (1024, 768)}
CUTTING, OTHER = ((2048, 32, 8), (1536, 16, 4)), ((3072, 64, 12), (2048, 32, 8))
PROFILE = "struct<profile:int,max_tokens:int,ctx_tokens:int,batch_size:int,gpu_layers:int>"


def retry_profiles(task, in_process, max_tokens, ctx_tokens=None, batch_size=None, gpu_layers=None) -> Column:
    """array<PROFILE>: the settings as given and, for a model that runs in the process, two narrower ones."""
    none = F.lit(None).cast("int")
    tokens, ctx, batch, layers = (none if c is None else col(c).cast("int") for c in (max_tokens, ctx_tokens, batch_size, gpu_layers))
    kind = F.coalesce(col(task), F.lit("general"))
    cutting = kind == "segment"
    positive = lambda c: F.when(c != 0, c)
    first = F.struct(F.lit(1), tokens, ctx, batch, layers).cast(PROFILE)

    def narrower(i):
        most = F.coalesce(*[F.when(kind == k, v[i]) for k, v in TASK_TOKENS.items()], F.lit(TASK_TOKENS["general"][i]))
        limit = lambda j: F.when(cutting, CUTTING[i][j]).otherwise(OTHER[i][j])
        own_layers = F.when(layers.isNull() | (layers == -1), 16).otherwise(layers)
        return F.struct(F.lit(i + 2), F.least(F.coalesce(positive(tokens), most), most), F.least(F.coalesce(positive(ctx), F.lit(4096)), limit(0)), F.least(F.coalesce(positive(batch), F.lit(128)), limit(1)), F.least(own_layers, limit(2))).cast(PROFILE)

    return F.when(F.coalesce(col(in_process), F.lit(False)), F.array(first, narrower(0), narrower(1))).otherwise(F.array(first))


def transient(error) -> Column:
    """Failures after which a plain call is made again."""
    marks = "|".join(x.replace(".", "\\.") for k in ("timeout", "transient") for x in FAILURES[k])
    return F.lower(F.coalesce(col(error), F.lit(""))).rlike(marks) & (failure_kinds(error) != "length")


def resolve_attempts(log: DataFrame, calls: DataFrame, retries: int = RETRIES, delay_ms: int = DELAY_MS) -> DataFrame:
    """log (call_id, profile, attempt, response, error) and calls (call_id, plain, profiles) -> a row a call: outcome, response,
    error, kind, profile, max_tokens, attempts, waited_ms.

    Attempts are made profile by profile, `retries` each, up to the first that is answered. Between two of a profile the pause
    is delay_ms times the attempt's number, before the next profile it is delay_ms. A `plain` call has one profile and ends at
    the first failure that is not transient. What the log holds beyond the end was never made. Outcomes: ok; stopped (not
    transient); exhausted; open (the log ends before the call does); a call without attempts is open, too.
    """
    both = log.join(calls, "call_id").withColumn("last_profile", F.when(F.col("plain"), 1).otherwise(F.size("profiles")))
    usable = both.where((F.col("attempt") <= retries) & (F.col("profile") <= F.col("last_profile")))
    w = Window.partitionBy("call_id").orderBy("profile", "attempt")
    stops = F.col("error").isNull() | (F.col("plain") & ~transient("error"))
    marked = usable.withColumn("stops", stops.cast("int"))
    made = marked.withColumn("before", F.coalesce(F.max("stops").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before = 0")
    follows = F.lead("profile").over(w)
    paused = made.withColumn("pause", F.when(follows.isNull(), 0).when(follows == F.col("profile"), F.col("attempt") * delay_ms).otherwise(delay_ms))
    at = F.struct("profile", "attempt")
    end = F.max_by(F.struct("profile", "attempt", "response", "error", "stops", "plain", "last_profile", F.col("profiles")), at)
    per = paused.groupBy("call_id").agg(end.alias("e"), F.count("*").cast("int").alias("attempts"), F.sum("pause").cast("long").alias("waited_ms"))
    done = (F.col("e.profile") == F.col("e.last_profile")) & (F.col("e.attempt") == retries)
    outcome = F.when(F.col("e.attempt").isNull(), "open").when(F.col("e.error").isNull(), "ok").when(F.col("e.stops") == 1, "stopped").when(done, "exhausted").otherwise("open")
    kind = F.when(F.col("e.error").isNotNull(), failure_kinds("e.error"))
    tokens = F.try_element_at("e.profiles", F.col("e.profile"))["max_tokens"]
    out = calls.select("call_id").join(per, "call_id", "left")
    return out.select("call_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("e.response")).alias("response"), F.col("e.error").alias("error"), kind.alias("kind"), F.col("e.profile").alias("profile"), tokens.alias("max_tokens"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("waited_ms", F.lit(0).cast("long")).alias("waited_ms"))


def progress_feed(events: DataFrame, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """events (run, at in microseconds, seq to order equal times, event) -> run, at, event, pings included.

    A feed that hears nothing for idle_seconds sends a ping, and again after each such time; an event at that very moment comes
    instead of it. The first `complete` or `error` ends a run: nothing after it is sent. A run that is not ended has no pings
    behind its last event. Rows without a run or a time are left out.
    """
    idle = int(idle_seconds * 1_000_000)
    w = Window.partitionBy("run").orderBy("at", "seq")
    known = events.where("run is not null and at is not null").select("run", "at", "seq", "event")
    ended = F.coalesce(F.max(F.col("event").isin("complete", "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sent = known.withColumn("ended", ended).where("ended = 0").withColumn("next", F.lead("at").over(w))
    quiet = F.when(F.col("at") + idle < F.col("next"), F.sequence(F.col("at") + idle, F.col("next") - 1, F.lit(idle).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = F.concat(F.array(F.struct(F.col("at"), F.col("event"))), F.transform(quiet, lambda t: F.struct(t.alias("at"), F.lit("ping").alias("event"))))
    return sent.select("run", F.explode(rows).alias("r")).select("run", "r.at", "r.event")
