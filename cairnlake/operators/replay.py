"""Replays of historical handoffs, planned with pinned references, and recovery from outages of what
a job depends on.

Both are small state machines over many keys: commands of one plan, or attempts of one job, decide
each on the state that those before them left. What depends on data (references still published, raw
objects still there, sources unchanged) is joined once a batch for all keys; the machines are then
folds of a few steps in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.hashing import sha256_ref

#: States of a raw object that can be replayed; the longest one that is (fixed values).
DURABLE, MOST_RAW_BYTES = ("VERIFIED", "COMPACTED", "COLD"), 10_485_760
#: Waits after the first failures of an episode, in ms; the last one holds for all later (fixed values).
DELAYS = (5_000, 15_000, 60_000, 300_000, 900_000)
MOST_ATTEMPTS, MOST_MILLIS = 128, 86_400_000

PLAN = ("plan_id", "tenant_id", "source_handoff_id", "raw_id", "state", "version", "refs", "baseline_hash", "payload_hash", "missing", "reason", "replay_handoff_id")


def resolved(plans: DataFrame, catalogue: DataFrame) -> DataFrame:
    """plans(plan_id, refs) with now_missing, the sorted hashes of references that aren't AVAILABLE,
    and now_hash, the digest of what all of them are published as; null while one is missing.

    refs: array of struct(kind, ref), those of one handoff; catalogue: kind, ref, version,
    content_hash, status. (kind, ref) are joined once for all plans that name them."""
    line = lambda *c: F.concat_ws("\n", *c)
    there = catalogue.filter("status = 'AVAILABLE'").groupBy("kind", "ref").agg(F.max(F.struct("version", "content_hash")).alias("_e"))
    refs = plans.select("plan_id", F.explode("refs").alias("r")).select("plan_id", "r.kind", "r.ref").distinct().join(there, ["kind", "ref"], "left")
    pinned = F.when(F.col("_e").isNotNull(), line("kind", "ref", F.col("_e.version"), F.col("_e.content_hash")))
    gone = F.when(F.col("_e").isNull(), sha256_ref(line("kind", "ref")))
    by = refs.groupBy("plan_id").agg(F.sort_array(F.collect_list(gone)).alias("now_missing"), F.sort_array(F.collect_list(pinned)).alias("_p"))
    by = by.select("plan_id", "now_missing", F.when(F.size("now_missing") == 0, sha256_ref(F.array_join("_p", "\n"))).alias("now_hash"))
    none = F.array().cast("array<string>")
    empty = sha256_ref(F.lit(""))
    out = plans.join(by, "plan_id", "left")
    return out.withColumns({"now_hash": F.when(F.col("now_missing").isNull(), empty).otherwise(F.col("now_hash")), "now_missing": F.coalesce("now_missing", none)})


def sources(handoffs: DataFrame, raws: DataFrame) -> DataFrame:
    """Handoffs with a replayable raw object of the same content: (source_handoff_id, tenant_id, raw_id,
    payload_hash, source_refs). handoffs: handoff_id, content_hash, raw_id, refs; raws: raw_id,
    tenant_id, tier, state, content_hash, size_bytes."""
    fit = raws.filter((F.col("tier") == "RAW") & F.col("state").isin(*DURABLE) & F.col("size_bytes").between(1, MOST_RAW_BYTES)).select("raw_id", "tenant_id", F.col("content_hash").alias("_c"))
    rows = handoffs.join(fit, "raw_id").filter(F.col("content_hash") == F.col("_c"))
    return rows.select(F.col("handoff_id").alias("source_handoff_id"), "tenant_id", "raw_id", F.col("content_hash").alias("payload_hash"), F.col("refs").alias("source_refs"))


def plan_replays(requests: DataFrame, handoffs: DataFrame, raws: DataFrame, catalogue: DataFrame) -> DataFrame:
    """New plans for requests(plan_id, tenant_id, source_handoff_id, reason), with outcome: REASON_REQUIRED,
    RAW_NOT_DURABLE (then no plan: state is null), or REPRODUCE_PLANNED and REPRODUCE_PAUSED."""
    rows = requests.join(sources(handoffs, raws), ["source_handoff_id", "tenant_id"], "left")
    rows = resolved(rows.withColumn("refs", F.coalesce("source_refs", F.array().cast(handoffs.schema["refs"].dataType))), catalogue)
    wrong = F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "REASON_REQUIRED").when(F.col("raw_id").isNull(), "RAW_NOT_DURABLE")
    ready = F.size("now_missing") == 0
    only = lambda c: F.when(wrong.isNull(), c)
    made = {"state": only(F.when(ready, "READY").otherwise("PAUSED")), "version": only(F.lit(0).cast("long")), "baseline_hash": only(F.col("now_hash")), "missing": only(F.col("now_missing")), "replay_handoff_id": F.lit(None).cast("string")}
    return rows.withColumns(made).select(*PLAN, F.coalesce(wrong, F.when(ready, "REPRODUCE_PLANNED").otherwise("REPRODUCE_PAUSED")).alias("outcome"))


def _advance(s: Column, x: Column) -> Column:
    """State after one command. s: state, version, baseline_hash, missing, outcomes; x: the command and
    the facts of its plan."""
    known = F.coalesce(x["expected_version"] == s["version"], F.lit(False))
    ready, same = F.size(x["now_missing"]) == 0, x["now_hash"].eqNullSafe(s["baseline_hash"])
    asked = lambda command, *states: (x["command"] == command) & s["state"].isin(*states) & known
    outcome = (
        F.when((x["command"] == "ABORT") & (F.coalesce(F.trim(x["reason"]), F.lit("")) == ""), "REASON_REQUIRED")
        .when((x["command"] == "EXECUTE") & (s["state"] == "SUCCEEDED"), "REPRODUCE_DONE")
        .when(asked("ABORT", "READY", "PAUSED"), "REPRODUCE_ABORTED")
        .when(asked("RESUME", "PAUSED"), F.when(ready, "REPRODUCE_RESUMED").otherwise("REPRODUCE_RECHECK_FAILED"))
        .when(asked("EXECUTE", "READY"), F.when(~(ready & same), "REPRODUCE_PAUSED").when(~x["durable"], "RAW_NOT_DURABLE").when(~x["unchanged"], "SOURCE_CHANGED").otherwise("REPRODUCE_EXECUTED"))
        .otherwise("VERSION_CONFLICT")
    )
    is_ = lambda *o: outcome.isin(*o)
    moved = is_("REPRODUCE_ABORTED", "REPRODUCE_RESUMED", "REPRODUCE_PAUSED", "REPRODUCE_EXECUTED")
    state = F.when(is_("REPRODUCE_ABORTED"), "ABORTED").when(is_("REPRODUCE_RESUMED"), "READY").when(is_("REPRODUCE_PAUSED"), "PAUSED").when(is_("REPRODUCE_EXECUTED"), "SUCCEEDED").otherwise(s["state"])
    none = F.array().cast("array<string>")
    missing = F.when(is_("REPRODUCE_RESUMED"), none).when(is_("REPRODUCE_PAUSED"), F.when(ready, F.array(sha256_ref(F.lit("BASELINE_CHANGED")))).otherwise(x["now_missing"])).otherwise(s["missing"])
    pinned = F.when(is_("REPRODUCE_RESUMED"), x["now_hash"]).when(is_("REPRODUCE_PAUSED"), F.lit(None)).otherwise(s["baseline_hash"])
    said = F.struct(x["seq"].alias("seq"), x["command"].alias("command"), outcome.alias("outcome"))
    return F.struct(state.alias("state"), (s["version"] + moved.cast("long")).alias("version"), pinned.alias("baseline_hash"), missing.alias("missing"), F.array_append(s["said"], said).alias("said"))


def step_replays(plans: DataFrame, commands: DataFrame, handoffs: DataFrame, raws: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Plans after a batch of commands(plan_id, tenant_id, seq, command, expected_version, reason), in order
    of seq, with said: an array of (seq, command, outcome).

    command is RESUME, EXECUTE or ABORT. A command works only on the version that it names, and each
    change makes the next version. Execution takes place only while the references are what the plan
    pinned; else the plan pauses. Outcomes that change nothing: REPRODUCE_RECHECK_FAILED,
    REPRODUCE_DONE (executed before), RAW_NOT_DURABLE, SOURCE_CHANGED, REASON_REQUIRED,
    VERSION_CONFLICT. Commands of another tenant or of no plan do nothing and say nothing: unknown()
    has them. plans: the columns of PLAN, states not null."""
    own = commands.groupBy("plan_id", "tenant_id").agg(F.sort_array(F.collect_list(F.struct("seq", "command", "expected_version", "reason"))).alias("_c"))
    touched = plans.join(own, ["plan_id", "tenant_id"])
    facts = sources(handoffs, raws).select("source_handoff_id", "tenant_id", F.col("payload_hash").alias("_hash"), "source_refs")
    rows = resolved(touched, catalogue).join(facts, ["source_handoff_id", "tenant_id"], "left")
    refs = lambda c: F.array_sort(F.transform(c, lambda r: F.concat_ws("\n", r["kind"], r["ref"])))
    rows = rows.withColumns({"durable": F.col("_hash").isNotNull(), "unchanged": F.coalesce((F.col("_hash") == F.col("payload_hash")) & (refs("refs") == refs("source_refs")), F.lit(False))})
    each = F.transform("_c", lambda c: F.struct(*[c[n].alias(n) for n in ("seq", "command", "expected_version", "reason")], *[F.col(n) for n in ("now_missing", "now_hash", "durable", "unchanged")]))
    said = commands.schema["seq"].dataType.simpleString()
    zero = F.struct("state", F.col("version").cast("long").alias("version"), "baseline_hash", "missing", F.array().cast(f"array<struct<seq:{said},command:string,outcome:string>>").alias("said"))
    done = rows.withColumn("_s", F.aggregate(each, zero, _advance))
    made = F.when(F.col("_s.state") == "SUCCEEDED", F.coalesce("replay_handoff_id", F.concat(F.lit("replay-"), "plan_id")))
    done = done.select(*[F.col(f"_s.{c}").alias(c) if c in ("state", "version", "baseline_hash", "missing") else made.alias(c) if c == "replay_handoff_id" else F.col(c) for c in PLAN], F.col("_s.said").alias("said"))
    quiet = plans.join(own, ["plan_id", "tenant_id"], "left_anti").select(*PLAN).withColumn("said", F.array().cast(done.schema["said"].dataType))
    return done.unionByName(quiet)


def unknown(plans: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands that name no plan of their tenant."""
    return commands.join(plans.select("plan_id", "tenant_id"), ["plan_id", "tenant_id"], "left_anti")


def replayed_handoffs(stepped: DataFrame, handoffs: DataFrame) -> DataFrame:
    """The handoffs that a step's executions append: the source's row under the plan's own ids."""
    ran = stepped.filter(F.exists("said", lambda x: x["outcome"] == "REPRODUCE_EXECUTED")).select("plan_id", F.col("source_handoff_id").alias("handoff_id"), "replay_handoff_id")
    run = F.concat(F.lit("reproduce-"), "plan_id")
    rows = handoffs.join(ran, "handoff_id")
    keep = [c for c in handoffs.columns if c not in ("handoff_id", "ingestion_run_id", "ingestion_id")]
    return rows.select(F.col("replay_handoff_id").alias("handoff_id"), run.alias("ingestion_run_id"), run.alias("ingestion_id"), *keep, F.col("handoff_id").alias("replay_of"))


def delay_millis(attempts: Column, factor: Column) -> Column:
    """The wait after so many attempts of an episode, times a factor of 0.8 to 1.2."""
    waits = F.array(*[F.lit(d) for d in DELAYS])
    return F.floor(F.element_at(waits, F.least(F.greatest(attempts, F.lit(1)), F.lit(len(DELAYS))).cast("int")) * F.least(F.greatest(factor, F.lit(0.8)), F.lit(1.2)))


def spread(job: Column, attempt: Column) -> Column:
    """A factor of 0.8 to 1.2 that a job and attempt always have, in steps of 1/1024 of the range."""
    return F.lit(0.8) + F.conv(F.substring(F.sha2(F.concat_ws("|", job.cast("string"), attempt.cast("string")), 256), 1, 3), 16, 10).cast("double") / 4095 * 0.4


def recover(jobs: DataFrame, attempts: DataFrame, most_attempts: int = MOST_ATTEMPTS, most_millis: int = MOST_MILLIS) -> DataFrame:
    """Jobs after a batch of attempts at what they depend on.

    jobs: job_id, state, started_ms (of the open episode, null without), attempts, cumulative, due_ms,
    failure_code. attempts: job_id, at_ms, claimed_ms, outcome (OK, UNAVAILABLE or another failure),
    not_before_ms. In order of at_ms, per job: an episode that has run out of attempts or of time
    quarantines the job; a failure that may pass opens an episode, from claimed_ms, or goes on with it,
    and pauses the job until the wait is over or not_before_ms, if that is later; a wait beyond the
    episode's end quarantines; OK ends the episode; other failures quarantine at once under their own
    code. Quarantined and SUCCEEDED jobs don't move. Attempts without a job are left out.
    """
    tries = attempts.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("at_ms", "claimed_ms", "outcome", "not_before_ms"))).alias("_t"))
    fields = {"state": "string", "started_ms": "long", "attempts": "long", "cumulative": "long", "due_ms": "long", "failure_code": "string"}

    def step(s: Column, x: Column) -> Column:
        null = lambda t: F.lit(None).cast(t)
        over = s["state"].isin("QUARANTINED", "SUCCEEDED")
        open_ = s["started_ms"].isNotNull()
        spent = open_ & ((s["attempts"] >= most_attempts) | (x["at_ms"] >= s["started_ms"] + most_millis))
        n = F.when(open_, s["attempts"] + 1).otherwise(F.lit(1).cast("long"))
        began = F.coalesce(s["started_ms"], x["claimed_ms"])
        due = F.greatest(x["at_ms"] + delay_millis(n, spread(F.col("job_id"), n)), x["not_before_ms"])  # nulls don't count
        late = (n >= most_attempts) | (due >= began + most_millis)
        ok, away = x["outcome"] == "OK", x["outcome"] == "UNAVAILABLE"

        def pick(name: str, at_spent: Column, at_ok: Column, at_away: Column, at_late: Column, at_else: Column) -> Column:
            return F.when(over, s[name]).when(spent, at_spent).when(ok, at_ok).when(away & late, at_late).when(away, at_away).otherwise(at_else).cast(fields[name]).alias(name)

        stop, wait = F.lit("QUARANTINED"), F.lit("PAUSED")
        return F.struct(
            pick("state", stop, F.lit("SUCCEEDED"), wait, stop, stop),
            pick("started_ms", s["started_ms"], null("long"), began, began, s["started_ms"]),
            pick("attempts", s["attempts"], F.lit(0), n, n, F.when(open_, n).otherwise(s["attempts"])),
            pick("cumulative", s["cumulative"], s["cumulative"] + open_.cast("long"), s["cumulative"] + 1, s["cumulative"] + 1, s["cumulative"] + open_.cast("long")),
            pick("due_ms", null("long"), null("long"), due, null("long"), null("long")),
            pick("failure_code", F.lit("RETRY_EXHAUSTED"), null("string"), F.lit("DEPENDENCY_UNAVAILABLE"), F.lit("RETRY_EXHAUSTED"), x["outcome"]),
        )

    zero = F.struct(*[F.col(n).cast(t).alias(n) for n, t in fields.items()])
    empty = F.array().cast(tries.schema["_t"].dataType)
    rows = jobs.join(tries, "job_id", "left").withColumn("_s", F.aggregate(F.coalesce("_t", empty), zero, step))
    return rows.select("job_id", *[F.col(f"_s.{n}").alias(n) for n in fields])
