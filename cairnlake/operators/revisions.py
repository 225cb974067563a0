"""Materialising observations into immutable revisions, and reconstructing revisions from them.

An object's observations are folded in order, for each decides on the state that those before it
left: a delta is refused unless it names the current revision and content, equal fingerprints and
equal content make no revision, conflicting sources leave the previous value, and only a source
with the right to may delete. Objects are dealt by id and sorted; a task streams through its rows
with the state of one object in hand, so an object of any length costs no memory. The state left
behind is a row an object; the next batch of observations goes on from it.

Reconstruction needs no fold: revisions between two checkpoints are a segment, and per property the
last set or removal in it decides.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.sources.scratch import stored

from .canonical import UNRANKED

FULL = "FULL_SNAPSHOT"
_NAME = re.compile(r"[A-Za-z0-9_.:/#-]+")


class Rule(NamedTuple):
    """How a property's sources rank, who may delete it, and its access label."""

    property: str
    order: Sequence[str] = ()
    label: str = "OPEN"
    deleters: Sequence[str] = ()


class Profile(NamedTuple):
    rules: Sequence[Rule]
    checkpoint_interval: int = 10

    def check(self) -> Profile:
        names = [r.property for r in self.rules]
        if len(set(names)) < len(names) or not all(_NAME.fullmatch(x) for r in self.rules for x in (r.property, r.label)):
            raise ValueError("properties must be distinct, and names and labels plain")
        if self.checkpoint_interval < 1:
            raise ValueError("the checkpoint interval must be positive")
        return self


def canonical_text(values: Column, labels: Column) -> Column:
    """Sorted JSON of {labels, values}; values are JSON literals already. Names are plain."""
    part = lambda m, v: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), v(e["value"]))), ",")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    return F.concat(F.lit('{"labels":{'), part(labels, quoted), F.lit('},"values":{'), part(values, lambda x: x), F.lit("}}"))


def canonical_hash(values: Column, labels: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_text(values, labels), 256))


def _digest(text: str) -> str:
    return f"sha256:{hashlib.sha256(text.encode()).hexdigest()}"


def _joined(items) -> str:
    return "{" + ",".join(f'"{k}":{v}' for k, v in sorted(items)) + "}"


class _State:
    """What is known of one object; its size depends on properties and sources, not on history."""

    def __init__(self, rules: Sequence[Rule], text: str | None):
        kept = json.loads(text) if text else {}
        self.rules = rules
        self.revision: int = kept.get("revision", 0)
        self.content: str = kept.get("content", "")
        self.authority_hash: str = kept.get("authority_hash", "")
        self.fingerprint: str | None = kept.get("fingerprint")
        self.values: dict[str, str] = kept.get("values", {})
        self.authority: dict[str, str] = kept.get("authority", {})
        #: property -> source -> [when, literal or None for a deletion]
        self.latest: dict[str, dict[str, list]] = kept.get("latest", {})

    def text(self) -> str:
        return json.dumps({k: v for k, v in self.__dict__.items() if k != "rules"}, ensure_ascii=False, sort_keys=True)

    def refused(self, mode: str, base_revision: int | None, base_content: str | None) -> str | None:
        if mode == FULL:
            return None
        if not self.revision:
            return "DELTA_BASE_REQUIRED"
        wrong = base_revision not in (None, self.revision) or base_content not in (None, self.content)
        return "DELTA_BASE_MISMATCH" if wrong else None

    def contribute(self, source: str, observed: int | None, seq: int, payload: dict[str, str], deletes: Sequence[str]) -> None:
        for rule in self.rules:
            if rule.property in deletes and source in rule.deleters:
                literal = None
            elif rule.property in payload:
                literal = payload[rule.property]
            else:
                continue  # what is absent says nothing
            mine = self.latest.setdefault(rule.property, {})
            when = [observed is not None, observed or 0, seq]
            if source not in mine or when >= mine[source][0]:
                mine[source] = [when, literal]

    def choose(self) -> tuple[dict[str, str], dict[str, str], list[str]]:
        """Values, authority and conflicting properties by what the sources say now."""
        values, authority, conflicts = dict(self.values), dict(self.authority), []
        for rule in self.rules:
            ranks = {s: rule.order.index(s) if s in rule.order else UNRANKED for s in self.latest.get(rule.property, {})}
            if not ranks:
                continue
            best = min(ranks.values())
            top = {s: self.latest[rule.property][s][1] for s in sorted(ranks) if ranks[s] == best}
            if len(set(top.values())) > 1:
                conflicts.append(rule.property)
                continue
            source, literal = next(iter(top.items()))
            if literal is None:
                values.pop(rule.property, None)
                authority.pop(rule.property, None)
            else:
                values[rule.property] = literal
                authority[rule.property] = f'{{"rank":{best},"source":{json.dumps(source, ensure_ascii=False)},"value":{literal}}}'
        return values, authority, conflicts


OBSERVED = ("object_id", "seq", "handoff_id", "source_id", "mode", "base_revision", "base_content", "fingerprint", "observed_at", "payload", "deletes")
_MAP = pa.map_(pa.string(), pa.string())
FOLDED = pa.schema([
    ("object_id", pa.string()), ("seq", pa.int64()), ("handoff_id", pa.string()), ("outcome", pa.string()), ("revision_no", pa.int64()), ("representation", pa.string()),
    ("canonical_hash", pa.string()), ("authority_hash", pa.string()), ("values", _MAP), ("set", _MAP), ("remove", pa.list_(pa.string())), ("labels", _MAP), ("conflicts", pa.list_(pa.string())), ("state", pa.string()),
])
_FOLDED_SQL = "object_id string, seq long, handoff_id string, outcome string, revision_no long, representation string, canonical_hash string, authority_hash string, values map<string,string>, set map<string,string>, remove array<string>, labels map<string,string>, conflicts array<string>, state string"
BATCH = 2048


def _fold(profile: Profile):
    labels_of = {r.property: r.label for r in profile.rules}

    def step(s: _State, r: dict) -> dict:
        out = {"object_id": r["object_id"], "seq": r["seq"], "handoff_id": r["handoff_id"]}
        if r["fingerprint"] is not None and s.revision and r["fingerprint"] == s.fingerprint:
            return out | {"outcome": "UNCHANGED", "revision_no": s.revision, "canonical_hash": s.content, "authority_hash": s.authority_hash}
        if code := s.refused(r["mode"], r["base_revision"], r["base_content"]):
            return out | {"outcome": code}
        s.contribute(r["source_id"], r["observed_at"], r["seq"], dict(r["payload"] or ()), r["deletes"] or ())
        values, authority, conflicts = s.choose()
        labels = {p: labels_of.get(p, "OPEN") for p in values}
        content = _digest(f'{{"labels":{_joined((p, json.dumps(x)) for p, x in labels.items())},"values":{_joined(values.items())}}}')
        authority_hash = _digest(_joined(authority.items()))
        out |= {"canonical_hash": content, "authority_hash": authority_hash, "conflicts": conflicts or None}
        if (content, authority_hash) == (s.content, s.authority_hash):
            return out | {"outcome": "UNCHANGED", "revision_no": s.revision}
        whole = s.revision % profile.checkpoint_interval == 0
        out |= {"outcome": "REVISION", "revision_no": s.revision + 1, "representation": "FULL_CHECKPOINT" if whole else "DELTA_PATCH", "labels": sorted(labels.items())}
        if whole:
            out["values"] = sorted(values.items())
        else:
            out["set"] = sorted((p, v) for p, v in values.items() if s.values.get(p) != v)
            out["remove"] = sorted(set(s.values) - set(values))
        s.revision, s.content, s.authority_hash, s.fingerprint, s.values, s.authority = s.revision + 1, content, authority_hash, r["fingerprint"], values, authority
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        current, state = None, None
        made = lambda: pa.RecordBatch.from_pylist(held, FOLDED)
        for b in batches:
            for r in b.to_pylist():
                if state is None or r["object_id"] != current:
                    if state is not None:
                        held.append({"object_id": current, "outcome": "STATE", "state": state.text()})
                    current, state = r["object_id"], _State(profile.rules, r["state"])
                    if r["seq"] is None:
                        continue  # a row that only brings the state
                held.append(step(state, r))
                if len(held) >= BATCH:
                    yield made()
                    held.clear()
        if state is not None:
            held.append({"object_id": current, "outcome": "STATE", "state": state.text()})
            yield made()

    return run


def materialize(observations: DataFrame, profile: Profile, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, states) of observations(object_id, seq, handoff_id, source_id, mode, base_revision,
    base_content, fingerprint, observed_at, payload, deletes), folded by seq in each object.

    payload maps properties to JSON literals; deletes names properties that the source withdraws.
    seq is not null and distinct in an object. results has a row an observation: outcome REVISION
    (with representation FULL_CHECKPOINT and values, or DELTA_PATCH and set and remove), UNCHANGED,
    DELTA_BASE_REQUIRED or DELTA_BASE_MISMATCH; a refused observation contributes nothing.
    states(object_id, state) is what a later batch goes on from; an object without observations in
    this batch keeps its state.
    """
    rows = observations.select(*[F.col(c) for c in OBSERVED]).withColumns({"handoff_id": F.col("handoff_id").cast("string"), "observed_at": F.unix_micros(F.col("observed_at").cast("timestamp")), "state": F.lit(None).cast("string")})
    if states is not None:
        rows = rows.unionByName(states.select("object_id", "state"), allowMissingColumns=True)
    dealt = rows.repartition("object_id").sortWithinPartitions("object_id", F.col("seq").asc_nulls_first())
    out = stored(dealt.mapInArrow(_fold(profile.check()), _FOLDED_SQL), "revisions")
    return out.filter("outcome <> 'STATE'").drop("state"), out.filter("outcome = 'STATE'").select("object_id", "state")


def revisions_of(results: DataFrame) -> DataFrame:
    return results.filter("outcome = 'REVISION'").select("object_id", "revision_no", "representation", "canonical_hash", "values", "set", "remove", "labels")


def segments(revisions: DataFrame) -> DataFrame:
    """Revisions with `checkpoint`: the number of the last checkpoint up to each, null if none."""
    at = F.when(F.col("representation") == "FULL_CHECKPOINT", F.col("revision_no"))
    return revisions.withColumn("checkpoint", F.max(at).over(Window.partitionBy("object_id").orderBy("revision_no").rowsBetween(Window.unboundedPreceding, 0)))


def reconstruct(revisions: DataFrame, wanted: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(object_id, revision_no, status, values, canonical_hash) of the wanted(object_id, revision_no),
    or of all revisions.

    status: OK; REVISION_NOT_FOUND; CHAIN_INVALID if a revision between it and its checkpoint, or the
    checkpoint, is missing; CHAIN_LIMIT beyond `most` of them; HASH_MISMATCH. values are null but
    for OK. Only the revisions of a wanted one's own segment are read with it, so the cost is
    bounded by the checkpoint interval, not by the history.
    """
    seg = segments(revisions)
    heads = seg.select("object_id", "revision_no", "checkpoint", "labels", F.col("canonical_hash").alias("stored_hash"))
    asked = (heads if wanted is None else wanted.select("object_id", "revision_no").distinct().join(heads, ["object_id", "revision_no"], "left")).withColumnRenamed("revision_no", "n")
    gone = F.transform(F.coalesce("remove", F.expr("CAST(array() AS array<string>)")), lambda p: F.struct(p.alias("property"), F.lit(False).alias("here"), F.lit(None).cast("string").alias("value")))
    kept = F.transform(F.map_entries(F.coalesce("values", "set")), lambda e: F.struct(e["key"].alias("property"), F.lit(True).alias("here"), e["value"].alias("value")))
    steps = seg.select("object_id", "checkpoint", F.col("revision_no").alias("m"), F.concat(kept, gone).alias("changes"))
    # a revision reaches those of its segment only: at most `interval` times itself
    pairs = asked.filter("checkpoint IS NOT NULL").select("object_id", "checkpoint", "n").join(steps, ["object_id", "checkpoint"]).filter("m <= n")
    chain = pairs.groupBy("object_id", "n").agg(F.count(F.lit(1)).alias("links"))
    events = pairs.select("object_id", "n", "m", F.explode("changes").alias("c")).groupBy("object_id", "n", "c.property").agg(F.max(F.struct("m", "c.here", "c.value")).alias("last"))
    state = events.filter("last.here").groupBy("object_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("property", "last.value"))).alias("values"))
    out = asked.join(chain, ["object_id", "n"], "left").join(state, ["object_id", "n"], "left")
    values = F.coalesce("values", F.expr("CAST(map() AS map<string,string>)"))
    length = F.col("n") - F.col("checkpoint") + 1
    broken = F.col("checkpoint").isNull() | (F.col("links") != length)
    status = F.when(F.col("stored_hash").isNull(), "REVISION_NOT_FOUND").when(length > most, "CHAIN_LIMIT").when(broken, "CHAIN_INVALID").when(canonical_hash(values, F.col("labels")) != F.col("stored_hash"), "HASH_MISMATCH").otherwise("OK")
    ok = status == "OK"
    return out.select("object_id", F.col("n").alias("revision_no"), status.alias("status"), F.when(ok, values).alias("values"), F.when(ok, F.col("stored_hash")).alias("canonical_hash"))
