"""A queue of jobs with leases, delayed retries and cancelling, and guarded updates of vaults, folded over their events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.fold import fold

JOB = "status string, available_at long, retries int, applied boolean"
WAITING = ("pending", "retrying")


def job_step(state: dict, event: dict) -> dict:
    """What an event does to a job; ``applied`` tells whether it did anything.

    enqueue: pending at once, once only. lease: of a waiting job whose time has come. complete: of a leased job. fail and
    cancel: of any job. requeue: retrying after ``delay`` seconds. expire: a leased job whose lease is ``delay`` seconds old waits again;
    leases don't expire by themselves.
    """
    action, at, delay = event["action"], event["moment"], int(event["delay"] or 0)
    status, applied = state.get("status"), True
    if action == "enqueue" and status is None:
        state |= {"status": "pending", "available_at": at, "retries": 0}
    elif action == "lease" and status in WAITING and state["available_at"] <= at:
        state |= {"status": "leased", "leased_at": at}
    elif action == "complete" and status == "leased":
        state["status"] = "completed"
    elif action == "fail" and status is not None:
        state["status"] = "failed"
    elif action == "cancel" and status is not None:
        state["status"] = "cancelled"
    elif action == "requeue" and status is not None:
        state |= {"status": "retrying", "available_at": at + delay, "retries": state["retries"] + 1}
    elif action == "expire" and status == "leased" and state["leased_at"] + delay <= at:
        state |= {"status": "pending", "available_at": at}
    else:
        applied = False
    return {"status": state.get("status"), "available_at": state.get("available_at"), "retries": state.get("retries"), "applied": applied}


def job_history(events: DataFrame) -> DataFrame:
    """events(job_id, moment, event_id, action, delay) with the job's state after each; times are whole seconds."""
    return fold(events, ["job_id"], ["moment", "event_id"], dict, job_step, JOB)


def jobs_now(history: DataFrame) -> DataFrame:
    """Each job's latest state; jobs of which no event applied have a null status."""
    last = F.max_by(F.struct("status", "available_at", "retries"), F.struct("moment", "event_id"))
    return history.groupBy("job_id").agg(last.alias("j"), F.count_if("applied").alias("n_applied")).select("job_id", "j.*", "n_applied")


def ready(jobs: DataFrame, at: int, n: int) -> DataFrame:
    """The next n jobs to lease: waiting ones whose time has come, the most urgent, then the oldest first. jobs have priority and created_at."""
    waiting = jobs.where(F.col("status").isin(*WAITING) & (F.col("available_at") <= at))
    return waiting.orderBy(F.desc("priority"), "created_at", "job_id").limit(n)


def job_stream(events: DataFrame) -> DataFrame:
    """The latest state of each job of which a micro-batch has events: job_id, status, available_at, retries, n_applied.

    The state is kept with the stream's checkpoint, so a restart goes on from it. Events of one batch are taken in the order of moment and event_id; an event that
    comes in a later batch than its successors is applied when it comes.
    """
    held = "status string, available_at long, retries int, leased_at long, n_applied long"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in held.split(", ")]
        job: dict[str, Any] = {k: v for k, v in zip(names, state.get) if v is not None} if state.exists else {}
        n = int(job.pop("n_applied", 0))
        rows = pd.concat(list(parts)).sort_values(["moment", "event_id"])
        for event in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            n += job_step(job, event)["applied"]
        state.update((job.get("status"), job.get("available_at"), job.get("retries"), job.get("leased_at"), n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [job.get("status")], "available_at": [job.get("available_at")], "retries": [job.get("retries")], "n_applied": [n]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, available_at long, retries int, n_applied long", held, "update", GroupStateTimeout.NoTimeout)


VAULT = "accepted boolean, reason string, has_entity boolean, profile string, n_conflicts int, n_open int"


def vault_step(state: dict, op: dict) -> dict:
    """What an update does to a vault's entity: ``reason`` tells why it was refused.

    An entity is added once; it is removed if it has neither a profile nor any conflict, whatever its state. Profiles and conflicts need the entity. A
    conflict is registered once and resolved or dismissed while it is open.
    """
    conflicts = state.setdefault("conflicts", {})
    kind, has, profile, conflict = op["op"], state.get("entity", False), state.get("profile"), op["conflict_id"]
    reason = None
    if kind == "add_entity":
        reason = "exists" if has else None
    elif not has:
        reason = "no_entity"
    elif kind == "remove_entity":
        reason = "has_profile" if profile is not None else "has_conflicts" if conflicts else None
    elif kind == "remove_profile":
        reason = "no_profile" if profile is None else None
    elif kind == "register_conflict":
        reason = "registered" if conflict in conflicts else None
    elif kind in ("resolve_conflict", "dismiss_conflict"):
        reason = "no_conflict" if conflict not in conflicts else "not_open" if conflicts[conflict] != "open" else None
    elif kind != "update_profile":
        reason = "unknown"
    if reason is None:
        if kind in ("add_entity", "remove_entity"):
            state["entity"] = kind == "add_entity"
        elif kind in ("update_profile", "remove_profile"):
            state["profile"] = op["value"] or "" if kind == "update_profile" else None
        else:
            conflicts[conflict] = {"register_conflict": "open", "resolve_conflict": "resolved", "dismiss_conflict": "dismissed"}[kind]
    return {"accepted": reason is None, "reason": reason, "has_entity": state.get("entity", False), "profile": state.get("profile"), "n_conflicts": len(conflicts), "n_open": sum(s == "open" for s in conflicts.values())}


def vault_history(updates: DataFrame) -> DataFrame:
    """updates(vault_id, entity_id, seq, op, conflict_id, value) with whether each was accepted, and the entity's state after it.

    Guards of an update only look at its own entity, so entities are folded apart, each in the order of seq; a refused update changes nothing.
    """
    return fold(updates, ["vault_id", "entity_id"], ["seq"], dict, vault_step, VAULT)


def vault_at(history: DataFrame, seq: int) -> DataFrame:
    """The entities of each vault as they were after update ``seq``: vault_id, entity_id, profile, n_conflicts, n_open, version (the last accepted update)."""
    past = history.where((F.col("seq") <= seq) & F.col("accepted"))
    last = past.groupBy("vault_id", "entity_id").agg(F.max_by(F.struct("has_entity", "profile", "n_conflicts", "n_open", F.col("seq").alias("version")), "seq").alias("s"))
    return last.where("s.has_entity").select("vault_id", "entity_id", "s.profile", "s.n_conflicts", "s.n_open", "s.version")
