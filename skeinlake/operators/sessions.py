"""Sessions, transcripts and the decision ledger: small stateful tables as DataFrames."""

from __future__ import annotations

import hashlib
import hmac
import threading
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import IDLE_NOTICE, LEDGER, SESSIONS, EngineError
from .graph import implements_edges, valid_edges


def next_turn(turns: DataFrame) -> DataFrame:
    """session_id, turn_index: the index that each session's next turn gets."""
    return turns.groupBy("session_id").agg((F.coalesce(F.max("turn_index"), F.lit(-1)) + 1).alias("turn_index"))


def append_turn(turns: DataFrame, session_id: str, role: str, content: str, ts: datetime) -> DataFrame:
    at = turns.where(F.col("session_id") == session_id).agg((F.coalesce(F.max("turn_index"), F.lit(-1)) + 1).cast("int").alias("turn_index"))
    row = at.select(F.lit(session_id).alias("session_id"), "turn_index", F.lit(role).alias("role"), F.lit(content).alias("content"), F.lit(ts).alias("ts"))
    return turns.unionByName(row)


def transcript(turns: DataFrame, session_id: str) -> DataFrame:
    return turns.where(F.col("session_id") == session_id).orderBy("turn_index")


def transcripts(turns: DataFrame) -> DataFrame:
    """session_id, transcript: each session's turns in order (equal turn numbers by role and content),
    a line of role and content each."""
    one = F.struct("turn_index", "role", "content")
    text = F.transform(F.sort_array(F.collect_list(one)), lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return turns.groupBy("session_id").agg(F.array_join(text, "\n").alias("transcript"))


def turn_text(content: Column) -> Column:
    """The text of a turn stored as JSON ({"text": ...}); as it is where it is not."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(content), "$.text", "string"), content)


def trim_context(turns: DataFrame, budget: int, taken: int = 0, length: Column | None = None) -> DataFrame:
    """The newest turns of each session whose characters, with `taken` by what stands before them, fit
    the budget: oldest turns go first. A running sum from the newest turn back."""
    size = F.length("content") if length is None else length
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn_index")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("held", F.sum(size).over(newest)).where(F.col("held") + taken <= budget)


def check_budget(fixed_chars: int, budget: int) -> None:
    if fixed_chars > budget:
        raise EngineError("CONTEXT_BUDGET_EXCEEDED", str(budget))


class SessionQueue:
    """Requests of a session one after the other, on the driver; a session with `depth` of them waiting
    or running takes no more."""

    def __init__(self, depth: int = 5) -> None:
        self._depth, self._guard, self._held = depth, threading.Lock(), {}

    def run(self, session_id: str, request: Callable):
        with self._guard:
            turn, waiting = self._held.get(session_id, (threading.Lock(), 0))
            if waiting >= self._depth:
                raise EngineError("SESSION_BUSY", session_id)
            self._held[session_id] = turn, waiting + 1
        try:
            with turn:
                return request()
        finally:
            with self._guard:
                waiting = self._held[session_id][1] - 1
                if waiting:
                    self._held[session_id] = turn, waiting
                else:
                    del self._held[session_id]


def hash_secret(secret: str, salt: str) -> str:
    """PBKDF2-HMAC-SHA256; another scheme can be passed to decommission()."""
    return salt + "$" + hashlib.pbkdf2_hmac("sha256", secret.encode(), salt.encode(), 100_000).hex()


def verify_secret(secret: str, stored: str | None) -> bool:
    return stored is not None and hmac.compare_digest(hash_secret(secret, stored.partition("$")[0]), stored)


def spawn(sessions: DataFrame, name: str, new_id: str, now: datetime, secret_hash: str | None = None) -> tuple[DataFrame, str, str]:
    """(sessions, id, what): attach to the active session of that name, wake its idle one, or start a
    new one with the next generation; another active name is an error."""
    open_ = sessions.where(F.col("status").isin("active", "idle")).collect()  # at most one of a name is open
    other = [r for r in open_ if r.status == "active" and r.name != name]
    mine = [r for r in open_ if r.name == name]
    if mine and mine[0].status == "active":
        return sessions, mine[0].id, "attached"
    if other:
        raise EngineError("SESSION_ALREADY_ACTIVE", other[0].name)
    if mine:
        return set_status(sessions, mine[0].id, "active", now), mine[0].id, "reactivated"
    last = sessions.agg(F.coalesce(F.max("generation_id"), F.lit(0)) + 1).first()[0]
    row = sessions.sparkSession.createDataFrame([(new_id, name, "active", int(last), secret_hash, now, now)], SESSIONS)
    return sessions.unionByName(row), new_id, "created"


def set_status(sessions: DataFrame, session_id: str, status: str, now: datetime) -> DataFrame:
    mine = F.col("id") == session_id
    return sessions.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))})


def ensure_active(sessions: DataFrame, session_id: str, now: datetime) -> DataFrame:
    found = sessions.where(F.col("id") == session_id).limit(1).collect()
    if not found or found[0].status not in ("active", "idle"):
        raise EngineError("SESSION_NOT_FOUND", session_id)
    return sessions if found[0].status == "active" else set_status(sessions, session_id, "active", now)


def decommission(sessions: DataFrame, turns: DataFrame, session_id: str, secret: str, now: datetime, verify: Callable[[str, str | None], bool] = verify_secret) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns): the session closed and without its secret, its turns deleted."""
    found = sessions.where(F.col("id") == session_id).limit(1).collect()
    if not found:
        raise EngineError("SESSION_NOT_FOUND", session_id)
    if not verify(secret, found[0].secret_hash):
        raise EngineError("DECOMMISSION_DENIED", session_id)
    closed = set_status(sessions, session_id, "decommissioned", now)
    closed = closed.withColumn("secret_hash", F.when(F.col("id") != session_id, F.col("secret_hash")))
    return closed, turns.where(F.col("session_id") != session_id)


def reap_idle(sessions: DataFrame, turns: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Sessions with those idle whose newest turn (or start) is more than `minutes` old."""
    newest = turns.groupBy(F.col("session_id").alias("id")).agg(F.max("ts").alias("newest"))
    stale = F.coalesce("newest", "updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    both = sessions.join(newest, "id", "left")
    return both.withColumn("status", F.when((F.col("status") == "active") & stale, "idle").otherwise(F.col("status"))).select(*sessions.columns)


def idle_notices(sessions: DataFrame, turns: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """The turns (as TURNS) that say of each session that reap_idle puts to rest that it is idle now: after
    its last turn, or its first where it has none."""
    rested = reap_idle(sessions, turns, now, minutes).where("status = 'idle'").join(sessions.where("status = 'active'").select("id"), "id", "left_semi")
    at = rested.select(F.col("id").alias("session_id")).join(next_turn(turns), "session_id", "left")
    return at.select("session_id", F.coalesce("turn_index", F.lit(0)).cast("int").alias("turn_index"), F.lit("system").alias("role"), F.lit(IDLE_NOTICE).alias("content"), now.alias("ts"))


def madr_id(seq: Column) -> Column:
    return F.format_string("MADR-%03d", seq)


def commit_decision(ledger: DataFrame, edges: DataFrame, chunks: DataFrame, decision: dict, impacts_files: list[str], now: datetime) -> tuple[DataFrame, DataFrame, str]:
    """(ledger, edges, id): the decision appended, the one it supersedes marked, and an edge to each
    file that it affects; a file without a live module is an error and nothing changes."""
    spark = ledger.sparkSession
    seq = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
    new_id = f"MADR-{seq:03d}"
    row = {
        "seq": seq, "id": new_id, "generation_id": decision.get("generation_id", 1), "ts": now, "status": decision.get("status", "accepted"),
        "title": decision["title"], "context_and_problem": decision["context_and_problem"], "decision_drivers": decision.get("decision_drivers", []),
        "considered_options": decision.get("considered_options", []), "decision_outcome": decision["decision_outcome"], "supersedes": decision.get("supersedes"),
    }
    made = spark.createDataFrame([tuple(row.values())], LEDGER)
    wanted = implements_edges(spark.createDataFrame([(new_id, impacts_files)], "id string, impacts_files array<string>"))
    good = valid_edges(wanted, chunks.where("not is_deleted"), made)
    if good.count() != len(set(impacts_files)):
        raise EngineError("INVALID_GRAPH_ENDPOINT", ", ".join(impacts_files))
    old = decision.get("supersedes")
    marked = ledger if old is None else ledger.withColumn("status", F.when(F.col("id") == old, "superseded").otherwise(F.col("status")))
    return marked.unionByName(made), edges.unionByName(good).dropDuplicates(), new_id


def superseded(ledger: DataFrame) -> DataFrame:
    """id, superseded_by: what each decision was replaced by."""
    later = ledger.where("supersedes is not null").select(F.col("supersedes").alias("id"), F.col("id").alias("superseded_by"))
    return ledger.select("id").join(later, "id")


def decision_note(ledger: DataFrame) -> DataFrame:
    """id, file_name, note: each decision as a Markdown note with front matter."""
    nl, bullets = F.lit("\n"), lambda c, mark: F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x)), "\n")
    indent = lambda c: F.concat(F.lit("  "), F.regexp_replace(c, "\n", "\n  "))
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("madr_id: "), "id"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("status: "), "status"),
        F.concat(F.lit("timestamp: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.concat(F.lit("generation_id: "), F.col("generation_id").cast("string")),
        F.lit("context_and_problem: |"), indent("context_and_problem"), F.lit("decision_drivers:"), bullets("decision_drivers", "  - "),
        F.lit("considered_options:"), bullets("considered_options", "  - "), F.lit("decision_outcome: |"), indent("decision_outcome"),
        F.concat(F.lit("supersedes_madr: "), F.coalesce("supersedes", F.lit(""))), F.lit("---"),
    )
    body = F.concat_ws(
        "\n\n", front, F.concat(F.lit("# "), "id", F.lit(" — "), "title"), F.when(F.col("supersedes").isNotNull(), F.concat(F.lit("> This decision supersedes [["), "supersedes", F.lit("]]"))),
        F.concat(F.lit("## Context and Problem"), nl, F.col("context_and_problem")), F.concat(F.lit("## Decision Drivers"), nl, bullets("decision_drivers", "- ")),
        F.concat(F.lit("## Considered Options"), nl, bullets("considered_options", "- ")), F.concat(F.lit("## Decision Outcome"), nl, F.col("decision_outcome")),
    )
    return ledger.select("id", F.concat("id", F.lit("-"), X.title_slug(F.col("title")), F.lit(".md")).alias("file_name"), body.alias("note"))
