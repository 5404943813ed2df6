"""Fixing text that arrives in batches.

A message (session, message, turn) comes as numbered batches. A batch is shown fixed once
all earlier ones are there: the prefix and the batch are fixed together and the lines of the
prefix are skipped. Whatever goes wrong shows the original and leaves one diagnostics row;
it never loses text.

``Message`` holds the logic as plain Python over one key's state; ``display`` runs it in
Structured Streaming with ``applyInPandasWithState``; ``start`` writes its answers and its
diagnostics; ``replay_batches`` is the batch form.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosemill.functions.text import iso_timestamp
from prosemill.operators.fix import fix
from prosemill.operators.one_text import fix_text, unclosed_run
from prosemill.plans.config import Config, resolve

EVENT = "hook_event_name string, session_id string, message_id string, turn_id string, `index` bigint, delta string, final boolean, cwd string"
ANSWER = "session_id string, message_id string, turn_id string, `index` bigint, shown string, step string, kind string"
#: Limits of a message.
MOST_BATCHES, MOST_BYTES, WAIT_MS, KEEP_MS = 1000, 256 * 1024, 2000, 3_600_000
#: Environment variable that, where it is not empty, keeps ``start`` from starting anything.
DISABLE = "PROSEMILL_HOOK_DISABLE"


def events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Display events of JSON rows; what is no object, lacks an id, an integer index or a string delta is dropped."""
    e = raw.select(F.from_json(F.col(column).cast("string"), EVENT).alias("e"), F.get_json_object(F.col(column).cast("string"), "$.index").alias("i")).select("e.*", "i")
    return e.where("hook_event_name = 'MessageDisplay' and session_id <> '' and message_id <> '' and turn_id is not null and delta is not null").where(F.col("i").rlike("^[0-9]+$")).drop("i")


@dataclass
class Message:
    """State of one message: batches by index, a void marker, and batches that wait."""

    parts: dict[int, str] = field(default_factory=dict)
    void: bool = False
    waiting: dict[int, tuple[bool, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bytes = sum(len(p.encode()) for p in self.parts.values())

    def store(self, index: int, delta: str) -> str | None:
        """A failure kind, or None. The same batch twice is the same batch; another text under one index voids the message."""
        if self.void:
            return "void"
        if self.parts.get(index, delta) != delta:
            self.void = True
            return "conflict"
        if index not in self.parts:
            self.bytes += len(delta.encode())
        self.parts[index] = delta
        if len(self.parts) > MOST_BATCHES or self.bytes > MOST_BYTES:
            self.void = True
            return "limit"
        return None

    def ready(self, index: int) -> bool:
        return all(i in self.parts for i in range(index))

    def show(self, index: int, final: bool, fixer) -> tuple[str | None, str | None, str | None]:
        """(shown, step, kind): the fixed batch, None where it is as it was; step and kind where the original stays for a reason."""
        delta = self.parts[index]
        prefix = "".join(self.parts[i] for i in range(index))
        if (prefix and not prefix.endswith("\n")) or (not final and not delta.endswith("\n")):
            return None, "fix", "partial"
        whole = prefix + delta
        if not final and unclosed_run(whole):
            return None, "fix", "unclosed"
        fixed = fixer(whole)
        if fixed.count("\n") != whole.count("\n") or fixed.endswith("\n") != whole.endswith("\n"):
            return None, "fix", "failed"
        shown = "\n".join(fixed.split("\n")[prefix.count("\n") :])
        return (shown if shown != delta else None), None, None

    def arrive(self, index: int, delta: str, final: bool, now: float, fixer) -> list[tuple[int, str | None, str | None, str | None]]:
        """Rows (index, shown, step, kind) that this batch lets out, those of waiting batches included."""
        if failed := self.store(index, delta):
            return [(index, None, "siblings", failed)]
        if not delta:
            return []
        self.waiting[index] = (final, now)
        out = []
        for i in sorted(self.waiting):
            if self.ready(i):
                out.append((i, *self.show(i, self.waiting.pop(i)[0], fixer)))
        return [r for r in out if r[1] is not None or r[2] is not None]

    def expire(self, now: float) -> list[tuple[int, str | None, str | None, str | None]]:
        """Batches that waited too long for an earlier one are shown as they are; the message stays good."""
        late = [i for i, (_, at) in self.waiting.items() if now - at >= WAIT_MS / 1000]
        for i in late:
            self.waiting.pop(i)
        return [(i, None, "siblings", "incomplete") for i in sorted(late)]


def configs_of(folders: Iterable[str]) -> dict[str, Config]:
    """The configuration of each working folder, read here on the driver: executors may not see those folders."""
    return {f: resolve(f) for f in folders}


def display(batches: DataFrame, fixer: Callable[[str], str] | None = None, wait_ms: int = WAIT_MS, configs: Mapping[str, Config] | None = None) -> DataFrame:
    """Streaming: one row for each batch whose display changes or fails.

    Without a ``fixer`` (text -> fixed text), ``fix_text`` fixes under the configuration of the
    event's ``cwd`` in ``configs``, or under the default one where it has none.
    """
    known = dict(configs or {})
    state_schema = "indexes array<bigint>, deltas array<string>, void boolean, waiting array<bigint>, finals array<boolean>, since array<double>"

    def run(key, frames, state: GroupState):
        m = Message()
        if state.exists:
            indexes, deltas, void, waiting, finals, since = state.get
            m = Message(dict(zip(indexes, deltas, strict=True)), void, {i: (f, s) for i, f, s in zip(waiting, finals, since, strict=True)})
        now, rows = time.time(), []
        if state.hasTimedOut:
            rows = m.expire(now)
            if not rows and not m.waiting:
                state.remove()
                return
        else:
            for pdf in frames:
                for r in pdf.sort_values("index", kind="stable").itertuples():
                    try:
                        config = known.get(r.cwd)
                        rows += m.arrive(int(r.index), r.delta, bool(r.final), now, fixer or (lambda t, c=config: fix_text(t, c)))
                    except Exception:  # fail open: the original stays on display
                        rows.append((int(r.index), None, "fix", "failed"))
        state.update((list(m.parts), list(m.parts.values()), m.void, list(m.waiting), [f for f, _ in m.waiting.values()], [s for _, s in m.waiting.values()]))
        state.setTimeoutDuration(wait_ms if m.waiting else KEEP_MS)
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=["session_id", "message_id", "turn_id", "index", "shown", "step", "kind"])

    keyed = batches.select("session_id", "message_id", "turn_id", "index", "delta", F.coalesce("final", F.lit(False)).alias("final"), "cwd")
    return keyed.groupBy("session_id", "message_id", "turn_id").applyInPandasWithState(run, ANSWER, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def answers(rows: DataFrame) -> DataFrame:
    """value: the answer as one line of JSON, for batches whose display changes; characters beyond ASCII stay themselves."""
    shown = F.struct(F.lit("MessageDisplay").alias("hookEventName"), F.col("shown").alias("displayContent"))
    return rows.where("shown <> ''").select(F.to_json(F.struct(shown.alias("hookSpecificOutput"))).alias("value"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """Rows for the log: when, which message, which step, which kind; never the text."""
    return rows.where("kind is not null").select(iso_timestamp(F.current_timestamp()).alias("at"), "message_id", "step", "kind")


def start(raw: DataFrame, shown: str, log: str, checkpoint: str, configs: Mapping[str, Config] | None = None, env: Mapping[str, str] = os.environ):
    """Start the stream over JSON events: answers appended to ``shown`` as text, diagnostics to ``log`` as JSON lines.

    Returns the running query, or None where the environment variable ``DISABLE`` is not empty.
    """
    if env.get(DISABLE):
        return None

    def both(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            answers(rows).write.mode("append").text(shown)
            diagnostics(rows).write.mode("append").json(log)
        finally:
            rows.unpersist()

    return display(events(raw), configs=configs).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(both).start()


def replay_batches(batches: DataFrame, config: Config | None = None) -> DataFrame:
    """message_id, index, shown: each batch of a complete message, fixed as part of the whole.

    The batch form of the stream: a message is fixed once, and each batch takes its own lines
    of the result. Batches must end in a line end; the last may lack it.
    """
    w = Window.partitionBy("message_id").orderBy("index")
    lines = F.length("delta") - F.length(F.replace("delta", F.lit("\n"), F.lit("")))
    b = batches.withColumn("_n", lines.cast("int"))
    b = b.withColumn("_from", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    whole = b.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "delta"))), lambda x: x["delta"]), "").alias("text"))
    # Messages are numbered by hash for the fixer, which names documents by a number.
    whole = whole.select("message_id", F.xxhash64("message_id").alias("doc_id"), "text")
    done = fix(whole, config).join(whole.select("message_id", "doc_id"), "doc_id")
    parts = F.split("fixed", "\n", -1)
    own = F.slice(parts, F.col("_from") + 1, F.col("_n") + F.when(F.endswith("delta", F.lit("\n")), 0).otherwise(1))
    return b.join(done, "message_id").select("message_id", "index", F.concat(F.array_join(own, "\n"), F.when(F.endswith("delta", F.lit("\n")), "\n").otherwise("")).alias("shown"))
