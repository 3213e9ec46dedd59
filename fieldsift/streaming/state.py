"""Keyed state over review and candidate events that may arrive in any order, in as many batches as they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _whole(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


class _Decision(StatefulProcessor):
    """The newest decision of a photo and its last review row: two small values a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.review = handle.getValueState("review", "seq long")
        self.decision = handle.getValueState("decision", "seq long, reviewSeq long, action string")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802  the interface's name
        review = self.review.get()[0] if self.review.exists() else None
        decision = tuple(self.decision.get()) if self.decision.exists() else None
        for batch in rows:
            for kind, seq, on, action in zip(batch["kind"], batch["seq"], batch["reviewSeq"], batch["action"], strict=True):
                if kind == "review":
                    review = int(seq) if review is None else max(review, int(seq))
                elif decision is None or int(seq) > decision[0]:
                    decision = (int(seq), _whole(on), action)
        if review is not None:
            self.review.update((review,))
        if decision is not None:
            self.decision.update(decision)
            active = decision[1] == review
            yield pd.DataFrame({"fileId": [key[0]], "seq": [decision[0]], "action": [decision[2]], "active": [active]})

    def close(self) -> None:
        pass


def decision_states(stream: DataFrame) -> DataFrame:
    """`fileId, seq, action, active` after each batch, for the photos that it touches.

    `stream`: fileId, kind (`review` or `decision`), seq, reviewSeq (the review row that a decision was taken on; null:
    there was none), action. A review that comes later ends a decision, whichever of the two arrives first.
    """
    rows = stream.select("fileId", "kind", "seq", "reviewSeq", "action")
    return rows.groupBy("fileId").transformWithStateInPandas(_Decision(), "fileId string, seq long, action string, active boolean", "Update", "None")


#: Columns of candidate events; `kind` is propose, approve or reject.
CANDIDATE = "candidateId string, seq long, kind string, label string, definition string, excludes string, basis string, fileIds array<string>"
STATES = "candidateId string, status string, label string, definition string, fileIds array<string>, closedSeq long, refused long"


def complete(definition: str | None, excludes: str | None, basis: str | None) -> bool:
    """An approval must say what the class is, what it is not, and on what grounds."""
    return all((x or "").strip() for x in (definition, excludes, basis))


def candidate_after(events: list[dict]) -> dict | None:
    """State of a candidate after its events in order of `seq`; None as long as nobody has proposed it.

    proposed -> approved or rejected, which is final. File ids of proposals add up; a proposal after the end, a decision
    before the first proposal or after the end, and an incomplete approval are refused.
    """
    state, refused = None, 0
    for e in sorted(events, key=lambda e: e["seq"]):
        closed = state is not None and state["status"] != "proposed"
        if e["kind"] == "propose" and not closed:
            files = set(state["fileIds"] if state else []) | set(e["fileIds"])
            state = {"status": "proposed", "label": e["label"], "definition": e["definition"], "fileIds": files, "closedSeq": None}
        elif e["kind"] == "reject" and state and not closed:
            state = {**state, "status": "rejected", "definition": e["definition"], "closedSeq": e["seq"]}
        elif e["kind"] == "approve" and state and not closed and e["complete"]:
            state = {**state, "status": "approved", "definition": e["definition"], "closedSeq": e["seq"]}
        else:
            refused += 1
    return state and {**state, "fileIds": sorted(state["fileIds"]), "refused": refused}


def candidate_states(stream: DataFrame) -> DataFrame:
    """State of each candidate that a batch touches (`STATES`), as `candidate_after` has it; `stream` has the columns of `CANDIDATE`.

    The state held is the events of a candidate, which are few; what follows from them does not depend on the order of
    arrival. Both are columns, so no event leaves the engine.
    """
    said = lambda c: F.coalesce(F.col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
    files = F.coalesce("fileIds", F.array().cast("array<string>")).alias("fileIds")
    event = F.struct("seq", "kind", "label", "definition", (said("definition") & said("excludes") & said("basis")).alias("complete"), files)
    held = stream.groupBy("candidateId").agg(F.array_sort(F.collect_list(event)).alias("events"))
    proposed = F.filter("events", lambda e: e["kind"] == "propose")
    begun = held.withColumn("first", F.get(proposed, F.lit(0))["seq"]).filter(F.col("first").isNotNull())
    decides = lambda e: (e["seq"] > F.col("first")) & ((e["kind"] == "reject") | ((e["kind"] == "approve") & e["complete"]))
    ended = begun.withColumn("end", F.get(F.filter("events", decides), F.lit(0)))
    open_ = lambda e: (e["kind"] == "propose") & (F.col("end").isNull() | (e["seq"] < F.col("end.seq")))
    taken = ended.withColumn("taken", F.filter("events", open_)).withColumn("last", F.element_at("taken", -1))
    closed = F.col("end").isNotNull()
    return taken.select(
        "candidateId", F.when(~closed, "proposed").when(F.col("end.kind") == "approve", "approved").otherwise("rejected").alias("status"), F.col("last.label").alias("label"),
        F.when(closed, F.col("end.definition")).otherwise(F.col("last.definition")).alias("definition"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("taken", lambda e: e["fileIds"])))).alias("fileIds"),
        F.col("end.seq").alias("closedSeq"), (F.size("events") - F.size("taken") - closed.cast("int")).cast("long").alias("refused"),
    )


def candidates_of(events: DataFrame) -> DataFrame:
    """The same states from a whole log, by aggregates: the batch counterpart of `candidate_states`."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    proposes = F.col("kind") == "propose"
    decides = (F.col("kind") == "reject") | ((F.col("kind") == "approve") & said("definition") & said("excludes") & said("basis"))
    first = events.filter(proposes).groupBy("candidateId").agg(F.min("seq").alias("__first"))
    rows = events.join(first, "candidateId")
    ends = rows.filter(decides & (F.col("seq") > F.col("__first"))).groupBy("candidateId").agg(F.min(F.struct("seq", "kind", "definition")).alias("__end"))
    rows = rows.join(ends, "candidateId", "left")
    open_ = F.col("__end").isNull() | (F.col("seq") < F.col("__end.seq"))
    taken = (proposes & open_) | F.coalesce(F.col("seq") == F.col("__end.seq"), F.lit(False))
    last = F.max_by(F.when(proposes, F.struct("label", "definition")), F.when(proposes & open_, F.col("seq")))
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(proposes & open_, F.col("fileIds"))))))
    out = rows.groupBy("candidateId").agg(F.max("__end").alias("__end"), last.alias("__last"), files.alias("fileIds"), F.count_if(~taken).alias("refused"))
    status = F.when(F.col("__end").isNull(), F.lit("proposed")).when(F.col("__end.kind") == "approve", F.lit("approved")).otherwise(F.lit("rejected"))
    definition = F.when(F.col("__end").isNull(), F.col("__last.definition")).otherwise(F.col("__end.definition"))
    return out.select("candidateId", status.alias("status"), F.col("__last.label").alias("label"), definition.alias("definition"), "fileIds", F.col("__end.seq").alias("closedSeq"), "refused")
