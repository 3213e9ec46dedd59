"""Stream queries that are fed the event table in several parts, some of them out of order."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldsift.plans import bindings as B
from fieldsift.plans.catalogue import query
from fieldsift.session import scratch_path
from fieldsift.sources import events
from fieldsift.streaming import feeds, registry, state


def _parts(rows: DataFrame, by: Column, order: list[int]) -> list[DataFrame]:
    return [rows.filter(F.pmod(by, F.lit(len(order))) == n) for n in order]


def _review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as reviews and decisions of photos: every other decision is taken on the photo's last review."""
    e = B.table(spark, sf_dir, "events").withColumn("fileId", F.concat(F.lit("f"), F.col("user_id")))
    review = F.col("event_type") == "view"
    last = e.filter(review).groupBy("fileId").agg(F.max("event_id").alias("last"))
    on = F.when(F.col("event_id") % 2 == 0, F.col("last")).otherwise(F.col("event_id") - 1)
    kind = F.when(review, F.lit("review")).otherwise(F.lit("decision"))
    return e.join(last, "fileId", "left").select(
        "fileId", kind.alias("kind"), F.col("event_id").alias("seq"), F.when(~review, on).alias("reviewSeq"), F.when(~review, F.col("event_type")).alias("action")
    )


@query("""WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'view' GROUP BY 1),
    d AS (SELECT e.*, CASE WHEN event_id % 2 = 0 THEN last ELSE event_id - 1 END AS o, last, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
        FROM events e LEFT JOIN l USING (user_id) WHERE event_type <> 'view')
    SELECT 'f' || user_id AS "fileId", event_id AS seq, event_type AS action, o IS NOT DISTINCT FROM last AS active FROM d WHERE n = 1""")
def stream_active_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(_review_log(spark, sf_dir), F.col("seq"), [2, 0, 1])
    with state.rocks(spark):
        return feeds.Feed(spark).newest(parts, state.decision_states, ["fileId"])


def _candidate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as proposals of classes, now and then approved (some without grounds) or rejected."""
    n, kind = F.col("event_id"), F.col("event_type")
    what = F.when((kind == "signup") & (n % 40 == 3), F.lit("approve")).when((kind == "error") & (n % 40 == 7), F.lit("reject")).otherwise(F.lit("propose"))
    return B.table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id")).alias("candidateId"), n.alias("seq"), what.alias("kind"), F.concat(F.lit("trade-"), kind).alias("label"),
        F.concat(F.lit("d"), n % 10).alias("definition"), F.when(n % 3 > 0, F.lit("not this")).alias("excludes"), F.lit("tree").alias("basis"),
        F.array(F.concat(F.lit("f"), n % 13)).alias("fileIds"),
    )


_CANDIDATES = """WITH e AS (SELECT 'c' || user_id AS id, event_id AS seq, CASE WHEN event_type = 'signup' AND event_id % 40 = 3 THEN 'approve'
        WHEN event_type = 'error' AND event_id % 40 = 7 THEN 'reject' ELSE 'propose' END AS kind, 'trade-' || event_type AS label, 'd' || event_id % 10 AS definition, event_id % 3 > 0 AS whole, 'f' || event_id % 13 AS file FROM events),
    f AS (SELECT id, min(seq) AS first FROM e WHERE kind = 'propose' GROUP BY id),
    c AS (SELECT id, min(seq) AS endSeq, arg_min(kind, seq) AS how, arg_min(definition, seq) AS said FROM e JOIN f USING (id) WHERE seq > first AND (kind = 'reject' OR (kind = 'approve' AND whole)) GROUP BY id),
    r AS (SELECT e.*, endSeq, how, said, kind = 'propose' AND (endSeq IS NULL OR seq < endSeq) AS taken FROM e JOIN f USING (id) LEFT JOIN c USING (id))
    SELECT id AS "candidateId", CASE any_value(how) WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'proposed' END AS status, arg_max(label, seq) FILTER (taken) AS label,
        coalesce(any_value(said), arg_max(definition, seq) FILTER (taken)) AS definition, array_to_string(list_sort(list(DISTINCT file) FILTER (taken)), ',') AS files,
        any_value(endSeq) AS "closedSeq", count(*) FILTER (NOT taken AND seq IS DISTINCT FROM endSeq) AS refused FROM r GROUP BY id"""


def _candidate_rows(states: DataFrame) -> DataFrame:
    return states.select("candidateId", "status", "label", "definition", F.array_join("fileIds", ",").alias("files"), "closedSeq", "refused")


@query(_CANDIDATES)
def stream_candidate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(_candidate_log(spark, sf_dir), F.col("seq"), [1, 2, 0])
    with state.rocks(spark):
        return _candidate_rows(feeds.Feed(spark).newest(parts, state.candidate_states, ["candidateId"]))


@query(_CANDIDATES)
def candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_rows(state.candidates_of(_candidate_log(spark, sf_dir)))


@query("""WITH t AS (SELECT max(event_id // 2 + 1) AS top FROM events WHERE event_id % 2 = 0),
    s AS (SELECT event_type, user_id, CASE WHEN event_id % 2 = 0 THEN event_id // 2 + 1 ELSE top + (event_id + 1) // 2 END AS seq FROM events, t)
    SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS entity, max(seq) AS seq, 2 AS version FROM s GROUP BY ALL""")
def event_log_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches made on valid expectations, and one on a state that has moved on, which leaves no trace."""
    e = B.table(spark, sf_dir, "events")
    even, own = F.col("event_id") % 2 == 0, [F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("entity")]
    rows = e.select(*own, F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"), F.ceil(F.col("event_id") / 2).alias("pos"), even.alias("even"))
    first = rows.filter("even").withColumn("pos", F.col("pos") + 1)
    log = events.EventLog(spark, scratch_path(spark, "log"))
    log.append(first, first.select("kind", "entity", F.lit(0).alias("seq")).distinct())
    log.append(rows.filter("not even"), first.groupBy("kind", "entity").agg(F.max("pos").alias("seq")))
    with suppress(events.StaleAppend):
        log.append(first, first.select("kind", "entity", F.lit(0).alias("seq")).distinct())
    return log.heads().select("kind", "entity", "seq", F.lit(log.version()[0]).alias("version"))


PREDICTION = "predictionId string, fileId string, imageSha256 string, modelVersion string, modelSha256 string, catalogVersion string, seq long"


def _identity(number: Column, version: Column) -> list[Column]:
    """The identity columns of the prediction with this number."""
    file = F.concat(F.lit("f"), number % 977)
    return [
        F.concat(F.lit("p"), number).alias("predictionId"), file.alias("fileId"), F.sha2(file, 256).alias("imageSha256"), version.alias("modelVersion"),
        F.concat(F.lit("m"), version).alias("modelSha256"), F.concat(F.lit("c"), number % 5).alias("catalogVersion"),
    ]


def _half(of: int) -> Column:
    return F.floor(F.col("event_id") / of).cast("long")


def _recorded(spark: SparkSession, sf_dir: str) -> registry.Registry:
    """Every prediction arrives twice, in three parts; after an error it names another model version."""
    version = F.when(F.col("event_type") == "error", F.lit("v2")).otherwise(F.lit("v1"))
    rows = B.table(spark, sf_dir, "events").select(*_identity(_half(2), version), F.col("event_id").alias("seq"))
    held = registry.Registry(spark, scratch_path(spark, "predictions"), "predictionId", registry.IDENTITY, StructType.fromDDL(PREDICTION), "seq")
    feeds.Feed(spark).run(_parts(rows, F.col("seq"), [0, 1, 2]), lambda s: s, lambda batch, n: held.upsert(batch, n) and None)
    return held


_PREDICTIONS = """p AS (SELECT event_id // 2 AS k, event_id AS seq, CASE event_type WHEN 'error' THEN 'v2' ELSE 'v1' END AS v FROM events),
    first AS (SELECT k, arg_min(seq, (seq % 3) * 1000000000000 + seq) AS seq, arg_min(v, (seq % 3) * 1000000000000 + seq) AS v FROM p GROUP BY k)"""


@query(f"""WITH {_PREDICTIONS} SELECT 'p' || k AS "predictionId", 'recorded' AS kind, seq, v AS "modelVersion", seq AS recorded FROM first
    UNION ALL SELECT 'p' || k, 'conflict', p.seq, p.v, first.seq FROM p JOIN first USING (k) WHERE p.v <> first.v""")
def stream_prediction_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _recorded(spark, sf_dir)
    columns = ["predictionId", "kind", "seq", "modelVersion", "recorded"]
    rows = held.rows().withColumn("kind", F.lit("recorded")).withColumn("recorded", F.col("seq")).select(*columns)
    return rows.unionByName(held.conflicts().withColumn("kind", F.lit("conflict")).select(*columns))


FEEDBACK = f"eventId string, {PREDICTION}, action string, selectedClass string, candidateLabel string"


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as feedback that arrives in pairs of one id; some break a rule, name no prediction or another class."""
    number, value, kind = _half(4), F.col("value"), F.col("event_type")
    names = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chosen"), F.col("n_name").alias("name"))
    action = F.when(kind == "purchase", F.lit("correct")).when(kind == "signup", F.lit("new_candidate")).otherwise(F.lit("agree"))
    e = B.table(spark, sf_dir, "events").withColumn("chosen", F.col("user_id") % 25).join(F.broadcast(names), "chosen")  # 25 nations
    chosen = F.when((kind == "purchase") & (value >= 5) | (kind == "view") & (value < 5), F.col("name"))
    label = F.when((kind == "signup") & (value >= 5), F.lit("trade-new"))
    identity = _identity(number, F.lit("v1"))
    unknown = F.when(F.col("event_id") % 11 < 2, F.concat(F.lit("q"), number)).otherwise(F.concat(F.lit("p"), number))
    id_ = F.concat(F.lit("e"), _half(2)).alias("eventId")
    return e.select(id_, unknown.alias("predictionId"), *identity[1:], F.col("event_id").alias("seq"), action.alias("action"), chosen.alias("selectedClass"), label.alias("candidateLabel"))


@query(f"""WITH {_PREDICTIONS},
    r AS (SELECT event_id AS seq, event_id // 2 AS id, event_id // 4 AS k, CASE WHEN event_id % 11 < 2 THEN 'q' ELSE 'p' END AS q,
        CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN 'new_candidate' ELSE 'agree' END AS action,
        CASE WHEN (event_type = 'purchase' AND value >= 5) OR (event_type = 'view' AND value < 5) THEN n_name END AS sel, CASE WHEN event_type = 'signup' AND value >= 5 THEN 'trade-new' END AS label, n_regionkey AS region
        FROM events JOIN nation ON n_nationkey = user_id % 25),
    b AS (SELECT *, CASE WHEN action = 'correct' AND sel IS NULL THEN 'correct requires selectedClass' WHEN action <> 'correct' AND sel IS NOT NULL THEN 'selectedClass is only valid for correct'
        WHEN action = 'new_candidate' AND label IS NULL THEN 'new_candidate requires candidateLabel' END AS broken FROM r),
    m AS (SELECT b.*, CASE WHEN q = 'q' OR first.k IS NULL THEN 'prediction' ELSE concat_ws(',', CASE WHEN first.v <> 'v1' THEN 'modelVersion,modelSha256' END, CASE WHEN sel IS NOT NULL AND region <> b.k % 5 THEN 'selectedClass' END) END AS mismatch
        FROM b LEFT JOIN first ON first.k = b.k WHERE broken IS NULL),
    g AS (SELECT *, q || k || '/' || action || '/' || coalesce(sel, '-') || '/' || coalesce(label, '-') AS payload FROM m WHERE mismatch = ''),
    h AS (SELECT *, first_value(seq) OVER w AS fs, first_value(payload) OVER w AS fp FROM g WINDOW w AS (PARTITION BY id ORDER BY seq % 2 DESC, seq))
    SELECT 'e' || id AS "eventId", seq, 'rejected' AS outcome, broken AS why FROM b WHERE broken IS NOT NULL
    UNION ALL SELECT 'e' || id, seq, 'mismatched', mismatch FROM m WHERE mismatch <> ''
    UNION ALL SELECT 'e' || id, seq, 'recorded', '' FROM h WHERE seq = fs
    UNION ALL SELECT 'e' || id, seq, 'conflict', CAST(fs AS VARCHAR) FROM h WHERE payload <> fp""")
def stream_feedback_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every feedback event: odd ones arrive first, and every part is delivered a second time."""
    predictions = _recorded(spark, sf_dir).rows()
    nation = B.table(spark, sf_dir, "nation")
    classes = nation.groupBy(F.concat(F.lit("c"), "n_regionkey").alias("catalogVersion")).agg(F.collect_set("n_name").alias("classes"))
    schema = StructType.fromDDL(FEEDBACK)
    identity = [c for c in schema.names if c not in ("eventId", "seq")]
    held = registry.Registry(spark, scratch_path(spark, "feedback"), "eventId", identity, schema, "seq")
    intake = registry.Intake(held, predictions, classes)

    def take(batch: DataFrame, number: int) -> None:
        intake.take(batch, number)
        intake.take(batch, number)

    feeds.Feed(spark).run(_parts(_feedback(spark, sf_dir), F.col("seq"), [1, 0]), lambda s: s, take)
    one = lambda rows, outcome, why: rows.select("eventId", "seq", F.lit(outcome).alias("outcome"), why.alias("why"))
    return (
        one(intake.rejects(), "rejected", F.array_join("broken", ","))
        .unionByName(one(intake.mismatched(), "mismatched", F.array_join("mismatch", ",")))
        .unionByName(one(held.rows(), "recorded", F.lit("")))
        .unionByName(one(held.conflicts(), "conflict", F.col("recorded").cast("string")))
    )


@query("""WITH w AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM events WHERE event_id % 10 <> 0),
    r AS (SELECT *, date_trunc('day', ts) AS d FROM events, w WHERE event_id % 10 <> 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
    SELECT strftime(d, '%Y-%m-%d') AS day, CAST(user_id % 3 AS VARCHAR) AS site, event_type AS cls, 'v' || user_id % 2 AS version, count(*) AS reviews, round(avg((value >= 60)::INT), 6) AS "overrideRate",
        round(avg((event_id % 7 = 0)::INT), 6) AS "rejectRate", round(avg((value < 20)::INT), 6) AS "lowRate" FROM r GROUP BY ALL""")
def stream_review_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the reviews arrives after all others: those of the last days count, older ones are too late."""
    e = B.table(spark, sf_dir, "events")
    rows = e.select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).cast("string").alias("site"), F.col("event_type").alias("cls"), F.concat(F.lit("v"), F.col("user_id") % 2).alias("version"),
        (F.col("value") >= 60).alias("overridden"), (F.col("event_id") % 7 == 0).alias("rejected"), (F.col("value") / 200).alias("confidence"), (F.col("event_id") % 10 == 0).alias("late"),
    )
    parts = [rows.filter(~F.col("late")).drop("late"), rows.filter("late").drop("late")]
    found = feeds.Feed(spark).newest(parts, lambda s: feeds.review_rates(s, 0.1), ["start", "site", "cls", "version"])
    rates = [F.round(c, 6).alias(c) for c in ("overrideRate", "rejectRate", "lowRate")]
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "site", "cls", "version", "reviews", *rates)
