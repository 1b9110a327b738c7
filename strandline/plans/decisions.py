"""Identities confirmed by a log of decisions on machine tracks: checked and signed decisions, their replay, and responses on what it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.canonical import json_object, json_string, json_strings, signature
from strandline.plans.burden import is_nodal
from strandline.plans.response import _assess_sql, _events, _measured, _placed, confirmed_side, contrast
from strandline.registry import query

# A log: subject, decision_id, decided_at, decision, primary_track, related_tracks (array), resulting_track, rationale, decided_by.

#: The kinds of decision.
CONFIRM, MERGE, SPLIT, UNRESOLVED, REJECT = "confirm", "merge", "split", "mark_unresolved", "reject"
KINDS = (CONFIRM, MERGE, SPLIT, UNRESOLVED, REJECT)


def _related() -> Column:
    return F.array_compact(F.coalesce("related_tracks", F.array().cast("array<string>")))


def signed(log: DataFrame) -> DataFrame:
    """The log with ``signature_sha256``, the hash of a decision's canonical JSON: what was decided, on which tracks, by whom. When isn't in it."""
    text = lambda c: json_string(F.col(c).cast("string"))
    payload = json_object(
        run_id=text("subject"), decision=text("decision"), primary_track_key=text("primary_track"), related_track_keys=json_strings(_related()),
        resulting_track_key=text("resulting_track"), rationale=text("rationale"), decided_by=text("decided_by"),
    )
    return log.withColumn("signature_sha256", signature(payload))


def decision_faults(log: DataFrame, tracks: DataFrame) -> DataFrame:
    """(subject, decision_id, fault, track) of decisions that name a track the subject doesn't have, or are of no known kind."""
    named = log.select("subject", "decision_id", F.explode(F.array_distinct(F.concat(F.array("primary_track"), _related()))).alias("track"))
    unknown = named.join(tracks.select("subject", "track").distinct(), ["subject", "track"], "left_anti")
    odd = log.where(F.col("decision").isNull() | ~F.col("decision").isin(*KINDS))
    return unknown.select("subject", "decision_id", F.lit("unknown_track_key").alias("fault"), "track").unionAll(odd.select("subject", "decision_id", F.lit("unknown_decision"), F.lit(None).cast("string")))


def confirmed_members(log: DataFrame) -> DataFrame:
    """(subject, lesion, track): the machine tracks of each confirmed identity once all decisions are applied in order.

    ``confirm`` and ``split`` put the primary track into the resulting identity (its own name where none is given),
    ``merge`` the related ones too. ``reject`` and ``mark_unresolved`` take the primary track out of every identity
    it is in and bar it, until a later confirm or merge of it as the primary lifts the bar.

    Nothing is replayed row by row: a track is in an identity if it was last put there after it was last taken out,
    and barred if it was last taken out after the bar was last lifted. So the state follows from the last of each kind of act,
    which partial aggregates find; a subject with very many decisions is no task of its own. Decisions go by
    decided_at, nulls last, then decision_id. Null tracks among the related count for nothing.
    """
    at = F.struct(F.col("decided_at").isNull().alias("late"), F.col("decided_at").alias("at"), F.col("decision_id").alias("id"))
    acts = log.select("subject", "decision", "primary_track", _related().alias("related"), F.coalesce(F.nullif("resulting_track", F.lit("")), "primary_track").alias("lesion"), at.alias("at"))
    put = F.when(F.col("decision") == MERGE, F.concat(F.array("primary_track"), F.col("related"))).otherwise(F.array("primary_track"))
    added = acts.where(F.col("decision").isin(CONFIRM, MERGE, SPLIT)).select("subject", "lesion", F.explode(put).alias("track"), "at").groupBy("subject", "lesion", "track").agg(F.max("at").alias("added"))
    last = lambda *kinds: F.max(F.when(F.col("decision").isin(*kinds), F.col("at")))
    marks = acts.groupBy("subject", F.col("primary_track").alias("track")).agg(last(REJECT, UNRESOLVED).alias("dropped"), last(CONFIRM, MERGE).alias("lifted"))
    stands = F.col("dropped").isNull() | ((F.col("added") > F.col("dropped")) & (F.col("lifted") > F.col("dropped")))
    return added.join(marks, ["subject", "track"], "left").where(stands).select("subject", "lesion", "track")


def confirmed_tracks(log: DataFrame, tracks: DataFrame) -> DataFrame:
    """(subject, lesion, tracks, finding_type, anatomy, laterality) per confirmed identity; attributes are those of its first known track by name."""
    members = confirmed_members(log).join(tracks.select("subject", "track", F.struct("track", "finding_type", "anatomy", "laterality").alias("own")), ["subject", "track"], "left")
    out = members.groupBy("subject", "lesion").agg(F.array_sort(F.collect_set("track")).alias("tracks"), F.min("own").alias("own"))
    return out.select("subject", "lesion", "tracks", "own.finding_type", "own.anatomy", "own.laterality")


def unconfirmed_targets(selections: DataFrame, members: DataFrame) -> DataFrame:
    """(subject, lesion) of selected targets that are no confirmed identity."""
    return selections.select("subject", "lesion").distinct().join(members, ["subject", "lesion"], "left_anti")


# --- the fixture's events as a log: each is a decision of its user on the track of its type

_OTHER = {"view": ["click"], "click": ["view", "purchase"]}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.sources.tables import table

    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, (CONFIRM, MERGE, SPLIT, CONFIRM, UNRESOLVED, MERGE, REJECT))), (k % 7 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "error", F.when(k % 2 == 0, REJECT).otherwise(CONFIRM)).otherwise(kind)
    related = F.coalesce(*[F.when(F.col("event_type") == t, F.array(*map(F.lit, o))) for t, o in _OTHER.items()], F.array(F.lit("signup"), F.lit(None).cast("string")))
    result = F.when(k % 5 < 2, "seen").when(k % 5 == 2, "").when(k % 5 == 3, F.col("event_type"))
    return e.select(
        F.col("user_id").alias("subject"), k.alias("decision_id"), F.col("ts").alias("decided_at"), kind.alias("decision"), F.col("event_type").alias("primary_track"), related.alias("related_tracks"),
        result.alias("resulting_track"), F.col("props").alias("rationale"), (k % 3).alias("decided_by"),
    )


_LOG = f"""lg AS (SELECT user_id AS subject, event_id AS decision_id, ts AS decided_at, event_type AS p, props, event_id % 3 AS decided_by,
  CASE WHEN event_type = 'error' THEN if(event_id % 2 = 0, '{REJECT}', '{CONFIRM}') ELSE ['{CONFIRM}', '{MERGE}', '{SPLIT}', '{CONFIRM}', '{UNRESOLVED}', '{MERGE}', '{REJECT}'][event_id % 7 + 1] END AS decision,
  CASE event_type WHEN 'view' THEN ['click'] WHEN 'click' THEN ['view', 'purchase'] ELSE ['signup'] END AS related,
  CASE WHEN event_id % 5 < 2 THEN 'seen' WHEN event_id % 5 = 2 THEN '' WHEN event_id % 5 = 3 THEN event_type END AS result,
  row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS k FROM events)"""
# the log applied row by row, a subject's state being its members ('identity|track') and the tracks that are barred
_REPLAY = f"""{_LOG},
replay AS (
  SELECT DISTINCT subject, 0::BIGINT AS k, []::VARCHAR[] AS members, []::VARCHAR[] AS barred FROM lg
  UNION ALL
  SELECT lg.subject, lg.k,
    CASE WHEN decision IN ('{REJECT}', '{UNRESOLVED}') THEN list_filter(members, lambda m: split_part(m, '|', 2) <> p)
      ELSE list_distinct(list_concat(members, list_transform(CASE WHEN decision = '{MERGE}' THEN list_prepend(p, related) ELSE [p] END, lambda t: coalesce(nullif(result, ''), p) || '|' || t))) END,
    CASE WHEN decision IN ('{REJECT}', '{UNRESOLVED}') THEN list_distinct(list_append(barred, p)) WHEN decision IN ('{CONFIRM}', '{MERGE}') THEN list_filter(barred, lambda t: t <> p) ELSE barred END
  FROM replay JOIN lg ON lg.subject = replay.subject AND lg.k = replay.k + 1),
fin AS (SELECT subject, arg_max(members, k) AS members, arg_max(barred, k) AS barred FROM replay GROUP BY subject),
mem AS (
  SELECT subject, split_part(m, '|', 1) AS lesion, split_part(m, '|', 2) AS track
  FROM (SELECT subject, barred, unnest(members) AS m FROM fin) WHERE NOT list_contains(barred, split_part(m, '|', 2)))"""


@query("confirmed_members", f"WITH RECURSIVE {_REPLAY} SELECT subject, lesion, track FROM mem")
def confirmed_members_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed_members(_log(spark, sf_dir))


@query("confirmed_tracks", f"""WITH RECURSIVE {_REPLAY}, tr AS (SELECT user_id AS subject, event_type AS track, min(value) AS least FROM events WHERE event_id % 4 <> 0 GROUP BY ALL)
SELECT subject, lesion, string_agg(track, ',' ORDER BY track) AS tracks, min(CASE WHEN tr.subject IS NOT NULL THEN track END) AS finding_type,
  min_by(round(least, 6), track) FILTER (tr.subject IS NOT NULL) AS anatomy FROM mem LEFT JOIN tr USING (subject, track) GROUP BY subject, lesion""")
def confirmed_tracks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand for findings, their least value for the site."""
    from strandline.sources.tables import table

    seen = table(spark, sf_dir, "events").where("event_id % 4 <> 0").groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("track")).agg(F.min("value").alias("anatomy"))
    tracks = seen.select("subject", "track", F.col("track").alias("finding_type"), F.round("anatomy", 6).alias("anatomy"), F.lit(None).cast("string").alias("laterality"))
    return confirmed_tracks(_log(spark, sf_dir), tracks).select("subject", "lesion", F.array_join("tracks", ",").alias("tracks"), "finding_type", "anatomy")


def _json(column: str) -> str:
    return f"coalesce('\"' || replace(replace({column}, '\\', '\\\\'), '\"', '\\\"') || '\"', 'null')"


@query("signed_decisions", f"""WITH {_LOG} SELECT decision_id, sha256('{{"decided_by":"' || decided_by || '","decision":"' || decision || '","primary_track_key":"' || p || '","rationale":' || {_json("props")} ||
  ',"related_track_keys":["' || array_to_string(related, '","') || '"],"resulting_track_key":' || {_json("result")} || ',"run_id":"' || subject || '"}}') AS signature_sha256 FROM lg""")
def signed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(_log(spark, sf_dir)).select("decision_id", "signature_sha256")


@query("decision_faults", f"""WITH {_LOG}, tr AS (SELECT DISTINCT user_id AS subject, event_type AS track FROM events WHERE event_id % 9 = 0)
SELECT subject, decision_id, 'unknown_track_key' AS fault, track FROM (SELECT subject, decision_id, unnest(list_distinct(list_prepend(p, related))) AS track FROM lg) ANTI JOIN tr USING (subject, track)""")
def decision_faults_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks known from every ninth event."""
    log = _log(spark, sf_dir)
    return decision_faults(log, log.where("decision_id % 9 = 0").select("subject", F.col("primary_track").alias("track")))


# --- responses on the identities that the log confirms


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, members by replay, and as selections all identities with a first measurement; one named signup is a node."""
    events, members = _events(spark, sf_dir), confirmed_members(_log(spark, sf_dir))
    first = _measured(_placed(events, members), ["subject", "lesion"]).where("lesion in ('seen', 'signup')").groupBy("subject", "lesion").agg(F.min_by("mm", "day").alias("baseline_mm"))
    finding = F.when(F.col("lesion") == "signup", "lymph_node").otherwise(F.col("lesion"))
    chosen = first.withColumn("finding", finding).select("subject", "lesion", F.substring("lesion", 1, 1).alias("organ"), "baseline_mm", is_nodal("finding").alias("nodal"))
    return events, members, chosen


_DECIDED = f"""{_REPLAY},
e AS (SELECT user_id AS subject, event_type AS track, CAST(ts AS DATE) AS day, CASE WHEN event_id % 4 <> 0 THEN value END AS mm, CASE WHEN event_id % 3 = 0 THEN 'absent' ELSE 'present' END AS assertion FROM events),
pl AS (SELECT e.*, mem.lesion FROM e JOIN mem USING (subject, track)),
md AS (SELECT subject, lesion, day, arg_max(mm, (track, mm)) AS mm FROM pl WHERE mm IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
sel AS (SELECT subject, lesion, min_by(mm, day) AS baseline_mm, lesion = 'signup' AS nodal FROM md WHERE lesion IN ('seen', 'signup') GROUP BY subject, lesion)"""
_WORKSHEET = _assess_sql("SELECT md.* FROM md JOIN sel USING (subject, lesion)", "SELECT * FROM sel", "SELECT subject, lesion, min(day) AS day FROM pl ANTI JOIN sel USING (subject, lesion) WHERE assertion = 'present' GROUP BY ALL")


@query("decided_worksheet", f"WITH RECURSIVE {_DECIDED}, {_WORKSHEET} SELECT subject, day, sld, nadir AS nadir_sld, fresh AS new_lesion, response FROM r")
def decided_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed_side(*_decided(spark, sf_dir)).select("subject", "day", "sld", "nadir_sld", "new_lesion", "response")


def decided_contrast(events: DataFrame, log: DataFrame, selections: DataFrame) -> DataFrame:
    """``contrast`` on the identities that a log of decisions confirms."""
    return contrast(events, confirmed_members(log), selections)
