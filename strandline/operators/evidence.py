"""Trust rules on extracted frames: evidence that supports an assertion, policies, quarantine, changes over time, certainty and conflicts.

A frame is a row with finding_type, finding_surface, evidence_text, anatomy, assertion, clinical_importance and
review_only. Rules are column expressions; nothing here shuffles but what windows over a track need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

# Fixed values of the rules.
NEGATION = r"(?i)\b(?:no|without|absence of|negative for|not seen|not identified|not detected|free of|resolved|resolution of|no evidence of)\b"
UNCERTAIN = r"(?i)\b(?:possible|possibly|probable|probably|suggests?|suggestive|borderline|cannot exclude|may represent|questionable|indeterminate)\b"
NORMAL_HEART = ("heart size normal", "normal heart size", "cardiac silhouette normal", "normal cardiac silhouette", "cardiomediastinal silhouette normal",
                "normal cardiomediastinal silhouette", "heart size within normal limits", "cardiomediastinal silhouette is within normal limits",
                "cardiomediastinal silhouette within normal limits", "cardiac silhouette within normal limits")
HEART_TYPES = ("cardiomegaly", "enlarged_cardiac_silhouette")
INFECTION = r"(?i)\b(?:pneumoni\w*|infect\w*|abscess\w*|consolidat\w*|infiltrat\w*|diverticulitis|cholecystitis|inflamm\w*|septic|empyema)\b"
GENERIC_FRACTURE = ("unknown", "bone", "bones", "skull", "spine", "cervical_spine", "thoracic_spine", "lumbar_spine", "rib", "ribs", "osseous_structures")
SPECIFIC_FRACTURE = ("hip", "ankle", "foot", "hand", "wrist", "knee", "shoulder", "femur", "tibia", "fibula", "malleolus", "patella", "radius", "ulna", "humerus")
INCREASE_RATIO, DECREASE_RATIO = 1.10, 0.90
CERTAINTY_SCORES = {"confirmed": 0.96, "suspected": 0.8, "differential": 0.6, "uncertain": 0.35, "negative": 0.99}
DIRECTIONS = {"worsening": ("new", "increased", "progressed", "worsened"), "improving": ("decreased", "resolved", "improved")}
SUBTYPES = {"stable": ("stable", "unchanged"), "new": ("new", "newly_developed"), "increased": ("increased", "progressed", "worsened"), "decreased": ("decreased", "improved"), "resolved": ("resolved",)}
MEDICATION, STAGING = ("medication", "drug", "analgesic", "dose", "regimen"), ("stage", "staging", "tnm")
SEVERITIES = {"critical": 0, "moderate": 1, "low": 2}


def tokens_text(text: Column) -> Column:
    """The runs of ASCII letters and digits in lower case, one blank between and around them."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def mentions_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a term stands in the text as whole tokens; an underscore in a term separates tokens."""
    norm, found = tokens_text(text), F.lit(False)
    for t in terms:
        found = found | F.contains(norm, F.lit(f" {' '.join(t.replace('_', ' ').lower().split())} "))
    return found


def assertion_supported(assertion: Column, finding_type: Column, evidence: Column) -> Column:
    """Absent needs a negation cue (or words for a normal heart), uncertain a hedge, present no negation; others need nothing."""
    negated, text = F.coalesce(evidence, F.lit("")).rlike(NEGATION), F.coalesce(evidence, F.lit(""))
    absent = negated | (finding_type.isin(*HEART_TYPES) & mentions_any(evidence, NORMAL_HEART))
    return F.when(assertion == "absent", absent).when(assertion == "uncertain", text.rlike(UNCERTAIN)).when(assertion == "present", ~negated).otherwise(True)


def slot_text(value: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("unknown"))


def routine_negative(frame: DataFrame) -> Column:
    """Why a broad routine negative is for review only; null for frames that are not."""
    evidence = F.concat_ws(" ", "finding_surface", "evidence_text")
    anatomy, kind = slot_text(F.col("anatomy")), F.col("finding_type")
    specific = mentions_any(F.concat_ws(" ", anatomy, evidence), SPECIFIC_FRACTURE)
    reason = (
        F.when(kind.isin("cardiomegaly", "hydronephrosis"), F.concat(F.lit("routine_negative_review_only:"), kind))
        .when((kind == "ascites") & ~mentions_any(evidence, ("ascites",)), "routine_negative_review_only:ascites_indirect_free_fluid")
        .when((kind == "fracture") & anatomy.isin(*GENERIC_FRACTURE) & ~specific, "routine_negative_review_only:generic_fracture")
    )
    routine = ~F.coalesce("review_only", F.lit(False)) & (F.col("assertion") == "absent") & ~F.coalesce(F.col("clinical_importance").isin("critical", "high"), F.lit(False))
    return F.when(routine, reason)


def frame_policy(frames: DataFrame) -> DataFrame:
    """``frames`` without infections that no evidence names, routine negatives demoted to review only; ``reason`` tells why."""
    explicit = F.concat_ws(" ", "finding_surface", "evidence_text").rlike(INFECTION)
    kept = frames.where((F.col("finding_type") != "pneumonia_or_infection") | explicit).withColumn("reason", routine_negative(frames))
    demoted = F.col("reason").isNotNull()
    importance = F.when(demoted, "review_only").otherwise(F.col("clinical_importance"))
    return kept.withColumn("review_only", F.coalesce("review_only", F.lit(False)) | demoted).withColumn("clinical_importance", importance)


#: Frames over the fixture's orders, as expressions that both engines read.
_PHRASES = ("no pleural effusion is seen", "heart size within normal limits", "possible consolidation at the left base", "stable appearance", "no acute fracture of the hip", "resolved since", "free fluid in the pelvis")
FRAMES = {
    "frame_id": "o_orderkey",
    "report_id": "o_custkey",
    "finding_type": "CASE o_orderkey % 6 WHEN 0 THEN 'cardiomegaly' WHEN 1 THEN 'pneumonia_or_infection' WHEN 2 THEN 'ascites' WHEN 3 THEN 'fracture' WHEN 4 THEN 'hydronephrosis' ELSE 'lung_metastasis' END",
    "finding_surface": "CASE WHEN o_orderkey % 4 = 0 THEN 'Ascites' ELSE 'finding' END",
    "evidence_text": "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END",
    "anatomy": "CASE WHEN o_orderkey % 5 = 0 THEN 'Cervical Spine' WHEN o_orderkey % 5 = 1 THEN 'femur' ELSE 'bone' END",
    "assertion": "CASE o_orderstatus WHEN 'P' THEN 'uncertain' WHEN 'F' THEN 'absent' ELSE 'present' END",
    "clinical_importance": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' ELSE 'normal' END",
    "review_only": "o_orderkey % 11 = 0",
}
_F = "f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FRAMES.items()) + " FROM orders)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in FRAMES.items()])


def _norm_sql(text: str) -> str:
    return f"' ' || trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _any_sql(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({_norm_sql(text)}, ' {t} ')" for t in terms) + ")"


_SUPPORTED = f"""CASE assertion WHEN 'absent' THEN regexp_matches(evidence_text, '{NEGATION}') OR (finding_type IN {HEART_TYPES} AND {_any_sql("evidence_text", NORMAL_HEART)})
  WHEN 'uncertain' THEN regexp_matches(evidence_text, '{UNCERTAIN}') WHEN 'present' THEN NOT regexp_matches(evidence_text, '{NEGATION}') ELSE true END"""


@query("assertion_support", f"WITH {_F} SELECT frame_id, assertion, {_SUPPORTED} AS supported, {_any_sql('evidence_text', ('hip', 'heart_size'.replace('_', ' ')))} AS names_concept FROM f")
def assertion_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.select("frame_id", "assertion", assertion_supported(F.col("assertion"), F.col("finding_type"), F.col("evidence_text")).alias("supported"), mentions_any(F.col("evidence_text"), ("hip", "heart_size")).alias("names_concept"))


@query("quarantined_frames", f"WITH {_F} SELECT report_id, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (ok) AS n_passed FROM (SELECT *, {_SUPPORTED} AS ok FROM f) GROUP BY report_id")
def quarantined_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per report the frames that pass the evidence gate and those set apart."""
    ok = assertion_supported(F.col("assertion"), F.col("finding_type"), F.col("evidence_text"))
    return frames(spark, sf_dir).groupBy("report_id").agg(F.count_if(~ok).alias("n_failed"), F.count_if(ok).alias("n_passed"))


_ISSUES = f"""list_filter([CASE WHEN NOT regexp_matches(evidence_text, '^.{{5,}}$') OR NOT contains(evidence_text, ' ') THEN 'evidence_not_readable_span' END,
  CASE WHEN NOT {_any_sql("evidence_text", ("fluid", "hip", "heart", "consolidation"))} THEN 'evidence_missing_finding_concept' END,
  CASE WHEN NOT ({_SUPPORTED}) THEN 'evidence_does_not_support_' || assertion || '_assertion' END], lambda x: x IS NOT NULL)"""


@query("evidence_issues", f"WITH {_F} SELECT frame_id, array_to_string({_ISSUES}, ',') AS issues FROM f")
def evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of what is wrong with a frame's evidence, in the order of the checks."""
    text = F.col("evidence_text")
    tokens = F.size(F.split(F.btrim(tokens_text(text)), " "))
    checks = [
        F.when((F.length(F.btrim(text)) < 5) | (tokens < 2) | text.rlike("^[,;]|,$"), "evidence_not_readable_span"),
        F.when(~mentions_any(text, ("fluid", "hip", "heart", "consolidation")), "evidence_missing_finding_concept"),
        F.when(~assertion_supported(F.col("assertion"), F.col("finding_type"), text), F.concat(F.lit("evidence_does_not_support_"), "assertion", F.lit("_assertion"))),
    ]
    return frames(spark, sf_dir).select("frame_id", F.array_join(F.array_compact(F.array(*checks)), ",").alias("issues"))


_REASON = f"""CASE WHEN review_only OR assertion <> 'absent' OR clinical_importance IN ('critical', 'high') THEN NULL
  WHEN finding_type IN ('cardiomegaly', 'hydronephrosis') THEN 'routine_negative_review_only:' || finding_type
  WHEN finding_type = 'ascites' AND NOT {_any_sql("finding_surface || ' ' || evidence_text", ("ascites",))} THEN 'routine_negative_review_only:ascites_indirect_free_fluid'
  WHEN finding_type = 'fracture' AND regexp_replace(lower(anatomy), '[^a-z0-9]+', '_', 'g') IN {GENERIC_FRACTURE}
    AND NOT {_any_sql("anatomy || ' ' || finding_surface || ' ' || evidence_text", SPECIFIC_FRACTURE)} THEN 'routine_negative_review_only:generic_fracture' END"""


@query("frame_policy", f"""WITH {_F}, r AS (SELECT *, {_REASON} AS reason FROM f WHERE finding_type <> 'pneumonia_or_infection' OR regexp_matches(finding_surface || ' ' || evidence_text, '{INFECTION}'))
SELECT frame_id, reason, review_only OR reason IS NOT NULL AS review_only, CASE WHEN reason IS NOT NULL THEN 'review_only' ELSE clinical_importance END AS clinical_importance FROM r""")
def frame_policy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_policy(frames(spark, sf_dir)).select("frame_id", "reason", "review_only", "clinical_importance")


@query("taxonomy_frames", f"""WITH {_F}, t AS (SELECT * FROM (VALUES ('cardiomegaly'), ('ascites'), ('fracture')) v(name))
SELECT report_id, count(*) FILTER (name IS NOT NULL) AS n_kept, count(*) FILTER (name IS NULL) AS n_dropped FROM f LEFT JOIN t ON finding_type = name GROUP BY report_id""")
def taxonomy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per report the frames whose type the taxonomy knows, and how many it drops: a join to a dimension of a few rows."""
    known = F.broadcast(spark.createDataFrame([("cardiomegaly",), ("ascites",), ("fracture",)], "name string"))
    met = frames(spark, sf_dir).join(known, F.col("finding_type") == F.col("name"), "left")
    return met.groupBy("report_id").agg(F.count("name").alias("n_kept"), F.count_if(F.col("name").isNull()).alias("n_dropped"))


# --- changes over time


def choose(value: Column, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    out = F
    for name, members in groups.items():
        out = out.when(F.lower(value).isin(*members), name)
    return out.otherwise(default)


def measurement_change(previous: Column, current: Column) -> Column:
    """By the ratio to the last measurement; null without both or without a positive last one."""
    ratio = current / previous
    return F.when(previous > 0, F.when(ratio > INCREASE_RATIO, "increased").when(ratio < DECREASE_RATIO, "decreased").when(ratio.isNotNull(), "stable"))


def assertion_change(previous: Column, current: Column) -> Column:
    """New from absent to present, resolved from present to absent; no sign of change otherwise. A missing assertion is present."""
    a, b = (F.lower(F.coalesce(F.nullif(x, F.lit("")), F.lit("present"))) for x in (previous, current))
    return F.when((a == "absent") & (b == "present"), "new").when((a == "present") & (b == "absent"), "resolved")


def temporal_changes(events: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """``events`` (mm, assertion, temporal_change) with ``inferred``: a stated change, else what measurements say, else what assertions say.

    Only changes that are not stated are inferred, and never of an uncertain event. The first event of a track has none before it.
    """
    w = Window.partitionBy(*track).orderBy(*order)
    first = F.row_number().over(w) == 1
    stated = F.coalesce("temporal_change", F.lit("not_stated"))
    found = F.coalesce(measurement_change(F.lag("mm").over(w), F.col("mm")), assertion_change(F.lag("assertion").over(w), F.col("assertion")))
    open_ = (stated == "not_stated") & (F.coalesce("assertion", F.lit("present")) != "uncertain") & ~first
    return events.withColumn("inferred", F.when(open_, F.coalesce(found, stated)).otherwise(stated))


_EVENTS = {
    "event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "ts": "ts", "mm": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END",
    "assertion": "CASE event_id % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'uncertain' ELSE 'present' END",
    "temporal_change": "CASE event_id % 7 WHEN 0 THEN 'worsened' WHEN 1 THEN 'Improved' WHEN 2 THEN 'resolved' WHEN 3 THEN 'newly_developed' ELSE 'not_stated' END",
}
_E = "e AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EVENTS.items()) + " FROM events)"


def stated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in _EVENTS.items()])


@query("temporal_changes", f"""WITH {_E}, w AS (SELECT *, lag(mm) OVER t AS pm, coalesce(lag(assertion) OVER t, 'present') AS pa, row_number() OVER t AS k FROM e WINDOW t AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN temporal_change <> 'not_stated' OR assertion = 'uncertain' OR k = 1 THEN temporal_change ELSE coalesce(
  CASE WHEN pm > 0 AND mm IS NOT NULL THEN CASE WHEN mm / pm > {INCREASE_RATIO} THEN 'increased' WHEN mm / pm < {DECREASE_RATIO} THEN 'decreased' ELSE 'stable' END END,
  CASE WHEN pa = 'absent' AND assertion = 'present' THEN 'new' WHEN pa = 'present' AND assertion = 'absent' THEN 'resolved' END, 'not_stated') END AS inferred FROM w""")
def temporal_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_changes(stated_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "inferred")


def _choose_sql(value: str, groups: dict[str, tuple[str, ...]], default: str) -> str:
    listed = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    return f"CASE {' '.join(f'WHEN lower({value}) IN {listed(m)} THEN {chr(39)}{n}{chr(39)}' for n, m in groups.items())} ELSE '{default}' END"


@query("temporal_kinds", f"WITH {_E} SELECT {_choose_sql('temporal_change', DIRECTIONS, 'stable')} AS direction, {_choose_sql('temporal_change', SUBTYPES, 'unknown')} AS subtype, count(*) AS n FROM e GROUP BY ALL")
def temporal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.col("temporal_change")
    return stated_events(spark, sf_dir).groupBy(choose(change, DIRECTIONS, "stable").alias("direction"), choose(change, SUBTYPES, "unknown").alias("subtype")).agg(F.count("*").alias("n"))


# --- certainty, conflicts, issues


def certainty_score(label: Column, given: Column) -> Column:
    """A given score, clamped to 0 to 1, else that of the label, else 0.5."""
    scores = F.create_map(*[F.lit(x) for pair in CERTAINTY_SCORES.items() for x in pair])
    clamped = F.when(given.isNotNull(), F.greatest(F.lit(0.0), F.least(given, F.lit(1.0))))  # both skip nulls
    return F.coalesce(clamped, F.try_element_at(scores, F.lower(F.btrim(label))), F.lit(0.5))


@query("certainty_of_labels", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(0.0, least(value / 100, 1.0)) ELSE CASE event_type WHEN 'view' THEN 0.96 WHEN 'click' THEN 0.8 WHEN 'error' THEN 0.99 ELSE 0.5 END END AS score FROM events")
def certainty_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "view", " Confirmed ").when(F.col("event_type") == "click", "SUSPECTED").when(F.col("event_type") == "error", "negative").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", certainty_score(label, F.when(F.col("event_id") % 3 == 0, F.col("value") / 100)).alias("score"))


def trajectory(first: Column, last: Column, lowest: Column, confirmed: int = 2) -> Column:
    """Ranks of the first and last label tell escalation and decline; otherwise whether all are confirmed."""
    return F.when(last > first, "escalating").when(last < first, "declining").when(lowest >= confirmed, "stable-confirmed").otherwise("stable-suspected")


@query("certainty_trajectories", """WITH r AS (SELECT user_id, event_type, ts, event_id, CASE WHEN value < 50 THEN 0 WHEN value < 100 THEN 1 ELSE 2 END AS rank FROM events),
t AS (SELECT user_id, event_type, min_by(rank, (ts, event_id)) AS a, max_by(rank, (ts, event_id)) AS b, min(rank) AS low FROM r GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN b > a THEN 'escalating' WHEN b < a THEN 'declining' WHEN low >= 2 THEN 'stable-confirmed' ELSE 'stable-suspected' END AS trajectory FROM t""")
def certainty_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank, at = F.when(F.col("value") < 50, 0).when(F.col("value") < 100, 1).otherwise(2), F.struct("ts", "event_id")
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by(rank, at).alias("a"), F.max_by(rank, at).alias("b"), F.min(rank).alias("low"))
    return each.select("user_id", "event_type", trajectory(F.col("a"), F.col("b"), F.col("low")).alias("trajectory"))


def conflict_type(text: Column) -> Column:
    holds = lambda words: F.lower(text).rlike("|".join(words))
    return F.when(holds(MEDICATION), "medication").when(holds(STAGING), "staging").otherwise("other")


def conflict_severity(kind: Column, negations_differ: Column, days: Column) -> Column:
    """Staging is critical, medication if only one side is negated; dates 90 days apart or more and status are moderate."""
    medication = F.when(negations_differ, "critical").otherwise("moderate")
    return F.when(kind == "staging", "critical").when(kind == "medication", medication).when((kind == "status") | ((kind == "date") & (days >= 90)), "moderate").otherwise("minor")


@query("conflict_severities", f"""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Dose change' WHEN 1 THEN 'TNM stage' ELSE 'pain' END AS entity, o_orderstatus = 'F' AS differ FROM orders),
k AS (SELECT *, CASE WHEN regexp_matches(lower(entity), '{"|".join(MEDICATION)}') THEN 'medication' WHEN regexp_matches(lower(entity), '{"|".join(STAGING)}') THEN 'staging' ELSE 'other' END AS kind FROM c),
s AS (SELECT o_orderkey, kind, CASE WHEN kind = 'staging' THEN 'critical' WHEN kind = 'medication' THEN CASE WHEN differ THEN 'critical' ELSE 'moderate' END ELSE 'minor' END AS severity FROM k)
SELECT *, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'moderate' THEN 1 WHEN 'low' THEN 2 ELSE 9 END AS INT) AS severity_rank FROM s""")
def conflict_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.when(F.col("o_orderkey") % 5 == 0, "Dose change").when(F.col("o_orderkey") % 5 == 1, "TNM stage").otherwise("pain")
    kind = conflict_type(entity)
    severity = conflict_severity(kind, F.col("o_orderstatus") == "F", F.lit(0))
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), severity.alias("severity"), F.coalesce(F.try_element_at(ranks, severity), F.lit(9)).alias("severity_rank"))
