"""Filters on extracted findings: negated ones that matter, evidence of the report at hand, findings that a compound one covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

# --- fixed values: words that keep a negated finding, words that don't tell a finding, the share of evidence to be found, compound findings

CRITICAL = (
    "metastasis", "metastases", "metastatic", "tumor", "tumour", "carcinoma", "malignancy", "malignant", "cancer", "neoplasm", "neoplastic", "lesion", "mass", "lymphadenopathy", "recurrence", "progression",
    "hemorrhage", "haemorrhage", "thrombosis", "embolism", "infarct", "infarction", "pneumothorax", "fracture", "dislocation", "hydrocephalus", "midline", "shift", "herniation", "enhancement",
    "effusion", "obstruction", "abnormality",
)
UNTELLING = ("the", "and", "for", "are", "not", "was", "has", "had", "with", "this", "that", "from", "have", "been", "will", "finding", "abnormality", "evidence", "normal")
LEAST_FOUND = 0.5
COMPOUND, PARTS = "hydropneumothorax", ("pneumothorax", "pleural_effusion")

_NO_WORD = r"[^\p{L}\p{N}_]+"


def _plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), "")


def negation_kept(negated: Column, name: Column, indication: Column) -> Column:
    """Whether a finding stays: if it isn't negated, nothing was asked, or its name holds a critical word or one of the question's."""
    words = _plain_words(name)
    asked = F.btrim(F.coalesce(indication, F.lit("")), F.lit(" \t\n\r\x0b\x0c")) != ""
    return ~F.coalesce(negated, F.lit(False)) | ~asked | F.arrays_overlap(words, F.array(*map(F.lit, CRITICAL))) | F.arrays_overlap(words, _plain_words(indication))


def _letters(text: Column, least: int) -> Column:
    """Words of only a-z, at least so long."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NO_WORD), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def in_current_report(name: Column, evidence: Column, report: Column) -> Column:
    """Whether a finding is of this report: half of its evidence's words of four letters, and a telling word of its name, are parts of the text. Without such words neither can fail."""
    text = F.lower(F.coalesce(report, F.lit("")))
    told = _letters(evidence, 4)
    found = F.size(F.filter(told, lambda w: text.contains(w)))
    telling = F.filter(_letters(name, 3), lambda w: ~w.isin(*UNTELLING))
    named = F.btrim(F.coalesce(name, F.lit("")), F.lit(" \t\n\r\x0b\x0c")) != ""
    return named & ((F.size(told) == 0) | (found >= LEAST_FOUND * F.size(told))) & ((F.size(telling) == 0) | F.exists(telling, lambda w: text.contains(w)))


def without_covered(frames: DataFrame, group: str) -> DataFrame:
    """``frames`` (group, kind, evidence, side) without the parts of a compound finding that has the same evidence, blanks and case aside, and side. A null side equals a null side."""
    key = F.lower(F.btrim(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s+", " ")))
    side = F.coalesce("side", F.lit("None"))
    compound = frames.where(F.col("kind") == COMPOUND).select(F.col(group).alias("_group"), key.alias("_key"), side.alias("_side"))
    same = (F.col(group) == F.col("_group")) & (key == F.col("_key")) & (side == F.col("_side")) & F.col("kind").isin(*PARTS)
    return frames.join(compound, same, "left_anti")


# --- the fixture: turns as reports, the turn before as evidence; events as frames


@query("policy_filters", rf"""WITH t AS (SELECT conv_id, turn, lower(text) AS t, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, role <> 'user' AS negated FROM conversations),
w AS (SELECT *, string_split_regex(lower(b), '[^\p{{L}}\p{{N}}_]+') AS w, list_filter(string_split_regex(lower(substr(b, 1, 40)), '[^a-z0-9]+'), lambda x: x <> '') AS name, list_filter(string_split_regex(substr(t, 1, 60), '[^a-z0-9]+'), lambda x: x <> '') AS asked,
  string_split_regex(lower(substr(b, 1, 40)), '[^\p{{L}}\p{{N}}_]+') AS n FROM t WHERE b IS NOT NULL AND t IS NOT NULL),
f AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '[a-z]{{4,}}')) AS told, list_filter(n, lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ({", ".join(f"'{w}'" for w in UNTELLING)})) AS telling FROM w)
SELECT conv_id, turn, NOT negated OR trim(substr(t, 1, 60)) = '' OR list_has_any(name, asked) OR list_has_any(name, [{", ".join(f"'{w}'" for w in CRITICAL)}]) AS kept,
  (len(told) = 0 OR len(list_filter(told, lambda x: contains(t, x))) >= 0.5 * len(told)) AND (len(telling) = 0 OR len(list_filter(telling, lambda x: contains(t, x))) > 0) AND trim(substr(b, 1, 40)) <> '' AS in_report FROM f""")
def policy_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("b"), (F.col("role") != "user").alias("negated")).where("b is not null and text is not null")
    name = F.substring("b", 1, 40)
    kept = negation_kept(F.col("negated"), name, F.substring("text", 1, 60))
    return rows.select("conv_id", "turn", kept.alias("kept"), in_current_report(name, F.col("b"), F.col("text")).alias("in_report"))


_KINDS = {"view": COMPOUND, "click": PARTS[0], "error": PARTS[1]}


@query("frames_without_covered", """SELECT event_id FROM events e WHERE event_type NOT IN ('click', 'error') OR NOT EXISTS (FROM events c WHERE c.event_type = 'view' AND c.user_id = e.user_id AND c.props = e.props AND (c.value < 30) = (e.value < 30))""")
def frames_without_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _KINDS.items()], "event_type")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"), F.col("props").alias("evidence"), F.when(F.col("value") < 30, "left").otherwise("right").alias("side"))
    return without_covered(rows, "user_id").select("event_id")
