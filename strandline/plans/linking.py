"""Longitudinal identities: link keys of events, compatibility of keys, and the ordered linking of a subject's events to tracks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

# Fixed values of the rules.
UNKNOWN_ANATOMY = ("", "unknown", "not_stated", "not_applicable", "none")
UNKNOWN_LATERALITY = ("", "unknown", "none", "not_applicable", "na", "n_a")
BILATERAL = ("bilateral", "both")
PARENTS = {
    "pleural_space": ("thorax",), "heart": ("thorax",), "lung": ("thorax",), "rib": ("bone", "thorax"), "sternum": ("bone", "thorax"), "spine": ("bone",),
    "lateral_malleolus": ("bone", "extremity"), "femoral_region": ("extremity",), "intracranial": ("head_neck",), "liver": ("abdomen",), "kidney": ("abdomen",),
    "renal_collecting_system": ("kidney", "abdomen"), "peritoneum": ("abdomen",), "aorta": ("abdomen",), "deep_vein": ("extremity",),
}
DEFAULT_ANATOMY = {
    "ascites": "peritoneum", "cardiomegaly": "heart", "hepatomegaly": "liver", "hydronephrosis": "kidney", "liver_metastasis": "liver", "lung_metastasis": "thorax",
    "brain_metastasis": "intracranial", "pleural_effusion": "pleural_space", "pneumothorax": "pleural_space", "pulmonary_embolism": "thorax",
}
SIDELESS = ("ascites", "cardiomegaly", "hepatomegaly")
GLOBAL_ABSENT = ("bone_metastasis", "fracture", "hemorrhage", "hydronephrosis", "lymph_node_metastasis", "pneumothorax", "pulmonary_embolism")
DEVICE_FAMILIES = (("ekg_leads", ("ekg", "ecg")), ("sternal_wires", ("sternal", "sternotomy")), ("foley_catheter", ("foley", "urinary_bladder")),
                   ("central_line", ("jugular", "central_line", "svc")), ("vascular_graft", ("graft", "stent", "bypass", "aorta", "femoral")))


def token(value: Column) -> Column:
    """Lower case, hyphens and runs of blanks as one underscore; null is empty."""
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), r"[-\s]+", " ")), " ", "_")


def link_anatomy(finding_type: Column, anatomy: Column) -> Column:
    """The anatomy that links an event: a type's own site where only a region is given. ``anatomy`` is a canonical token already."""
    defaults = F.try_element_at(F.create_map(*[F.lit(x) for pair in DEFAULT_ANATOMY.items() for x in pair]), finding_type)
    pleural = finding_type.isin("pleural_effusion", "pneumothorax") & (F.contains(anatomy, F.lit("pleura")) | (anatomy == "thorax"))
    renal = (finding_type == "hydronephrosis") & anatomy.isin("kidney", "renal_collecting_system")
    default = F.when(anatomy.isin("thorax", "abdomen", "pelvis"), defaults)
    return F.when(anatomy.isin(*UNKNOWN_ANATOMY), "unknown").otherwise(F.coalesce(default, F.when(pleural, "pleural_space").when(renal, "kidney").otherwise(anatomy)))


def link_laterality(finding_type: Column, assertion: Column, laterality: Column) -> Column:
    """The side that links an event; none for types without sides and for absence anywhere."""
    side = F.when(laterality.isin("na", "n_a", "none"), "not_applicable").otherwise(laterality)
    anywhere = (assertion == "absent") & finding_type.isin(*GLOBAL_ABSENT) & side.isin(*UNKNOWN_LATERALITY, *BILATERAL)
    return F.when(finding_type.isin(*SIDELESS) | anywhere, "not_applicable").when(side == "", "unknown").otherwise(side)


def link_family(finding_type: Column, text: Column) -> Column:
    """Which device a broad device event is about, by the first family with a word in ``text``; empty otherwise."""
    family = F
    for name, words in DEVICE_FAMILIES:
        family = family.when((finding_type == "device_or_line") & text.rlike("|".join(words)), name)
    return family.otherwise("")


def event_keys(events: DataFrame) -> DataFrame:
    """``events`` with the tokens and keys that linking works on; all of it in column expressions.

    Columns read: subject, report_id, report_date, frame_index, finding_type, anatomy, laterality, assertion, lesion_key,
    finding_surface, evidence_text, source_kind, review_only. Nulls are empty tokens.
    """
    kind, assertion = token(F.col("finding_type")), token(F.col("assertion"))
    lesion = token(F.col("lesion_key"))
    stated = F.when(lesion.isin("", "none", "null", "unknown", "unresolved_link"), "").otherwise(lesion)
    text = F.concat_ws(" ", token(F.col("finding_surface")), token(F.col("evidence_text")), token(F.col("anatomy")))
    catch_all = (kind == "other_important_finding") | (token(F.col("source_kind")) == "catch_all") | F.coalesce("review_only", F.lit(False))
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = events.select(
        "*", kind.alias("_kind"), link_anatomy(kind, token(F.col("anatomy"))).alias("link_anatomy"), link_laterality(kind, assertion, token(F.col("laterality"))).alias("link_laterality"),
        link_family(kind, text).alias("link_family"), stated.alias("_lesion"), (lesion == "unresolved_link").alias("_unresolved"), catch_all.alias("_catch_all"),
        F.concat_ws("|", string("report_id"), string("source_kind"), string("frame_index")).alias("_identity"),
    )
    part = lambda c: F.when(c != "", c)
    own = F.coalesce(part(F.col("_lesion")), part(F.col("link_family")))
    review = F.when((F.col("_lesion") == "") & F.col("_catch_all"), F.concat(F.lit("review_only|"), "_identity"))
    return out.withColumn("base_track_key", F.concat_ws("|", F.coalesce(part(F.col("_kind")), F.lit("unknown")), "link_anatomy", "link_laterality", own, review))


def ancestors(name: str, parents: Mapping[str, Iterable[str]] = PARENTS) -> set[str]:
    found: set[str] = set()
    pending = list(parents.get(name, ()))
    while pending:
        p = pending.pop()
        if p not in found:
            found.add(p)
            pending.extend(parents.get(p, ()))
    return found


def anatomy_compatible(a: str, b: str) -> bool:
    """Equal, or one lies within the other; an unknown one is compatible with nothing but itself."""
    if a == b:
        return True
    return not ({a, b} & set(UNKNOWN_ANATOMY)) and (a in ancestors(b) or b in ancestors(a))


def laterality_compatible(a: str, b: str) -> bool:
    return a == b or a in UNKNOWN_LATERALITY or b in UNKNOWN_LATERALITY


LINKED = "subject string, report_id string, frame_index int, track_key string, link_status string, link_decision string, candidates array<string>"


def link_events(events: DataFrame) -> DataFrame:
    """LINKED for each of ``events``: the track it joins, and how that was decided.

    A subject's events are taken by (report_date, report_id, frame_index), missing ones first. Each meets the tracks before it of the same
    type, lesion and family whose anatomy and side are compatible. None: a new track under its own key. Its own key among
    them, or one track only: linked. Several: unresolved, on a track of its own that nothing joins. An event marked
    as unresolved stays so. A decision depends on those before it, so a subject is one group, and its state is one entry
    per track; subjects are independent. A null subject is a subject; no events, no rows.
    """
    columns = ["subject", "report_id", "report_date", "frame_index", "_kind", "link_anatomy", "link_laterality", "link_family", "_lesion", "_unresolved", "_catch_all", "_identity", "base_track_key"]
    keyed = event_keys(events).select(*[F.col(c).cast("string") if c in ("subject", "report_id", "report_date") else F.col(c) for c in columns])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(report_date=group.report_date.fillna(""), frame_index=group.frame_index.fillna(0), _report=group.report_id.fillna(""))
        by_kind: dict[tuple, dict[str, tuple]] = {}
        rows = []
        for e in group.sort_values(["report_date", "_report", "frame_index"], kind="stable").drop(columns="_report").itertuples(index=False, name=None):
            subject, report, _, index, kind, anatomy, side, family, lesion, unresolved, catch_all, identity, base = e
            open_tracks = by_kind.setdefault((kind, lesion, family), {})
            found = [] if catch_all and not lesion else sorted(k for k, (a, s, seed) in open_tracks.items() if (lesion or not seed) and anatomy_compatible(anatomy, a) and laterality_compatible(side, s))
            if unresolved:
                key, status, decision = f"{base}|unresolved_link|{identity}", "unresolved_link", "explicit_unresolved_link"
            elif not found:
                key, status, decision = base, "new_track", "new_track"
            elif base in found:
                key, status, decision = base, "linked", "exact_key"
            elif len(found) == 1:
                key, status, decision = found[0], "linked", "compatible_merge"
            else:
                key, status, decision = f"{base}|unresolved_link|{identity}", "unresolved_link", "ambiguous_compatible_tracks"
            if status != "unresolved_link" and (lesion or not catch_all):  # nothing can join a catch-all without a lesion
                open_tracks[key] = (anatomy, side, catch_all)
            rows.append((subject, report, int(index), key, status, decision, found if status != "new_track" else []))
        return pd.DataFrame(rows, columns=["subject", "report_id", "frame_index", "track_key", "link_status", "link_decision", "candidates"])

    return keyed.groupBy("subject").applyInPandas(fold, LINKED)


def false_splits(tracks: DataFrame, parents: Mapping[str, Iterable[str]] = PARENTS) -> DataFrame:
    """Unordered pairs of a subject's tracks (subject, track_key, _kind, link_anatomy, link_laterality) of one type that are compatible.

    Each track is listed under its anatomy and all that contain it, a few at most, so pairs meet by equal keys: one
    of the two anatomies is the other's or contains it.
    """
    closure = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k in parents for x in (k, sorted(ancestors(k, parents)))])
    known = ~F.col("link_anatomy").isin(*UNKNOWN_ANATOMY)
    up = F.concat(F.array("link_anatomy"), F.when(known, F.coalesce(F.try_element_at(closure, F.col("link_anatomy")), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    a, b = tracks.select("*", F.explode(up).alias("site")).alias("a"), tracks.alias("b")
    side = lambda x: F.col(f"{x}.link_laterality")
    sides = (side("a") == side("b")) | side("a").isin(*UNKNOWN_LATERALITY) | side("b").isin(*UNKNOWN_LATERALITY)
    met = a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("a._kind") == F.col("b._kind")) & (F.col("a.site") == F.col("b.link_anatomy")) & (F.col("a.track_key") != F.col("b.track_key")) & sides)
    pair = met.where(F.col("a._kind") != "other_important_finding").select(F.col("a.subject").alias("subject"), F.least("a.track_key", "b.track_key").alias("left_track_key"), F.greatest("a.track_key", "b.track_key").alias("right_track_key"))
    return pair.distinct()


#: Events of the fixture as findings, as expressions that both engines read.
FINDINGS = {
    "subject": "user_id", "report_id": "CAST(CAST(ts AS DATE) AS STRING)", "report_date": "CAST(CAST(ts AS DATE) AS STRING)", "frame_index": "CAST(event_id AS INT)",
    "finding_type": "CASE event_type WHEN 'view' THEN 'pleural-effusion' WHEN 'click' THEN 'Rib Fracture' WHEN 'error' THEN 'device or line' WHEN 'signup' THEN 'hydronephrosis' ELSE 'fracture' END",
    "anatomy": "CASE event_id % 5 WHEN 0 THEN 'thorax' WHEN 1 THEN 'rib' WHEN 2 THEN 'kidney' WHEN 3 THEN 'Bone' ELSE NULL END",
    "laterality": "CASE event_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'Right' WHEN 2 THEN 'n/a' ELSE '' END",
    "assertion": "CASE WHEN event_id % 3 = 0 THEN 'absent' ELSE 'present' END", "lesion_key": "CASE WHEN event_id % 50 = 0 THEN 'L1' WHEN event_id % 51 = 0 THEN 'unresolved link' END",
    "finding_surface": "event_type", "evidence_text": "CASE event_id % 3 WHEN 0 THEN 'EKG leads' WHEN 1 THEN 'aortic stent' ELSE 'tip in the SVC' END",
    "source_kind": "CASE WHEN event_id % 40 = 0 THEN 'catch all' ELSE 'checklist' END", "review_only": "event_id % 60 = 0",
}
_I = "i AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FINDINGS.items()) + " FROM events)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in FINDINGS.items()])


def _token_sql(c: str) -> str:
    return rf"replace(trim(regexp_replace(lower(coalesce({c}, '')), '[-\s]+', ' ', 'g')), ' ', '_')"


def _in(values: Iterable[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_KEYS = f"""{_I}, t AS (SELECT *, {_token_sql("finding_type")} AS kind, {_token_sql("anatomy")} AS raw, {_token_sql("laterality")} AS lat, {_token_sql("lesion_key")} AS lk,
  {_token_sql("finding_surface")} || ' ' || {_token_sql("evidence_text")} || ' ' || {_token_sql("anatomy")} AS txt,
  {_token_sql("source_kind")} = 'catch_all' OR review_only OR {_token_sql("finding_type")} = 'other_important_finding' AS catch_all FROM i),
k AS (SELECT *, CASE WHEN raw IN {_in(UNKNOWN_ANATOMY)} THEN 'unknown'
    WHEN raw IN ('thorax', 'abdomen', 'pelvis') AND kind IN {_in(DEFAULT_ANATOMY)} THEN CASE kind {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DEFAULT_ANATOMY.items())} END
    WHEN kind IN ('pleural_effusion', 'pneumothorax') AND (contains(raw, 'pleura') OR raw = 'thorax') THEN 'pleural_space'
    WHEN kind = 'hydronephrosis' AND raw IN ('kidney', 'renal_collecting_system') THEN 'kidney' ELSE raw END AS link_anatomy,
  CASE WHEN kind IN {_in(SIDELESS)} OR (assertion = 'absent' AND kind IN {_in(GLOBAL_ABSENT)} AND lat IN {_in((*UNKNOWN_LATERALITY, *BILATERAL))}) THEN 'not_applicable'
    WHEN lat IN ('na', 'n_a', 'none') THEN 'not_applicable' WHEN lat = '' THEN 'unknown' ELSE lat END AS link_laterality,
  CASE WHEN kind <> 'device_or_line' THEN '' {" ".join(f"WHEN regexp_matches(txt, '{'|'.join(w)}') THEN '{n}'" for n, w in DEVICE_FAMILIES)} ELSE '' END AS link_family,
  CASE WHEN lk IN ('', 'none', 'null', 'unknown', 'unresolved_link') THEN '' ELSE lk END AS lesion FROM t),
b AS (SELECT *, concat_ws('|', kind, link_anatomy, link_laterality, coalesce(nullif(lesion, ''), nullif(link_family, '')),
  CASE WHEN lesion = '' AND catch_all THEN 'review_only|' || report_id || '|' || source_kind || '|' || frame_index END) AS base_track_key FROM k)"""


@query("link_keys", f"WITH {_KEYS} SELECT frame_index, link_anatomy, link_laterality, link_family, base_track_key FROM b")
def link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_keys(findings(spark, sf_dir)).select("frame_index", "link_anatomy", "link_laterality", "link_family", "base_track_key")


@query("linked_events")
def linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over a subject's events in order, which SQL can't express; tests compare with brute force."""
    return link_events(findings(spark, sf_dir))


@query("linker_summary")
def linker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and decisions of the linker."""
    e = linked_events(spark, sf_dir)
    made = lambda d: F.count_if(F.col("link_decision") == d)
    return e.agg(F.count("*").alias("n_events"), F.countDistinct("subject", "track_key").alias("n_tracks"), made("new_track").alias("n_new"), made("exact_key").alias("n_exact"), made("compatible_merge").alias("n_merged"), F.count_if(F.col("link_status") == "unresolved_link").alias("n_unresolved"))


_CLOSURE = ", ".join(f"('{a}', '{b}')" for a in PARENTS for b in sorted(ancestors(a)))


@query("false_split_pairs", f"""WITH {_KEYS}, tr AS (SELECT DISTINCT subject, base_track_key AS track_key, kind, link_anatomy, link_laterality FROM b WHERE NOT catch_all), cl AS (SELECT * FROM (VALUES {_CLOSURE}) v(low, high))
SELECT x.subject, x.track_key AS left_track_key, y.track_key AS right_track_key FROM tr x JOIN tr y ON x.subject = y.subject AND x.kind = y.kind AND x.track_key < y.track_key
WHERE (x.link_anatomy = y.link_anatomy OR EXISTS (SELECT 1 FROM cl WHERE (low = x.link_anatomy AND high = y.link_anatomy) OR (low = y.link_anatomy AND high = x.link_anatomy)))
AND (x.link_laterality = y.link_laterality OR x.link_laterality IN {_in(UNKNOWN_LATERALITY)} OR y.link_laterality IN {_in(UNKNOWN_LATERALITY)})""")
def false_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = event_keys(findings(spark, sf_dir)).where("not _catch_all")
    return false_splits(keyed.select("subject", F.col("base_track_key").alias("track_key"), "_kind", "link_anatomy", "link_laterality").distinct())


@query("lesion_names", f"""WITH {_KEYS}, p AS (SELECT DISTINCT base_track_key AS k FROM b), q AS (SELECT k, replace(split_part(k, '|', 1), '_', ' ') AS f, replace(split_part(k, '|', 2), '_', ' ') AS a, CASE WHEN split_part(k, '|', 3) IN ('not_applicable', 'unknown', '') THEN '' ELSE split_part(k, '|', 3) END AS l FROM p),
s AS (SELECT k, concat_ws(' — ', nullif(f, ''), nullif(concat_ws(' ', nullif(l, ''), CASE WHEN l = '' AND a <> '' AND contains(lower(f), lower(a)) THEN NULL ELSE nullif(a, '') END), '')) AS n FROM q)
SELECT k AS track_key, upper(substr(n, 1, 1)) || substr(n, 2) AS name FROM s""")
def lesion_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's name for readers, from its key: finding, then side and site unless the site is in the finding's name already."""
    part = lambda i: F.split_part("track_key", F.lit("|"), F.lit(i))
    words = lambda c: F.btrim(F.replace(c, F.lit("_"), F.lit(" ")))
    some = lambda c: F.nullif(c, F.lit(""))
    finding, anatomy = words(part(1)), words(part(2))
    side = F.when(part(3).isin("not_applicable", "unknown"), "").otherwise(F.btrim(part(3)))
    site = F.when((side == "") & (anatomy != "") & F.contains(F.lower(finding), F.lower(anatomy)), "").otherwise(anatomy)
    name = F.concat_ws(" — ", some(finding), some(F.concat_ws(" ", some(side), some(site))))
    keys = event_keys(findings(spark, sf_dir)).select(F.col("base_track_key").alias("track_key")).distinct()
    return keys.select("track_key", F.concat(F.upper(F.substr(name, F.lit(1), F.lit(1))), F.substr(name, F.lit(2))).alias("name"))
