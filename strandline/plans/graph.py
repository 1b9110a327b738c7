"""The graph of a subject's tracks: what a track turns into, which tracks change together, lie together and are told of together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

# tracks: subject, track, kind, anatomy. events: subject, track, nth (order of arrival in the track), report, assertion, change,
# review_only, start, end (of the evidence; -1 or null: unknown). Tracks are unique within a subject, nth within a track.

# --- fixed values: what makes a track salient, directions and subtypes of changes, body regions, organs with their other names, neighbours

INACTIVE = ("absent", "not_mentioned")
SALIENT = ("new", "increased", "decreased", "resolved", "recurrent")
LOW_SALIENCE = ("device_or_line",)
DIRECTIONS = (("worsening", ("new", "increased", "progressed", "worsened")), ("improving", ("decreased", "resolved", "improved")))
SUBTYPES = (
    ("stable", ("stable", "unchanged")),
    ("new", ("new", "newly_developed")),
    ("increased", ("increased", "progressed", "worsened")),
    ("decreased", ("decreased", "improved")),
    ("resolved", ("resolved",)),
)
NO_PLACE = ("any", "unknown", "")
NEAR = 200  # characters between evidence
LEAST_SHARED = 2  # intervals that two tracks must both have
REGIONS = (
    ("chest", ("chest", "lung", "thorax", "pleura", "mediastinum", "pulmonary_artery", "heart", "cardiac", "left_ventricle", "right_ventricle", "left_atrium", "right_atrium", "aortic_valve", "mitral_valve", "pericardial")),
    ("abdomen", ("abdomen", "liver", "hepatic", "peritoneum", "bowel", "gi", "kidney", "renal", "spleen", "pancreas", "gallbladder", "adrenal", "retroperitoneum")),
    ("pelvis", ("pelvis", "bladder", "uterus", "ovary", "prostate")),
    ("brain", ("brain", "head", "intracranial", "mri", "ct_head", "cerebellum", "brainstem")),
    ("spine", ("spine", "vertebra", "vertebral", "spinal")),
    ("bone", ("bone", "rib", "skull", "extremity", "femur", "humerus", "clavicle", "scapula", "sternum")),
    ("neck", ("neck", "thyroid", "parotid", "oropharynx", "larynx")),
    ("soft_tissue", ("soft_tissue", "body_wall", "subcutaneous", "muscle")),
    ("vessel", ("vein", "artery", "aorta", "vena_cava", "deep_vein")),
)
ORGANS = (
    ("lung", ("lung", "pulmonary", "bronchus", "airway", "trachea")),
    ("liver", ("liver", "hepatic")),
    ("kidney", ("kidney", "renal")),
    ("pancreas", ("pancreas", "pancreatic")),
    ("spleen", ("spleen",)),
    ("adrenal", ("adrenal", "suprarenal")),
    ("gallbladder", ("gallbladder", "biliary", "bile_duct", "cbd")),
    ("heart", ("heart", "cardiac", "pericardial", "myocardium")),
    ("brain", ("brain", "cerebral", "cerebellum", "brainstem", "intracranial")),
    ("bone", ("bone", "osseous", "skeletal")),
    ("lymph_node", ("lymph_node", "lymphadenopathy", "nodal")),
    ("peritoneum", ("peritoneum", "peritoneal", "ascites")),
    ("pleura", ("pleura", "pleural", "pleural_space")),
    ("bowel", ("bowel", "colon", "small_bowel", "duodenum", "rectum", "sigmoid", "gi")),
)
NEIGHBOURS = (
    ("liver", ("gallbladder", "bile_duct", "cbd", "duodenum", "adrenal", "kidney", "spleen")),
    ("gallbladder", ("liver", "pancreas", "duodenum")),
    ("pancreas", ("duodenum", "spleen", "gallbladder", "stomach", "bile_duct")),
    ("spleen", ("pancreas", "kidney", "stomach", "liver", "diaphragm")),
    ("kidney", ("adrenal", "ureter", "spleen", "liver", "pancreas")),
    ("adrenal", ("kidney", "liver")),
    ("stomach", ("esophagus", "duodenum", "pancreas", "spleen")),
    ("duodenum", ("stomach", "pancreas", "liver", "gallbladder", "small_bowel")),
    ("colon", ("rectum", "small_bowel", "appendix")),
    ("rectum", ("colon", "bladder", "prostate", "uterus")),
    ("lung", ("pleura", "mediastinum", "bronchus", "trachea", "pulmonary_artery", "heart")),
    ("pleura", ("lung", "chest_wall", "rib")),
    ("mediastinum", ("lung", "heart", "trachea", "esophagus", "lymph_node")),
    ("heart", ("lung", "mediastinum", "pericardium", "pulmonary_artery")),
    ("bladder", ("prostate", "uterus", "rectum")),
    ("prostate", ("bladder", "rectum", "seminal_vesicle")),
    ("uterus", ("ovary", "bladder", "cervix", "rectum")),
    ("brain", ("meninges", "ventricle", "skull")),
    ("bone", ("joint", "soft_tissue", "muscle")),
    ("spine", ("vertebra", "spinal", "nerve_root")),
)


def _plain(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _first(value: Column, named, default) -> Column:
    """The first name whose words hold the value."""
    return F.coalesce(*[F.when(value.isin(*words), name) for name, words in named], default if isinstance(default, Column) else F.lit(default))


def family(anatomy: Column, named) -> Column:
    """The first name of whose words one is the anatomy, or, if longer than three letters, part of it; else the anatomy."""
    a = F.trim(F.lower(anatomy))
    held = lambda words: F.lit(False) if not (long := [w for w in words if len(w) > 3]) else a.rlike("|".join(rf"\Q{w}\E" for w in long))
    return F.coalesce(*[F.when(a.isin(*words) | held(words), name) for name, words in named], a)


def adjacent(a: Column, b: Column, neighbours=NEIGHBOURS) -> Column:
    """Whether one of two different organs is a neighbour of the other, in either direction."""
    pairs = sorted({p for name, others in neighbours for o in others for p in (f"{name}|{o}", f"{o}|{name}")})
    return (a != b) & F.concat_ws("|", a, b).isin(*pairs)


def counted(events: DataFrame) -> DataFrame:
    """Events that are more than a matter of review."""
    return events.where(~F.coalesce("review_only", F.lit(False)))


def salient(tracks: DataFrame, events: DataFrame) -> DataFrame:
    """Tracks with an event that counts and is active or a salient change; kinds of low salience aside."""
    telling = ~_plain("assertion").isin(*INACTIVE) | _plain("change").isin(*SALIENT)
    some = counted(events).where(telling).select("subject", "track")
    return tracks.where(~_plain("kind").isin(*LOW_SALIENCE)).join(some, ["subject", "track"], "left_semi")


def steps(events: DataFrame) -> DataFrame:
    """Consecutive events of a track in the order of their reports' numbers: subject, track, nth (of the first), before, after, change (of the second)."""
    number = F.coalesce(F.replace("report", F.lit("report_"), F.lit("")).try_cast("long"), F.lit(0))
    w = Window.partitionBy("subject", "track").orderBy("_number", "nth")
    rows = counted(events).where("coalesce(report, '') <> ''").withColumn("_number", number)
    out = rows.select("subject", "track", F.row_number().over(w).alias("nth"), F.col("report").alias("before"), F.lead("report").over(w).alias("after"), F.lead(_plain("change")).over(w).alias("change"))
    return out.where("after is not null")


def _edges(rows: DataFrame, kind: str, strength: Column, evidence: Column, subtype: Column) -> DataFrame:
    return rows.select("subject", "source", "target", F.lit(kind).alias("type"), subtype.alias("subtype"), F.bround(strength.cast("double"), 4).alias("strength"), evidence.alias("evidence"))


def progression(events: DataFrame) -> DataFrame:
    """An edge from a track to itself for each step."""
    rows = steps(events).withColumnsRenamed({"track": "source"}).withColumn("target", F.col("source"))
    return _edges(rows, "progression", F.lit(1.0), F.array("before", "after"), _first(F.col("change"), SUBTYPES, "unknown"))


def _both(rows: DataFrame, on: list[str], own: list[str]) -> DataFrame:
    """Pairs of rows of different tracks that agree in ``on``, the smaller track first: ``own`` columns with a_ and b_."""
    side = lambda p, name: rows.select(*on, F.col("track").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in own])
    return side("a", "source").join(side("b", "target"), on).where("source < target")


def coevolution(tracks: DataFrame, events: DataFrame) -> DataFrame:
    """Tracks of different kinds that have at least LEAST_SHARED intervals between the same reports, and move alike in one of them."""
    direction = F.max_by(_first(F.col("change"), DIRECTIONS, "stable"), "nth")  # the last of a track's steps between two reports
    moves = steps(events).groupBy("subject", "track", "before", "after").agg(direction.alias("direction")).join(tracks.select("subject", "track", "kind"), ["subject", "track"])
    pairs = _both(moves, ["subject", "before", "after"], ["kind", "direction"]).where("not (a_kind <=> b_kind)")
    alike = F.col("a_direction") == F.col("b_direction")
    n = lambda d: F.count_if(alike & (F.col("a_direction") == d))
    told = F.array_sort(F.collect_list(F.when(alike, F.struct("before", "after"))))
    each = pairs.groupBy("subject", "source", "target").agg(F.count("*").alias("shared"), n("worsening").alias("w"), n("improving").alias("i"), n("stable").alias("s"), told.alias("told"))
    each = each.where((F.col("shared") >= LEAST_SHARED) & (F.size("told") > 0))
    top = F.greatest("w", "i", "s")
    subtype = F.when(F.col("w") == top, "co_worsening").when(F.col("i") == top, "co_improving").otherwise("co_stable")
    return _edges(each, "coevolution", F.size("told") / F.col("shared"), F.transform("told", lambda x: F.concat(x["before"], F.lit("->"), x["after"])), subtype)


def anatomical(tracks: DataFrame, regions=REGIONS, organs=ORGANS, neighbours=NEIGHBOURS) -> DataFrame:
    """Tracks in the same organ (1.0), in neighbouring organs of a region (0.8), or in the same region (0.6); those without a place aside.

    Two joins on equal keys, as one organ can lie in two regions by name.
    """
    placed = tracks.select("subject", "track", _plain("anatomy").alias("anatomy")).where(~F.col("anatomy").isin(*NO_PLACE))
    placed = placed.withColumns({"organ": family(F.col("anatomy"), organs), "region": family(F.col("anatomy"), regions)})
    some = lambda c: placed.where(~F.col(c).isin(*NO_PLACE))
    # an organ's name that is no organ's doesn't tell that two are the same, but the region still may
    known = lambda c: ~F.col(c).isin(*NO_PLACE)
    same = _both(some("organ"), ["subject", "organ"], ["anatomy"]).withColumns({"strength": F.lit(1.0), "tier": F.lit("same_organ")})
    near = _both(some("region"), ["subject", "region"], ["anatomy", "organ"]).where(~((F.col("a_organ") == F.col("b_organ")) & known("a_organ")))
    close = (F.col("a_organ") != "") & (F.col("b_organ") != "") & adjacent(F.col("a_organ"), F.col("b_organ"), neighbours)
    near = near.withColumns({"strength": F.when(close, 0.8).otherwise(0.6), "tier": F.when(close, "adjacent").otherwise("same_region")})
    rows = same.drop("organ").unionByName(near.drop("region", "a_organ", "b_organ"))
    told = F.array(F.concat(F.lit("anatomy:"), "a_anatomy"), F.concat(F.lit("anatomy:"), "b_anatomy"))
    return _edges(rows, "anatomical", F.col("strength"), told, F.col("tier"))


def proximity(events: DataFrame, near: int = NEAR) -> DataFrame:
    """An edge for each two events of different tracks in a report whose evidence is at most ``near`` characters apart, or unknown (0.5),
    unless both tell of what is absent.

    Distances are taken between starts, and from each start to the other's end. Both ends of an evidence go to their
    bins of ``near`` + 1 characters, starts to the bins beside theirs too, so a point meets only those that can be near:
    tasks grow with the pairs found, not with the square of a report. Events without a place meet all others of their
    report, as each of those pairs is an edge.
    """
    rows = counted(events).where("coalesce(report, '') <> ''")
    there = (F.coalesce("start", F.lit(-1)) >= 0) & (F.coalesce("end", F.lit(-1)) >= 0)
    rows = rows.select("subject", "report", "track", "nth", _plain("assertion").isin(*INACTIVE).alias("off"), F.when(there, F.struct("start", "end")).alias("at"))
    placed, on = rows.where("at is not null"), ["subject", "report"]
    cell = lambda c: F.floor(F.col(c) / (near + 1))

    # a start of one and any point of the other; the roles of the two are swapped by the order of tracks afterwards
    own, there = ["track", "nth", "off"], lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("track", "nth", "off")]
    starts = placed.select(*on, *there("x"), F.col("at.start").alias("p")).withColumn("bin", F.explode(F.array(cell("p") - 1, cell("p"), cell("p") + 1)))
    points = placed.select(*on, *there("y"), F.explode(F.array("at.start", "at.end")).alias("q")).withColumn("bin", cell("q"))
    met = starts.join(points, [*on, "bin"]).withColumn("apart", F.abs(F.col("p") - F.col("q")))
    met = met.where((F.col("x_track") != F.col("y_track")) & (F.col("apart") <= near) & ~(F.col("x_off") & F.col("y_off")))
    turned = F.col("x_track") > F.col("y_track")
    pick = lambda c, first: F.when(turned == first, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}"))
    met = met.select(*on, *[pick(c, True).alias(f"a_{c}") for c in own], *[pick(c, False).alias(f"b_{c}") for c in own], "apart")
    both = met.groupBy(*on, "a_track", "a_nth", "a_off", "b_track", "b_nth", "b_off").agg(F.min("apart").alias("apart"))
    strength = F.greatest(F.lit(0.0), 1 - F.col("apart") / near)
    known = both.select(*on, F.col("a_track").alias("source"), F.col("b_track").alias("target"), (F.col("a_off") | F.col("b_off")).alias("off"), strength.alias("strength"))

    side = lambda some, p: some.select(*on, F.col("track").alias(f"{p}_track"), F.col("off").alias(f"{p}_off"), F.col("at").isNull().alias(f"{p}_lost"))
    lost = side(rows.where("at is null"), "x").join(side(rows, "y"), on)
    # of two lost events each meets the other: one of the two rows stays
    lost = lost.where("x_track <> y_track and not (x_off and y_off) and (not y_lost or x_track < y_track)")
    unknown = lost.select(*on, F.least("x_track", "y_track").alias("source"), F.greatest("x_track", "y_track").alias("target"), F.expr("x_off or y_off").alias("off"), F.lit(0.5).alias("strength"))
    subtype = F.when(F.col("off"), "present_with_negative").otherwise("co_present")
    return _edges(known.unionByName(unknown), "proximity", F.col("strength"), F.array("report"), subtype)


def track_graph(tracks: DataFrame, events: DataFrame, routine_negatives: bool = False, by_evidence: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges: subject, source, target, type, subtype, strength, evidence; one row of figures per subject).

    Of two tracks the smaller by name is the source; edges between them hold in both directions, those of progression
    forward. ``routine_negatives`` keeps tracks without a salient event, ``by_evidence`` adds edges of proximity.
    Density counts edges between tracks by pairs of active tracks.

    Nulls: a null assertion, change or kind is an empty word; events without a report have no edges; events of unknown tracks
    have none either. A subject without active tracks has figures of zero.
    """
    active = tracks if routine_negatives else salient(tracks, events)
    own = events.join(active.select("subject", "track"), ["subject", "track"], "left_semi")
    edges = progression(own).unionByName(coevolution(active, own)).unionByName(anatomical(active))
    edges = edges.unionByName(proximity(own)) if by_evidence else edges
    of = lambda kind: F.count_if(F.col("type") == kind).alias(f"n_{kind}")
    n_edges = edges.groupBy("subject").agg(F.count("*").alias("n_edges"), *[of(k) for k in ("progression", "coevolution", "anatomical", "proximity")])
    size = tracks.groupBy("subject").agg(F.count("*").alias("n_tracks")).join(active.groupBy("subject").agg(F.count("*").alias("n_active")), "subject", "left").join(n_edges, "subject", "left").na.fill(0)
    pairs = F.col("n_active") * (F.col("n_active") - 1) / 2
    density = F.when(pairs > 0, F.bround((F.col("n_edges") - F.col("n_progression")) / pairs, 6)).otherwise(0.0)
    return edges, size.withColumn("density", density)


# --- the fixture: users' events as tracks. The report is the day's third, evidence lies where the value says.

_ANATOMIES = ("lung", "liver", "gallbladder", "kidney", "unknown", "pleural space", "heart", "right kidney", "scalp", "rib")
_CHANGES = ("new", "stable", "worsened", "resolved", "improved", "", "unchanged", "recurrent")
_ASSERTIONS = ("present", "absent", "present", "uncertain", "not_mentioned")


def _tracks_of_users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    of = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("user_id").alias("subject"), F.concat_ws("_", "event_type", (F.col("k") % 3).cast("string")).alias("track"), F.col("event_id").alias("nth"), F.col("event_type").alias("kind"),
        F.concat(F.lit("report_"), F.floor(F.dayofmonth("ts") / 3).cast("string")).alias("report"), of(_ASSERTIONS, F.col("k")).alias("assertion"), of(_CHANGES, F.col("k")).alias("change"),
        (F.col("k") % 11 == 0).alias("review_only"), F.when(F.col("k") % 13 > 0, F.floor(F.col("value") * 10)).otherwise(-1).cast("int").alias("start"),
    )
    rows = rows.withColumn("end", F.col("start") + F.when(F.col("start") < 0, 0).otherwise(F.col("nth") % 50).cast("int"))
    place = of(_ANATOMIES, F.length("track") * 3 + F.right("track", F.lit(1)).cast("int") * 4 + F.col("subject"))
    tracks = rows.where("track is not null").groupBy("subject", "track", "kind").agg(F.count("*").alias("n")).select("subject", "track", "kind", place.alias("anatomy"))
    return tracks, rows.drop("kind")


def _case(value: str, named, default: str) -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    return f"CASE {' '.join(f"WHEN {value} IN ({quoted(words)}) THEN '{name}'" for name, words in named)} ELSE {default} END"


def _family_sql(value: str, named) -> str:
    held = lambda words: " OR ".join([f"{value} IN ({', '.join(f"'{w}'" for w in words)})", *[f"contains({value}, '{w}')" for w in words if len(w) > 3]])
    return f"CASE {' '.join(f"WHEN {held(words)} THEN '{name}'" for name, words in named)} ELSE {value} END"


_words = lambda words: f"[{', '.join(f"'{w}'" for w in words)}]"
_set = lambda words: ", ".join(f"'{w}'" for w in words)
_GRAPH_SQL = f"""WITH e AS (SELECT user_id AS subject, event_type || '_' || (k % 3) AS track, event_id AS nth, event_type AS kind, 'report_' || (day(ts) // 3) AS report, {_words(_ASSERTIONS)}[k % 5 + 1] AS assertion,
  {_words(_CHANGES)}[k % 8 + 1] AS change, k % 11 = 0 AS review_only, CASE WHEN k % 13 > 0 THEN CAST(floor(value * 10) AS INT) ELSE -1 END AS s FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)),
v AS (SELECT *, s + CASE WHEN s < 0 THEN 0 ELSE nth % 50 END AS t FROM e),
tracks AS (SELECT DISTINCT subject, track, kind, {_words(_ANATOMIES)}[(length(track) * 3 + CAST(right(track, 1) AS INT) * 4 + subject) % 10 + 1] AS anatomy FROM v),
active AS (SELECT * FROM tracks x WHERE kind NOT IN ({_set(LOW_SALIENCE)}) AND EXISTS (FROM v WHERE v.subject = x.subject AND v.track = x.track AND NOT review_only AND (assertion NOT IN ({_set(INACTIVE)}) OR change IN ({_set(SALIENT)})))),
c AS (SELECT v.*, assertion IN ({_set(INACTIVE)}) AS off FROM v SEMI JOIN active USING (subject, track) WHERE NOT review_only),
steps AS (SELECT * FROM (SELECT subject, track, kind, nth, report AS before, lead(report) OVER w AS after, lead(change) OVER w AS change, row_number() OVER w AS i FROM c
  WINDOW w AS (PARTITION BY subject, track ORDER BY CAST(replace(report, 'report_', '') AS INT), nth)) WHERE after IS NOT NULL),
moves AS (SELECT subject, track, kind, before, after, max_by({_case("change", DIRECTIONS, "'stable'")}, i) AS d FROM steps GROUP BY ALL),
pairs AS (SELECT a.subject, a.track AS source, b.track AS target, count(*) AS shared, count(*) FILTER (a.d = b.d) AS n, count(*) FILTER (a.d = b.d AND a.d = 'worsening') AS w, count(*) FILTER (a.d = b.d AND a.d = 'improving') AS i,
  count(*) FILTER (a.d = b.d AND a.d = 'stable') AS s, list(a.before || '->' || a.after ORDER BY a.before, a.after) FILTER (a.d = b.d) AS told
  FROM moves a JOIN moves b USING (subject, before, after) WHERE a.track < b.track AND a.kind IS DISTINCT FROM b.kind GROUP BY ALL),
placed AS (SELECT subject, track, anatomy, {_family_sql("anatomy", ORGANS)} AS organ, {_family_sql("anatomy", REGIONS)} AS region FROM active WHERE anatomy NOT IN ({_set(NO_PLACE)})),
beside AS (SELECT unnest([{", ".join(f"'{name}|{o}', '{o}|{name}'" for name, others in NEIGHBOURS for o in others)}]) AS p),
edges AS (SELECT subject, track AS source, track AS target, 'progression' AS type, {_case("change", SUBTYPES, "'unknown'")} AS subtype, 1.0::DOUBLE AS strength, before || ' ' || after AS evidence FROM steps
UNION ALL SELECT subject, source, target, 'coevolution', CASE WHEN w >= i AND w >= s THEN 'co_worsening' WHEN i >= s THEN 'co_improving' ELSE 'co_stable' END, round_even(n / shared, 4), array_to_string(told, ' ') FROM pairs WHERE shared >= {LEAST_SHARED} AND n > 0
UNION ALL SELECT a.subject, a.track, b.track, 'anatomical', CASE WHEN a.organ = b.organ THEN 'same_organ' WHEN a.organ || '|' || b.organ IN (FROM beside) THEN 'adjacent' ELSE 'same_region' END,
  CASE WHEN a.organ = b.organ THEN 1.0 WHEN a.organ || '|' || b.organ IN (FROM beside) THEN 0.8 ELSE 0.6 END::DOUBLE, 'anatomy:' || a.anatomy || ' anatomy:' || b.anatomy
  FROM placed a JOIN placed b ON a.subject = b.subject AND a.track < b.track AND (a.organ = b.organ OR a.region = b.region)
UNION ALL SELECT subject, source, target, 'proximity', CASE WHEN off THEN 'present_with_negative' ELSE 'co_present' END, CASE WHEN apart IS NULL THEN 0.5 ELSE round_even(1 - apart / {NEAR}, 4) END::DOUBLE, report FROM (
  SELECT a.subject, a.report, a.track AS source, b.track AS target, a.off OR b.off AS off, CASE WHEN a.s >= 0 AND b.s >= 0 THEN least(abs(b.s - a.t), abs(a.s - b.t), abs(b.s - a.s)) END AS apart
  FROM c a JOIN c b ON a.subject = b.subject AND a.report = b.report AND a.track < b.track AND NOT (a.off AND b.off)) WHERE apart IS NULL OR apart <= {NEAR})"""


@query("track_graph_edges", _GRAPH_SQL + " SELECT * FROM edges")
def track_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = track_graph(*_tracks_of_users(spark, sf_dir))
    return edges.withColumn("evidence", F.array_join("evidence", " "))


@query("track_graph_figures", _GRAPH_SQL + """, n AS (SELECT subject, count(*) AS n_edges, count(*) FILTER (type = 'progression') AS n_progression, count(*) FILTER (type = 'coevolution') AS n_coevolution,
  count(*) FILTER (type = 'anatomical') AS n_anatomical, count(*) FILTER (type = 'proximity') AS n_proximity FROM edges GROUP BY subject),
k AS (SELECT subject, count(*) AS n_tracks FROM tracks GROUP BY subject), a AS (SELECT subject, count(*) AS n_active FROM active GROUP BY subject)
SELECT k.subject, n_tracks, coalesce(n_active, 0) AS n_active, coalesce(n_edges, 0) AS n_edges, coalesce(n_progression, 0) AS n_progression, coalesce(n_coevolution, 0) AS n_coevolution, coalesce(n_anatomical, 0) AS n_anatomical, coalesce(n_proximity, 0) AS n_proximity,
  CASE WHEN n_active > 1 THEN round_even((coalesce(n_edges, 0) - coalesce(n_progression, 0)) / (n_active * (n_active - 1) / 2), 6) ELSE 0.0 END AS density FROM k LEFT JOIN a USING (subject) LEFT JOIN n USING (subject)""")
def track_graph_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_graph(*_tracks_of_users(spark, sf_dir))[1]
