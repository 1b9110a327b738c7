"""Findings whose words are part of another finding's go into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

# --- fixed values: words that don't count, the fewest words of a set that can hold another or be held

EMPTY_WORDS = ("finding", "no", "the", "of", "in", "a", "an", "is", "are")
LEAST_WORDS = 2


def content_words(name: Column) -> Column:
    """The set of a name's words that count, in order."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(F.lit(""), *map(F.lit, EMPTY_WORDS))))


def contained(sets: DataFrame, group: str, words: str = "words") -> DataFrame:
    """Pairs of distinct sets of a group (group, child, parent: arrays) where all words of the child, and more, are in the parent.

    Equal sets meet once. A child looks for parents only under its word that the fewest sets of the group hold, so a word
    that all sets hold brings a set to the others only if it has no rarer one. No all-pairs rows arise but those of one such word.
    """
    distinct = sets.where(F.size(words) >= LEAST_WORDS).select(group, F.col(words).alias("_set")).distinct()
    held = distinct.select(group, "_set", F.explode("_set").alias("_word"))
    often = held.groupBy(group, "_word").agg(F.count("*").alias("_n"))
    rarest = held.join(often, [group, "_word"]).groupBy(group, F.col("_set").alias("child")).agg(F.min(F.struct("_n", "_word"))["_word"].alias("_word"))
    met = rarest.join(held.withColumnRenamed("_set", "parent"), [group, "_word"])
    return met.where((F.size("parent") > F.size("child")) & (F.size(F.array_except("child", "parent")) == 0)).select(group, "child", "parent")


def _settle(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(child, parent) in the order in which findings are taken in: pairs come by the earlier and then the later finding, and what is taken in takes no part any more."""
    gone, taken = set(), []
    for child, parent in sorted(links, key=lambda x: (min(x), max(x))):
        if child not in gone and parent not in gone:
            gone.add(child)
            taken.append((child, parent))
    return taken


def _told(own: str, other: str) -> str:
    """Evidence with another's, unless it holds that already."""
    return own if not other or other in own else f"{own}; {other}" if own else other


def absorb(findings: DataFrame, group: str) -> DataFrame:
    """``findings`` (group, nth, name, evidence) with ``parent`` (nth of the finding that took it in, null if it stays) and ``told``, the evidence with all that was taken in.

    A finding with at least LEAST_WORDS words goes if its words are a proper part of another's in its group. Who takes it in,
    and in which order evidence grows, follows from nth: links are settled in one group per ``group``, as each decides on later
    ones. That group holds the links between findings that are part of one another, and nothing of the others. A finding without
    evidence passes on its name. Equal sets both stay. nth is unique in a group; nulls in name or evidence are empty.
    """
    rows = findings.select(group, "nth", "name", "evidence", content_words(F.col("name")).alias("words"))
    pairs = contained(rows, group)
    at = rows.select(group, "nth", "words", F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("name", F.lit("")).alias("name"))
    side = lambda name: at.select(group, F.col("words").alias(name), F.struct("nth", "evidence", "name").alias(f"{name}_row"))
    links = pairs.join(side("child"), [group, "child"]).join(side("parent"), [group, "parent"]).select(group, F.col("child_row").alias("child"), F.col("parent_row").alias("parent"))
    kind, number = findings.schema[group].dataType.simpleString(), findings.schema["nth"].dataType.simpleString()

    def settle(key, frame):
        import pandas as pd

        known = {r["nth"]: r for r in [*frame["child"], *frame["parent"]]}
        taken = _settle([(c["nth"], p["nth"]) for c, p in zip(frame["child"], frame["parent"], strict=True)])
        told, into = {n: r["evidence"] for n, r in known.items()}, dict(taken)
        for child, parent in taken:
            told[parent] = _told(told[parent], told[child] or known[child]["name"])
        return pd.DataFrame({group: key[0], "nth": list(known), "parent": pd.array([into.get(n) for n in known], "Int64"), "told": [told[n] for n in known]})

    settled = links.groupBy(group).applyInPandas(settle, f"{group} {kind}, nth {number}, parent {number}, told string")
    out = findings.join(settled, [group, "nth"], "left")
    return out.withColumn("told", F.coalesce("told", "evidence", F.lit("")))


# --- the fixture: a user's days as findings, named by the kinds of events on them


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("name"), F.min("event_id").alias("evidence"))
    return rows.select("user_id", F.datediff("day", F.lit("2000-01-01")).alias("nth"), F.concat(F.lit("the "), "name").alias("name"), F.col("evidence").cast("string").alias("evidence"))


_LINKS_SQL = """WITH RECURSIVE d AS (SELECT user_id, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS nth, list_sort(list(DISTINCT event_type)) AS words, CAST(min(event_id) AS VARCHAR) AS evidence FROM events GROUP BY user_id, CAST(ts AS DATE)),
l AS (SELECT user_id, c.nth AS child, p.nth AS parent, row_number() OVER (PARTITION BY user_id ORDER BY least(c.nth, p.nth), greatest(c.nth, p.nth)) AS i
  FROM d c JOIN d p USING (user_id) WHERE len(c.words) >= 2 AND len(p.words) > len(c.words) AND list_has_all(p.words, c.words)),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(child BIGINT, parent BIGINT)[]) AS taken FROM l
UNION ALL SELECT f.user_id, l.i, CASE WHEN list_contains(list_transform(taken, lambda x: x.child), child) OR list_contains(list_transform(taken, lambda x: x.child), parent) THEN taken ELSE list_append(taken, {'child': child, 'parent': parent}) END
  FROM f JOIN l ON f.user_id = l.user_id AND l.i = f.i + 1),
t AS (SELECT user_id, unnest(max_by(taken, i)) AS x FROM f GROUP BY user_id)
SELECT d.user_id, CAST(d.nth AS INT) AS nth, CAST(x.parent AS INT) AS parent FROM d LEFT JOIN t ON t.user_id = d.user_id AND t.x.child = d.nth"""


@query("absorbed_findings", _LINKS_SQL)
def absorbed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return absorb(_days(spark, sf_dir), "user_id").select("user_id", "nth", "parent")
