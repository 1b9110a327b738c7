"""Text functions: normalisers, keyword labels, negation near a term, tokens, lines and claims. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

#: White space, stop words, cues of negation and of change in the order in which they are tried.
SPACE = r"[\t\n\x0B\f\r ]+"
STOP = ("and", "for", "the", "was", "with")
NEGATION = "(^|[^a-z])(no|not|without|la)([^a-z]|$)"
CHANGE = (("stable", "stable|unchanged"), ("increased", "increas|larger|enn"), ("decreased", "decreas|smaller|ith"), ("new", "new"))
SIDES = (("bilateral", "bilateral|both"), ("left", "left|le "), ("right", "right|ri"))
LEAST_CLAIM, LONG_LINE, MANY_WORDS = 10, 40, 60


def slot_token(x: Column) -> Column:
    """Lower case; runs of other than a-z and 0-9 become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slot_text(x: Column) -> Column:
    """As slot_token, unknown where nothing is left or the value is null."""
    return F.coalesce(F.nullif(slot_token(x), F.lit("")), F.lit("unknown"))


def link_token(x: Column) -> Column:
    """Lower case, hyphens as spaces, white space as underscores; other punctuation stays."""
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(x), "-", " ")), SPACE, "_")


def one_spaced(x: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(x, SPACE, " "))


def first_label(x: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The label of the first pattern that is found."""
    found = F.when(x.isNull(), default)
    for label, pattern in rules:
        found = found.when(x.rlike(pattern), label)
    return found.otherwise(default)


def negated_near(x: Column, term: str, before: int = 50, after: int = 80) -> Column:
    """Whether a cue of negation stands in the ``before`` characters in front of the first ``term`` or the ``after`` from its start; null without the term."""
    at = F.locate(term, x)
    front = F.substring(x, F.greatest(at - before, F.lit(1)), F.least(F.lit(before), at - 1))
    return F.when(at > 0, front.rlike(NEGATION) | F.substring(x, at, F.lit(after)).rlike(NEGATION))


def tokens(x: Column) -> Column:
    """The set of runs of a-z and 0-9 longer than two, without stop words."""
    words = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP)))


def lexical_match(a: Column, b: Column, least: int = 2) -> Column:
    """One text holds the other, or they share min(least, size of the smaller set) tokens and at least one."""
    x, y = tokens(a), tokens(b)
    bar = F.greatest(F.lit(1), F.least(F.lit(least), F.size(x), F.size(y)))
    return a.contains(b) | b.contains(a) | (F.size(F.array_intersect(x, y)) >= bar)


@query("slot_normalisers", r"""SELECT event_id, trim(regexp_replace(lower(trim(props)), '[^a-z0-9]+', '_', 'g'), '_') AS slot_token, coalesce(nullif(trim(regexp_replace(lower(trim(props)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slot_text,
  regexp_replace(trim(replace(lower(props), '-', ' ')), '[\t\n\x0B\f\r ]+', '_', 'g') AS link_token FROM events""")
def slot_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", slot_token(p).alias("slot_token"), slot_text(p).alias("slot_text"), link_token(p).alias("link_token"))


@query("evidence_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS evidence FROM documents")
def evidence_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", one_spaced(F.col("text")).alias("evidence"))


def _label_sql(x: str, rules: tuple[tuple[str, str], ...], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{label}'" for label, p in rules) + f" ELSE '{default}' END"


@query("text_labels", f"""SELECT conv_id, turn, {_label_sql("t", CHANGE, "not_stated")} AS change, {_label_sql("t", SIDES, "none")} AS side,
  regexp_matches(t, '[a-z]{{2,}}') AND regexp_matches(t, '[^\\x00-\\x7F]') AS code_mixed, regexp_matches(t, '[\\x{{0900}}-\\x{{097F}}]') AS devanagari
  FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by ordered keywords: change, side, ASCII words beside other scripts, Devanagari."""
    t = F.col("t")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("t"))
    mixed = t.rlike("[a-z]{2,}") & t.rlike(r"[^\x00-\x7F]")
    return rows.select("conv_id", "turn", first_label(t, CHANGE, "not_stated").alias("change"), first_label(t, SIDES, "none").alias("side"), mixed.alias("code_mixed"), t.rlike(r"[ऀ-ॿ]").alias("devanagari"))


@query("negation_window", f"""SELECT doc_id, CASE WHEN p > 0 THEN regexp_matches(substr(t, greatest(p - 50, 1), least(50, p - 1)), '{NEGATION}') OR regexp_matches(substr(t, p, 80), '{NEGATION}') END AS negated
  FROM (SELECT doc_id, t, CAST(strpos(t, 'ing') AS INT) AS p FROM (SELECT doc_id, lower(text) AS t FROM documents))""")
def negation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t")).select("doc_id", negated_near(F.col("t"), "ing").alias("negated"))


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('and', 'for', 'the', 'was', 'with')))"


@query("turn_matches", f"""SELECT conv_id, turn, contains(a, b) OR contains(b, a) OR len(list_intersect(x, y)) >= greatest(1, least(2, len(x), len(y))) AS matched, len(x) AS n_tokens FROM (
  SELECT *, {_TOKENS.format('a')} AS x, {_TOKENS.format('b')} AS y FROM (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)) WHERE b IS NOT NULL AND a IS NOT NULL""")
def turn_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn takes up words of the turn before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), before.alias("b")).where("a is not null and b is not null")
    return rows.select("conv_id", "turn", lexical_match(F.col("a"), F.col("b")).alias("matched"), F.size(tokens(F.col("a"))).cast("long").alias("n_tokens"))


@query("claims", f"""SELECT doc_id, CAST(i AS BIGINT) AS place, claim FROM (SELECT doc_id, unnest(c) AS claim, generate_subscripts(c, 1) - 1 AS i FROM (
  SELECT doc_id, list_transform(string_split_regex(text, '[.!?\n]+'), lambda s: trim(s, ' ')) AS c FROM documents)) WHERE length(claim) >= {LEAST_CLAIM}""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of at least LEAST_CLAIM characters and their places."""
    parts = F.posexplode(F.transform(F.split("text", "[.!?\n]+"), lambda x: F.btrim(x))).alias("i", "claim")
    rows = table(spark, sf_dir, "documents").select("doc_id", parts)
    return rows.where(F.length("claim") >= LEAST_CLAIM).select("doc_id", F.col("i").cast("long").alias("place"), "claim")


@query("line_dedupe", f"""WITH l AS (SELECT doc_id, unnest(c) AS line, generate_subscripts(c, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n > 1 AND length(line) > {LONG_LINE}) AS n_dropped, sha256(string_agg(line, chr(10) ORDER BY i) FILTER (n = 1 OR length(line) <= {LONG_LINE})) AS kept FROM r GROUP BY doc_id""")
def line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of a long line go. A text's lines never leave its row, so nothing is shuffled: a line stays if it is the first that equals it."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines.alias("l"))
    # short lines get a tag by place, which makes each of them unlike the others
    tagged = F.transform("l", lambda x, i: F.struct(F.when(F.length(x) <= LONG_LINE, i).alias("at"), x.alias("line")))
    kept = F.array_distinct(tagged)
    text = F.array_join(F.transform("k", lambda x: x["line"]), "\n")
    rows = rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), kept.alias("k"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size("k")).alias("n_dropped"), F.sha2(text, 256).alias("kept"))


@query("closing_part", f"""SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) > {MANY_WORDS} THEN array_to_string(w[len(w) - len(w) // 3 + 1:], ' ') ELSE '' END AS closing FROM (
  SELECT doc_id, list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS w FROM documents)""")
def closing_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last third of the words of a text of more than MANY_WORDS, else nothing."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split("text", SPACE), "").alias("w"))
    n = F.size("w")
    third = F.floor(n / 3).cast("int")
    part = F.when(n > MANY_WORDS, F.array_join(F.slice("w", n - third + 1, third), " ")).otherwise("")
    return words.select("doc_id", n.cast("long").alias("n_words"), part.alias("closing"))


@query("marker_confidence", """SELECT doc_id, n AS n_markers, round(greatest(0.0, least(1.0, 1 - 0.05 * n)), 4) AS confidence, n > 3 OR 1 - 0.05 * n < 0.6 AS review FROM (
  SELECT doc_id, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n FROM documents)""")
def marker_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence falls by 0.05 for each marker of a text; more than three, or under 0.6, asks for review."""
    n = F.floor((F.length("text") - F.length(F.replace("text", F.lit(" the "), F.lit("")))) / 5)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lit(0.05) * F.col("n")))
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
    return rows.select("doc_id", F.col("n").alias("n_markers"), F.round(share, 4).alias("confidence"), ((F.col("n") > 3) | (share < 0.6)).alias("review"))


@query("entity_recall", """SELECT doc_id, round(len(list_filter(['ing', 'and', 'lle', 'ent'], lambda e: contains(t, e))) / 4, 4) AS recall FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def entity_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the expected terms that a text holds."""
    terms = ("ing", "and", "lle", "ent")
    held = sum((F.col("t").contains(e).cast("int") for e in terms), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t")).select("doc_id", F.round(held / len(terms), 4).alias("recall"))
