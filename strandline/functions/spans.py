"""From texts to spans: sections, sentences and rule findings as table-valued functions, with offsets into the text as it came; evidence located in it."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

# --- fixed values: headings of reports, what they count as, and the cues of the rules

HEADINGS = (
    r"(?:CLINICAL\s+)?HISTORY\s*:",
    r"INDICATION\s*:",
    r"REASON\s+FOR\s+(?:EXAM(?:INATION)?|STUDY)\s*:",
    r"COMPARISON\s*:",
    r"TECHNIQUE\s*:",
    r"PROCEDURE\s*:",
    r"CLINICAL\s+INFORMATION\s*:",
    r"FINDINGS\s*:",
    r"IMPRESSION\s*:",
    r"CONCLUSION\s*:",
    r"RECOMMENDATION\s*:",
    r"WET\s+READ\s*:",
    r"ADDENDUM\s*:",
)
#: What a heading counts as: the first whose words it holds; studies and body parts head findings.
SECTIONS = (
    ("indication", ("indication", "reason for")),
    ("history", ("history", "clinical information")),
    ("comparison", ("comparison",)),
    ("technique", ("technique", "procedure")),
    ("findings", ("findings",)),
    ("impression", ("impression",)),
    ("conclusion", ("conclusion",)),
    ("recommendation", ("recommendation",)),
    ("findings", ("ct", "mri", "mr ", "views", "spine", "pa and lateral", "chest", "head", "abdomen", "pelvis", "knee", "brain", "breast", "mammograph", "ultrasound", "vascular", "angiograph", "spectroscopy", "perfusion", "dwi", "flair", "post-contrast", "post contrast", "post gadolinium", "nuclear medicine", "pet", "windows")),
)
READ, ASKED = ("findings", "impression", "conclusion"), ("indication", "history")

NEGATED_BEFORE = r"\b(?:no\s+evidence\s+of|no\s+acute|no\s+significant|no\s+definite|negative\s+for|absence\s+of|without\s+evidence\s+of|without|not\s+identified|not\s+seen|not\s+detected|no)\b"
NEGATED_AFTER = r"\b(?:is\s+absent|are\s+absent|not\s+seen|not\s+identified|not\s+detected|is\s+negative|are\s+negative)\b"
MEASURED = r"(\d+\.?\d*)\s*(?:x\s*(\d+\.?\d*)\s*)??(?:x\s*(\d+\.?\d*)\s*)??(cm|mm|centimeters?|millimeters?)\b"
CHANGES = (
    ("stable", r"\b(?:stable|unchanged|no\s+(?:significant\s+)?change)\b"),
    ("increased", r"\b(?:increas(?:ed|ing)|enlarg(?:ed|ing)|worsen(?:ed|ing)|progress(?:ed|ing)|grow(?:n|ing))\b"),
    ("decreased", r"\b(?:decreas(?:ed|ing)|smaller|improv(?:ed|ing)|resolv(?:ed|ing)|diminish(?:ed|ing)|regress(?:ed|ing))\b"),
    ("new", r"\bnew(?:ly)?\b"),
)
CERTAINTIES = (
    ("definite", r"\b(?:definite(?:ly)?|confirmed|proven)\b"),
    ("probable", r"\b(?:probable|probably|likely|suggestive)\b"),
    ("possible", r"\b(?:possible|possibly|may\s+represent|cannot\s+exclude|questionable)\b"),
    ("indeterminate", r"\b(?:indeterminate|equivocal|uncertain|unclear)\b"),
)
BEFORE, AFTER, AROUND = 50, 80, 60  # characters that negations and measurements are sought in
PLAIN, MEASURED_SURE, NEGATED_SURE = 0.85, 0.92, 0.90  # confidences
FILLERS = ("the", "a", "an", "of", "in", "on", "is", "are", "no", "not")
LEAST_SENTENCE = 8


# --- texts to rows, one text at a time


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), start + len(part.rstrip())


def section_of(heading: str) -> str:
    plain = re.sub(r"\s+", " ", re.sub(r"\s*[:.]\s*$", "", heading.strip()).lower())
    return next((name for name, words in SECTIONS if any(w in plain for w in words)), plain)


def sections_of(text: str | None, headings: tuple[str, ...] = HEADINGS) -> list[tuple[int, str, int, int]]:
    """(place, section, start, end) of what stands under each heading at the beginning of a line, without blanks around it."""
    text = text or ""
    found = list(re.finditer(r"^\s*(" + "|".join(headings) + ")", text, re.MULTILINE | re.IGNORECASE))
    out = []
    for i, m in enumerate(found):
        start, end = _trimmed(text, m.end(), found[i + 1].start() if i + 1 < len(found) else len(text))
        out.append((i, section_of(m[1]), start, max(start, end)))
    return out


def joined_lines(text: str) -> str:
    """Line ends inside a sentence as blanks: as many characters as before, so offsets stay."""
    return re.sub(r"(?<![.!?])\n(?!\s*\n)", " ", text)


def sentences_of(text: str | None) -> list[tuple[int, str, int, int]]:
    """(place, sentence, start, end): cut after a stop before a capital, and at line ends that end a sentence or paragraph."""
    text = joined_lines(text or "")
    out, at = [], 0
    for m in [*re.finditer(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=\S)", text), None]:
        start, end = _trimmed(text, at, m.start() if m else len(text))
        if end > start:
            out.append((len(out), text[start:end], start, end))
        at = m.end() if m else at
    return out


def folded_sentences_of(text: str | None) -> list[tuple[int, str, int, int]]:
    """(place, sentence, start, end): blanks folded to one, cut at stops and semicolons but not after "vs", at least LEAST_SENTENCE long.

    Offsets are those of the sentence in the text before folding.
    """
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", text or "")]
    folded = " ".join(w for _, w in words)
    places = [0]
    for _, w in words:
        places.append(places[-1] + len(w) + 1)
    back = lambda i: words[k := bisect_right(places, i) - 1][0] + i - places[k]
    stops = re.sub(r"\b(vs)\.", "\\1\x00", folded, flags=re.IGNORECASE)
    out = []
    for m in re.finditer(r"[^.;]+(?:[.;]|$)", stops):
        start, end = _trimmed(folded, *m.span())
        if end - start >= LEAST_SENTENCE:
            out.append((len(out), folded[start:end], back(start), back(end - 1) + 1))
    return out


class Rules:
    """Findings by (name, pattern) rules: where, negated or not, how sure, with what change and measurement.

    Of two values the second is value3, as the pattern's groups give way from the left; mm is that of the first.
    """

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        cased = lambda p: re.compile(p, re.IGNORECASE)
        self.rules = [(name, cased(p)) for name, p in rules]
        self.before, self.after, self.measured = cased(NEGATED_BEFORE), cased(NEGATED_AFTER), cased(MEASURED)
        self.changes, self.certainties = ([(name, cased(p)) for name, p in some] for some in (CHANGES, CERTAINTIES))

    def of_sentence(self, sentence: str) -> list[tuple]:
        first = lambda some, default: next((name for name, p in some if p.search(sentence)), default)
        found, change, certainty = [], None, None
        for name, pattern in self.rules:
            for m in pattern.finditer(sentence):
                if not found:
                    change, certainty = first(self.changes, None), first(self.certainties, "definite")
                s, e = m.span()
                negated = bool(self.before.search(sentence[max(0, s - BEFORE) : s]) or self.after.search(sentence[s : s + AFTER]))
                size = self.measured.search(sentence[max(0, s - AROUND) : e + AROUND])
                values = [float(v) if v else None for v in size.groups()[:3]] if size else [None] * 3
                unit = ("cm" if size[4].lower().startswith("c") else "mm") if size else None
                mm = values[0] * (10.0 if unit == "cm" else 1.0) if size else None
                found.append((s, e, name, negated, certainty, change, *values, unit, mm, NEGATED_SURE if negated else MEASURED_SURE if size else PLAIN))
        kept: list[tuple] = []
        for f in sorted(found, key=lambda f: f[0] - f[1]):  # the longest first, others inside of it go
            if not any(k[0] <= f[0] and k[1] >= f[1] and k[1] - k[0] > f[1] - f[0] for k in kept):
                kept.append(f)
        return kept

    def of_text(self, text: str | None) -> list[tuple]:
        """(place, name, negated, certainty, change, value, value2, value3, unit, mm, confidence, start, end, sentence_place, sentence)."""
        out = []
        for at, sentence, start, _ in sentences_of(text):
            for s, e, *rest in self.of_sentence(sentence):
                out.append((len(out), *rest, start + s, start + e, at, sentence))
        return out


# --- the same as table-valued functions: join them laterally to the rows that hold a text


def sections(headings: tuple[str, ...] = HEADINGS):
    """Rows (place, section, start, end) of a text, a row per heading."""

    class Sections:
        def eval(self, text: str):
            yield from sections_of(text, headings)

    return F.udtf(Sections, returnType="place int, section string, start int, end int", useArrow=True)


def sentences(folded: bool = False):
    """Rows (place, sentence, start, end) of a text; ``folded``: with blanks folded, cut at semicolons, too."""
    cut = folded_sentences_of if folded else sentences_of

    class Sentences:
        def eval(self, text: str):
            yield from cut(text)

    return F.udtf(Sentences, returnType="place int, sentence string, start int, end int", useArrow=True)


FINDING = "place int, finding string, negated boolean, certainty string, change string, value double, value2 double, value3 double, unit string, mm double, confidence double, start int, end int, sentence_place int, sentence string"


def rule_findings(rules: tuple[tuple[str, str], ...]):
    """Rows (FINDING) of a text, a row per finding."""

    class Findings:
        def __init__(self):
            self.rules = Rules(rules)

        def eval(self, text: str):
            yield from self.rules.of_text(text)

    return F.udtf(Findings, returnType=FINDING, useArrow=True)


def spread(rows: DataFrame, function, text: str = "text") -> DataFrame:
    """``rows`` without their text, once per row that ``function`` makes of it. A text is read by one task and is not exchanged."""
    columns = [c for c in rows.columns if c != text]
    return rows.lateralJoin(function(F.col(text).outer())).drop(text).select(*columns, *[c for c in function(F.lit("")).columns])


def folded_rows(rows: DataFrame, key: str, held: int = 1 << 22) -> DataFrame:
    """(key, place, sentence, start, end, piece) of ``folded_sentences_of`` each text of ``rows`` (key, text); ``piece`` is what stands at the offsets.

    Sentences go on in batches of some ``held`` characters, and no text is copied to each of its sentences.
    """
    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            own, texts, n, columns = batch.column(0), batch.column(1), 0, ([], [], [], [], [], [])

            def made(columns, own=own):
                at, *rest = columns
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
                return pa.RecordBatch.from_arrays([own.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names=[key, "place", "sentence", "start", "end", "piece"])

            for at in range(len(texts)):
                text = texts[at].as_py()
                for place, sentence, start, end in folded_sentences_of(text):
                    for c, v in zip(columns, (at, place, sentence, start, end, text[start:end]), strict=True):
                        c.append(v)
                    n += end - start
                    if n > held:
                        yield made(columns)
                        n, columns = 0, ([], [], [], [], [], [])
            yield made(columns)

    return rows.select(key, "text").mapInArrow(cut, f"{key} {kind}, place int, sentence string, start int, end int, piece string")


def coverage(rows: DataFrame, rules: tuple[tuple[str, str], ...], key: str) -> DataFrame:
    """Per row of ``rows`` (key, text): sentences, those with a finding, and their share of all."""
    some = spread(rows.select(key, "text"), rule_findings(rules)).groupBy(key).agg(F.countDistinct("sentence_place").alias("n_found"))
    every = spread(rows.select(key, "text"), sentences()).groupBy(key).agg(F.count("*").alias("n_sentences"))
    out = rows.select(key).join(every, key, "left").join(some, key, "left").na.fill(0, ["n_found", "n_sentences"])
    return out.withColumn("coverage", F.round(F.col("n_found") / F.greatest("n_sentences", F.lit(1)), 6))


def cleaned(text: Column) -> Column:
    """struct(read, asked, sections): what is to be read (findings, impression, conclusion; the whole text without them), what was asked, and the sections found."""

    @F.pandas_udf("read string, asked string, sections array<string>")
    def clean(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            parts: dict[str, list[str]] = {}
            found = sections_of(text)
            for _, name, s, e in found:
                parts.setdefault(name, []).append(text[s:e])
            joined = {name: "\n".join(p) for name, p in parts.items()}
            read = [joined[n] for n in READ if joined.get(n)]
            rows.append(("\n\n".join(read) if read else text.strip(), next((joined[n] for n in ASKED if joined.get(n)), ""), [n for _, n, _, _ in found]))
        return pd.DataFrame(rows, columns=["read", "asked", "sections"])

    return clean(text)


# --- spans in texts, by column expressions. Offsets count from 0, -1 is nowhere.

_LETTER = r"[\p{L}\p{N}]"


def _nowhere() -> Column:
    return F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))


def _quoted(piece: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(piece, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _found(text: Column, pattern: Column) -> Column:
    at = F.regexp_instr(text, pattern)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(F.regexp_substr(text, pattern))).cast("int").alias("end")))


def locate(text: Column, evidence: Column) -> Column:
    """struct(start, end) of evidence in a text, no matter the case, and not inside a word: as it is, else with any blanks between
    its words, else with or without blanks around each mark."""
    wanted = F.btrim(F.regexp_replace(evidence, r"\s+", " "))
    inside = lambda end: F.when(F.substr(wanted, *end).rlike(_LETTER), True).otherwise(False)
    before = F.when(inside((F.lit(1), F.lit(1))), rf"(?<!{_LETTER})").otherwise("")
    after = F.when(inside((F.length(wanted), F.lit(1))), rf"(?!{_LETTER})").otherwise("")
    whole = lambda body: F.concat(F.lit("(?iu)"), before, body, after)
    words = F.array_join(F.transform(F.split(wanted, " "), _quoted), r"\s+")
    marks = F.array_join(F.transform(F.regexp_extract_all(wanted, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)), _quoted), r"\s*")
    tried = F.coalesce(_found(text, whole(_quoted(wanted))), _found(text, whole(words)), _found(text, whole(marks)))
    return F.coalesce(F.when((F.length(text) > 0) & (wanted != ""), tried), _nowhere())


def span_gate(start: Column, end: Column) -> Column:
    """Whether both ends are whole numbers, neither is negative, and the span isn't empty."""
    s, e = start.try_cast("long"), end.try_cast("long")
    return F.coalesce((s >= 0) & (e >= 0) & (e > s), F.lit(False))


def valid_span(text: Column, start: Column, end: Column, name: Column) -> Column:
    """The span, cut at the text's end, or nowhere: if it begins beyond, or holds none of the name's words, fillers aside. A name without words can't fail."""
    fits = span_gate(start, end)
    s, e = start.try_cast("int"), F.least(end.try_cast("long"), F.length(text)).cast("int")
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")
    words = F.array_except(F.array_distinct(F.array_remove(F.split(plain(F.coalesce(name, F.lit(""))), r"\s+"), "")), F.array(*map(F.lit, FILLERS)))
    part = plain(F.substr(text, s + 1, e - s))
    named = (F.size(words) == 0) | F.exists(words, lambda w: part.contains(w))
    return F.when(fits & (s < F.length(text)) & named, F.struct(s.alias("start"), e.alias("end"))).otherwise(_nowhere())


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence that holds a span: from after the last stop and blank, or line end, before it to the first after it."""
    head, tail = F.substr(text, F.lit(1), start), F.substr(text, end + 1, F.length(text))
    begin = F.length(F.regexp_extract(head, r"(?s)^(.*(?:\. |\n))", 1))
    # a stop counts wherever it is, a line end only where no stop follows
    stop, line = F.locate(". ", tail), F.locate("\n", tail)
    upto = F.when(stop > 0, stop).when(line > 0, line).otherwise(F.length(tail))
    fine = (start >= 0) & (end > start) & (end <= F.length(text))
    return F.when(fine, F.btrim(F.substr(text, begin + 1, end - begin + upto), F.lit(" \t\n\r\x0b\x0c"))).otherwise("")


def recover(name: Column, evidence: Column) -> Column:
    """struct(start, end) of an entity's name in evidence: as it is, else the stretch that holds half its words, else words that begin like them."""
    wanted, text = F.btrim(F.lower(name)), F.lower(evidence)
    at = F.instr(text, wanted)
    words = F.regexp_extract_all(wanted, F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    enough = F.greatest(F.lit(1), F.floor(F.size(words) / 2))

    def stretch(some: Column, pattern) -> Column:
        spans = F.array_compact(F.transform(some, lambda w: _found(text, pattern(w))))
        return F.when(F.size(spans) >= enough, F.struct(F.array_min(F.transform(spans, lambda x: x["start"])).alias("start"), F.array_max(F.transform(spans, lambda x: x["end"])).alias("end")))

    whole = stretch(words, lambda w: F.concat(F.lit(r"\b"), w, F.lit(r"\b")))
    begins = stretch(F.filter(words, lambda w: F.length(w) >= 5), lambda w: F.concat(F.lit(r"\b"), F.substr(w, F.lit(1), F.lit(5)), F.lit(r"\w*\b")))
    direct = F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(wanted)).cast("int").alias("end")))
    fine = (F.length(name) > 0) & (F.length(evidence) > 0)
    return F.coalesce(F.when(fine, F.coalesce(direct, F.when(F.size(words) > 0, F.coalesce(whole, begins)))), _nowhere())


# --- the fixture: texts as reports

_RULES = (("insult", r"\bidiots?\b|\bmorons?\b"), ("threat", r"\b(?:kill|attack|destroy)\b"), ("licence", r"\blicen[cs]e[sd]?\b"), ("and", r"\b(?:and|und|et|y)\b"), ("pair", r"\b\w+ (?:and|und|et|y) \w+\b"))


@query("folded_sentences", rf"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(t, '\b([vV][sS])\.', '\1' || chr(1), 'g'), '[^.;]+(?:[.;]|$)'), lambda x: trim(replace(x, chr(1), '.'))) AS s FROM f),
k AS (SELECT doc_id, list_filter(s, lambda x: length(x) >= {LEAST_SENTENCE}) AS s FROM s)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS place, unnest(s) AS sentence, true AS in_place FROM k""")
def folded_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with blanks folded; ``in_place``: what stands at their offsets in the text is they."""
    rows = folded_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    there = F.btrim(F.regexp_replace("piece", r"(?U)\s+", " "))
    return rows.select("doc_id", "place", "sentence", (there == F.col("sentence")).alias("in_place"))


@query("text_findings")
def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rules over whole texts, with their spans."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), rule_findings(_RULES)).drop("sentence")


@query("evidence_spans")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where four words from the middle of a text, in capitals and with single blanks, stand in it, and the sentence around."""
    words = F.array_remove(F.split("text", r"\s+"), "")
    wanted = F.upper(F.array_join(F.slice(words, F.greatest(F.lit(1), (F.size(words) / 2).cast("int")), 4), " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", wanted.alias("wanted")).withColumn("span", locate(F.col("text"), F.col("wanted")))
    return rows.select("doc_id", "span.start", "span.end", span_gate(F.col("span.start"), F.col("span.end")).alias("passes"), sentence_around(F.col("text"), F.col("span.start"), F.col("span.end")).alias("sentence"))
