"""Sections, sentences, findings and spans on clinical texts made by hand, and against plain searches on random ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from strandline.functions import spans

REPORT = """INDICATION: Cough.
FINDINGS:
No pleural effusion. There is a 3.2 x 2.1 cm mass in the
right upper lobe, likely stable. Nodules are not seen.

The 8 mm nodule is new. No new fracture.
IMPRESSION: Mass, probably unchanged.
FINDINGS: late part
RECOMMENDATION:
"""
RULES = (("effusion", r"\beffusion\b"), ("pleural_effusion", r"\bpleural\s+effusion\b"), ("mass", r"\bmass(?:es)?\b"), ("nodule", r"\bnodules?\b"), ("fracture", r"\bfracture\b"))


def test_sections(spark):
    rows = spark.createDataFrame([(1, REPORT), (2, "no heading at all"), (3, None), (4, "")], "id int, text string")
    found = spans.spread(rows, spans.sections()).orderBy("id", "place").collect()
    assert found[0].asDict().keys() == {"id", "place", "section", "start", "end"} and {r.id for r in found} == {1}
    assert [r.section for r in found] == ["indication", "findings", "impression", "findings", "recommendation"]
    assert [REPORT[r.start : r.end] for r in found][0::2] == ["Cough.", "Mass, probably unchanged.", ""]
    clean = {r.id: r.c for r in rows.select("id", spans.cleaned(F.col("text")).alias("c")).collect()}
    assert clean[1].asked == "Cough." and clean[1].read.endswith("fracture.\nlate part\n\nMass, probably unchanged.") and clean[1].sections[0] == "indication"
    assert (clean[2].read, clean[2].asked, clean[2].sections, clean[3].read) == ("no heading at all", "", [], "")
    assert [spans.section_of(h) for h in ("REASON FOR STUDY :", "CT  CHEST:", "BONE WINDOWS:", "WET READ:", "Clinical History:")] == ["indication", "findings", "findings", "wet read", "history"]
    own = spans.spread(rows, spans.sections((r"MASS,",))).collect()
    assert own == []  # a heading begins a line


def test_sentences(spark):
    rows = spark.createDataFrame([(1, REPORT), (2, " One. two! Three?\n\n\nfour  \n"), (3, None)], "id int, text string")
    found = spans.spread(rows, spans.sentences()).collect()
    texts = {1: REPORT, 2: " One. two! Three?\n\n\nfour  \n"}
    assert all(spans.joined_lines(texts[r.id])[r.start : r.end] == r.sentence and "\n" not in r.sentence for r in found)
    assert [r.sentence for r in found if r.id == 2] == ["One. two!", "Three?", "four"]
    assert "There is a 3.2 x 2.1 cm mass in the right upper lobe, likely stable." in [r.sentence for r in found]
    folded = spans.folded_sentences_of("Mild edema  vs. prominent\n veins; ok. No  effusion\n")
    text = "Mild edema  vs. prominent\n veins; ok. No  effusion\n"
    assert [(s, text[a:b]) for _, s, a, b in folded] == [("Mild edema vs. prominent veins;", "Mild edema  vs. prominent\n veins;"), ("No effusion", "No  effusion")]


def test_folded_rows(spark):
    """Pieces stand at their offsets, whatever batches they come in."""
    texts = {1: "Mild edema  vs. prominent\n veins; ok. No  effusion\n", 2: None, 3: "", 4: "Größe  der Läsion; 漢字 \U0001f600 und  mehr davon. " * 50}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    for held in (1, 1 << 22):
        found = sorted(map(tuple, spans.folded_rows(rows, "id", held).collect()))
        assert found == sorted((i, *f, texts[i][f[2] : f[3]]) for i, t in texts.items() for f in spans.folded_sentences_of(t)) and len(found) > 100


def test_findings(spark):
    rows = spark.createDataFrame([(1, REPORT), (2, "Fracture. No evidence of mass or nodule, which cannot be excluded 4 mm."), (3, ""), (4, None)], "id int, text string")
    found = spans.spread(rows, spans.rule_findings(RULES)).orderBy("id", "place").collect()
    got = [(r.id, r.finding, r.negated, r.certainty, r.change, r.value, r.value3, r.unit, r.mm, r.confidence) for r in found]
    assert got == [
        (1, "pleural_effusion", True, "definite", None, None, None, None, None, 0.9),
        (1, "mass", False, "probable", "stable", 3.2, 2.1, "cm", 32.0, 0.92),
        (1, "nodule", True, "definite", None, None, None, None, None, 0.9),
        (1, "nodule", False, "definite", "new", 8.0, None, "mm", 8.0, 0.92),
        (1, "fracture", True, "definite", "new", None, None, None, None, 0.9),
        (1, "mass", False, "probable", "stable", None, None, None, None, 0.85),
        (2, "fracture", False, "definite", None, None, None, None, None, 0.85),
        (2, "nodule", True, "definite", None, 4.0, None, "mm", 4.0, 0.9),
        (2, "mass", True, "definite", None, 4.0, None, "mm", 4.0, 0.9),
    ]
    pattern = dict(RULES)
    assert all(re.fullmatch(pattern[r.finding], {1: REPORT, 2: rows.collect()[1].text}[r.id][r.start : r.end], re.I) for r in found)
    share = {r.id: (r.n_sentences, r.n_found, r.coverage) for r in spans.coverage(rows, RULES, "id").collect()}
    assert share[2] == (2, 2, 1.0) and share[3] == share[4] == (0, 0, 0.0) and share[1][1] == 6


def plain_locate(text, evidence):
    wanted = re.sub(r"\s+", " ", evidence or "").strip()
    if not text or not wanted:
        return (-1, -1)
    for pattern in (re.escape(wanted), r"\s+".join(map(re.escape, wanted.split(" "))), r"\s*".join(map(re.escape, re.findall(r"\w+|[^\w\s]", wanted)))):
        for at in range(len(text)):
            if m := re.compile(pattern, re.IGNORECASE).match(text, at):
                s, e = m.span()
                if not (s and text[s - 1].isalnum() and text[s].isalnum()) and not (text[e : e + 1].isalnum() and text[e - 1].isalnum()):
                    return (s, e)
    return (-1, -1)


def plain_sentence(text, s, e):
    if s < 0 or e <= s or e > len(text):
        return ""
    head = text[:s]
    begin = max(head.rfind(". ") + 2 if ". " in head else 0, head.rfind("\n") + 1)
    end = text.find(". ", e)
    end = text.find("\n", e) if end < 0 else end
    return text[begin : len(text) if end < 0 else end + 1].strip()


def test_located(spark):
    rng = random.Random(3)
    bits = ["mass", "Mass", "mas", " ", "  ", "\n", ". ", ".", ",", "(", "é", "left lung", "\\E", "_"]
    rows = [("".join(rng.choices(bits, k=rng.randrange(0, 14))), "".join(rng.choices(bits, k=rng.randrange(0, 4)))) for _ in range(400)]
    rows += [("Cardiomegaly . Stable", "cardiomegaly."), ("masses mass", "MASS"), (None, "x"), ("x", None), ("a  b", "A B"), ("x a b", "a\nb")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, e string").withColumn("s", spans.locate(F.col("t"), F.col("e")))
    for r in frame.select("t", "e", "s", spans.sentence_around(F.col("t"), F.col("s.start"), F.col("s.end")).alias("around")).collect():
        assert (r.s.start, r.s.end) == plain_locate(r.t, r.e), (r.t, r.e)
        if r.t is not None:
            assert r.around == plain_sentence(r.t, r.s.start, r.s.end), (r.t, r.s)


@pytest.mark.parametrize("name, evidence, want", [
    ("hemorrhage", "No evidence of Hemorrhage.", "Hemorrhage"), ("pleural effusion", "effusion in the pleural space", "effusion in the pleural"), ("osteophytosis", "small osteophytes seen", "osteophytes"),
    ("left lung mass", "a mass", "mass"), ("left lung upper mass", "a mass", None), ("ab", "cd", None), ("", "x", None), (None, "x", None), ("x", None, None),
])
def test_recovered(spark, name, evidence, want):
    row = spark.createDataFrame([(name, evidence)], "n string, e string").select(spans.recover(F.col("n"), F.col("e")).alias("s")).first().s
    assert (evidence[row.start : row.end] if row.start >= 0 else None) == want


def test_gates(spark):
    rows = [("0", "3", True), ("3", "3", False), ("-1", "4", False), ("x", "4", False), (None, "4", False), ("1", None, False), ("2.5", "4", False)]
    frame = spark.createDataFrame([r[:2] for r in rows], "s string, e string")
    assert [r[0] for r in frame.select(spans.span_gate(F.col("s"), F.col("e"))).collect()] == [r[2] for r in rows]
    cases = [(0, 4, "the mass", (0, 4)), (0, 99, "mass", (0, 11)), (40, 99, "mass", (-1, -1)), (5, 11, "mass", (-1, -1)), (5, 11, "of the", (5, 11)), (5, 11, None, (5, 11)), (7, 2, "mass", (-1, -1))]
    frame = spark.createDataFrame([("Mass, lower", *c[:3]) for c in cases], "t string, s int, e int, n string")
    assert [tuple(r[0]) for r in frame.select(spans.valid_span(F.col("t"), F.col("s"), F.col("e"), F.col("n"))).collect()] == [c[3] for c in cases]


def test_fixture(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rules = spans.Rules(spans._RULES)
    want = sorted((i, *f[:-1]) for i, t in texts.items() for f in rules.of_text(t))
    found = spans.text_findings(spark, SF).collect()
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2]) and len({r.finding for r in found}) > 2
    for r in spans.evidence_spans(spark, SF).collect():
        words = texts[r.doc_id].split() if texts[r.doc_id] else []
        if len(words) > 8:
            wanted = words[len(words) // 2 - 1 :][:4]
            assert r.passes == (texts[r.doc_id][r.start : r.end].split() == wanted)
            assert r.passes or any(len(w.upper()) != len(w) for w in wanted)  # ß has no capital
