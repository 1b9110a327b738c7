"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import fold, other_columns, park, table

# The words of each class of the grammar.
INSULTS = """arschloch bastard bitch cabron clown coward creep cretin degenerate dimwit disgusting dumbass fool freak garbage gilipollas
hurensohn idiot idiota idiote imbecil imbecile imbécile jerk loser lowlife moron parasite pathetic pendejo pig psycho retard salaud scum
scumbag stupid trash ugly vermin wichser worthless""".split()
THREATS = "attack beat burn choke crush destroy hang hurt kill murder punch rape shoot slap slaughter smash stab strangle".split()
TARGETS = "du euch he her him his ihr she te them they toi tu u usted vos vous ya you your yours yourself".split()
NEGATIONS = "aint arent cannot cant dont isnt kein keine neither never nicht no none nor not pas sin wasnt without wont".split()
REPORTS = "alleged allegedly called calls claimed claims complained dijo dit quote quoted report reported said sagte say says writes wrote".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What a clause can hold: the outputs of the composed transducer.
OUTPUTS = ("insult", "insult at a target", "negated insult", "reported insult", "threat", "threat at a target")
#: Weights where there is nothing to learn from, and the centre of the ridge where there is.
BIAS, PRIOR = -3.0, (3.0, 3.5, 0.5, 0.5, 1.0, 3.5)
MOST_OF_EACH = 3  # counts of an output beyond this add nothing

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:|\n\r]")

# A transducer maps (state, class) to (state, output). State 0 is where every clause begins.
# The composed machine runs all of them on the same word and reads insult and threat outputs under the others' states.


def near(of: int, reach: int):
    """Its state counts down the words in which a word of class ``of`` still acts."""
    return lambda state, c: (reach, True) if c == of else (max(0, state - 1), state > 0)


def lasting(of: int):
    """Once seen, a word of class ``of`` acts to the end of the clause."""
    return lambda state, c: (1, True) if c == of or state else (0, False)


def emits(of: int):
    return lambda state, c: (0, c == of)


MACHINES = (emits(INSULT), emits(THREAT), near(TARGET, 4), near(NEGATION, 3), lasting(REPORT), near(INSULT, 3), near(THREAT, 4))


class Composed:
    """The product of MACHINES; its arcs are worked out when first used and kept."""

    def __init__(self):
        self.arcs: dict[tuple, tuple] = {}

    def arc(self, state: tuple, c: int) -> tuple:
        found = self.arcs.get((state, c))
        if found is None:
            (s1, insult), (s2, threat), (s3, target), (s4, negated), (s5, reported), (s6, insulted), (s7, threatened) = (m(s, c) for m, s in zip(MACHINES, state, strict=True))
            out: tuple[int, ...] = ()
            if insult:
                out = (3,) if reported else (2,) if negated else (1,) if target else (0,)
            elif threat and not negated and not reported:
                out = (4,)
            elif c == TARGET and not negated and not reported:
                out = (1,) * insulted + (5,) * threatened
            found = self.arcs[state, c] = ((s1, s2, s3, s4, s5, s6, s7), out)
        return found

    def outputs(self, words: list[str], classes: Classes) -> list[int]:
        state, found = (0,) * len(MACHINES), [0] * len(OUTPUTS)
        for w in words:
            state, out = self.arc(state, classes(w))
            for o in out:
                found[o] += 1
        return found


class Classes:
    """The class of a word: by the fixed lists, the learned words, or the learned stems it begins with."""

    def __init__(self, words: list[str] = (), stems: list[str] = ()):
        self.words: dict[str, int] = {}
        for given, c in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT), (words, INSULT)):
            self.words |= dict.fromkeys(given, c)
        self.stems = frozenset(stems)
        self.lengths = sorted({len(x) for x in stems})

    def __call__(self, word: str) -> int:
        return self.words.get(word) or (INSULT if any(word[:k] in self.stems for k in self.lengths) else OTHER)


def outputs_udf(classes: Classes):
    """Text to the counts of OUTPUTS over its clauses. Only clauses that hold an insult or a threat are read word by word."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def outputs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        seeds = ahocorasick.Automaton()
        for w, c in classes.words.items():
            if c in (INSULT, THREAT):
                seeds.add_word(w, (len(w), False))
        for w in classes.stems:
            seeds.add_word(w, (len(w), True))
        seeds.make_automaton()
        machine = Composed()

        def one(text: str | None) -> list[int]:
            total = [0] * len(OUTPUTS)
            text = (text or "").lower()
            done = 0  # clauses before this place are counted
            for end, (length, stem) in seeds.iter(text):
                start = end - length + 1
                if start < done or (start and text[start - 1].isalpha()) or (not stem and text[end + 1 : end + 2].isalpha()):
                    continue
                begin = start
                while begin > done and not CLAUSE_END.match(text, begin - 1):
                    begin -= 1
                stop = CLAUSE_END.search(text, end)
                done = stop.start() if stop else len(text)
                clause = WORD.findall(text[begin:done].replace("'", "").replace("’", ""))
                total = [a + b for a, b in zip(total, machine.outputs(clause, classes), strict=True)]
            return total

        for texts in batches:
            yield pd.Series([one(t) for t in texts])

    return outputs


#: A mark's rows are surely toxic by so much, at the lower end of the interval that 1.96 standard errors leave (Wilson's): 6 of 6, 12 of 13, 18 of 20.
LEAST_SHARE, ERRORS, FEWEST = 0.6, 1.96, 6


def lower_share(bad: Column, n: Column) -> Column:
    """The lower end of Wilson's interval for the share of ``bad`` in ``n``."""
    z2, p = ERRORS * ERRORS, bad / n
    return (p + z2 / (2 * n) - ERRORS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def distinct_marks(marks: list[tuple[str, int, int]]) -> tuple[list[str], list[str]]:
    """(words, stems) of (mark, toxic rows, rows), without those that say what another one says.

    A stem that stands in the rows of one word or longer stem only is that; of what remains a word or stem that begins with a stem is.
    """
    rows = {m: (bad, n) for m, bad, n in marks}
    repeats = {m[:k] + "*" for m in rows for k in (4, 5, 6, 7) if len(m.rstrip("*")) > k and rows.get(m[:k] + "*") == rows[m]}
    stems = {m[:-1] for m in rows if m[-1] == "*"} - {m[:-1] for m in repeats}
    covered = lambda m: any(m[:k] in stems for k in range(1, len(m)))
    return sorted(m for m in rows if m[-1] != "*" and m not in stems and not covered(m)), sorted(m for m in stems if not covered(m))


def learned_insults(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[str], list[str]]:
    """(words, stems) that mark toxic rows: of the sample's rows that hold one, LEAST_SHARE are toxic even at the lower end of the interval.

    The test is on counts alone, whatever the size of the table, and all that pass it are kept. Rows with the mark in one and the
    same clause are copies of each other and count once, as toxic if all are. Stems are beginnings of four to seven letters. The sample is bounded: about ``sample`` labelled rows, picked by a hash of the id.
    """
    part = min(1.0, sample / max(labels.count(), 1))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    rows = docs.join(F.broadcast(picked.limit(4 * sample)), "doc_id")  # the bound of the sample bounds this side
    clauses = rows.select("doc_id", "toxic", F.explode(F.split(F.lower("text"), CLAUSE_END.pattern)).alias("c")).select("doc_id", "toxic", F.xxhash64("c").alias("h"), F.array_distinct(F.array_remove(F.split("c", r"[^\p{L}]+"), "")).alias("words"))
    # a stem is written with a star
    entries = lambda w: F.concat(F.array(w), *[F.when(F.length(w) > k, F.array(F.concat(F.substr(w, F.lit(1), F.lit(k)), F.lit("*")))).otherwise(F.array().cast("array<string>")) for k in (4, 5, 6, 7)])
    held = clauses.select("doc_id", "toxic", "h", F.explode(F.flatten(F.transform("words", entries))).alias("e")).where(F.length("e") > 2)
    # only marks of toxic rows can pass; they are fewer than the toxic words of the sample, whose bound so bounds what is broadcast
    seen = held.where("toxic = 1").groupBy("e").agg(F.countDistinct("doc_id").alias("k")).where(F.col("k") >= FEWEST).select("e")
    once = held.join(F.broadcast(seen), "e", "left_semi").groupBy("e", "doc_id", "toxic").agg(F.min("h").alias("h")).groupBy("e", "h").agg(F.min("toxic").alias("toxic"))
    marks = once.groupBy("e").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    best = marks.where(lower_share(F.col("bad"), F.col("n")) > LEAST_SHARE).collect()  # of the sample's words
    return distinct_marks([(r.e, r.bad, r.n) for r in best])


def fit_weights(cells: list[tuple[list[int], int, int]]) -> np.ndarray:
    """Ridge logistic regression around BIAS and PRIOR by Newton's steps; a cell: output counts, toxic rows, all rows."""
    centre = np.array([BIAS, *PRIOR])
    w = centre.copy()
    if cells:
        x = np.array([[1, *c[0]] for c in cells], float)
        bad, n = (np.array([c[i] for c in cells], float) for i in (1, 2))
        ridge = np.diag([1e-3, *[1.0] * len(OUTPUTS)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (bad - n * p) - ridge @ (w - centre))
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000, threshold: float = 0.3) -> DataFrame:
    """``docs`` with a struct column ``_toxic`` (outputs, score, predicted).

    Transducers for insults, threats, targets, negation and reported speech are composed into one machine
    that reads each clause of the whole text; insults count by whether they stand plain, at a target, negated
    or reported. A logistic weight per output turns counts (up to three of each) into a score. Learned from
    labelled rows whose crc32(doc_id) mod 4 is not 2: further insult words and stems (from a bounded sample of about
    ``sample`` rows) and the weights (from all of them, summed by output counts, at most a few thousand cells).

    Nulls: a null or empty text has no outputs and the score of the bias; rows without an id or label teach
    nothing; of several labels for an id the highest counts. Without labels the built-in weights hold.
    Repeated rows score alike. An empty table gives no rows. A column ``_toxic`` or ``_tx_*``, in any case, is replaced.
    """
    own = other_columns(docs, "_toxic", prefix="_tx_")
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    truth = truth.where(fold(F.col("doc_id"), 4) != 2)
    classes = Classes(*learned_insults(docs.select("doc_id", "text"), truth, sample))
    marked = docs.select(*own, outputs_udf(classes)(F.col("text")).alias("_tx_outputs"))
    out = park(marked.select("doc_id", "_tx_outputs"), "toxicity")  # not the texts: they are read a second time instead
    capped = F.transform("_tx_outputs", lambda n: F.least(n, F.lit(MOST_OF_EACH)))
    cells = out.select("doc_id", capped.alias("x")).join(truth, "doc_id").groupBy("x").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    weights = fit_weights([(r.x, r.bad, r.n) for r in cells.orderBy("x").collect()])
    logit = sum((F.least(F.get("_tx_outputs", F.lit(i)), F.lit(MOST_OF_EACH)) * F.lit(float(w)) for i, w in enumerate(weights[1:])), F.lit(float(weights[0])))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    if set(own) <= {"doc_id", "text"}:
        marked, own = out, ["doc_id"]
    return marked.select(*own, F.struct(F.col("_tx_outputs").alias("outputs"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")).alias("_toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "_toxic.score", "_toxic.predicted")
