"""Language identification: unigram models over a fixed piece vocabulary, marginalised over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import fold, other_columns, park, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\W\d_]+")
START = "▁"  # marks the start of a word in the vocabulary
BASE = np.uint64(0x9E3779B97F4A7C15)
SCALE = 3.0  # nats a character added while summing, so that usual words stay in range
LONGEST = 64  # longer words are summed in logarithms


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, of any length, with or without the start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return sorted(p for p in found if WORD.fullmatch(p.removeprefix(START)) or p == START)


class Segmenter:
    """Sums over all ways to cut a word into pieces, for all languages at once. ``probs``: a row per piece, a column per language; the last row is an unknown character."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.longest = max(map(len, pieces), default=1)
        self.id = {p: i for i, p in enumerate(pieces)}
        self.probs = probs
        self.tables = []
        for m in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == m], np.int64)
            keys = self._hash([pieces[i] for i in ids], m)
            order = np.argsort(keys)
            self.tables.append((keys[order], ids[order]))

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def _hash(self, words: list[str], m: int) -> np.ndarray:
        codes = self._codes(words).reshape(len(words), m)
        h = np.zeros(len(words), np.uint64)
        for k in range(m):
            h = h * BASE + codes[:, k]
        return h

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts and lengths of words, and per piece length the piece id at each character (-1: none)."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        codes = self._codes(words)
        left = np.repeat(start + length, length) - np.arange(len(codes))
        h, found = np.zeros(len(codes), np.uint64), []
        for m, (keys, ids) in enumerate(self.tables, 1):
            h = h * BASE + np.concatenate([codes[m - 1 :], np.zeros(min(m - 1, len(codes)), np.uint64)])[: len(codes)]
            here = np.flatnonzero(left >= m) if len(keys) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(keys, h[here]), max(len(keys) - 1, 0))
            hit = keys[at] == h[here]
            piece = np.full(len(codes), -1)
            piece[here[hit]] = ids[at[hit]]
            found.append(piece)
        found[0] = np.where(found[0] < 0, len(self.probs) - 1, found[0])  # an unknown character
        return start, length, found

    def forward(self, words: list[str], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word by language (a row per word).

        With ``counts`` (word by language) a backward pass adds each piece's expected uses to ``expected``.
        """
        n, k = len(words), self.probs.shape[1]
        out = np.zeros((n, k))
        if not n:
            return out
        order = sorted(range(n), key=lambda i: -len(words[i]))
        words = [words[i] for i in order]
        long = sum(len(w) > LONGEST for w in words)
        for i in range(long):
            out[i] = self._in_logs(words[i])
        if long < n:
            start, length, ids = self.lattice(words[long:])
            rows, most = n - long, int(length[0])
            alpha = np.zeros((most + 1, rows, k))
            alpha[0] = 1
            active = [int(np.searchsorted(-length, -j, side="right")) for j in range(most + 2)]
            for j in range(1, most + 1):
                a = active[j]
                for m in range(1, min(j, self.longest) + 1):
                    piece = ids[m - 1][start[:a] + j - m]
                    some = np.flatnonzero(piece >= 0)
                    if len(some):
                        alpha[j, some] += alpha[j - m, some] * self.probs[piece[some]] * np.exp(SCALE * m)
            z = alpha[length, np.arange(rows)]
            out[long:] = np.log(np.maximum(z, 1e-300)) - SCALE * length[:, None]
            if expected is not None:
                share = counts[order][long:] / np.maximum(z, 1e-300)
                beta = np.zeros((most + 1, rows, k))
                beta[length, np.arange(rows)] = 1
                for j in range(most, 0, -1):
                    a = active[j]
                    for m in range(1, min(j, self.longest) + 1):
                        piece = ids[m - 1][start[:a] + j - m]
                        some = np.flatnonzero(piece >= 0)
                        if len(some):
                            step = self.probs[piece[some]] * np.exp(SCALE * m)
                            uses = alpha[j - m, some] * step * beta[j, some] * share[some]
                            for c in range(k):
                                expected[:, c] += np.bincount(piece[some], uses[:, c], len(expected))
                            beta[j - m, some] += step * beta[j, some]
        back = np.empty_like(out)
        back[order] = out
        return back

    def _in_logs(self, word: str) -> np.ndarray:
        logs = np.log(self.probs)
        alpha = [np.zeros(self.probs.shape[1])]
        for j in range(1, len(word) + 1):
            ways = []
            for m in range(1, min(j, self.longest) + 1):
                piece = self.id.get(word[j - m : j], len(self.probs) - 1 if m == 1 else -1)
                if piece >= 0:
                    ways.append(alpha[j - m] + logs[piece])
            alpha.append(np.logaddexp.reduce(ways))
        return alpha[-1]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _probabilities(counts: np.ndarray, smoothing: float = 0.1) -> np.ndarray:
    """Smoothed columns; the last row, an unknown character, is as unlikely in every language."""
    probs = (counts + smoothing) / (counts + smoothing).sum(axis=0)
    return np.vstack([probs, np.full(counts.shape[1], 1e-9)])


def learn(rows: DataFrame, vocabulary: str = VOCABULARY, sample: int = 1500, rounds: int = 2) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities) from ``rows`` (text, lang), by expectation-maximisation from uniform pieces.

    Bounded: about ``sample`` rows of each language, picked by a hash of the text, copies of a text once. Word counts and expected
    piece counts are summed by Spark; the driver gets one number per piece and language.
    """
    rows = rows.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs, pieces = sorted(sizes), read_pieces(vocabulary)
    if not langs:
        return langs, pieces, np.zeros((len(pieces) + 1, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(1e6 * min(1.0, sample / sizes[lang])))])
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang").text:
                c = Counter()
                for t in texts:
                    c.update(words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])  # columns are named by numbers: a language may have any name
    columns = [str(i) for i in range(len(langs))]
    words = picked.select("lang", "text").dropDuplicates().mapInPandas(count, "lang string, word string, n long")
    words = words.select("word", number[F.col("lang")].alias("k"), "n").groupBy("word").pivot("k", list(range(len(langs)))).agg(F.sum("n")).fillna(0)
    words = park(words.repartition(24), "words")
    probs = _probabilities(np.ones((len(pieces), len(langs))))
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], probs=probs) -> Iterator[pd.DataFrame]:
            model, expected = Segmenter(pieces, probs), np.zeros((len(probs), len(langs)))
            for b in batches:
                model.forward([START + w for w in b.word], b[columns].to_numpy(float), expected)
            piece, lang = np.nonzero(expected[:-1])
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": expected[piece, lang]})

        counts = np.zeros((len(pieces), len(langs)))
        for r in words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            counts[r.piece, r.lang] = r.n
        probs = _probabilities(counts)
    return langs, pieces, probs


class Scorer:
    """A model with the scores of the first ``most`` words it met. As a broadcast value it lives as long as its Python worker."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray, most: int):
        self.langs, self.pieces, self.probs, self.most = langs, pieces, probs, most
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(langs)))
        self.used = 0
        self.segmenter: Segmenter | None = None

    def score(self, fresh: list[str]) -> np.ndarray:
        self.segmenter = self.segmenter or Segmenter(self.pieces, self.probs)
        return np.concatenate([self.segmenter.forward([START + w for w in fresh[i : i + 20_000]]) for i in range(0, len(fresh), 20_000)])

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Log probability of each list of words by language."""
        fresh = list({w for words in texts for w in words if w not in self.known})
        new = self.score(fresh) if fresh else np.zeros((0, len(self.langs)))
        room = max(0, min(len(fresh), self.most - self.used))
        if self.used + room > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(room, len(self.logs), 1 << 14), len(self.langs)))])
        self.logs[self.used : self.used + room] = new[:room]
        self.known |= zip(fresh[:room], range(self.used, self.used + room), strict=True)
        self.used += room
        beyond = dict(zip(fresh[room:], range(len(self.logs), len(self.logs) + len(fresh) - room), strict=True))
        logs = np.concatenate([self.logs, new[room:]]) if beyond else self.logs
        get = self.known.__getitem__ if not beyond else lambda w: self.known.get(w) if w in self.known else beyond[w]
        return np.array([logs[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0) for words in texts]).reshape(len(texts), len(self.langs))


def predict_language(docs: DataFrame, langs: list[str], pieces: list[str], probs: np.ndarray, most_words: int = 800_000) -> DataFrame:
    """``docs`` with a struct column ``_lang`` (pred, score): the language under which the whole text is likeliest, and its posterior.

    A Python worker keeps the scores of up to ``most_words`` words; others are scored anew in each batch.
    Nulls, and texts without letters: ``und`` and score 0. Repeated rows agree; an empty table gives no rows;
    a column ``_lang`` of the input, in any case, is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(Scorer(langs, pieces, probs, most_words))  # bounded: vocabulary by languages

    @F.pandas_udf("pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = model.value
        for texts in batches:
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts), 500):
                words = [words_of(t) for t in texts.iloc[at : at + 500]]
                some = [i for i, w in enumerate(words) if w and scorer.langs]
                for i, total in zip(some, scorer.totals([words[i] for i in some]) if some else (), strict=True):
                    best = int(total.argmax())
                    pred[at + i] = scorer.langs[best]
                    score[at + i] = float(1 / np.exp(total - total[best]).sum())
            yield pd.DataFrame({"pred": pred, "score": score})

    own = other_columns(docs, "_lang")
    return docs.select(*own, identify(F.col("text")).alias("_lang"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~fold(F.col("doc_id"), 4).isin(2, -1)).select("text", "lang"))
    out = predict_language(docs.select("doc_id", "text"), *model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_lang.pred").alias("lang_pred"), "_lang.score")
