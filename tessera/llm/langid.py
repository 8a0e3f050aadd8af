"""Language identification, words first.

A known word scores by its log frequency in each language. A word that training
didn't meet falls back to its character 5-grams (with word-boundary marks), and
where none of those is known to 4-grams, and so on down to single letters.

A posterior compares the learned languages only. Whether a text is in any of
them is told by the share of its words that training met in the language found,
held against the share that training texts reach without their own words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on at most, the ones with the smallest hashes.
TRAIN_DOCS = 4_000
#: Longest n-gram; times that a word or n-gram must occur to be known.
LONGEST, LEAST = 5, 2
#: Characters of a training text that the least share of known words is learned from, that share's quantile among
#: training texts and the part of it that is asked for; words taken as known besides, which spares short texts.
PROBE, QUANTILE, PART, SPARED = 20_000, 0.01, 0.5, 2
_WORDS, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Unseen words whose scores a worker remembers.
MEMORY = 50_000


def counted(text: str) -> Counter[str]:
    """Words, runs of letters, in lower case. Number characters such as fractions, which \\w has, too, aren't letters."""
    words = Counter(_WORDS.findall(text.lower()))
    for mixed in [w for w in words if not w.isalpha()]:
        n = words.pop(mixed)
        for w in _LETTERS.findall(mixed):
            words[w] += n
    return words


class BackoffModel:
    """Per-language log frequencies of words and of character n-grams that training met LEAST times or more.

    A table is an index {key: row} and a matrix with a column for each language.
    `known` tells which words training met that often in which language, and
    `least_share` is what familiar texts have of these.
    """

    def __init__(self, samples: Iterator[tuple[str, str]]):
        words: dict[str, Counter[str]] = {}
        probes: list[tuple[str, str]] = []
        for lang, text in samples:
            words.setdefault(lang, Counter()).update(counted(text))
            probes.append((lang, text[:PROBE]))
        self.langs = sorted(words)
        self.tables = [self._logs(words)]
        self.known = np.array([[words[g][k] >= LEAST for g in self.langs] for k in self.tables[0][0]], bool).reshape(len(self.tables[0][0]), len(self.langs))
        self.least_share = self._least_share(words, probes)
        for size in range(1, LONGEST + 1):
            grams: dict[str, Counter[str]] = {g: Counter() for g in self.langs}
            for lang, counts in words.items():
                for word, n in counts.items():
                    for g in self._grams(word, size):
                        grams[lang][g] += n
            self.tables.append(self._logs(grams))

    @staticmethod
    def _grams(word: str, size: int) -> list[str]:
        marked = f"^{word}$" if size > 1 else word
        return [marked[i : i + size] for i in range(len(marked) - size + 1)]

    def _logs(self, level: dict[str, Counter[str]]) -> tuple[dict[str, int], np.ndarray]:
        total = sum(level.values(), Counter())
        keys = sorted(k for k, n in total.items() if n >= LEAST)
        counts = np.array([[level[g][k] for g in self.langs] for k in keys], np.float64).reshape(len(keys), len(self.langs))
        size = np.array([sum(level[g].values()) for g in self.langs], float)
        return {k: i for i, k in enumerate(keys)}, np.log((counts + 0.5) / (size + 0.5 * len(keys))).astype(np.float32)

    @staticmethod
    def _least_share(words: dict[str, Counter[str]], probes: list[tuple[str, str]]) -> float:
        shares = []
        for lang, text in probes:
            own = counted(text)
            if own:
                met, n = sum(c for w, c in own.items() if words[lang][w] - c >= LEAST), own.total()
                shares.append((met + SPARED) / (n + SPARED))
        return PART * float(np.quantile(shares, QUANTILE)) if shares else 0.0

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word that training didn't meet; None if not even a letter of it is known."""
        for size in range(LONGEST, 0, -1):
            index, logs = self.tables[size]
            found = [i for g in self._grams(word, size) if (i := index.get(g)) is not None]
            if found:
                return logs[found].mean(axis=0)
        return None

    def predict(self, text: str | None, memory: dict[str, np.ndarray | None]) -> tuple[str, float]:
        """(language, posterior under equal priors); ('und', 0.0) for a null text, one without letters or an untrained model."""
        return self.judge(text, memory)[:2]

    def judge(self, text: str | None, memory: dict[str, np.ndarray | None]) -> tuple[str, float, float]:
        """predict() and the share of the text's words that are known in that language."""
        counts = counted(text) if text else {}
        if not counts or not self.langs:
            return "und", 0.0, 0.0
        index, logs = self.tables[0]
        rows, times = [], []
        total, n = np.zeros(len(self.langs)), 0
        for word, c in counts.items():
            i = index.get(word)
            if i is not None:
                rows.append(i)
                times.append(c)
                continue
            if word not in memory:
                if len(memory) >= MEMORY:
                    memory.clear()
                memory[word] = self.word(word)
            x = memory[word]
            if x is not None:
                total += c * x
                n += c
        if rows:
            total += np.array(times, np.float32) @ logs[rows]
            n += sum(times)
        # Words of a text aren't independent: the evidence of at most 50 counts.
        total *= min(n, 50) / max(n, 1)
        p = np.exp(total - total.max())
        best = int(p.argmax())
        met = int(np.array(times) @ self.known[rows, best]) if rows else 0
        return self.langs[best], float(p.max() / p.sum()), (met + SPARED) / (counts.total() + SPARED)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, limit: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BackoffModel:
    """A model of the at most `limit` labelled documents that aren't held out and have the smallest hashes.

    The hash is that of id, text and language, so that rows which tie are equal.
    Documents without text, language or id teach nothing.
    """
    usable = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)
    hashed = docs.filter(usable).select(F.xxhash64(id_col, text_col, lang_col).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("g"))
    edge = [r["h"] for r in hashed.select("h").orderBy("h").limit(limit).collect()]
    rows = hashed.filter(F.col("h") <= edge[-1]).select("g", "t").limit(limit).toLocalIterator() if edge else []
    return BackoffModel((str(r["g"]), r["t"]) for r in rows)


def language_of(model: BackoffModel, spark):
    """A column function text -> struct(lang, score, share)."""
    sent = spark.sparkContext.broadcast(model)
    memory: dict[str, np.ndarray | None] = {}

    @F.pandas_udf("lang string, score double, share double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        return pd.DataFrame([m.judge(t, memory) for t in texts], columns=["lang", "score", "share"])

    return predict


def identify(docs: DataFrame, model: BackoffModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, from its whole text alone.

    lang_pred is a language of the model, or 'und' with score 0 where the text
    is null or has no letter. Rows are treated alike however often they repeat;
    an empty table gives an empty result, and a model without training says 'und'.
    """
    guess = language_of(model, docs.sparkSession)(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), guess.alias("guess"))
    return rows.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))
