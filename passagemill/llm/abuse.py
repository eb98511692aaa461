"""Abusive, hateful or sexual content (problem 10).

Method: counterfactual-regularised classifier.  A linear model over words, word
pairs and character n-grams of single sentences is trained on a bounded sample
of the labelled documents: at most ``SAMPLE`` documents of each class, in random
order until ``SENTENCES`` sentences of the class are read, of an unmarked
document ``SENTENCES_EACH`` sentences drawn at random, and ``SWAPS`` sentences
with swapped terms.  All four are parameters of :func:`fit_model`.  For sentences that
mention an identity term the term is swapped for another one and the change of
the score is penalised, so that mentioning a group carries no weight of its
own.  Labels belong to documents and some are wrong: training starts from the
document's mark for every sentence and is repeated with the sentences that carry
each marked document, without marks that the model contradicts firmly.

A document's score is that of its worst sentence.  Texts are read whole;
disguises (look-alike letters, digits for letters, masked, doubled, spread or
invisible characters) are undone before words are compared.

Defined results: NULL and blank texts score 0; documents with contradictory or
NULL marks don't train; without marks of both kinds every score is 0; repeated
ids are scored row by row; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.mixing import source_name
from passagemill.runtime import settle

#: Bounds of the training sample: documents of each class, sentences of one unmarked document, sentences of each class, swapped sentences.
SAMPLE, SENTENCES_EACH, SENTENCES, SWAPS = 6_000, 40, 80_000, 10_000
BITS = 18
THRESHOLD = 0.3
#: Longest run of words scored as one sentence; longer ones are scored in overlapping runs.
RUN = 40
#: Letters that look like Latin ones (fixed values).
ALIKE = str.maketrans("аеорсухіјѕһԁɡӏвмнктαεονρτυικɑ", "aeopcyxijshdglbmhktaeovptuika")
#: Characters that stand for letters inside words (fixed values).
LEET = str.maketrans("013457@$!€|", "oieastasiel")
#: Terms for groups of people that are swapped for one another (fixed values); terms found in the labelled sentences are added.
GROUPS = ("women", "men", "gays", "lesbians", "jews", "muslims", "christians", "hindus", "atheists", "immigrants", "refugees", "foreigners", "migrants", "blacks", "whites", "asians", "arabs", "mexicans", "africans", "gypsies", "poles", "turks", "indians", "americans", "germans", "frenchmen", "disabled", "elderly", "teenagers", "transgender", "natives", "villagers", "locals")
_SPREAD = re.compile(r"(?<!\w)\w([ \-._*~])(?:\w\1)+\w(?!\w)")
_EDGE = re.compile(r"^[^\w@$#*]+|[^\w@$#*!]+$")
_MASK = re.compile(r"[^a-z]")
_TWICE = re.compile(r"(.)\1+")


def plain_word(raw: str) -> str:
    """A word without its disguises."""
    w = unicodedata.normalize("NFKC", raw).lower().translate(ALIKE)
    w = "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) not in ("Mn", "Cf"))
    w = _EDGE.sub("", w)
    if any(c.isalpha() for c in w):
        if w.endswith("!"):
            w = w.rstrip("!")
        w = _MASK.sub("", w.translate(LEET)) if w.isascii() else w
        return _TWICE.sub(r"\1", w)
    return "0" if w else ""


def _joined(m: re.Match) -> str:
    return re.sub(r"[ \-._*~]", "", m.group())


class Reader:
    """Splits texts into sentences of plain words; remembers words it has seen."""

    def __init__(self):
        self.words: dict[str, tuple[str, ...]] = {}

    def sentences(self, text: str):
        text = text.replace("​", "").replace("\xad", "")
        for line in text.splitlines():
            out: list[str] = []
            for raw in _SPREAD.sub(_joined, line).split():
                got = self.words.get(raw)
                if got is None:
                    got = tuple(x for x in (plain_word(p) for p in re.split(r"[/]|(?<=\w)['’](?=\w)", raw)) if x)
                    if len(self.words) > 300_000:
                        self.words.clear()
                    self.words[raw] = got
                out += got
                if raw[-1] in ".!?…。" or (raw[-1] in "\"'”)" and len(raw) > 1 and raw[-2] in ".!?"):
                    if out:
                        yield out
                        out = []
            if out:
                yield out


def runs(words: list[str]):
    if len(words) <= RUN:
        yield words
    else:
        for i in range(0, len(words) - RUN // 2, RUN // 2):
            yield words[i : i + RUN]


def _h(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << BITS) - 1)


def word_features(w: str) -> tuple[list[int], list[float]]:
    """A word's own feature and those of its character n-grams, which weigh less."""
    ids, vals = [_h("w" + w)], [1.0]
    marked = f"<{w}>"
    for n in (3, 4, 5):
        for i in range(len(marked) - n + 1):
            ids.append(_h("c" + marked[i : i + n]))
            vals.append(0.25)
    return ids, vals


def pair_feature(a: str, b: str) -> int:
    return _h(f"p{a} {b}")


class Features:
    def __init__(self):
        self.memo: dict[str, tuple[list[int], list[float]]] = {}

    def of(self, words: list[str]) -> tuple[list[int], list[float]]:
        ids: list[int] = []
        vals: list[float] = []
        for w in words:
            got = self.memo.get(w)
            if got is None:
                got = self.memo[w] = word_features(w)
            ids += got[0]
            vals += got[1]
        marked = ["<s>", *words, "</s>"]
        for a, b in zip(marked, marked[1:], strict=False):
            ids.append(pair_feature(a, b))
            vals.append(1.0)
        return ids, vals


def identity_terms(sentences: list[list[str]]) -> list[str]:
    """The listed terms, and words that stand where groups of people are named in at least three sentences."""
    found: dict[str, int] = {}
    for s in sentences:
        text = " ".join(s)
        for m in re.finditer(r"\b(?:the|those|these|all) (\w{4,}) (?:are|people|should|stink|deserve|never)\b|\bpeople from the (\w{4,})\b|\b(\w{4,}) people (?:are|were|should)\b", text):
            t = next(x for x in m.groups() if x)
            found[t] = found.get(t, 0) + 1
    return sorted({_TWICE.sub(r"\1", g) for g in GROUPS} | {t for t, n in found.items() if n >= 3})


class Linear:
    """Logistic regression by adaptive gradient steps, with the counterfactual penalty."""

    def __init__(self, l2: float = 2e-6, fair: float = 1.0, rate: float = 0.1, share: float = 0.5):
        # ``share``: how likely a sentence without evidence is a case; at a half, short sentences of unknown words stay near the threshold
        self.w, self.b = np.zeros(1 << BITS, np.float32), math.log(share / (1 - share))
        self.g = np.full(1 << BITS, 1e-3, np.float32)
        self.gb, self.l2, self.fair, self.rate = 1e-3, l2, fair, rate

    @staticmethod
    def pack(rows):
        sizes = np.array([len(r[0]) for r in rows], np.int64)
        ids = np.fromiter((i for r in rows for i in r[0]), np.int32, int(sizes.sum()))
        vals = np.fromiter((v for r in rows for v in r[1]), np.float32, int(sizes.sum()))
        return np.concatenate([[0], np.cumsum(sizes)]), ids, vals

    def raw(self, packed) -> np.ndarray:
        ptr, ids, vals = packed
        total = np.concatenate([[0.0], np.cumsum(self.w[ids].astype(np.float64) * vals)])
        return total[ptr[1:]] - total[ptr[:-1]] + self.b

    def fit(self, packed, y, weight, swaps, epochs: int, rng) -> None:
        """``swaps``: packed sentences, packed sentences with the term swapped."""
        ptr, ids, vals = packed
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            pause = min(16, 1 + len(order) // 2048)  # batches between two steps on swaps
            for k in range(0, len(order), 256):
                rows = order[k : k + 256]
                self._step(*_rows(ptr, ids, vals, rows), y[rows], weight[rows])
                if swaps is not None and self.fair and k // 256 % pause == pause - 1:
                    self._even(swaps, rng)

    def _step(self, where, ids, vals, y, weight) -> None:
        s = np.bincount(where, self.w[ids] * vals, len(y)) + self.b
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        d = (p - y) * weight
        u, inverse = np.unique(ids, return_inverse=True)
        grad = np.bincount(inverse, d[where] * vals, len(u)).astype(np.float32) / len(y) + self.l2 * self.w[u]
        self.g[u] += grad**2
        self.w[u] -= self.rate * grad / np.sqrt(self.g[u])
        gb = float(d.mean())
        self.gb += gb**2
        self.b -= self.rate * gb / math.sqrt(self.gb)

    def _even(self, swaps, rng) -> None:
        """A step against the squared change of the score when the identity term is swapped, on a random batch of swaps."""
        (pa_, ia, va), (pb, ib, vb) = swaps
        rows = rng.integers(0, len(pa_) - 1, 512)
        sides = [(*_rows(p, i, v, rows), sign) for p, i, v, sign in ((pa_, ia, va, 1.0), (pb, ib, vb, -1.0))]
        d = sum(sign * np.bincount(where, self.w[ids] * vals, len(rows)) for where, ids, vals, sign in sides)
        # the features of both sides together, so what they share stays as it is
        where, ids, vals = (np.concatenate(x) for x in zip(*((w, i, s * v) for w, i, v, s in sides), strict=True))
        u, inverse = np.unique(ids, return_inverse=True)
        grad = self.fair * np.bincount(inverse, d[where] * vals, len(u)).astype(np.float32) / len(rows)
        self.g[u] += grad**2
        self.w[u] -= 0.3 * self.rate * grad / np.sqrt(self.g[u])


def _rows(ptr, ids, vals, rows):
    sizes = ptr[rows + 1] - ptr[rows]
    where = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ptr[rows], sizes)
    return where, ids[at], vals[at]


def train(texts: list[str], marks: list[int], seed: int = 7, each: int = SENTENCES_EACH, most: int = SENTENCES, most_swaps: int = SWAPS, fair: float = 1.0) -> Linear | None:
    """The model from documents and their marks (0 or 1); see the bounds of the training sample."""
    if not 0 < sum(marks) < len(marks):
        return None
    reader, features, rng = Reader(), Features(), np.random.default_rng(seed)
    pick = random.Random(seed)
    doc, sents = [], []
    order = list(range(len(texts)))
    pick.shuffle(order)
    order.sort(key=lambda i: -marks[i])
    read = [0, 0]
    for i in order:
        if read[marks[i]] >= most:
            continue
        mine = [r for s in reader.sentences(texts[i]) for r in runs(s)]
        if marks[i] == 0 and len(mine) > each:
            mine = pick.sample(mine, each)
        read[marks[i]] += len(mine)
        doc += [i] * len(mine)
        sents += mine
    doc = np.array(doc)
    packed = Linear.pack([features.of(s) for s in sents])
    y = np.array(marks, float)[doc]
    size = np.bincount(doc, minlength=len(texts))
    # counterfactuals: every sentence with an identity term, the term swapped
    terms = identity_terms(sents)
    known = set(terms)
    pairs = []
    for s in sents:
        own = [w for w in s if w in known]
        if own:
            other = pick.choice(terms)
            pairs.append((s, [other if w == own[0] else w for w in s]))
    pairs = pick.sample(pairs, min(len(pairs), most_swaps))
    swaps = (Linear.pack([features.of(a) for a, _ in pairs]), Linear.pack([features.of(b) for _, b in pairs])) if pairs else None
    target, weight = y.copy(), np.where(y > 0, 1.0 / np.maximum(size[doc], 1), 1.0)
    weight[y > 0] *= 3
    model = None
    for step in range(5):
        # the models that look for the cases start even, so that rare ones are found; the last one starts from their share
        share = min(max(float((target * weight).sum() / weight.sum()), 1e-3), 0.5) if step == 4 else 0.5
        model = Linear(fair=fair, share=share)
        model.fit(packed, target, weight, swaps, 4 if step < 4 else 10, rng)
        p = 1 / (1 + np.exp(-np.clip(model.raw(packed), -30, 30)))
        worst = np.zeros(len(texts))
        np.maximum.at(worst, doc, p)
        # sentences that carry a marked document are its cases; a marked document without one teaches nothing
        carries = (y > 0) & (p >= np.maximum(0.5 * worst[doc], 0.3)) & (worst[doc] >= 0.35)
        target = np.where(carries, 1.0, 0.0)
        weight = np.where(carries, 1.0, np.where(y > 0, 0.15, 1.0))
        # other sentences of a marked document are likely harmless; an unmarked document with a sure case is doubtful
        weight[(y == 0) & (p > 0.8)] = 0.1
    return model


class Scorer:
    """Scores texts with a trained model; words and pairs are looked up once."""

    def __init__(self, w: np.ndarray, b: float):
        self.w, self.b, self.reader = w, b, Reader()
        self.uni: dict[str, float] = {}
        self.two: dict[tuple[str, str], float] = {}

    def sentence(self, words: list[str]) -> float:
        total, last = self.b, "<s>"
        for x in (*words, "</s>"):
            if x != "</s>":
                u = self.uni.get(x)
                if u is None:
                    ids, vals = word_features(x)
                    u = self.uni[x] = float(np.dot(self.w[ids], vals))
                total += u
            t = self.two.get((last, x))
            if t is None:
                if len(self.two) > 500_000:
                    self.two.clear()
                t = self.two[last, x] = float(self.w[pair_feature(last, x)])
            total += t
            last = x
        return total

    def text(self, text: str | None) -> float:
        if not text:
            return 0.0
        best = max((self.sentence(r) for s in self.reader.sentences(text) for r in runs(s)), default=-math.inf)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, best)))) if best > -math.inf else 0.0


def fit_model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, each: int = SENTENCES_EACH, most: int = SENTENCES, most_swaps: int = SWAPS) -> tuple[bytes, float] | None:
    """Weights and bias, trained in one task on at most ``sample`` documents and ``most`` sentences of each class, ``each`` of one unmarked document, and ``most_swaps`` swapped sentences."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi and lo in (0, 1)").select("doc_id", F.col("lo").alias("mark"))
    chosen = marks.where("mark = 1").orderBy(F.xxhash64("doc_id")).limit(sample).unionByName(marks.where("mark = 0").orderBy(F.xxhash64("doc_id")).limit(sample))
    rows = documents.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "text", "mark", F.lit(0).alias("one"))

    def learn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])  # rows come in any order, and the draws below depend on it
        m = train(pdf["text"].tolist(), [int(x) for x in pdf["mark"]], each=each, most=most, most_swaps=most_swaps)
        return pd.DataFrame({"w": [m.w.tobytes()], "b": [m.b]}) if m else pd.DataFrame({"w": pd.Series([], dtype=object), "b": pd.Series([], dtype=float)})

    got = rows.groupBy("one").applyInPandas(learn, "w binary, b double").collect()
    return (bytes(got[0]["w"]), got[0]["b"]) if got else None


def scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, source, score)`` of every document."""
    model = fit_model(documents, labels, sample)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def score(it):
        held = shared.value
        scorer = Scorer(np.frombuffer(held[0], np.float32), held[1]) if held else None
        for b in it:
            got = [scorer.text(t) if scorer else 0.0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], names=["doc_id", "source", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, source string, score double")


def flagged(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores(documents, labels).where(F.col("score") >= threshold)


def rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, flagged documents and rate of each source."""
    rows = settle(scores(documents, labels))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("score") >= threshold).cast("int")).alias("n_flagged"), F.round(F.avg((F.col("score") >= threshold).cast("int")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
