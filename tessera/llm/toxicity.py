"""Toxicity scores from a weighted lexicon.

Text is folded (lower case, homoglyphs to Latin letters, digits to the letters they stand for, the
look-alikes i, l and 1 to one letter, everything else to single spaces), matched by Aho-Corasick against
lexicon entries that start at a word, and scored from the weights of the hits, as they are and in relation
to the number of words. Hits inside an exception phrase don't count. The lexicon (whole words and word
beginnings), its weights and the logistic curve are learned from labelled rows.

Null and empty texts have no hits and get the score of such a text. Repeated rows each get a row. Labels
that are null are passed over; of several labels of one document the highest counts.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import first_hashes, held_out, lean

#: Labelled documents of each class from which the model is learned, at most, and bytes of their texts: those with the smallest hashes.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2500, 16 << 20
#: Lexicon entries need this many toxic documents and this log odds ratio.
LEAST_DOCS, LEAST_WEIGHT = 6, 2.0
#: Everyday phrases whose words aren't meant as insults.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "idiot proof", "sore loser", "pond scum", "white trash bag")
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ѡ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ⅼ": "l", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}


def _fold_table() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        c = c if len(c.lower()) != 1 else c.lower()
        if 0xFF01 <= ord(c) <= 0xFF5E:
            c = chr(ord(c) - 0xFEE0).lower()
        c = DIGITS.get(HOMOGLYPHS.get(c, c), HOMOGLYPHS.get(c, c))
        if c.isalpha():
            table[i] = ord("i") if c == "l" else ord(c)
    return table


_table: list[np.ndarray] = []


def fold_all(texts: list[str]) -> tuple[str, np.ndarray]:
    """All texts folded into one string, and where each begins; each is bounded by a space on either side."""
    if not _table:
        _table.append(_fold_table())
    codes = _table[0][np.frombuffer("".join(f" {x} " for x in texts).encode("utf-32-le", "replace"), np.uint32)]
    ends = np.cumsum([len(x) + 2 for x in texts])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep].astype(np.uint32).tobytes().decode("utf-32-le"), before[starts]


def fold(text: str) -> str:
    return fold_all([text])[0].strip()


@dataclass(frozen=True)
class Model:
    #: (folded entry with a leading space and, for a whole word, one behind; weight)
    entries: tuple[tuple[str, float], ...]
    coefficients: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _built: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {"entries": self.entries, "coefficients": self.coefficients, "exceptions": self.exceptions}

    def __setstate__(self, state):
        for k, v in (state | {"_built": {}}).items():
            object.__setattr__(self, k, v)

    def automaton(self):
        if "a" not in self._built:
            import ahocorasick

            a = ahocorasick.Automaton()
            for e, w in self.entries:
                a.add_word(e, (len(e), w, hash(e)))
            for e in self.exceptions:
                e = f" {fold(e)} "
                a.add_word(e, (len(e), None, 0))
            a.make_automaton()
            self._built["a"] = a
        return self._built["a"]

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text: 1, any hit, the logs of weighted hits, of weighted hits per 100 words and of distinct entries."""
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1
        if not texts:
            return out
        text, starts = fold_all(texts)
        words = np.add.reduceat(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32, starts) - 1
        first = starts.tolist()
        hits: dict[int, list[tuple[int, int, float, int]]] = {}
        if self.entries:
            for end, (size, weight, key) in self.automaton().iter(text):
                k = bisect.bisect_right(first, end - size + 1) - 1
                hits.setdefault(k, []).append((end - size + 1, end, weight, key))
        for k, found in hits.items():
            spared = sorted((a, b) for a, b, w, _ in found if w is None)
            begins, ends = [a for a, _ in spared], [*accumulate((b for _, b in spared), max)]
            found = [x for x in found if x[2] is not None and not (spared and (i := bisect.bisect_right(begins, x[0])) and x[1] <= ends[i - 1])]
            if found:
                total = sum(x[2] for x in found)
                out[k, 1:] = 1, math.log1p(total), math.log1p(100 * total / max(int(words[k]), 1)), math.log1p(len({x[3] for x in found}))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.coefficients), -30, 30)))


def learn(texts: list[str], toxic: list[int], weights: list[float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from labelled texts; weights: how many rows each stands for."""
    y = np.array(toxic, float)
    w = np.ones(len(y)) if weights is None else np.array(weights, float)
    counts = [Counter(), Counter()]
    for text, label in {(fold(x), int(c)) for x, c in zip(texts, toxic, strict=True)}:  # copies count once
        found = set()
        for word in set(text.split(" ")):
            if len(word) >= 3:
                found.add(f" {word} ")
            found.update(" " + word[:k] for k in range(4, min(len(word), 10) + 1))
        counts[label].update(found)
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    scored = []
    for e, a in counts[1].items():
        b = counts[0][e]
        weight = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        if a >= LEAST_DOCS and weight >= LEAST_WEIGHT:
            # evidence that the two rates differ (log likelihood ratio)
            p, r = (a + b) / (n[0] + n[1]), sum(x * math.log(x / (m * (a + b) / (n[0] + n[1]))) for x, m in ((a, n[1]), (b, n[0])) if x)
            if 2 * r >= 15 and p < 0.5:
                scored.append((-r, -len(e), e, weight))
    entries: dict[str, float] = {}
    stems, beginnings = set(), set()  # of the entries so far; none begins another
    for _, _, e, weight in sorted(scored):
        stem = e.rstrip(" ")
        heads = {stem[:k] for k in range(1, len(stem) + 1)}
        if stem not in beginnings and not heads & stems:
            entries[e] = round(weight, 6)
            stems.add(stem)
            beginnings |= heads
    model = Model(tuple(sorted(entries.items())), (0.0,) * 5, exceptions)
    x, beta = np.concatenate([model.features(texts[i : i + 100]) for i in range(0, len(texts), 100)]), np.zeros(5)  # few texts are folded at once
    for _ in range(40):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * w.mean() * np.eye(5)
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-3 * w.mean() * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.entries, tuple(float(b) for b in beta), exceptions)


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the labelled rows that aren't held out; at most sample_per_class rows and about SAMPLE_BYTES of texts of each class reach the driver."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for c in (0, 1)]
    few = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most 2 * sample_per_class ids
    rows = first_hashes(few.withColumn("hash", F.xxhash64("doc_id", "text")), "toxic", sample_per_class, SAMPLE_BYTES).collect()  # bounded in rows and bytes
    rows.sort(key=lambda r: (r["toxic"], r["doc_id"], r["text"] or ""))
    if not rows:
        return Model((), (-4.0, 0.0, 0.0, 0.0, 0.0))
    got = Counter(r["toxic"] for r in rows)
    return learn([r["text"] or "" for r in rows], [r["toxic"] for r in rows], [sizes[r["toxic"]] / got[r["toxic"]] for r in rows])


def _all_scores(model: Model, column: pa.Array, most: int = 1 << 19) -> np.ndarray:
    """Scores of a column of texts, taken in blocks of about `most` characters."""
    scores, block, size = [], [], 0
    for x in column:
        block.append(x.as_py() or "")
        size += len(block[-1])
        if size > most:
            scores.append(model.scores(block))
            block, size = [], 0
    if block:
        scores.append(model.scores(block))
    return np.concatenate(scores) if scores else np.zeros(0)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs' doc_id, held_out, score and predicted, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _all_scores(model, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_all_scores(model, b.column(b.schema.names.index("text"))) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
