"""Language identification with string kernels.

A text is the set of its character n-grams (1 to 3 characters, lower case, everything but letters as one
space), of any alphabet: the blended spectrum, by presence. The kernel of two texts is the number of shared
n-grams divided by the root of the product of their sizes. N-grams that no landmark holds are shared with
none, so the n-grams of the landmarks, all of them, span the kernel, and sizes are counted in them. A Nyström
map on landmark texts and one-versus-rest kernel ridge regression give a score for each language; texts are
scored in blocks, as matrix products of their presence rows with the landmarks' and of the kernels with the
coefficients.

Every language of the training rows can be predicted. Null texts and texts without a letter are `und` with
score 0. Repeated rows each get a row; equal scores go to the language that sorts first. Without training
rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import held_out, lean, smallest_hashes
from ._words import mix

#: Training rows and landmarks among them in all, shared by the languages, and those of a language at least; bytes of training texts in all.
ROWS, LANDMARKS, LEAST_ROWS, LEAST_LANDMARKS, SAMPLE_BYTES = 2000, 160, 20, 8, 16 << 20
RIDGE = 1e-2
UND = "und"
#: Cells of a dense block of presence rows or landmarks.
CELLS = 1 << 23
_EMPTY = np.int64(-(1 << 63))
_code: list[np.ndarray] = []


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts as code points, a zero before and behind each text and for every other run inside, and the text of each code."""
    if not _code:
        table = np.zeros(0x110000, np.int64)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _code.append(table)
    codes = _code[0][np.frombuffer("".join(f" {x} " for x in texts).encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) + 2 for x in texts])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    return codes[keep], owner[keep]


def _ngrams(codes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the n-grams that start at each place, for n from 1 to 3; all n-grams have different numbers."""
    two = (codes[:-1] << 21) + codes[1:]
    return [-1 - codes, -(1 << 42) - two, (two[:-1] << 21) + codes[2:]]


class Columns:
    """Columns 1, 2, ... of some n-grams, 0 for any other: a hash table with open addressing, looked up for many at once."""

    def __init__(self, grams: np.ndarray):
        self.width = len(grams) + 1
        self.mask = (1 << max(4, (8 * len(grams)).bit_length())) - 1
        self.key, self.value = np.full(self.mask + 1, _EMPTY), np.zeros(self.mask + 1, np.int32)
        todo, value, at = grams.astype(np.int64), np.arange(1, len(grams) + 1, dtype=np.int32), self._slot(grams)
        while len(todo):
            free = self.key[at] == _EMPTY
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(todo), bool)
            put[first] = free[first]
            self.key[at[put]], self.value[at[put]] = todo[put], value[put]
            todo, value, at = todo[~put], value[~put], (at[~put] + 1) & self.mask

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (mix(grams.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        at = self._slot(grams)
        key = self.key[at]
        out = np.where(key == grams, self.value[at], 0)
        todo = np.flatnonzero((key != grams) & (key != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            key = self.key[at[todo]]
            same = key == grams[todo]
            out[todo[same]] = self.value[at[todo[same]]]
            todo = todo[~same & (key != _EMPTY)]
        return out


class Model:
    """languages; columns of the n-grams; the landmarks' presence rows, as bits, and sizes; from kernels with them to the languages' scores."""

    def __init__(self, languages: tuple[str, ...], columns: Columns, bits: np.ndarray, sizes: np.ndarray, coefficients: np.ndarray):
        self.languages, self.columns, self.bits, self.sizes, self.coefficients = languages, columns, bits, sizes, coefficients
        self._dense: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_dense": {}}

    def presence(self, texts: list[str]) -> np.ndarray:
        codes, owner = _codes(texts)
        width = self.columns.width
        rows = np.zeros((len(texts), width), np.float32)
        flat, base = rows.reshape(-1), owner.astype(np.int64) * width
        for n, grams in enumerate(_ngrams(codes), 1):
            same = owner[n - 1 :] == owner[: len(owner) - n + 1]
            flat[(base[n - 1 :] + self.columns.of(grams))[same]] = 1
        rows[:, 0] = 0
        return rows

    def _marks(self, first: int, step: int) -> np.ndarray:
        """Some columns of the landmarks' rows; kept where all of them are few."""
        if first in self._dense:
            return self._dense[first]
        out = np.unpackbits(self.bits[:, first // 8 : (first + step) // 8], axis=1).astype(np.float32)
        if len(self.sizes) * self.columns.width <= 2 * CELLS:
            self._dense[first] = out
        return out

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Kernels of texts with the landmarks, block by block."""
        out = []
        count = max(1, CELLS // self.columns.width)
        step = max(8, CELLS // max(1, len(self.sizes)) // 8 * 8)
        for i in range(0, len(texts), count):
            rows = self.presence(texts[i : i + count])
            shared = np.zeros((len(rows), len(self.sizes)), np.float32)
            for c in range(0, self.columns.width, step):
                marks = self._marks(c, step)
                part = rows[:, c : c + step]
                shared += part @ marks[:, : part.shape[1]].T
            out.append(shared / np.sqrt(np.maximum(rows.sum(1), 1))[:, None] / np.sqrt(np.maximum(self.sizes, 1)))
        return np.concatenate(out) if out else np.zeros((0, len(self.sizes)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [x or "" for x in texts]
        if not self.languages:
            return [UND] * len(known), np.zeros(len(known))
        out = self.kernels(known) @ self.coefficients
        best = out.argmax(1)
        lettered = [any(map(str.isalpha, x)) for x in known]
        return [self.languages[k] if ok else UND for k, ok in zip(best, lettered, strict=True)], np.where(lettered, np.clip(out.max(1), 0, 1), 0.0).astype(float)


EMPTY = Model((), Columns(np.zeros(0, np.int64)), np.zeros((0, 1), np.uint8), np.zeros(0, np.float32), np.zeros((0, 0), np.float32))


def learn(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = tuple(sorted(set(langs)))
    if not languages:
        return EMPTY
    each = max(LEAST_LANDMARKS, landmarks // len(languages))
    picked, taken = [], dict.fromkeys(languages, 0)
    for i, lang in enumerate(langs):
        if taken[lang] < each:
            taken[lang] += 1
            picked.append(i)
    grams = np.unique(np.concatenate([np.unique(np.concatenate(_ngrams(_codes([texts[i]])[0]))) for i in picked]))
    columns = Columns(grams)
    bare = Model(languages, columns, np.zeros((0, 1), np.uint8), np.zeros(0, np.float32), EMPTY.coefficients)
    rows = [bare.presence([texts[i]])[0] for i in picked]
    bits, sizes = np.stack([np.packbits(r > 0) for r in rows]), np.array([r.sum() for r in rows], np.float32)
    half = Model(languages, columns, bits, sizes, EMPTY.coefficients)
    k = half.kernels(texts).astype(float)
    values, vectors = np.linalg.eigh(k[picked])
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    phi = k @ nystrom
    y = np.array([[float(lang == x) for x in languages] for lang in langs])
    weight = np.sqrt(1 / y.sum(0))[y.argmax(1)][:, None]  # every language weighs the same
    w = np.linalg.solve((phi * weight).T @ (phi * weight) + ridge * np.eye(phi.shape[1]), (phi * weight).T @ (y * weight))
    return Model(languages, columns, bits, sizes, (nystrom @ w).astype(np.float32))


def train(docs: DataFrame, rows: int = ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from text and lang of the rows that aren't held out; about `rows` of them and `sample_bytes` of texts reach the driver, shared by the languages."""
    open_rows = docs.filter(F.col("lang").isNotNull() & ~held_out())
    n = max(1, open_rows.agg(F.countDistinct("lang").alias("n")).first()["n"])
    got = smallest_hashes(open_rows.filter(F.col("text").rlike(r"\p{L}")), "lang", max(LEAST_ROWS, rows // n), max(1 << 18, sample_bytes // n)).collect()  # bounded in rows and bytes
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return learn([r["text"] for r in got], [r["lang"] for r in got])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id, held_out, lang_pred and score, a row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, block, size = [], [], [], 0
            for x in [*b.column(2), None]:
                if block and (size > 1 << 19 or len(block) == 300):
                    got = m.predict(block)
                    langs += got[0]
                    scores.append(got[1])
                    block, size = [], 0
                block.append(x.as_py() if x is not None else None)
                size += len(block[-1] or "")
            got = m.predict(block)  # its last text is the None added above
            langs, scores = (langs + got[0])[:-1], np.concatenate([*scores, got[1]])[:-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
