"""Language identification with interpolated Kneser-Ney character models.

Texts become lower-case letters with single spaces between runs of letters. Each language has a model of characters given
up to ORDER - 1 before them: discounted counts at the highest order, continuation counts below, down to a uniform
share. Discounted probabilities and back-off weights of all languages lie in arrays sorted by n-gram hash. A text
goes to the language of the lowest cross-entropy per character. Its result is marked rejected if that entropy is above the
language's calibrated limit: the given quantile of entropies of training documents left out of the counts.

Training uses at most `per_language` documents a language, those of the least hash of their ids (default 400; the
documented bound of the driver's memory), whole texts. Prediction uses whole texts; each batch scores its distinct n-grams once.

Edge cases. Null text or a text without letters (marks and digits are none): `und`, score 0, not rejected. Rows that repeat an id are
predicted each. Documents without lang don't train. Without any training document all texts are `und`. Of languages with equal
entropies the first by code point wins. Empty tables give empty results. Extra columns are ignored. A very long text is scored in one
piece, some 100 bytes a letter. The driver and each worker hold n-grams x languages probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewords import mix, pieces
from .shared import cut

ORDER = 5


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter, or 32 if it is no letter or mark; and whether it is a letter."""
    out, letter = np.full(0x110000, 32, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        s = chr(c)
        letter[c] = s.isalpha()
        if letter[c] or (c > 0x2FF and unicodedata.category(s)[0] == "M"):
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out, letter


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts in a row, and for each symbol its text."""
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), lengths)
    out = alphabet()[0][points]
    blank = out == 32
    start = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    keep = ~blank | ~np.append(True, blank[:-1])[: len(blank)] & ~start
    return out[keep], doc[keep]


def gram_hashes(letters: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Hashes of the k letters that end at each place, k = 1..ORDER; the start of a text counts as spaces."""
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    base = mix(letters.astype(np.uint64))
    blank = mix(np.array([32], np.uint64))[0]
    out, h = [], np.zeros(len(doc), np.uint64)
    for k in range(ORDER):
        before = np.full(len(doc), blank)
        before[k:] = base[: max(len(base) - k, 0)]
        before[place < k] = blank
        h = h + mix(before + np.uint64(k + 1))
        out.append(mix(h))
    return out


class Models:
    """Sorted hash arrays of all languages' models."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        n = len(self.languages)
        grams: list[list[tuple]] = [[] for _ in range(ORDER)]
        letters_seen = 1
        for lang in self.languages:
            letters, doc = symbols(texts[lang])
            letters_seen = max(letters_seen, len(np.unique(letters)))
            hashes = gram_hashes(letters, doc)
            # context of the k-gram that ends here: the (k-1)-gram that ends one place before
            held = []
            for k in range(ORDER):
                context = self.contexts(hashes, doc, k)
                held.append((hashes[k], context))
            counts = None
            for k in range(ORDER - 1, -1, -1):
                values, at, number = np.unique(held[k][0], return_index=True, return_counts=True)
                if k < ORDER - 1:  # continuation counts: in how many longer n-grams the n-gram ends
                    longer, where = np.unique(held[k + 1][0], return_index=True)
                    number = np.bincount(np.searchsorted(values, held[k][0][where]), minlength=len(values))
                counts = number.astype(np.float64)
                one, two = (counts == 1).sum(), (counts == 2).sum()
                discount = one / (one + 2 * two) if one and two else 0.5
                context, back = np.unique(held[k][1][at], return_inverse=True)
                total = np.bincount(back, weights=counts)
                kinds = np.bincount(back)
                grams[k].append((values, (counts - discount) / total[back], context, discount * kinds / total))
        self.share = 1.0 / (letters_seen + 1)
        self.keys, self.parts, self.context_keys, self.weights = [], [], [], []
        for k in range(ORDER):
            for which, default, keys_to, values_to in ((0, 0.0, self.keys, self.parts), (2, 1.0, self.context_keys, self.weights)):
                keys = np.unique(np.concatenate([g[which] for g in grams[k]])) if grams[k] else np.zeros(0, np.uint64)
                table = np.full((len(keys) + 1, n), default, np.float32)
                for i, g in enumerate(grams[k]):
                    table[np.searchsorted(keys, g[which]), i] = g[which + 1]
                keys_to.append(keys)
                values_to.append(table)

    @staticmethod
    def contexts(hashes: list[np.ndarray], doc: np.ndarray, k: int) -> np.ndarray:
        if not k:
            return np.zeros(len(doc), np.uint64)
        start = np.append(True, doc[1:] != doc[:-1])
        out = np.empty(len(doc), np.uint64)
        out[1:] = hashes[k - 1][:-1]
        out[np.flatnonzero(start)] = k  # nothing before: one context of its own
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of each text in each language, and its number of letters."""
        letters, doc = symbols(texts)
        total = np.zeros((len(texts), len(self.languages)))
        if not len(doc):
            return total, np.zeros(len(texts), np.int64)
        hashes = gram_hashes(letters, doc)
        start = np.append(True, doc[1:] != doc[:-1])
        _, some, back = np.unique(hashes[-1] + start.astype(np.uint64), return_index=True, return_inverse=True)
        p = np.full((len(some), len(self.languages)), self.share, np.float32)
        for k in range(ORDER):
            context = self.contexts(hashes, doc, k)[some]
            p = self.found(self.keys[k], self.parts[k], hashes[k][some]) + self.found(self.context_keys[k], self.weights[k], context) * p
        logs = -np.log(p)
        first = np.flatnonzero(start)
        sums = np.add.reduceat(logs[back], first, axis=0, dtype=np.float64)
        total[doc[first]] = sums / np.diff(np.append(first, len(doc)))[:, None]
        return total, np.bincount(doc[alphabet()[1][letters]], minlength=len(texts))

    @staticmethod
    def found(keys: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return table[np.zeros(len(wanted), np.int64)]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return table[np.where(keys[at] == wanted, at, len(keys))]


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """lang, text and calibrate of at most per_language documents a language, by the least hash of their ids. Rows that repeat an id within a
    language are one document: the text with the least hash, so that reruns train on the same."""
    ids = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("skein_id"), F.col(lang_col).alias("skein_lang")).withColumn("skein_salt", F.spark_partition_id() % 1000)
    # the first of each task, then of each thousandth of the tasks, then of all
    for keys in (["skein_lang", "skein_salt"], ["skein_lang"]):
        order = W.partitionBy(*keys).orderBy(F.xxhash64("skein_id"), "skein_id")
        ids = ids.withColumn("skein_n", F.dense_rank().over(order)).where(F.col("skein_n") <= per_language).dropDuplicates(["skein_id", *keys])
    ids = cut(ids.select("skein_id", "skein_lang", (F.col("skein_n") % 5 == 0).alias("calibrate")))
    # written, so that Spark knows its size and broadcasts it if it is small: per_language rows a language
    found = docs.select(F.col(id_col).alias("skein_id"), F.col(lang_col).alias("skein_lang"), F.col(text_col).alias("text")).join(ids, ["skein_id", "skein_lang"])
    least = found.groupBy("skein_id", "skein_lang", "calibrate").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return least.select(F.col("skein_lang").alias("lang"), "x.text", "calibrate")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, quantile: float = 0.995) -> tuple[Models, np.ndarray]:
    """Models and entropy limits of the languages."""
    fit: dict[str, list[str]] = {}
    check: dict[str, list[str]] = {}
    for lang, text, calibrate in sampled(docs, id_col, text_col, lang_col, per_language).toLocalIterator():
        (check if calibrate else fit).setdefault(lang, []).append(text or "")
    fit = {k: v for k, v in fit.items() if any(symbols(v)[0] != 32)}
    models = Models(fit)
    limits = np.full(len(models.languages), np.inf)
    for i, lang in enumerate(models.languages):
        own, n = models.entropies(check.get(lang, []))
        if (n >= 20).any():
            limits[i] = np.quantile(own[n >= 20, i], quantile)
    return models, limits


def identify(docs: DataFrame, models: Models, limits: np.ndarray, id_col: str = "doc_id", text_col: str = "text", sharpness: int = 50) -> DataFrame:
    """id, lang_pred, score, entropy and rejected per row.

    score is the share of the best language in exp(-min(letters, sharpness) * entropy)."""
    shared = docs.sparkSession.sparkContext.broadcast((models, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limits = shared.value
        names = np.array([*models.languages, "und"], dtype=object)
        for batch in pieces(batches, text_col, 1_500_000):
            entropy, n = models.entropies(batch.column(text_col).to_pylist())
            known = (n > 0) & bool(models.languages)
            best = np.where(known, entropy.argmin(axis=1) if models.languages else 0, -1)
            least = np.where(known, entropy.min(axis=1, initial=np.inf), 0.0)
            score = np.zeros(len(n))
            if models.languages:
                power = -(entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, sharpness)[:, None]
                score = np.where(known, 1 / np.exp(power).sum(axis=1), 0.0)
            rejected = known & (least > (limits[best] if len(limits) else np.inf))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(least), pa.array(rejected)], [id_col, "lang_pred", "score", "entropy", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, entropy double, rejected boolean")
