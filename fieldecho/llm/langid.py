"""Language identification with error-correcting output codes.

Every language gets a codeword. For each bit a binary classifier over hashed letter n-grams tells
the languages with a 1 from those with a 0: the weight of an n-gram is the log ratio of its mean
frequencies on both sides, and the margin of a text is the mean weight of its n-grams. Frequencies
are counted over all training rows, one vector per language. How often a bit is right for a
language is measured on the training rows and weights the loss of that bit; the codeword with the
least weighted loss wins, and a text whose two best codewords are close is flagged ambiguous.

Prediction reads nothing but the text. A text that is null or has no letter is ``und`` with score
0, and so is every text if nothing could be learned. With one language learned, it is the answer
for all others, with score 1. Ties go to the language that sorts first. Null labels are not
learned from; an empty label is a label. Repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

#: Hashed n-grams of 1 to ORDER letters share so many places.
PLACES, ORDER = 1 << 13, 3
#: More labels than this are an error: one vector of ``PLACES`` counts per label comes to the driver.
MAX_LANGUAGES = 512
#: Characters hashed at once.
STEP = 1 << 18
#: Languages with all columns in their code; more get random ones.
EXHAUSTIVE = 6
#: A margin of so much counts as fully sure.
SURE = 0.25
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """Counts of the hashed n-grams of the lower-cased letters; a run of anything else is one blank. All zero without a letter."""
    out = np.zeros(PLACES, dtype=np.int64)
    low = (text or "").lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes] if len(codes) else np.zeros(0, dtype=bool)
    if not letter.any():
        return out
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = np.concatenate(([32], codes[letter | np.append(True, letter[:-1])], [32])).astype(np.uint32)
    for a in range(0, len(codes), STEP):
        part = codes[a:a + STEP + ORDER - 1]
        h = np.zeros(len(part), dtype=np.uint32)
        for k in range(ORDER):
            h = h[:len(part) - k] * np.uint32(31) ^ part[k:] * MIX[k] + np.uint32(k)
            own = min(STEP, len(h))
            out += np.bincount((h[:own] * MIX[0]) >> np.uint32(32 - 13), minlength=PLACES)
    return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def codebook(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language: every way to part a few languages in two, or random columns for many."""
    if n <= EXHAUSTIVE:
        columns = [[1 if k == 0 or not m >> (k - 1) & 1 else -1 for k in range(n)] for m in range(1, 1 << max(n - 1, 0))]
        return np.array(columns, dtype=np.int8).reshape(len(columns), n).T
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, 10 * (n - 1).bit_length()))
        gram = code.astype(np.int32) @ code.T.astype(np.int32)
        nearest = int((code.shape[1] - gram - np.eye(n, dtype=np.int32) * 2 * code.shape[1]).min(initial=10 ** 6, where=~np.eye(n, dtype=bool))) // 2
        if nearest > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, nearest
    return best


def learn(docs: DataFrame, label: str) -> tuple[list[str], np.ndarray]:
    """The languages and their n-gram counts, over every row with a label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(label).to_pylist(), batch.column("text").to_pylist()):
                g = grams(text)
                sums[lang] = sums[lang] + g if lang in sums else g
                if len(sums) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, g in sums.items():
            at = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(g[at])], ["lang", "place", "n"])

    rows = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(label, "text").mapInArrow(count, "lang string, place int, n long")
    per = rows.groupBy("lang", "place").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("place", "n")).alias("v"))
    found = sorted(per.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(found), PLACES))
    for i, r in enumerate(found):
        counts[i, [x["place"] for x in r["v"]]] = [x["n"] for x in r["v"]]
    return [r["lang"] for r in found], counts


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One column of n-gram weights per bit."""
    rates = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + 1e-6
    out = [np.log(rates[code[:, b] > 0].mean(axis=0)) - np.log(rates[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    return np.array(out).T.reshape(counts.shape[1], code.shape[1])


def predict(docs: DataFrame, label: str, train: Column, ambiguous_below: float = 0.1) -> DataFrame:
    """``docs`` without ``text`` and with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, learned from the rows where
    ``train`` holds."""
    text_batches(docs.sparkSession)
    rows = docs.withColumn("_train", train)
    languages, counts = learn(rows.filter("_train"), label)
    code = codebook(len(languages))
    weights = bit_weights(counts, code)

    @F.pandas_udf("array<double>")
    def margins(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            g = grams(t)
            n = g.sum()
            out.append(g @ weights / n / SURE if n else None)
        return pd.Series(out)

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    got = stored(rows.select(*[c for c in kept if c != "text"], "_train", margins("text").alias("_margins"), *([F.col(label).alias("_label")])), "margins")
    trust = _trust(got, languages, code)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decode(margins: pd.Series) -> pd.DataFrame:
        out = []
        for m in margins:
            if m is None or not languages:
                out.append(("und", 0.0, False))
                continue
            loss = (trust * np.log1p(np.exp(-4 * code * np.clip(np.asarray(m), -2, 2)))).sum(axis=1)
            likely = np.exp(-2 * (loss - loss.min()))
            likely /= likely.sum()
            order = np.argsort(-likely, kind="stable")
            close = len(order) > 1 and likely[order[0]] - likely[order[1]] < ambiguous_below
            out.append((languages[order[0]], float(likely[order[0]]), bool(close)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    return got.select(*[c for c in kept if c != "text"], decode("_margins").alias("_d")).select(*[c for c in kept if c != "text"], "_d.*")


def _trust(got: DataFrame, languages: list[str], code: np.ndarray) -> np.ndarray:
    """Share of each language's training rows whose bits come out right, each language's weights summing to 1 ...
    times the number of bits, so that losses of languages compare."""
    bits = code.shape[1]
    if not bits:
        return np.ones(code.shape)
    known = got.filter(F.col("_train") & F.col("_label").isNotNull() & F.col("_margins").isNotNull())
    ones = known.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("_margins")[b] > 0).cast("long")).alias(f"b{b}") for b in range(bits)]).collect()
    trust = np.ones(code.shape)
    for r in ones:
        i = languages.index(r["_label"])
        share = np.array([r[f"b{b}"] for b in range(bits)]) / r["n"]
        trust[i] = np.where(code[i] > 0, share, 1 - share)
    trust = np.maximum(trust, 1e-3)
    return trust / trust.sum(axis=1, keepdims=True) * bits
