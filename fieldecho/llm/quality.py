"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how far to trust them.

Every rule looks at counts of one document and votes good, votes bad or abstains. Documents are
counted by the pattern of their votes, which leaves at most three to the power of the number of
rules rows whatever the size of the corpus, and a two-class model is fitted to those counts: the
share of good documents, and for each rule and class how often it votes good, bad or not at all.
The posterior probability of the good class replaces the demand that all rules pass.

A null text has no words; it and any text of too few words, or of too many repeated ones, fails
the base test and is not kept. An empty table gives no rows. Repeated rows are judged alike. All
columns pass through; names of the counts are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_bangs", "n_bars", "n_distinct")
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"
SPAN = 5
GOOD, BAD = 1, 2
#: Fixed odd multipliers that mix the word numbers of a window.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of ``SPAN`` words found twice or more."""
    n = len(ids) - SPAN + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(SPAN):
        mixed ^= (ids[k:k + n].astype(np.uint64) + np.uint64(k + 1)) * MIX[k]
        mixed *= MIX[-1]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    suspects = order[np.append(same, False) | np.append(False, same)]
    seen: dict[tuple, list[int]] = {}
    for i in suspects.tolist():
        seen.setdefault(tuple(ids[i:i + SPAN].tolist()), []).append(i)
    starts = np.array([i for at in seen.values() if len(at) > 1 for i in at], dtype=np.int64)
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + SPAN, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in raw.split()]
    seen, repeated, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    points = len(raw) - int(byte[0x80:0xC0].sum())
    of = lambda chars: int(byte[list(chars)].sum())
    return (len(ids), points - of(BLANK), of(SYMBOLS), repeated, repeated_words(np.array(ids, dtype=np.int64)), lines, int(byte[65:91].sum()),
            int(byte[97:123].sum()), of(b".!?"), of(b"!"), of(b"|"), len(number))


def rules() -> dict[str, tuple[Column, Column]]:
    """name -> (votes bad, votes good) over the counts of ``COUNTS``; neither is an abstention. Only a property that poor
    texts rarely have is worth a good vote, so most rules can but vote bad or abstain."""
    words = F.greatest("n_words", F.lit(1))
    letters = F.col("n_upper") + F.col("n_lower")
    per_word = lambda name: F.col(name) / words
    never = F.lit(False)
    return {
        "symbols": (per_word("n_symbols") > 0.1, never),
        "capitals": ((F.col("n_upper") > 0.5 * letters) & (letters >= 20), never),
        "exclamations": (per_word("n_bangs") > 0.1, never),
        "bars": (per_word("n_bars") > 0.1, never),
        "repeated_words": (per_word("n_repeat_words") > 0.2, never),
        "repeated_lines": (F.col("n_dup_lines") > 0.35 * F.greatest("n_lines", F.lit(1)), never),
        "variety": ((per_word("n_distinct") < 0.35) & (F.col("n_words") >= 20), per_word("n_distinct") >= 0.5),
        "sentences": ((per_word("n_marks") < 0.01) & (F.col("n_words") >= 30), per_word("n_marks").between(0.02, 0.6)),
        "word_length": ((per_word("word_chars") > 12) | (per_word("word_chars") < 2.5), per_word("word_chars").between(3.0, 7.0)),
        "length": (F.col("n_words") < 10, F.col("n_words") >= 50),
    }


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with one long column per name in ``COUNTS``."""
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([counts_of(t) for t in part], columns=list(COUNTS))

    text_batches(docs.sparkSession)
    kept = docs.drop(*COUNTS)
    return kept.select("*", count("text").alias("_counts")).select(*kept.columns, "_counts.*")


def pattern() -> Column:
    """All votes as one string of 0 (abstains), 1 (good) and 2 (bad), in the order of ``rules()``."""
    return F.concat(*[F.when(bad, str(BAD)).when(good, str(GOOD)).otherwise("0") for bad, good in rules().values()])


def _bounded(rates: np.ndarray, most_false: float, least_praise: float) -> np.ndarray:
    """``rates`` within the bounds of ``fit``; what a bound takes from one outcome goes to the others in proportion."""
    out = rates.copy()
    for c, k, value in ((0, BAD, np.minimum(out[0, :, BAD], most_false)), (1, GOOD, np.maximum(out[1, :, GOOD], least_praise * out[0, :, GOOD]))):
        rest = [v for v in range(3) if v != k]
        out[c][:, rest] *= ((1 - value) / np.maximum(out[c][:, rest].sum(axis=1), 1e-12))[:, None]
        out[c, :, k] = value
    return out


def fit(votes: dict[str, int], rounds: int = 200, prior: float = 0.02, most_false: float = 0.001, least_praise: float = 0.7) -> dict[str, float]:
    """Posterior probability of the good class for every pattern of votes.

    Expectation: the class probabilities of each pattern under the current rates. Maximisation: the
    share of good documents and each rule's rates, smoothed by ``prior`` of all documents in favour
    of rules that rarely vote against the class. Two bounds keep what votes mean: no rule votes bad
    on more than ``most_false`` of the good documents, and poor ones get at least ``least_praise``
    of the good votes that good ones get. Without them, a fault that one rule alone sees would be
    explained as a habit of good documents. Starts from that belief and stops when nothing moves.
    """
    if not votes:
        return {}
    names = sorted(votes)
    n = np.array([votes[p] for p in names], dtype=float)
    is_vote = np.array([[[v == str(k) for k in range(3)] for v in p] for p in names], dtype=float)
    belief = np.array([[0.28, 0.70, 0.02], [0.40, 0.30, 0.30]])  # good class, bad class: abstains, votes good, votes bad
    can = is_vote.max(axis=0) > 0
    start = np.where(can, 1.0, 0.0)[None] * belief[:, None, :]
    start /= start.sum(axis=2, keepdims=True)
    rates, share, weight = _bounded(start, most_false, least_praise), np.array([0.85, 0.15]), prior * n.sum()
    for _ in range(rounds):
        joint = np.log(share) + np.einsum("prv,crv->pc", is_vote, np.log(np.maximum(rates, 1e-12)))
        post = np.exp(joint - joint.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * n[:, None]
        seen = np.einsum("pc,prv->crv", mass, is_vote) + weight * start
        new, share = _bounded(seen / seen.sum(axis=2, keepdims=True), most_false, least_praise), (mass.sum(axis=0) + weight * share) / (n.sum() + weight)
        moved, rates = np.abs(new - rates).max(), new
        if moved < 1e-9:
            break
    return dict(zip(names, post[:, 0].tolist()))


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts, ``votes``, ``base_failed``, the posterior ``quality`` and the verdict ``kept``."""
    spark = docs.sparkSession
    rows = with_counts(docs.drop("votes", "base_failed", "quality", "kept")).withColumn("votes", pattern())
    few = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}  # at most 3 ** len(rules()) rows
    known = spark.createDataFrame(list(fit(few).items()), "_votes string, quality double")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.join(F.broadcast(known), F.col("votes") == F.col("_votes"), "left").drop("_votes")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (F.coalesce("quality", F.lit(0.0)) >= 0.5))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    own = docs.select(*[F.col(c).alias(f"_own_{c}") for c in docs.columns], "text")
    return judged(own).filter("kept").select(*[F.col(f"_own_{c}").alias(c) for c in docs.columns])
