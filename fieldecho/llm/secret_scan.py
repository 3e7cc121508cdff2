"""Secret scan: fixed patterns, and a linear-chain conditional random field that finds what they miss.

Tokens are tagged as begin, inside or outside of a secret. A tag's score is a sum over features of
the token itself (shape, length, character classes, keyword), of the three tokens before it and
the one after, and of the file (how much of it is digits and punctuation); tags of neighbours have
transition scores. There are no labelled secrets, so the field is trained on what the patterns
find, in windows of tokens from a bounded sample of documents (``SAMPLE``), and then decoded by
Viterbi over every token of every text. It adds spans where no pattern matched.

Decoding is exact and cheap: a token whose outside score leads by more than any two transitions can
win back is outside on every best path, so the chain falls apart there and only the stretches
between such tokens are worked off.

A null text is an empty one. An empty table gives no rows. Without anything to learn from, only
the patterns' spans are found. Repeated rows come out alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: The patterns every scan includes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\W\d_]+|\S")
O, B, I = range(3)
#: Documents sampled for training, with a pattern's match and without, and windows taken from each.
SAMPLE, WINDOWS, REACH = 1000, 4, 12
#: Feature places, features of a token, and neighbours looked at (offsets).
PLACES, WIDTH, AROUND = 1 << 12, 8, (-3, -2, -1, 0, 1)
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "bearer", "akia", "credential", "pass", "auth")
SIGNS = {**dict.fromkeys(range(48, 58), "0"), **dict.fromkeys(range(65, 91), "A"), **dict.fromkeys(range(97, 123), "a")}
FILE_KINDS = 8
#: Distinct words remembered per worker before it starts afresh.
REMEMBERED = 300_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value_spans(text: str) -> list[tuple[int, int]]:
    """Where the secret itself stands in each match of a pattern: what the field learns to tag."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return sorted(out + [m.span() for m in HEX.finditer(text)])


def signature(token: str) -> tuple:
    """What the features of a token are made of; tokens with the same one score alike."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return (token,)
    low = token.lower()
    key = next((k for k in KEYS if k in low), "")
    size = (n >= 8) + (n >= 16)
    if token.isalpha():
        return "word", size, token.islower() or token.istitle(), key
    signs = token.translate(SIGNS)
    runs = re.sub(r"(.)\1+", r"\1", signs)
    vowels = sum(map(low.count, "aeiou"))
    return "mixed", size, ("0" in signs) + 2 * ("A" in signs) + 4 * ("a" in signs), min(len(runs) // 3, 4), 4 * signs.count("0") // n, 5 * vowels // n, key


def features(sig: tuple) -> list[int]:
    """Places of a signature's features, always ``WIDTH`` of them."""
    kind, size, key = sig[0], sig[1] if len(sig) > 1 else 0, sig[-1] if len(sig) > 1 else ""
    mixed = sig[0] == "mixed"
    named = (f"t:{kind}", f"n:{kind}:{size}", f"w:{key}", f"k:{sig[2] if mixed else sig[2:3]}", f"r:{sig[3] if mixed else ''}", f"d:{sig[4] if mixed else ''}",
             f"v:{sig[5] if mixed else ''}:{size >= 1}", f"m:{mixed and sig[3] > 1}:{size}")
    return [crc32(f.encode("utf-8", "surrogatepass")) % PLACES for f in named]


def file_kind(text: str) -> int:
    """One of a few kinds of file, by the shares of digits and of code punctuation."""
    n = max(len(text), 1)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    digits, code = int(raw[48:58].sum()) / n, int(raw[[34, 39, 40, 41, 58, 59, 61, 91, 93, 95, 123, 125]].sum()) / n
    return min(int(digits * 50), 3) + 4 * (code > 0.03)


class Tables:
    """Scores of tokens by offset and tag, relative to outside. Words, cut at blanks, are remembered as the signatures of their tokens."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights  # (offsets, PLACES, 3)
        self.row: dict[tuple, int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.scores = np.zeros((len(AROUND), 2, 1024))

    def _row(self, sig: tuple) -> int:
        at = self.row.get(sig)
        if at is None:
            at = self.row[sig] = len(self.row)
            if at >= self.scores.shape[2]:
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)], axis=2)
            w = self.weights[:, features(sig), :].sum(axis=1)
            self.scores[:, :, at] = w[:, 1:] - w[:, :1]
        return at

    def rows(self, text: str) -> np.ndarray:
        words, known = text.split(), self.words
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = tuple(self._row(signature(t)) for t in TOKEN.findall(w))
        return np.fromiter(chain.from_iterable(map(known.__getitem__, words)), dtype=np.int64)

    def emissions(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores of begin and of inside, less that of outside, for every token."""
        ids = self.rows(text)
        out = []
        for tag in (0, 1):
            score = self.scores[AROUND.index(0), tag][ids]
            for k, d in enumerate(AROUND):
                if d < 0 and len(ids) > -d:
                    score[-d:] += self.scores[k, tag][ids[:d]]
                elif d > 0 and len(ids) > d:
                    score[:-d] += self.scores[k, tag][ids[d:]]
            out.append(score)
        return out[0], out[1]


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of one stretch; the tags before and after it are outside. ``step[a, b]`` scores tag b after tag a."""
    best, back = scores[0] + step[O], []
    for row in scores[1:]:
        via = best[:, None] + step
        back.append(via.argmax(axis=0))
        best = via.max(axis=0) + row
    tags = [int((best + step[:, O]).argmax())]
    for came in reversed(back):
        tags.append(int(came[tags[-1]]))
    return np.array(tags[::-1])


def decode(begin: np.ndarray, inside: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of a text from scores relative to outside. ``lead`` bounds what another tag can win at its two transitions."""
    gains = [step[a, x] + step[x, b] - step[a, O] - step[O, b] for a in range(3) for b in range(3) for x in (B, I)]
    lead = max(0.0, max(gains))
    tags = np.zeros(len(begin), dtype=np.int64)
    open_ = np.flatnonzero(np.maximum(begin, inside) >= -lead)
    if len(open_):
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            tags[run] = viterbi(np.stack([np.zeros(len(run)), begin[run], inside[run]], axis=1), step)
    return tags


def train(windows: list[tuple[list[str], list[int], int]], rounds: int = 60, rate: float = 0.2, decay: float = 1e-4, dropped: float = 0.4):
    """Weights (offsets, PLACES, 3), file weights (FILE_KINDS, 3) and transitions, by full-batch AdaGrad on the log likelihood.
    Every round hides a share of the features, so that none becomes indispensable."""
    n, long = len(windows), max(len(w[0]) for w in windows)
    place = np.zeros((n, long, WIDTH), dtype=np.int64)
    gold, mask = np.zeros((n, long), dtype=int), np.zeros((n, long), dtype=bool)
    for i, (tokens, tags, _) in enumerate(windows):
        place[i, :len(tokens)] = [features(signature(t)) for t in tokens]
        gold[i, :len(tokens)], mask[i, :len(tokens)] = tags, True
    kind, rng = np.array([w[2] for w in windows]), np.random.default_rng(11)
    weights, file_w, step = np.zeros((len(AROUND), PLACES, 3)), np.zeros((FILE_KINDS, 3)), np.zeros((3, 3))
    past = [np.full_like(x, 1e-6) for x in (weights, file_w, step)]
    # for each offset: the window and token it speaks about, and its places
    said = []
    for d in AROUND:
        i, t = np.nonzero(mask[:, max(0, -d):long - max(0, d)] & mask[:, max(0, d):long - max(0, -d)])
        said.append((i, t + max(0, -d), place[i, t + max(0, d)]))
    one = np.eye(3)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    gold_step = np.einsum("ita,itb->ab", one[:, :-1] * pairs[..., None], one[:, 1:])
    for _ in range(rounds):
        e = np.repeat(file_w[kind][:, None, :], long, axis=1)
        shown = [rng.random(p.shape) >= dropped for _, _, p in said]
        for k, (i, t, p) in enumerate(said):
            e[i, t] += (weights[k][p] * shown[k][..., None]).sum(axis=1)
        forward, backward = np.zeros((n, long, 3)), np.zeros((n, long, 3))
        forward[:, 0] = e[:, 0]
        for t in range(1, long):
            new = _logsum(forward[:, t - 1, :, None] + step, 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            new = _logsum(step + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        total = _logsum(forward[:, -1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        edge = np.exp(forward[:, :-1, :, None] + step + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        gap = one - node
        grads = [np.zeros_like(weights), np.zeros_like(file_w), gold_step - edge.sum(axis=(0, 1))]
        for k, (i, t, p) in enumerate(said):
            for tag in range(3):
                grads[0][k][:, tag] = np.bincount(p.ravel(), weights=(gap[i, t, tag][:, None] * shown[k]).ravel(), minlength=PLACES)
        np.add.at(grads[1], kind, gap.sum(axis=1))
        for x, g, h in zip((weights, file_w, step), grads, past):
            g -= decay * n * x
            h += g * g
            x += rate * g / np.sqrt(h)
    return weights, file_w, step


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def labelled_windows(text: str) -> list[tuple[list[str], list[int], int]]:
    """Windows of tokens and tags around the first secrets of a text, and one in its middle."""
    at = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    if not at:
        return []
    starts = np.array([a for _, a, _ in at])
    tags = np.zeros(len(at), dtype=int)
    centres = []
    for a, b in value_spans(text):
        i, j = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b))
        i += at[max(i, 0)][2] <= a
        if i < j:
            tags[i], tags[i + 1:j] = B, I
            centres.append(i)
    kind = file_kind(text)
    out = []
    for c in [*centres[:WINDOWS - 1], len(at) // 2]:
        lo, hi = max(0, c - REACH), c + REACH
        out.append(([t for t, _, _ in at[lo:hi]], tags[lo:hi].tolist(), kind))
    return out


def training_windows(docs: DataFrame) -> list[tuple[list[str], list[int], int]]:
    """Windows from at most ``SAMPLE`` different texts with a match of a pattern and as many without.

    The hash of a text deals it to one of ``SAMPLE`` places, and each place keeps its smallest hash; only hashes are
    aggregated, and the few texts that own one are then looked up."""
    held = F.col("text").rlike(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""") | F.col("text").rlike(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")

    @F.pandas_udf("array<struct<tokens:array<string>,tags:array<int>,kind:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"tokens": a, "tags": b, "kind": c} for a, b, c in labelled_windows(t)] for t in texts])

    known = docs.filter("text is not null").select("text", F.xxhash64("text").alias("_h"))
    chosen = known.groupBy(held.alias("held"), F.pmod("_h", F.lit(SAMPLE)).alias("place")).agg(F.min("_h").alias("_least")).select("_least").distinct()
    texts = known.join(F.broadcast(chosen), F.col("_h") == F.col("_least")).groupBy("_h").agg(F.min("text").alias("text"))  # at most 2 * SAMPLE rows
    rows = texts.select(F.explode(cut("text")).alias("w")).select("w.*").collect()
    return sorted((list(r["tokens"]), list(r["tags"]), r["kind"]) for r in rows)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all spans of every document as (kind, start, end), sorted by start and then kind."""
    text_batches(docs.sparkSession)
    windows = training_windows(docs)
    model = train(windows) if any(any(w[1]) for w in windows) else None

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = Tables(model[0]) if model else None
        for part in parts:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t or "", tables, model)] for t in part])

    return docs.select("doc_id", spans("text").alias("spans"))


def spans_of(text: str, tables: Tables | None, model) -> list[tuple[int, int, int]]:
    """(start, kind, end), patterns first, then what the field tags beside them."""
    base = base_spans(text)
    if not model or not text.strip():
        return base
    begin, inside = tables.emissions(text)
    extra = model[1][file_kind(text)]
    tags = decode(begin + extra[B] - extra[O], inside + extra[I] - extra[O], model[2])
    if not tags.any():
        return base
    at = [m.span() for m in TOKEN.finditer(text)]
    found, last = [], -2
    for i in np.flatnonzero(tags).tolist():
        if found and tags[i] == I and last == i - 1:
            found[-1][1] = at[i][1]
        else:
            found.append([at[i][0], at[i][1]])
        last = i
    taken = [(a, b) for a, _, b in base]
    return sorted(base + [(a, 3, b) for a, b in found if not any(a < y and x < b for x, y in taken)])
