"""Token alignment, token counts and periodic runs: brute force, both routes, awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldecho.llm import alignment, queries, runs, tokens

DIR = "/root/testdata/sf0.001"
A, B, C = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [None, "", " ", "a", "▁ x", "<|endoftext|> <s> </s>", "tab\tand\nlines\r\n", "  two  blanks ", "\x00 nul", "日本語。テスト、です",
           "\U0001f600\U0001f600 é́ ﬁ ½ 12345", "x" * 3000, " " * 1500 + "y", "<0x41> ~~~ ==== aaaa", "0" * 500, "İstanbul ΑΣ ΟΔΟΣ", prose(3, 400)]


def docs_of(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")


def texts_of(spark):
    return [(r["doc_id"], r["text"]) for r in docs_of(spark).collect()]


@lru_cache
def tokenizer(path):
    return sentencepiece.SentencePieceProcessor(model_file=path) if path.endswith(".model") else Tokenizer.from_file(path)


# token alignment

def plain_groups(text):
    """Groups of a text as (A ids, B ids), None if the bytes differ."""
    if not text:
        return []
    own = tokenizer(A)
    own.encode_special_tokens = True
    ids_a, ids_b = own.encode(" " + text, add_special_tokens=False).ids, tokenizer(B).encode(text)
    bytes_a, bytes_b = ([t[i] for i in ids] for t, ids in ((alignment.byte_level(A), ids_a), (alignment.piece_level(B), ids_b)))
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    out, i, j, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
    while i < len(ids_a) or j < len(ids_b):
        if at_a <= at_b:
            at_a += len(bytes_a[i])
            left.append(ids_a[i])
            i += 1
        else:
            at_b += len(bytes_b[j])
            right.append(ids_b[j])
            j += 1
        if at_a == at_b:
            out.append((left, right))
            left, right = [], []
    return out


def plain_alignment(docs):
    groups = [plain_groups(t) for _, t in docs]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for gs in groups]
    count = Counter(p for own in links for p in own)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc_id, _), gs, own in zip(docs, groups, links):
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in gs)
        out.append((doc_id, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_alignment_of_given_documents(spark):
    docs = texts_of(spark)
    assert sorted(map(tuple, queries.QUERIES["op11_token_alignment"](spark, DIR).collect())) == sorted(plain_alignment(docs))


def test_alignment_of_awkward_texts(spark):
    docs = [*enumerate(AWKWARD), (None, "one two"), (3, "one two"), (3, "one two")]
    want = sorted(plain_alignment(docs), key=key)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "pair", "n", "times", "key")})
    for table in (alignment.TABLE, 0):  # looked up, and joined
        assert sorted(map(tuple, alignment.linked(frame, A, B, table).collect()), key=key) == want
    assert alignment.linked(frame.limit(0), A, B).count() == 0


def test_wide_groups_are_folded(monkeypatch):
    texts = ["x" * 300 + " " + prose(1, 50), None, "日本 語 " * 20]
    want = [[x.tolist() for x in pair] for pair in alignment.Aligned(texts, A, B).links()]
    monkeypatch.setattr(alignment, "WIDE", 0)
    assert [[x.tolist() for x in pair] for pair in alignment.Aligned(texts, A, B).links()] == want


def test_groups_are_ranks():
    found = alignment.Aligned([prose(4, 30), "", "naïve café"], A, B)
    for text, rows in zip([prose(4, 30), "", "naïve café"], found.groups()):
        assert [(r["a_last"] - r["a_first"] + 1, r["b_last"] - r["b_first"] + 1) for r in rows] == [(len(a), len(b)) for a, b in plain_groups(text)]


def test_gallop():
    rnd = random.Random(1)
    for _ in range(200):
        long = np.sort(np.array([rnd.randrange(500) for _ in range(rnd.randint(1, 300))]))
        short = np.sort(np.array([rnd.randint(0, int(long[-1])) for _ in range(rnd.randint(0, len(long)))], dtype=np.int64))
        assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


# token counts

def plain_count(text):
    return len(tokenizer(C).encode(text or "", add_special_tokens=False).ids)


def test_counts_of_given_documents(spark):
    want = [(d, len((t or "").encode()), plain_count(t), plain_count(t) > 2048) for d, t in texts_of(spark)]
    got = queries.QUERIES["op12_token_counts"](spark, DIR).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("chunk, overlap", [(tokens.CHUNK, tokens.OVERLAP), (300, 40), (64, 8), (16, 4)])
def test_counts_of_awkward_texts(spark, chunk, overlap):
    more = ["<|endoftext|>" * 40, "a<|startoftext|>b " * 30, "it's we'll 'sad don'tx " * 20, "é" * 400 + " é" * 100, "日本語" * 200, "x" * 900,
            "a.b,c;1 2" * 60, " ́x ̸= " * 50, "ÀÉÎ Σας ΟΔΟΣ İ " * 30, " wide blanks here\x1cand\x85there " * 20, prose(5, 900)]
    docs = [*enumerate([*AWKWARD, *more]), (None, prose(5, 900)), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "k", "n_tokens", "head")})
    want = sorted(((d, len((t or "").encode()), plain_count(t)) for d, t in docs), key=key)
    assert sorted(map(tuple, tokens.token_counts(frame, C, chunk, overlap).collect()), key=key) == want
    assert tokens.token_counts(frame.limit(0), C, chunk, overlap).count() == 0


def test_boundaries_are_stable():
    rnd, own = random.Random(2), tokenizer(C)
    stuff = ["a", "B", "é", "é", "Σ", "́", " ", "\n", " ", "\t", "1", "٣", "'s", "'", "<|endoftext|>", "<|", ",", "。", "、", "語", "ァ", "゙", "が", "½", "ﬁ", "İ", "​", "\U0001f600"]
    for _ in range(1500):
        text = "".join(rnd.choice(stuff) for _ in range(rnd.randint(2, 14)))
        whole = own.encode(text, add_special_tokens=False).ids
        for p in tokens.stable(text, C).tolist():
            parts = [own.encode(x, add_special_tokens=False).ids for x in (text[:p], text[p:])]
            assert whole == parts[0] + parts[1], (text, p)


# periodic runs

def plain_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted(([s, n, q] for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    ws = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [x if i < a else ws[a + (i - a) % p] for i, x in enumerate(ws)]
    found = plain_runs(ws)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else [None] * 3
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    left = hashlib.sha256(" ".join(x for i, x in enumerate(ws) if i not in gone).encode()).hexdigest()
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest, left


def test_runs_of_given_documents(spark):
    got = queries.QUERIES["op13_periodic_runs"](spark, DIR).collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(d, t) for d, t in texts_of(spark))


def test_runs_and_extensions():
    rnd = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            n, k = rnd.choice([0, 1, 5, 13, 40, 150, 400]), rnd.choice([1, 2, 3, 10, 1000])
            t = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(2, 10)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(t, dtype=np.int64))
        assert [r.tolist() for r in runs.runs_of(texts)] == [plain_runs(t.tolist()) for t in texts]
        w, _, _ = runs._joined(texts)
        if len(w) > 40:
            i = np.array([rnd.randrange(len(w) - 1) for _ in range(200)])
            j = np.array([rnd.randrange(a + 1, len(w)) for a in i])
            assert (runs.Extension(w)(i, j) == runs.common(w, i, j, len(w) - j)).all()


def test_cover_reaches_every_difference():
    for i in range(runs.MODULUS):
        for d in range(runs.MODULUS):
            step = runs.STEPS[i, d]
            assert (i + step) % runs.MODULUS in runs.COVER and (i + d + step) % runs.MODULUS in runs.COVER


def test_runs_of_awkward_rows(spark, awkward, clashing):
    want = sorted(((r["doc_id"], len(WORD.findall(r["text"] or "")), [tuple(x) for x in plain_runs(WORD.findall(r["text"] or ""))]) for r in awkward.collect() if r["doc_id"] != 7), key=key)
    for frame in (awkward, clashing):
        rows = runs.periodic_runs(frame.filter("doc_id IS NULL OR doc_id <> 7")).collect()
        assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in rows), key=key) == want
    assert runs.periodic_runs(awkward.filter("doc_id = 7")).first()["n_words"] > 20_000
    assert runs.periodic_runs(awkward.limit(0)).count() == 0
