"""Jobs done whole: tasks stay bounded, candidates reach the promised similarity, short lines count."""

import random

import numpy as np
from conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline
from fieldecho.llm import blocks, copies, lines, near


def test_lines_of_one_fingerprint_are_spread_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 256)
    rows = spark.range(3000).select("id", F.lit(7).cast("long").alias("fp"), F.lit(1).cast("long").alias("near"))
    dealt = blocks.in_tasks(rows, F.col("near"), "id").cache()
    assert dealt.groupBy("lo", "hi").count().agg(F.max("count")).first()[0] < 4 * 256
    halves = dealt.select("lo", "hi", "id").distinct().groupBy("lo", "hi").agg(F.collect_list("id").alias("ids")).collect()
    chunks = {i: set() for i in range(3000)}
    for k, r in enumerate(halves):
        for i in r["ids"]:
            chunks[i].add(k)
    assert all(chunks[a] & chunks[b] for a in range(0, 3000, 97) for b in range(3000))


def edited(line, words, seed):
    rng, ws = random.Random(seed), line.split()
    for i in rng.sample(range(len(ws)), words):
        ws[i] = prose(seed + i, 1)
    return " ".join(ws)


def test_lines_of_edit_similarity_meet(spark, monkeypatch):
    """Recall against edit similarity alone, whole groups of copies, chunks of a few rows."""
    monkeypatch.setattr(blocks, "CHUNK", 4)
    monkeypatch.setattr(near, "SMALL", 3)
    found = wanted = 0
    texts = []
    for n, (words, changed) in enumerate([(6, 1), (12, 1), (15, 2), (30, 3), (30, 5), (60, 3), (60, 8)]):
        for k in range(6):
            base = prose(1000 * n + k, words)
            texts += [base, *[edited(base, changed, 7919 * (n + 1) + 31 * k + j) for j in range(3)]]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    norms = [lines.normalised(t) for t in texts]
    for i, a in enumerate(norms):
        if any(lines.similar(a, b, 0.8) for b in norms[:i]):
            wanted += 1
            found += got[i]
        elif not any(lines.similar(a, b, 0.8) for b in norms[i + 1:]):
            assert got[i] == 0
    assert wanted > 80 and found >= 0.95 * wanted


def test_parts_do_not_cross_rows():
    rows = [b"one two three four five six seven eight", b"x y", b"", b"the quick brown fox jumps over the lazy dog"]

    def of(own):
        return near.parts(np.frombuffer(b"".join(own), dtype=np.uint8).astype(np.uint64), np.repeat(np.arange(len(own)), [len(x) for x in own]), len(own), 8)
    both = of(rows)
    assert (both[1] == both[2]).all() and (both[0] == of(rows[:1])[0]).all() and (both[3] == of(rows[3:])[0]).all() and both[0, 0] != both[1, 0]
    assert (near.unpacked(near.packed(both)) == both).all() and len(near.packed(both[:0])) == 0


def test_exact_copies_of_short_lines_and_of_lines_without_blanks(spark, tmp_path):
    from fieldecho.llm import queries

    glyphs = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(200))
    texts = [f"Chapter one\n\n{glyphs}\nabc", f"chapter  ONE\n\n{glyphs}\nabd", f"{glyphs[:150]}x{glyphs[151:]}\n\nother words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "\nabd", 2: "\nother words"}


def test_near_copies_against_brute_force(spark, awkward):
    """Documents with words replaced, and different texts in which one shingle is over half."""
    texts = []
    for k in range(8):
        base = prose(4000 + k, 300)
        texts += [base, *[edited(base, n, 100 * k + n) for n in (2, 4, 6, 12)]]
    texts += [" ".join(["same"] * 100) + " " + prose(9000 + k, 60) for k in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [set(copies.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert left == set(root) and len(left) < len(texts) - 15
    assert copies.near_copies(awkward).count() == awkward.count()
