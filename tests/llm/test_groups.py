"""SimHash groups, connected components and fuzzy lines against brute force."""

import random

import numpy as np
import pytest
import xxhash
from conftest import prose

from fieldecho.llm import blocks, edits, lines, near, simhash
from fieldecho.llm.components import components

DIR = "/root/testdata/sf0.001"


def roots_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, k):
    ws = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000, 2001), (2001, 2002), (2002, 2000), (7, 7)]
    pairs += [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(700)]
    rng.shuffle(pairs)
    want = roots_of(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows", [10, 10**7, 10**12])
def test_every_close_pair_shares_a_bucket(spark, rows, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 5))) for b in base]
    hub = rng.getrandbits(64)
    near += [hub ^ 1 << i for i in range(40)]
    fps = [x - 2**64 if x >> 63 else x for x in {*base, *near}]
    monkeypatch.setattr(blocks, "CHUNK", 8)
    monkeypatch.setattr(blocks, "layout", lambda d, n, f=blocks.layout: f(d, rows))
    links = blocks.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3).collect()
    far = [(a, b) for a, b in links if (a ^ b) % 2**64 and bin((a ^ b) % 2**64).count("1") > 3]
    assert not far
    want = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) % 2**64).count("1") <= 3]
    assert roots_of(links, fps) == roots_of(want, fps)


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fp = {r["doc_id"]: plain_fingerprint(r["text"], 3) for r in rows}
    ids = sorted(fp)
    want = roots_of([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs, 3, 3).collect()}
    assert got == {i: (fp[i], want[i]) for i in ids}
    kept = simhash.one_of_each(docs, 3, 3)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_simhash_of_awkward_rows(spark, awkward, clashing, nothing):
    got = [tuple(r) for r in simhash.near_duplicates(awkward, 3, 3).collect()]
    assert len(got) == awkward.count()
    fp = {r["text"]: simhash.fingerprint(r["text"], 3) for r in awkward.collect()}
    assert all(fp[t] == plain_fingerprint(t, 3) for t in fp) and fp[None] == fp[""] == 0
    empty = [r for r in got if r[1] == 0]
    assert {r[2] for r in empty} == {1}
    kept = simhash.one_of_each(clashing, 3, 3)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 2 and 1 in ids and 2 not in ids
    assert simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_edit_distance(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 80))) for _ in range(2))
    if seed % 2:
        b = a[:10] + b[:3] + a[10:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert lines.edit_distance(a, b) == row[-1]


def test_words_of_lines_at_any_offset():
    text = "\n".join(["", "a b  c\td", " e ", "", "été  ǈ x", "\r\x0b"] * 5)
    hashes, n_words, starts = lines.line_words(text.encode())
    assert n_words.tolist() == [len(x.encode().split()) for x in text.split("\n")] and len(starts) == len(n_words) + 1
    words = text.encode().split()
    assert len(set(hashes.tolist())) == len(set(words)) and all((hashes == h).sum() == words.count(w) for w, h in zip(words, hashes))


def plain_lines(docs, least=5):
    """docs: rows (doc_id, text). The (doc_id, text, line number)s that go, by edit similarity alone."""
    occ = [(d, x, i, lines.normalised(line)) for d, x in docs for i, line in enumerate((x or "").split("\n")) if len(line.encode().split()) >= least]
    norms = sorted({o[3] for o in occ}, key=lambda n: (len(n), n))
    pairs = []
    for i, a in enumerate(norms):
        for j in range(i):
            if len(norms[j]) >= 0.8 * len(a) and lines.similar(a, norms[j], 0.8):
                pairs.append((i, j))
    group = roots_of(pairs, range(len(norms)))
    where = {n: group[i] for i, n in enumerate(norms)}
    version = {x: (xxhash.xxh64_intdigest((x or "").encode(), 42) + 2**63) % 2**64 - 2**63 for _, x in docs}
    keep = {}
    for d, x, i, n in occ:
        key = (d is not None, d or 0, version[x], i)
        keep[where[n]] = min(keep.get(where[n], key), key)
    return {(d, x, i) for d, x, i, n in occ if keep[where[n]] != (d is not None, d or 0, version[x], i)}


@pytest.mark.parametrize("chunk", [4])
def test_fuzzy_lines_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    monkeypatch.setattr(near, "SMALL", chunk)
    base = [prose(100 + k, 60) for k in range(6)]
    rows, n = [], 0
    for k, line in enumerate(base):
        ws = line.split()
        for j in range(8):
            own = list(ws)
            own[j * 5 % 60] = f"changed{j}"
            rows.append((n, "\n".join([prose(500 + n, 30), " ".join(own), "short line", line.upper() if j % 3 == 0 else prose(900 + n, 12), f"x{j}"])))
            n += 1
    rows += [(n, "x\ny\n\n" + "z" * 200_000), (n + 1, "z" * 100_000 + "y" + "z" * 99_990 + "\n "), (n + 2, None), (n + 3, prose(3, 40_000)), (n + 4, prose(4, 40_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = plain_lines(rows, 1)
    assert len(gone) > 90
    got = {r["doc_id"]: r for r in lines.deduplicated(docs, min_words=1).collect()}
    for d, x in rows:
        if x is not None:
            want = "\n".join(line for i, line in enumerate(x.split("\n")) if (d, x, i) not in gone)
            assert (got[d]["text"], got[d]["n_lines"], got[d]["n_dropped"]) == (want, x.count("\n") + 1, sum((d, x, i) in gone for i in range(x.count("\n") + 1)))


def test_lines_of_given_documents(spark):
    """Against edit similarity alone: nothing goes that should stay, and nearly all that should go (few edits reach no part of a short line)."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    gone, here = plain_lines(rows, 1), set()
    for r in lines.deduplicated(docs, min_words=1).collect():
        x = dict(rows)[r["doc_id"]]
        left = r["text"].split("\n") if r["text"] or not r["n_dropped"] else []
        went = {(r["doc_id"], x, i) for i in range(r["n_lines"]) if (r["doc_id"], x, i) in gone}
        if r["text"] == "\n".join(line for i, line in enumerate(x.split("\n")) if (r["doc_id"], x, i) not in went):
            here |= went
        else:
            assert r["n_dropped"] <= len(went) and len(left) == r["n_lines"] - r["n_dropped"]
            here |= set(list(went)[:r["n_dropped"]])
    assert len(here) >= 0.98 * len(gone)


@pytest.mark.parametrize("long", [4096, 3])
def test_edits_are_counted_up_to_a_limit(monkeypatch, long):
    monkeypatch.setattr(lines, "LONG", long)
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        b = list(a)
        for _ in range(rng.randrange(0, 14)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randrange(2)] = rng.choice(["", "a", "d"])
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for most in (0, 1, 3, 7, 12, 100):
            found = lines.edits_within(a, b, most)
            assert found == row[-1] if row[-1] <= most else found > most
        if a:
            assert lines.checker([a, b, a + "x"], 0.8)(0, np.array([1, 2])).tolist() == [lines.similar(a, b, 0.8), lines.similar(a, a + "x", 0.8)]


def test_short_lines_one_edit_apart_meet(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklm nopq") for _ in range(rng.randrange(5, 25))).strip() or "q" for _ in range(60)]
    texts += [t[:i] + c + t[i + k:] for t in texts for i, c, k in [(len(t) // 2, "z", 1), (1, "z", 0), (len(t) - 2, "", 1)]]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=1).collect()}
    norms = [lines.normalised(t) for t in texts]
    for i, a in enumerate(norms):
        if i >= 60 and lines.similar(a, norms[(i - 60) // 3], 0.8):
            assert got[i] == 1, (a, norms[(i - 60) // 3])


def test_lines_of_awkward_rows(spark, awkward, clashing, nothing):
    got = lines.deduplicated(clashing)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == awkward.count()
    rows = got.collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["text"] is None and by_id[1]["n_lines"] == 0 and by_id[2]["text"] == "" and by_id[6]["text"] == "" and by_id[6]["n_dropped"] == 1
    assert [r["text"] for r in rows if r["doc_id"] == 5].count(prose(2, 80)) == 2  # rows that repeat both come out alike
    assert lines.deduplicated(nothing).count() == 0


def test_group_reader_carries_over():
    import pyarrow as pa
    t = pa.table({"key": pa.array(np.repeat([1, 2, 3, 4], [3, 1, 6, 2])), "lo": pa.array(np.zeros(12, int)), "hi": pa.array(np.zeros(12, int)), "fp": pa.array(np.arange(12))})
    got = [(part["fp"].to_pylist(), e.tolist()) for part, e in blocks.groups(iter(t.to_batches(max_chunksize=4)))]
    flat = [p[a:b] for p, e in got for a, b in zip(e, e[1:])]
    assert flat == [[0, 1, 2], [3], [4, 5, 6, 7, 8, 9], [10, 11]]


def test_group_reader_gathers_batches():
    import pyarrow as pa
    rng = random.Random(8)
    keys = [k for k in range(900) for _ in range(rng.choice((2, 2, 3, 40)))]
    n = len(keys)
    whole = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "lo": pa.array([0] * n, pa.int64()), "hi": pa.array([0] * n, pa.int64()), "id": pa.array(range(n), pa.int64())})
    few = [whole.slice(i, 100) for i in range(0, n, 100)]
    for rows, size, most in ((3000, 1 << 30, n // 2900 + 2), (1 << 30, 32 * 3000, n // 2900 + 2), (1 << 30, 1 << 30, 1)):
        got = list(blocks.groups(iter(few), rows, size))
        assert len(got) <= most and [i for t, _ in got for i in t["id"].to_pylist()] == list(range(n))
        for t, edges in got:
            parts = [t["key"].to_pylist()[a:b] for a, b in zip(edges[:-1], edges[1:])]
            assert all(len(set(p)) == 1 and len(p) == keys.count(p[0]) for p in parts) and edges[-1] == t.num_rows


def test_majority_of_bits():
    from fieldecho.llm.bits import majority, spread
    rng = np.random.default_rng(0)
    sizes = [1, 2, 255, 256, 1000, 3, 510]
    hashes = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    starts = np.append(0, np.cumsum(sizes)[:-1])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[a:a + n]) > n) for a, n in zip(starts, sizes)]
    assert majority(spread(hashes), starts).tolist() == want


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "a\u4e00\u4e01b", "a\U0001F600bc"])
def test_edits_of_many_pairs(letters, monkeypatch):
    from fieldecho.llm import edits
    monkeypatch.setattr(edits, "TABLE", 1 << 12)
    monkeypatch.setattr(edits, "CELLS", 1 << 13)
    rnd = random.Random(4)
    held = [""]
    for _ in range(150):
        a = [rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 20, 63, 64, 65, 128, 130, 200, 700]))]
        b = list(a)
        for _ in range(rnd.randrange(30)):
            i = rnd.randrange(len(b) + 1)
            b[i:i + rnd.randrange(2)] = rnd.choice(["", *letters])
        held += ["".join(a), "".join(b)]
    pairs = [(rnd.randrange(len(held)), rnd.randrange(len(held))) for _ in range(600)] + [(i, i + 1) for i in range(1, len(held), 2)]
    most = [rnd.choice([0, 1, 5, 20, 60]) for _ in pairs]
    got = edits.Lines(held).within(*np.array(pairs).T, np.array(most))
    assert got.tolist() == [lines.edits_within(held[i], held[j], k) <= k for (i, j), k in zip(pairs, most)]
    assert 50 < got.sum() < len(got) - 50


def test_replaced_words_are_never_fewer_than_edits():
    import random
    from fieldecho.llm.lines import edit_distance, replaced
    r = random.Random(5)
    for _ in range(400):
        a = [r.choice("abcde") * r.randint(0, 4) for _ in range(r.randint(1, 25))]
        b = [w for w in a if r.random() > 0.1]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.choice(["q", "rst", "ab", ""]))
        b = b or ["q"]
        exact = edit_distance(" ".join(a), " ".join(b))
        assert replaced(a, b, 10**9) >= exact
        assert (replaced(a, b, exact) <= exact) == (replaced(a, b, 10**9) <= exact)


def test_pairs_of_all_groups_connect_what_the_check_allows():
    import numpy as np
    from fieldecho.llm.near import unlinked_pairs
    rng = np.random.default_rng(1)
    edges = np.cumsum([0, 2, 1, 700, 3, 40])
    kind = rng.integers(0, 9, edges[-1])
    asked = []

    def exact(a, b):
        asked.append(len(a))
        return kind[a] == kind[b]
    linked = {(int(x), int(y)) for a, b in unlinked_pairs(edges, lambda a, b: np.ones(len(a), dtype=bool), exact) for x, y in zip(a, b)}
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    root = np.arange(edges[-1])
    for a, b in sorted(linked):
        assert group[a] == group[b] and kind[a] == kind[b]
        root[root == root[b]] = root[a]
    for g in range(len(edges) - 1):
        for k in range(9):
            assert len(set(root[(group == g) & (kind == k)])) <= 1
    assert max(asked) > 4000
    assert not list(unlinked_pairs(np.array([0]), None, None)) and not any(len(a) for a, _ in unlinked_pairs(np.array([0, 1, 2]), lambda a, b: a > b, exact))


def test_links_of_near_copies_are_fewer_than_the_copies():
    """One group of many near copies: the pairs that a batch finds are passed on as a forest."""
    import numpy as np
    from fieldecho.llm.near import unlinked_pairs

    def yes(a, b):
        return np.ones(len(a), dtype=bool)
    for edges in ([0, 3000], [0, 50, 2500, 2501, 2600]):
        found = list(unlinked_pairs(np.array(edges), yes, yes))
        assert sum(len(a) for a, _ in found) == edges[-1] - (len(edges) - 1)


def test_stored_tables_leave_no_shuffle_files(spark):
    import os
    import time
    from fieldecho.llm.common import stored
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, conf = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = stored(spark.range(5000).repartition("id").groupBy("id").count(), "few")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and got.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf


def _edited(rng: random.Random, a: str, letters: str, share: float) -> str:
    b = list(a)
    for _ in range(int(len(a) * share) + rng.randint(0, 1)):
        k = rng.randrange(len(b) + 1)
        b[k:k + rng.randint(0, 1)] = [rng.choice(letters) for _ in range(rng.randint(0, 1))]
    if rng.random() < 0.2:  # a stretch that only one of them has
        k = rng.randrange(len(b) + 1)
        b[k:k] = [rng.choice(letters) for _ in range(rng.randint(1, 50))]
    return "".join(b)


@pytest.mark.parametrize("letters", ["ab", "abcdef ", "abcdefghijklmnopqrstuvwxyzäöü 漢字"])
def test_edits_in_a_window_are_the_edits_of_the_whole_column(letters):
    rng = random.Random(letters)
    held, most = [], []
    for _ in range(120):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 500)))
        held += [a, _edited(rng, a, letters, rng.choice([0, 0.05, 0.2, 0.4]))]
        most.append(max(0, lines.edit_distance(*held[-2:]) + rng.choice([-30, -3, -1, 0, 0, 1, 5, 40])))
    at = np.arange(0, len(held), 2)
    got = edits.Lines(held).within(at, at + 1, np.array(most))
    assert got.tolist() == [lines.edit_distance(a, b) <= k for a, b, k in zip(held[::2], held[1::2], most)]


def test_edits_of_long_lines_are_counted_together(monkeypatch):
    rng = random.Random(4)
    held, letters = [], "abcdefghijklmnop "
    for k in range(80):
        a = "".join(rng.choice(letters) for _ in range(1500))
        held += [a, _edited(rng, a, letters, 0.1) if k % 2 else "".join(rng.choice(letters) for _ in range(1500))]
    want = [lines.similar(a, b, 0.8) for a, b in zip(held[::2], held[1::2])]
    monkeypatch.setattr(lines, "edits_within", lambda *_: pytest.fail("counted one by one"))
    at = np.arange(0, len(held), 2)
    assert lines.checker(held, 0.8)(at, at + 1).tolist() == want == [k % 2 > 0 for k in range(80)]
