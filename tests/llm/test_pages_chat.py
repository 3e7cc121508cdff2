"""Page text, reply trees, decontamination and the pipeline on small cases."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from conftest import prose
from pyspark.sql import functions as F

from fieldecho.llm import chat, decontam, pages

DIR = "/root/testdata/sf0.001"

CASES = {
    "plain": ("<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One  two\n three &amp; &eacute;</p><p>Four<br>five</p></article><footer>c</footer></body></html>",
              "T\nOne two three & é\nFour five"),
    "unclosed": ("<div id=menu>m</div><article><h1>T</h1><p><b>Bold text.<br><p>Next <i>one<p>Last one</article><aside>s</aside>", "T\nBold text.\nNext one\nLast one"),
    "scripts": ("<body><script>var t='</p><p>no';</script><style>p{}</style><div class='post'><p>Text a b c</p><script>x</script><p>More text</p></div>"
                "<div class='cookie-notice'>We use cookies</div>", "Text a b c\nMore text"),
    "classes": ("<body class='page with-sidebar'><div class='page-header'>Site</div><div class='main-content layout-with-sidebar'><h1>T</h1><p>Body of it</p>"
                "<div class='ad-box'>Buy</div><form><label>Mail</label></form><div class='comments'><article class='comment'>Nice</article></div></div>"
                "<div class='sidebar'>Links</div></body>", "T\nBody of it"),
    "lists": ("<main><h2>H</h2><ul><li>a b<li>c d</ul><table><tr><td>x y<td>z</table><p>The end of this page.</p></main>", "H\na b\nc d\nx y\nz\nThe end of this page."),
    "broken": ("<article><p>a < b and <unknown>c</unknown> <!-- no --> d &lt;p&gt; <p title=\"1>2\">q</p> tail</article><p cla", "a < b and c d <p>\nq\ntail"),
    "hidden": ("<article><p>Seen text</p><p hidden>no</p><div style='display: none'>no</div><p role=alert>no</p></article>", "Seen text"),
    "bare": ("just words &nbsp; here", "just words here"), "empty": ("", ""), "none": (None, ""), "menu only": ("<nav>a b</nav>", ""),
}


@pytest.mark.parametrize("name", list(CASES))
def test_page(name):
    page, want = CASES[name]
    assert pages.extract(page, None) == want


def test_hosts_agree(spark):
    full = "<body><div class='top'>Menu of all</div><div class='story n{i}'><p>{a}</p><p>{b}</p></div><div class='low'><p>{c}</p></div></body>"
    rows = [(i, f"https://a.example.com/{i}", full.format(i=i, a=prose(i, 80), b=prose(i + 50, 60), c="Read on.")) for i in range(9)]
    odd = full.format(i=99, a="Short.", b="Too.", c=prose(5, 90))  # alone it would take the lower box
    rows += [(100, "http://A.example.com:80/odd", odd), (101, "https://b.example.com/", odd), (102, None, None), (103, "no url", "<p>Some text</p>")]
    got = {r["page_id"]: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"{prose(i, 80)}\n{prose(i + 50, 60)}" for i in range(9))
    assert got[100]["text"] == "Short.\nToo." and got[100]["path"].endswith("div.n#.story") and got[101]["text"] == prose(5, 90)
    assert got[102]["text"] == "" and got[103]["text"] == "Some text"


def test_given_pages(spark):
    for r in pages.main_text(spark.read.parquet(f"{DIR}/pages.parquet")).join(spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.DOTALL)[1]
        blocks = [" ".join(pages.html.unescape(re.sub(r"<[^>]+>", " ", b) if "<br>" in b else re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"<p>|</p>|<h1>|</h1>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("page", ["<" * 3000, "<a '" * 3000, "<p>" * 20_000 + "x", "<!--" * 2000, "<div class=\"" * 2000, "&amp" * 5000, "<b></p></div>" * 3000])
def test_hostile_pages_end(page):
    pages.extract(page, None)


@pytest.mark.parametrize("n", [1500, 100_000])
def test_deep_pages(n):
    """A foreign winner, end tags that close nothing, and a winner that is there."""
    assert pages.extract("<div>" * n + "text", "#/html/body/article") == "text"
    assert pages.extract("<div><b>" * n + "text</p></p>" + "</b></table>" * n, "#/div/b") == "text"
    assert pages.extract("<section>" + "<div>" * n + "text" + "</div>" * n + "<p>more", "#/section") == "text\nmore"


def test_pages_without_rows_repeats_and_the_shuffle_route(spark, monkeypatch):
    schema = "page_id long, url string, html string, path string, _host string, host string, text string"
    deep = "<div>" * 2000 + "deep down"
    rows = [(1, "https://h.example/1", f"<main><p>{prose(1, 30)}</p></main>", "p", "h", "x", "t")] * 2 + [(2, "https://h.example/2", deep, "p", "h", "x", "t")]
    frame = spark.createDataFrame(rows, schema)
    want = sorted([(1, prose(1, 30)), (1, prose(1, 30)), (2, "deep down")])
    for limit in (pages.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(pages, "BROADCAST_HOSTS", limit)
        assert sorted((r["page_id"], r["text"]) for r in pages.main_text(frame).collect()) == want
    assert pages.main_text(frame.limit(0)).count() == 0


TREE = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a1", 1.0), ("t", 3, 1, "assistant", "a2", 5.0), ("t", 4, 2, "user", "q2", 9.0),
        ("t", 5, 4, "assistant", "<|end|>\n<|turn|>\\", 9.0), ("t", 6, 3, None, None, None), ("u", 1, 77, "user", "orphan", 0.0), ("v", 1, 2, "user", "c1", 0.0),
        ("v", 2, 1, "user", "c2", 0.0), ("v", 3, 2, "user", "below a cycle", 0.0), (None, 1, None, "system", "s", 0.0), (None, 2, 1, "assistant", "t", 0.0),
        ("t", 5, 4, "zzz", "repeated id", 0.0), ("w", 1, None, "user", "x", 1.0), ("w", 2, None, "user", "y", 1.0)]


def test_trees(spark):
    got = chat.conversations(spark.createDataFrame(TREE, "tree string, id long, parent long, role string, text string, score double"), top=5)
    rows = got.withColumn("said", chat.read_back(F.col("formatted"))).withColumn("taught", chat.learned(F.col("formatted"), F.col("loss"))).collect()
    found = {(r["tree"], r["rank"]): (r["leaf"], r["score"], [tuple(t) for t in r["said"]], r["taught"]) for r in rows}
    assert found == {
        ("t", 1): (5, 4.75, [("user", "q"), ("assistant", "a1"), ("user", "q2"), ("assistant", "<|end|>\n<|turn|>\\")], "a1<|end|>\n<|turn|>\\"),
        ("t", 2): (6, 5 / 3, [("user", "q"), ("assistant", "a2"), ("", "")], "a2"), ("u", 1): (1, 0.0, [("user", "orphan")], ""),
        (None, 1): (2, 0.0, [("system", "s"), ("assistant", "t")], "t"), ("w", 1): (1, 1.0, [("user", "x")], ""), ("w", 2): (2, 1.0, [("user", "y")], "")}


def test_long_and_odd_conversations(spark):
    rng = random.Random(2)
    odd = ["<|", "\\", "|>", "<\\|", "<|text|>", "<|turn|>", "<", "|", "\n", "é", "</s>[INST] ok [/INST]", "$1"]
    rows = [(1, i, "assistant" if i % 2 else "user", "".join(rng.choice(odd) for _ in range(5))) for i in range(300)]
    rows += [(2, None, None, None), (2, None, "assistant", "x"), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, 1, "a|<|b", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1)).withColumn("dist", F.lit("x"))
    got = chat.conversations(chat.linear(turns)).withColumn("said", chat.read_back(F.col("formatted"))).withColumn("taught", chat.learned(F.col("formatted"), F.col("loss")))
    found = {r["tree"]: r for r in got.collect()}
    for conv in (1, 2, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        assert [tuple(t) for t in found[conv]["said"]] == want and found[conv]["taught"] == "".join(t for r, t in want if r == "assistant")
    assert chat.conversations(chat.linear(turns.limit(0))).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(docs, items):
    wins = {}
    for i, t in items:
        ws = plain_words(t)
        for k in range(max(len(ws) - 9, 1) if ws else 0):
            wins.setdefault(tuple(ws[k:k + 10]), set()).add(i if i is None else str(i))
    out = []
    for d, t in docs:
        ws, hit, found = plain_words(t), set(), set()
        for w in {len(x) for x in wins}:
            for k in range(len(ws) - w + 1):
                got = wins.get(tuple(ws[k:k + w]))
                if got:
                    hit.update(range(k, k + w))
                    found |= got
        out.append((d, len(ws), len(hit), sorted(x or "" for x in found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [True, False])
def test_decontamination(spark, awkward, few, monkeypatch):
    if not few:
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    item = prose(40, 25)
    items = [(1, item), (2, prose(41, 12)), (3, "the"), (4, ""), (5, None), (6, item), (None, prose(42, 10)), (7, "été À b"), (8, "never seen words here"), (9, "a a a a a a a a a a a")]
    docs = [(1, item.upper()), (2, "x " + item + " y " + item), (3, " ".join(item.split()[3:14])), (3, " ".join(item.split()[3:12])), (4, "The cat"), (5, None), (6, ""),
            (7, prose(42, 10) + prose(43, 30)), (8, "a " * 30), (None, "ÉTÉ été À B"), (9, prose(41, 12)), (9, prose(41, 12)), (None, None)]
    docs += [(r["doc_id"], r["text"]) for r in awkward.collect()]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("win", F.lit(1)).withColumn("n", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = decontam.contamination(table, bench).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got], key=str) == plain_hits(docs, items)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)
    kept = decontam.clean(table, bench)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(str(d) for d, h in zip(docs, [plain_hits([d], items)[0][2] for d in docs]) if not h)
    assert kept.columns == table.columns
    assert decontam.contamination(table, bench.limit(0)).filter("n_hit = 0").count() == len(docs)
    assert decontam.contamination(table.limit(0), bench).count() == 0


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{DIR}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        if k < 4:
            assert docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        kept.append(rows)
    bench = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert len(kept[0]) == len(kept[1]) > len(kept[2]) > len(kept[3]) > 0
    assert sum(len(r["text"]) for r in kept[1]) < sum(len(r["text"]) for r in kept[0]) and all(r["n_chars"] == len(r["text"]) for r in kept[1] if r["n_chars"])
    clean = {r["doc_id"] for r in kept[2] if not plain_hits([(r["doc_id"], r["text"])], bench)[0][2]}
    assert {r["doc_id"] for r in kept[3]} == clean
    assert {r["doc_id"] for r in kept[4]} == clean
    digest = lambda rows: hashlib.sha256(repr(sorted(tuple(r) for r in rows)).encode()).hexdigest()
    assert digest(r[:5] for r in corpus_pipeline.run(spark, DIR).collect()) == digest(r[:5] for r in kept[4])


def test_pipeline_of_awkward_rows(spark, clashing, nothing):
    for docs in (clashing, nothing):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, DIR)
            if k < 4:
                assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
