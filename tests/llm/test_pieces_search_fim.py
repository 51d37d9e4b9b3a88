"""Operators 11, 12 and 13 against the library and plain loops, on odd rows, ties, repeats and long texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import fim, lexical, pieces
from factloom.llm.queries import op11_sentencepiece

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, ids string, n int, item long, score double, form string"
ODD = [
    "", " ", "a", "a ", " a", "  a  b   ", "▁", "▁▁ a▁b", "a\nb\n\n c\n", "\n", "\n\n", " \n ", "\t a\r\n", "a\x00b", "<s> x </s><unk>", "<0x0A>", "ﬁ　㎏ é é", "日本語😀 ​🏳️‍🌈", "1234 5,678.90", "Straße ÄÖÜ naïve",
    "x" * 3000, "word " * 4000, "ab" * 900 + " " + "ab" * 900, "The quick brown fox. The quick  brown fox!", "<P>a", "b<S>c", "<M>", "<P", "<", "a<", "S>b <S> c",
]


def rows():
    texts = [*ODD, None, ODD[10]]
    r = random.Random(5)
    texts += ["".join(r.choice(["river", "Stone", " ", "  ", "\n", "é", "<", "S", ">", "9", "▁", "the "]) for _ in range(r.randint(1, 200))) for _ in range(60)]
    return [(i, t, "k", 3, 1, 0.5, "f") for i, t in enumerate(texts)] + [(4, texts[4], "k", 3, 1, 0.5, "f"), (None, "a b", *[None] * 5), (None, None, *[None] * 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces_as_the_library(odd, empty):
    from sentencepiece import SentencePieceProcessor

    path = tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    got = odd.select("text", pieces.encode(F.col("text"), path).alias("found")).withColumn("back", pieces.decode(F.col("found"), path)).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["found"] == sp.encode(r["text"] or ""), repr(r["text"])[:80]
        assert r["back"] == sp.decode(r["found"]), repr(r["text"])[:80]
    assert empty.select(pieces.encode(F.col("text"), path)).count() == 0


def test_round_trip_encodes_once(spark, odd, empty):
    from sentencepiece import SentencePieceProcessor

    path = tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    got = odd.select("text", pieces.round_trip(F.col("text"), path).alias("found")).select("text", "found.ids", F.col("found.text").alias("back")).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["ids"] == sp.encode(r["text"] or "") and r["back"] == sp.decode(r["ids"]), repr(r["text"])[:80]
    assert empty.select(pieces.round_trip(F.col("text"), path)).count() == 0
    plan = op11_sentencepiece(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    calls = re.search(r"ArrowEvalPython \[(.*?)\], \[", plan)[1]
    assert calls.count("run(") == 1, calls  # it was run(text), run(run(text)): each text was encoded twice


def test_pieces_of_any_ids(spark):
    from sentencepiece import SentencePieceProcessor

    path = tokenizers.path("piece_bpe_32k.model")
    sp, r = SentencePieceProcessor(model_file=path), random.Random(1)
    lists = [[r.choice([0, 1, 2, 13, 259, 28705, 28724, 264, 3 + 0xC3, 3 + 0xA9, r.randrange(32000)]) for _ in range(r.randrange(12))] for _ in range(400)]
    lists = [ids for ids in lists if not any(b < 3 for b in ids[1:])] + [[1, 264, 2], [1, 28705, 264], [], [0], [2], [28705], [28705, 28705, 264]]
    frame = spark.createDataFrame([(i, ids) for i, ids in enumerate([*lists, None])], "i long, ids array<int>")
    got = {x["i"]: x["t"] for x in frame.select("i", pieces.decode(F.col("ids"), path).alias("t")).collect()}
    assert got.pop(len(lists)) == ""
    for i, ids in enumerate(lists):
        assert got[i] == sp.decode(ids), ids


def test_tables_stay_bounded():
    table = pieces.ChunkTable(tokenizers.path("piece_bpe_32k.model"), keep=40, keep_chars=400)
    r = random.Random(2)
    for _ in range(30):
        texts = [" ".join(r.choice(["a", "bb", "cccccccc", f"n{r.random()}"]) for _ in range(20)) for _ in range(3)] + [""]
        counts, ids = table.encode(texts)
        assert counts.tolist() == [len(x) for x in table.sp.encode(texts)]
        assert ids.tolist() == [i for x in table.sp.encode(texts) for i in x]
        assert len(table.place) <= 60 and table.chars <= 1200  # a range's own chunks at most, or what is kept


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(odd, empty):
    found = fim.transform(odd)
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got == sorted(repr(plain_cut(i, t)) for i, t, *_ in rows())
    back = found.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter((r["doc_id"], r["t"]) for r in back) == Counter((i, t or "") for i, t, *_ in rows())
    assert {r["form"] for r in found.collect()} == {"plain", "psm", "spm"}
    assert fim.transform(empty).count() == 0


def test_skip_list_reaches_every_rank():
    for text in ["", "a", "é1", "ab cd " * 700, "x" * 50, "12" * 200, "日a本 b" * 90]:
        units, list_ = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), fim.SkipList(text, step=3)
        assert list_.units == len(units)
        assert [list_.chars_before(i) for i in range(len(units) + 1)] == [sum(map(len, units[:i])) for i in range(len(units) + 1)]


def plain_ranks(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_all, l_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item_id, text in {x for x in items if x[1] is not None}:
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out.update((item_id, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("block", [7, 10_000])
def test_lexical_search(spark, odd, empty, block):
    r = random.Random(8)
    words = [f"w{i}" for i in range(90)] + ["Élan", "été", "x1"]
    texts = [" ".join(r.choices(words, weights=[1 / (1 + i) for i in range(93)], k=r.randint(1, 60))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(200 + i, texts[3]) for i in range(15)] + [(7, texts[7]), (None, texts[3]), (None, None), (300, ""), (301, " .;\n"), (302, "w1 " * 5000), (303, texts[9].upper())]
    items = [(1, "W1 w2, w3!"), (2, " ".join(words)), (3, texts[3]), (4, None), (5, ""), (6, "unseen terms"), (7, "w5 w5 w5"), (7, "w5 w5 w5"), (7, "w9 élan"), (None, "w80-w81"), (8, texts[20] + " unseen")]
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 0.1, "f") for i, t in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    got = lexical.rank(frame, asked, items_at_once=4, block=block).collect()
    assert Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got) == plain_ranks(docs, items)
    assert lexical.rank(empty, asked).count() == 0
    assert lexical.rank(frame, asked.where("item_id = 99")).count() == 0


def test_masks_are_left_out_once_safe(spark):
    docs = [(i, "common filler text here") for i in range(500)] + [(1000 + i, "rare words common " + "rare " * i) for i in range(12)] + [(2000 + i, f"common u{i} v{i % 40}") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "rare words common " + " ".join(f"v{i}" for i in range(40)))], "item_id long, text string")
    got = lexical.rank(frame, asked, k=5).collect()
    assert Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got) == plain_ranks(docs, [(1, asked.first()["text"])], 5)
    assert all(x["masks_read"] < x["masks"] for x in got)
