"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import fingerprint, langid, lattice, licenses, line_dedup, minhash, mixing, mtree, packing, suffix_dedup

tokenizers = pytest.importorskip("public_tokenizers")

WORDS = "alpha beta gamma delta omega kappa sigma lambda river stone cloud paper".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, root long, count long, start int, chunks_cut int, mix_take int, hits string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", ".", ",", "é"]) for _ in range(n))


def messy_rows():
    base = prose(1, 120)
    texts = [base, base, base.replace("alpha", "ALPHA", 1), base + " tail", None, "", "  \n\t ", "word", prose(2, 60), prose(3, 9000), base[:300] + prose(4, 80), "x" * 1500, "日本語 😀 \x00 テキスト", prose(5, 90) + "\n" + base, "a\nb\nc\nd\n" * 8, "a\nb\nc\nd\n" * 8, "Released under the MIT License. MIT license", "12 34 !!"]
    rows = [(i, t, None if i == 7 else "en" if i % 3 else "fr", None if i == 8 else f"src{i % 3}", None, 1, "k", 2, 3, 4, 5, 6, "h") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[8], (None, base, "en", "src1", 1, *[None] * 8), (None, None, None, None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_minhash(messy, empty):
    docs = {i: t for i, t, *_ in messy_rows() if i is not None}
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set()) for i, w in ((i, words(t)) for i, t in docs.items())}
    root = {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = minhash.near_duplicates(messy, size=2).collect()
    assert len(got) == len(messy_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.drop_near_duplicates(messy, size=2)
    assert left.columns == messy.columns
    ids = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    assert ids == sorted(i for i in docs if root[i] == i)


def test_near_duplicates_of_clashing_ids(spark):
    t, u = prose(1, 80), prose(2, 80)
    rows = [(1, t), (2, t), (2, u), (2, u), (3, u + " more"), (None, t), (4, ""), (5, None)]
    got = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5).collect()
    kept = {(r["doc_id"], r["text"]) for r in got}
    assert len(got) == len(kept) and {(1, t), (None, t), (4, ""), (5, None)} <= kept and (2, t) not in kept
    assert len({(2, u), (3, u + " more")} & kept) == 1


def test_minhash_large_group(spark):
    r = random.Random(3)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(100)] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 2]) for k in range(99)} for _, t in rows]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(300)}


def test_language(spark, messy, empty):
    rows = [(i, " ".join(random.Random(i).choice(v) for _ in range(40)), lang) for i in range(60) for lang, v in [("en", "the and of thing that with from have there being".split()), ("de", "der die und nicht sich auch werden können über schön".split())]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(i, " ".join(random.Random(900 + i).choice("der die und nicht sich auch werden können über schön".split()) for _ in range(30))) for i in range(10)]
    got = spark.createDataFrame(test, "doc_id long, text string").select(langid.classify(F.col("text"), model).alias("p")).select("p.*").collect()
    assert all(r["lang"] == "de" and not r["rejected"] and 0.5 < r["score"] <= 1 for r in got)
    found = messy.select("text", langid.classify(F.col("text"), model).alias("p")).collect()
    for r in found:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["p"]["lang"], r["p"]["score"], r["p"]["rejected"]) == ("und", 0.0, True)
    none = langid.fit(empty)
    assert none.dictionaries == () and messy.select(langid.classify(F.col("text"), none)["lang"].alias("l")).distinct().collect()[0]["l"] == "und"
    assert empty.select(langid.classify(F.col("text"), model)).count() == 0


def test_licences(spark, messy, empty):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "mit-license! MIT\nLicense", "Licensed under CC BY-NC 4.0.", "mitt license", None, "Redistribution and use in source and binary forms, with or without modification, are permitted", "apache license apache license"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["base_labels"] == ["gpl"] and got[0]["labels"] == ["gpl", "gpl-3.0"] and got[0]["base_places"] == [6] and got[0]["score"] == 1
    assert got[1]["base_places"] == [0, 2] and got[1]["n_words"] == 4
    assert got[2]["base_labels"] == ["cc-by"] and "cc-by-nc-4.0" in got[2]["labels"]
    assert got[3]["labels"] == [] and got[3]["score"] == 0 and got[4]["n_words"] == 0
    assert got[5]["labels"] == ["bsd"] and got[6]["base_places"] == [0, 2]
    assert licenses.scan(messy).count() == len(messy_rows()) and licenses.scan(empty).count() == 0


def brute_marginals(pieces, logp):
    """word -> log probability over all segmentations, by a plain recursion over prefixes."""
    at = {p: i for i, p in enumerate(pieces)}
    byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
    plain = {p for p, i in at.items() if i not in byte.values() and p not in ("<unk>", "<s>", "</s>")}

    def of(word):
        w, alpha = lattice.MARK + word, [1.0]
        for j in range(1, len(w) + 1):
            total = 0.0
            for i in range(max(0, j - 40), j):
                if w[i:j] in plain:
                    total += alpha[i] * math.exp(logp[at[w[i:j]]])
                elif i == j - 1:
                    total += alpha[i] * math.exp(sum(logp[byte[b]] for b in w[i].encode()))
            alpha.append(total)
        return math.log(alpha[-1])

    return of


def brute_fit(pieces, counts):
    """One round of expectation maximisation: expected uses are the slopes of the marginals."""
    logp = lattice.rank_scores(pieces)
    of, totals = brute_marginals(pieces, logp), np.full(len(pieces), 0.1)
    for word, c in counts.items():
        w = lattice.MARK + word
        near = {i for i, p in enumerate(pieces) if p in w} | {i for i, p in enumerate(pieces) if p.startswith("<0x") and len(p) == 6 and int(p[3:5], 16) in w.encode()}
        for i in near:
            step = np.array(logp)
            step[i] += 1e-5
            totals[i] += c * (brute_marginals(pieces, step)(word) - of(word)) / 1e-5
    for i, p in enumerate(pieces):
        if p in ("<unk>", "<s>", "</s>"):
            totals[i] = 1e-12
    return np.log(totals / totals.sum())


def test_lattice_scores_whole_texts(spark):
    """score against brute force: pieces fitted and words summed over segmentations by plain loops."""
    path = tokenizers.path("piece_bpe_32k.model")
    docs = [(0, "the sea sea"), (1, "a sea é"), (2, "unseen the q"), (3, "")]
    pieces = lattice.read_vocabulary(path)
    counts = Counter(w for i, t in docs if i < 2 for w in t.split())
    of = brute_marginals(pieces, brute_fit(pieces, counts))
    tokens, distinct = sum(counts.values()) + 2, len(counts) + 1
    end = (2 + 0.5) / (tokens + 0.5 * (distinct + 1))
    unseen = sum(c == 1 for c in counts.values()) / sum(counts.values())
    for head in (60_000, 0):
        got = {r["doc_id"]: r for r in lattice.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 2, path, head_words=head, rounds=1).collect()}
        for i, t in docs:
            want = math.log10(end) + sum(of(w) / math.log(10) + math.log10(1 - end) for w in t.split())
            mixed = math.log10(end) + sum(math.log10(min(unseen, 0.5) * math.exp(of(w)) + (1 - min(unseen, 0.5)) * counts[w] / sum(counts.values())) + math.log10(1 - end) for w in t.split())
            assert abs(got[i]["score"] - want) < 1e-3 and abs(got[i]["mixed_score"] - mixed) < 1e-3


def test_long_words():
    pieces = lattice.read_vocabulary(tokenizers.path("piece_bpe_32k.model"))
    model = lattice.Pieces(pieces, lattice.rank_scores(pieces))
    word = "".join(random.Random(1).choice("etaoiné日") for _ in range(lattice.LONG - 1))
    (_, points), = lattice.Pieces.by_length([word])
    short, long = np.zeros(len(pieces)), np.zeros(len(pieces))
    one = model.forward(points)[-1, 0]
    model.expect(points, np.array([3.0]), short)
    lattice.LONG, held = 10, lattice.LONG
    try:
        assert abs(model.forward(points)[-1, 0] - one) < 1e-6
        model.expect(points, np.array([3.0]), long)
    finally:
        lattice.LONG = held
    assert np.allclose(short, long)


@pytest.mark.parametrize("head", [60_000, 0])
def test_lattice(messy, empty, head):
    path = tokenizers.path("piece_bpe_32k.model")
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    docs = [(i, t or "") for i, t, *_ in messy_rows()]
    counts = Counter()
    for i, t, *_ in messy_rows():
        if i is not None and i % 2 == 0:
            counts.update([*words(t), "end"])
    total, distinct = sum(counts.values()), len(counts)
    got = lattice.score(messy, learn, path, head_words=head, rounds=1).collect()
    want = sorted((-1 if i is None else i, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), "end"]), round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*words(t), "end"]), 6)) for i, t in docs)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == total and r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lattice.score(empty, learn, path, rounds=1).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = lattice.read_vocabulary(tokenizers.path("piece_bpe_32k.model"))
    model = lattice.Pieces(pieces, lattice.rank_scores(pieces))
    at = {p: i for i, p in enumerate(pieces)}

    def brute(w):
        if not w:
            return 1.0
        total = 0.0
        for n in range(1, len(w) + 1):
            if w[:n] in at and not w.startswith("<0x"):
                total += math.exp(model.logp[at[w[:n]]]) * brute(w[n:])
            elif n == 1:
                total += math.exp(sum(model.logp[model.byte[b]] for b in w[0].encode())) * brute(w[1:])
        return total

    found = ["the", "rivers", "日x", "q\x00", "a"]
    for rows, points in lattice.Pieces.by_length(found):
        for r, s in zip(rows, model.forward(points)[-1]):
            assert abs(s - math.log(brute(lattice.MARK + found[r]))) < 1e-9


def test_line_chunks(spark):
    """Boundaries depend on the last two lines only: by the rolling hash of their hashes."""
    text = "\n".join(random.Random(1).choice("abcdefgh") for _ in range(200))
    hs, want, start = [], [], 0
    for i, line in enumerate(text.split("\n")):
        hs.append(int(hashlib.md5(line.encode()).hexdigest()[:8], 16) % line_dedup.MODULUS)
        roll = (hs[i] + (hs[i - 1] * line_dedup.BASE % line_dedup.MODULUS if i else 0)) % line_dedup.MODULUS
        if roll % 2 == 0 or i == 199:
            want.append(("\n".join(text.split("\n")[start : i + 1]), i + 1 - start))
            start = i + 1
    got = spark.createDataFrame([(text,)], "t string").select(line_dedup.line_chunks(F.col("t")).alias("c")).first()["c"]
    assert [tuple(c) for c in got] == want


def test_line_dedup(messy, empty):
    got = line_dedup.dedup_lines(messy)
    assert got.columns == [c for c in messy.columns if c != "chunks_cut"] + ["chunks_cut"]
    rows = got.collect()
    assert len(rows) == len(messy_rows())
    by_id = {r["doc_id"]: r["text"] for r in rows}
    # the table's other row of that text goes as a whole; a text of one period keeps what holds no repeated chunk
    assert by_id[15] == "" and set(by_id[14].split("\n")) == {"a", "b", "c", "d", ""} and len(by_id[14]) < 64 and by_id[4] is None and by_id[None] in (None, prose(1, 120))
    assert by_id[13] == prose(5, 90) + "\n" + prose(1, 120)
    assert line_dedup.dedup_lines(empty).count() == 0


def alike(a, b):
    """Likeness by a plain loop: the common prefix and suffix, without overlap, of the longer text."""
    most, n, m = min(len(a), len(b)), 0, 0
    while n < most and a[n] == b[n]:
        n += 1
    while m < most - n and a[-1 - m] == b[-1 - m]:
        m += 1
    return (n + m) / max(len(a), len(b)) if a or b else 1.0


def expected_fingerprints(spark, rows):
    """(id, length, edited text, both likenesses) of each row; equal ids follow by their texts' hashes, null ids last."""
    texts = sorted({t for _, t in rows})
    hashes = dict(zip(texts, (r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).selectExpr("xxhash64(t)").collect())))
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]]))
    out = Counter()
    for (i, t), (_, after) in zip(order, [*order[1:], *order[:1]]):
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        out[i, len(t), edited, round(alike(t, edited), 9), round(alike(t, after), 9)] += 1
    return out


def fingerprint_rows(found):
    return Counter((r["doc_id"], r["n_chars"], r["edited_text"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found)


@pytest.mark.parametrize("each", [1, 3, 256])
def test_fingerprints(spark, messy, empty, each):
    want = expected_fingerprints(spark, [(i, t or "") for i, t, *_ in messy_rows()])
    assert fingerprint_rows(fingerprint.compare_neighbours(messy, rows_each=each).collect()) == want
    assert fingerprint.compare_neighbours(empty, rows_each=each).count() == 0


@pytest.mark.parametrize("each", [1, 20])
def test_fingerprints_of_hot_and_far_ids(spark, each):
    r = random.Random(2)
    rows = [(None, prose(i % 7, 12)) for i in range(120)] + [(None, "")] * 100 + [(5, "same text here")] * 90 + [(5, prose(i, 9)) for i in range(60)]
    rows += [(r.choice([-(1 << 62), (1 << 63) - 1, -4, i * 1000]), prose(i, r.randrange(30))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = fingerprint.compare_neighbours(df, rows_each=each).collect()
    assert fingerprint_rows(found) == expected_fingerprints(spark, [x for x in rows])
    of_text = {}
    assert all(of_text.setdefault((r["n_chars"], r["edited_text"]), r["edited_fingerprint"]) == r["edited_fingerprint"] for r in found)


def test_prefix_hash():
    a, b = fingerprint.PrefixHash("xxabcabcd"), fingerprint.PrefixHash("abcabcdz")
    assert a.forward(2, b, 0) == 7 and a.backward(9, b, 7) == 7 and a.forward(0, b, 0) == 0
    assert a.equal(2, b, 0, 7) and not a.equal(2, b, 1, 3)
    assert fingerprint.PrefixHash("").likeness(fingerprint.PrefixHash("")) == 1


def test_packing(messy, empty):
    path = tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x, *_ in messy_rows())
    rows = packing.pack(messy, path, max_length=512, buffer_tokens=3000).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in s)
        assert size & (size - 1) == 0 and size <= 512 and size == s[0]["window"]
        assert all(r["offset"] == sum(x["length"] for x in s[:k]) for k, r in enumerate(s))
    assert Counter(zlib.crc32(b) for _, b in want.elements()).total() == len(messy_rows())
    for i, rs in by_doc.items():
        assert sum(r["length"] for r in rs) * 4 == sum(len(b) * k for (j, b), k in want.items() if j == i)
        whole = [b for j, b in want if j == i]
        assert all(any(b[4 * r["start"] : 4 * (r["start"] + r["length"])] == bytes(r["ids"]) for b in whole) for r in rs)
    assert packing.pack(empty, path).count() == 0


def test_chunk_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), packing.ChunkEncoder(path, cache_size=500)
    r = random.Random(5)
    letters = [chr(i) for i in [*range(33, 127), *range(0xA0, 0x100)]] + list("abcdef012 \n\t") + ["'", "'", " ", "日", "😀", "İ", "ǅ", "́", "<|", "\x1c", "\x1f", "\x85", "\x00", "　", "​"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(2000)]
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], encoder.encode(texts[at : at + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_mixing(messy, empty):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(messy, levels, {"lang": {"en": 3.0, "fr": 1.0}}, total=400, max_epochs=2, seed=1)
    assert got.columns == [c for c in messy.columns if c != "mix_take"] + list(mixing.OWN)
    rows = got.collect()
    taken = sum(r["mix_take"] for r in rows)
    assert 380 < taken <= 400 and max(r["mix_epoch"] for r in rows) <= 2
    assert all(r["mix_take"] <= r["mix_tokens"] for r in rows)
    whole = mixing.mix(messy, levels, {}, share=1.0, max_epochs=1)
    assert sum(r["mix_tokens"] for r in whole.collect()) == sum(len(words(t)) for _, t, *_ in messy_rows())
    assert mixing.mix(empty, levels, {}, share=0.5).count() == 0


def test_mixing_water_level(spark):
    nodes = spark.createDataFrame([("a", 1, 10, 1.0, 90), ("b", 1, 100, 1.0, 90), ("c", 1, 100, 2.0, 90)], "node string, p int, capacity long, weight double, budget long")
    assert {r["node"]: r["budget"] for r in mixing.fill(nodes, ["p"]).collect()} == {"a": 10, "b": 26, "c": 53}


def test_top_k(spark):
    r = np.random.default_rng(4)
    data = [(i, [float(x) for x in r.normal(size=6)]) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(60)]
    data += [(None, [1.0] * 6), (900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0] * 3), (440, [0.5] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").select("vec_id", mtree.quantise(F.col("embedding")).alias("vector"), F.lit(1).alias("block"))
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    got = mtree.top_k(df, F.col("vec_id") % 20 == 0, k=5, block=64, query_block=8).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert mtree.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("batch", [4096, 1])
def test_suffix_dedup(messy, empty, keep_first, batch):
    rows = [(-1 if i is None else i, (t or "").encode()) for i, t, *_ in messy_rows()]
    seen = defaultdict(list)
    for i, b in rows:
        for k in range(len(b) - 399):
            seen[b[k : k + 400]].append((i, k))
    want = Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            places = seen[b[k : k + 400]]
            if len(places) > 1 and not (keep_first and min(places) == (i, k)):
                gone[k : k + 400] = True
        want[(None if i < 0 else i, len(b), np.frombuffer(b, np.uint8)[~gone].tobytes())] += 1
    got = suffix_dedup.dedup_substrings(messy, keep_first=keep_first, batch=batch).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got) == want
    assert suffix_dedup.dedup_substrings(empty, keep_first=keep_first).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, prose(i % 37, 150), ["en", "fr"][i % 2], f"src{i % 5}", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        assert at.count() <= 60
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 37


def test_suffix_dedup_of_many_copies_and_passages(spark):
    """1,000 copies of one row, null ids, and passages of more than 50 words in fewer than 400 bytes, against plain loops."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    passage = " ".join(word() for _ in range(55))
    few = " ".join(word() for _ in range(50))
    around = lambda p: " ".join([*(word() for _ in range(30)), p, *(word() for _ in range(20))])
    copy = " ".join(word() for _ in range(160))
    rows = [(7, copy)] * 1000 + [(None, copy[:420])] * 3 + [(None, around(passage)), (None, around(passage)), (1, around(few)), (2, around(few)), (3, passage.replace(" ", "\n")), (4, around("")), (5, around(copy[200:700]))]
    assert len(passage) < 400
    seen, starts = defaultdict(set), Counter()
    for n, (_, t) in enumerate(rows):
        for k in range(len(t) - 399):
            seen[t[k : k + 400]].add((n, k))
    windows = lambda t: [tuple(t.split()[k : k + 51]) for k in range(len(t.split()) - 50)]
    for _, t in rows:
        starts.update(windows(t))
    want = Counter()
    for n, (i, t) in enumerate(rows):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            gone[k : k + 400] |= len(seen[t[k : k + 400]]) > 1
        want[i, "".join(c for c, g in zip(t, gone) if not g), sum(starts[w] > 1 for w in windows(t))] += 1
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep_first=False).collect()
    assert Counter((x["doc_id"], bytes(x["kept"]).decode(), x["passage_starts"]) for x in got) == want
    assert sum(x["passage_starts"] > 0 for x in got) == 1000 + 3 + 2 + 1 + 1


def test_longest_previous_factors():
    """Against a plain search: the longest match with any earlier, and with any later, place."""
    r = random.Random(4)
    text = bytes(r.choice(b"ab") for _ in range(120))
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))
    common = [0] + [lcp(a, b) for a, b in zip(order, order[1:])]
    assert suffix_dedup.longest_previous(order, common) == [max((lcp(i, j) for j in range(i)), default=0) for i in order]
    assert suffix_dedup.longest_previous([-i for i in order], common) == [max((lcp(i, j) for j in range(i + 1, len(text))), default=0) for i in order]


class _Rows:
    """Stands for a table whose mapInArrow is called at once."""

    def __init__(self, batch):
        self.batch = batch

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_texts_are_cut_together_as_they_are_alone(monkeypatch):
    """Anchors and segments of many texts at once are those of each text, and come in batches of texts (it was a batch for each)."""
    pa = pytest.importorskip("pyarrow")
    texts = ["", "a", "x" * 399, "x" * 400, "w " * 60, " é " * 300, *(prose(i, 20 + 40 * i) for i in range(12)), prose(3, 200) + "\n\t" + prose(4, 90), "x" * 1500]
    uids = [b"%d" % i for i in range(len(texts))]

    def found(part):
        rows = pa.RecordBatch.from_arrays([pa.array([uids[i] for i in part], pa.binary()), pa.array([texts[i] for i in part], pa.string())], names=["uid", "text"])
        return suffix_dedup.find_anchors(_Rows(rows), 400, 51)

    def cut(part, anchors):
        lists = pa.array([anchors.get(uids[i], []) for i in part], pa.list_(pa.struct([("words", pa.bool_()), ("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])))
        ids = pa.array(part, pa.int64())
        rows = pa.RecordBatch.from_arrays([pa.array([uids[i] for i in part], pa.binary()), ids, ids, pa.array([texts[i] for i in part], pa.string()), lists], names=["uid", "doc_id", "m", "text", "anchors"])
        return suffix_dedup.cut_segments(_Rows(rows), 400, 51)

    flat = lambda batches: sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=repr)
    every = range(len(texts))
    together = found(every)
    assert len(together) == 1 and flat(together) == flat(b for i in every for b in found([i]))
    anchors = defaultdict(list)
    for b in together:
        for r in b.to_pylist():
            anchors[r["uid"]].append({k: r[k] for k in ("words", "place", "first", "last")})
            assert r["first"] >= 0 and (r["words"] or r["last"] + 400 <= len(texts[int(r["uid"])].encode()))
    segments = cut(every, anchors)
    assert len(segments) == 1 and flat(segments) == flat(b for i in every for b in cut([i], anchors))
    monkeypatch.setattr(suffix_dedup, "PART", 3000)
    assert flat(found(every)) == flat(together) and flat(cut(every, anchors)) == flat(segments)
    # each window of bytes lies in one segment of its text
    for i in every:
        starts = [k for r in flat(segments) if r[3] == uids[i] and r[9] is None for k in range(r[6], r[6] + r[8])]
        assert sorted(starts) == list(range(max(0, len(texts[i].encode()) - 399)))
