"""Passages of lines that stand elsewhere too, wherever they begin and end."""

import hashlib
import random

import pytest

from factloom.llm import line_dedup

LINES = [f"line {i} of what is written" for i in range(400)]


def rows():
    r = random.Random(3)
    passage = LINES[:7]
    texts = ["\n".join([*LINES[10 * i : 10 * i + 5], *passage, *LINES[10 * i + 5 : 10 * i + 10]]) for i in range(1, 9)]
    texts += ["\n".join(LINES[100:102]), "\n".join([LINES[200], *LINES[100:102], LINES[201]]), "\n".join(["again"] * 50), "a\nb\nc\nd\n" * 8, "one", "", None, "\n\n\n"]
    texts += ["\n".join(r.choice("xyz") for _ in range(40)) for _ in range(10)]
    found = list(enumerate(texts))
    return [*found, found[0], found[9], (3, "other\ntext"), (3, "\n".join([*LINES[300:304], "mine"])), (80, "\n".join(LINES[300:304])), (None, texts[0])]


def chunks_of(text):
    """(first line, lines) of each chunk."""
    lines, out, start = text.split("\n"), [], 0
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % line_dedup.MODULUS for x in lines]
    for i, h in enumerate(hashes):
        if i == len(lines) - 1 or (i and h == hashes[i - 1]) or (h + (hashes[i - 1] * line_dedup.BASE % line_dedup.MODULUS if i else 0)) % line_dedup.MODULUS % 2 == 0:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def expected(found, least=0):
    """(id, text) to what is left and the numbers of the lines that go: later places of chunks, grown while lines are those around the first place."""
    order = sorted({(k, text_hash, t) for k, t, text_hash in found if k is not None and t is not None})
    first, left = {}, {}
    for k, _, t in order:
        ls, cut = t.split("\n"), set()
        cs = chunks_of(t)
        for n, (a, chunk) in enumerate(cs):
            before, rest = [x for _, c in cs[max(0, n - 2) : n] for x in c], [c for _, c in cs[n + 1 : n + 4]]
            if len(chunk) == 1 and rest:
                chunk = chunk + rest.pop(0)
            after = [x for c in rest[:2] for x in c]
            if len(chunk) < 2:
                continue
            if tuple(chunk) not in first:
                first[tuple(chunk)] = before, after
                continue
            before0, after0 = first[tuple(chunk)]
            up = down = 0
            while up < min(len(before), len(before0)) and before[-1 - up] == before0[-1 - up]:
                up += 1
            while down < min(len(after), len(after0)) and after[down] == after0[down]:
                down += 1
            cut |= set(range(a - up, a + len(chunk) + down))
        for run, _ in runs(t, sorted(cut), places=True):
            if sum(len("".join(ls[i].split()).encode()) for i in run) < least:
                cut -= set(run)
        left[k, t] = ("\n".join(x for i, x in enumerate(ls) if i not in cut), sorted(cut))
    return left


def runs(text, cut, places=False):
    """The runs of neighbouring numbers in cut, as (text or numbers, n_lines)."""
    out = []
    for i in cut:
        if not out or out[-1][-1] != i - 1:
            out.append([])
        out[-1].append(i)
    return [(run if places else "\n".join(text.split("\n")[j] for j in run), len(run)) for run in out]


@pytest.mark.parametrize("least", [0, 80])
def test_dedup_passages(spark, least):
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows())], "doc_id long, text string, n int").repartition(3)
    want = expected([(r["doc_id"], r["text"], r["u"]) for r in docs.selectExpr("*", "xxhash64(text) AS u").collect()], least)
    got = line_dedup.dedup_lines(docs, min_bytes=least)
    assert got.columns == ["doc_id", "text", "n", "chunks_cut"]
    found = got.collect()
    assert len(found) == len(rows())
    for r in found:
        k, t = rows()[r["n"]]
        left, cut = want.get((k, t), (t, []))
        assert (r["text"], [tuple(c) for c in r["chunks_cut"]]) == (left, runs(t, cut))
    by_n = {r["n"]: r["text"] for r in found}
    assert all(not set(by_n[i].split("\n")) & set(LINES[:7]) for i in range(1, 8)) and (least or by_n[10] == "again")
    assert by_n[rows().index((3, "other\ntext"))] == "other\ntext"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_pipeline_cuts_whole_passages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, t, "en", "src1", len(t or "")) for k, t in rows()[:8]], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got[0]["text"] == rows()[0][1]
    for i in range(1, 8):
        assert not set(got[i]["text"].split("\n")) & set(LINES[:7]) and got[i]["n_chars"] == len(got[i]["text"])


def test_another_text_of_the_same_id_stays_whole(spark):
    """Rows (1, T), (2, T), (2, U): U stands nowhere else."""
    t, u = "\n".join(f"t {i}" for i in range(40)), "\n".join(f"u {i}" for i in range(40))
    docs = spark.createDataFrame([(1, t), (2, t), (2, u)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()) == [(1, t), (2, ""), (2, u)]


def test_trivial_runs_stay_and_chunks_decide(spark):
    """Blank lines and closing braces repeat in most texts; chunks of one line each could not choose anything."""
    texts = ["a = 1\n\n\nb = 2\n}\n}\n", "c = 3\n\n\nd = 4\n}\n}\ne", "x\n\n\ny"]
    passage = "\n".join(LINES[20:32])
    docs = spark.createDataFrame([*enumerate(texts), (10, f"p\n{passage}\nq"), (11, f"r\ns\n{passage}"), (12, f"{passage}\nt")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_bytes=80).collect()}
    assert [got[i] for i in range(3)] == texts and got[10] == f"p\n{passage}\nq" and got[11] == "r\ns" and got[12] == "t"
    alone = line_dedup.dedup_lines(docs, divisor=1_000_000_007, min_bytes=80).collect()  # every text is one chunk
    assert all(not r["chunks_cut"] for r in alone)


def test_every_later_pair_of_lines_goes(spark):
    docs = spark.createDataFrame([(1, "a\n}\n\nb\nc"), (2, "x\n}\n\ny"), (3, "b\nc\nq\n}\n\nb\nc")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, pairs=True).collect()}
    assert got == {1: "a\n}\n\nb\nc", 2: "x\ny", 3: "q"}


def test_the_query_of_line_dedup_keeps_no_short_runs(spark, tmp_path):
    from factloom.llm.queries import op5_line_dedup

    spark.createDataFrame([(1, "a\n}\n\nb"), (2, "x\n}\n\ny")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: (r["n_chunks_cut"], r["n_lines_cut"]) for r in op5_line_dedup(spark, str(tmp_path)).collect()} == {1: (0, 0), 2: (1, 2)}
