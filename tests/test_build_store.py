"""Builds, imports, chains, queues, vaults, pages and evidence against plain loops, on odd rows and through restarts."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import build, decisions, evidence_match, fold, mrz, ocr, passport, queues
from factloom.operators.hints import HINTS
from factloom.sources import ledger
from factloom.streaming import imports



def today():
    return F.lit("2024-06-15").cast("date")

CANDIDATE = "candidate_id string, entity_id long, document_id long, source_id long, fact_type string, raw_value string, normalized_value string, source_stage string, confidence double, metadata map<string,string>"


def decided(spark, rows):
    made = [(f"c{i}", 1, 2, 3, kind, value, value, stage, 0.8, meta) for i, (kind, value, stage, meta) in enumerate(rows)]
    found = decisions.decide(spark.createDataFrame(made, CANDIDATE), today()).collect()
    return [(r["field_name"], r["date_rule"] or r["field_rule"], r["reject_reason"]) for r in sorted(found, key=lambda r: int(r["candidate_id"][1:]))]


def test_decisions(spark):
    rows = [
        ("surname", "Mustermann", "mrz", None), ("date", "12.05.1984", "mrz", {"label": "Geburtsdatum"}), ("date", "12.05.1984", "mrz", {"context": "Gesetz, geboren am"}), ("date", "12.05.1984", "mrz", {"target_field": "date_of_birth", "context": "Gesetz"}),
        ("email", "info@firma.example", "mrz", None), ("full_name", "Sparkasse Nord", "mrz", None), ("review_candidate", "x-ray 12", "mrz", None), ("nationality", "DEUTSCH", "llm_structured", {"role": "document_label"}), (None, None, None, None),
        ("hobby", "Schach spielen", "ocr", {"is_person_fact": "false"}), ("hobby", "Schach spielen", "ocr", {"section": "Anlage 3"}), ("expiry_date", "01.01.2030", "ocr", {}), ("hobby", "01.01.2030", "ocr", {}), ("address", "Am Ring 5, 99817 Ort", "ocr", None), ("address", "irgendwo", "ocr", None),
    ]
    got = decided(spark, rows)
    assert got[0] == ("surname", "own", None)
    assert got[1] == ("date_of_birth", "near_birth", "evidence_type") and got[2][:2] == ("legal_reference_date", "near_legal") and got[3][:2] == ("date_of_birth", "named")
    assert got[4] == ("contact_email", "contact_email", "evidence_field") and got[5][0] == "organization_name"
    assert got[6][2] == "review_type" and got[7] == ("nationality", "own", None)  # a model's value of a reviewed type is kept before roles count
    assert got[8] == ("", "own", "label") and got[9] == ("hobby", "own", "not_of_person") and got[10] == ("form_instruction", "form", "evidence_field")
    assert got[11][:2] == ("expiry_date", "called_expiry_date") and got[12][:2] == ("expiry_date", "far_ahead") and got[13] == ("address", "own", None) and got[14] == ("address", "own", "address")
    assert decisions.decide(spark.createDataFrame([], CANDIDATE), today()).count() == 0


def test_hints_are_all_found(spark):
    """One pass finds the same families as looking for every word."""
    r = random.Random(4)
    words = [w for ws in HINTS.values() for w in ws]
    texts = ["", "zzz", *(w.lower() for w in words), *("".join(r.choice([w.lower(), " ", w.lower()[: len(w) // 2], "x"]) for w in r.choices(words, k=4)) for _ in range(200))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decisions.hint_bits(F.col("t")).alias("b")).collect()
    for row in got:
        assert row["b"] == sum(1 << n for n, f in enumerate(HINTS) if any(w.lower() in texts[row["i"]] for w in HINTS[f])), texts[row["i"]]


def test_a_batch_built_twice_changes_nothing(spark, tmp_path):
    rows = [(f"c{i}", i % 2, i, 3, "surname", v, v, "ocr_regex", 0.7, None) for i, v in enumerate(["Mustermann", "Sommer", "Winter", "", None])]
    found = decisions.decide(spark.createDataFrame([*rows, rows[0]], CANDIDATE), today())
    root = f"file://{tmp_path}/store"
    assert build.build_batch(found, F.lit("2024-06-15").cast("timestamp"), root, "b1")
    shapes = {"facts": "fact_id string, field_name string", "evidence": "evidence_id string", "links": "fact_id string, evidence_id string, role string", "provenance": "fact_id string, summary string", "conflict_facts": "conflict_id string, fact_id string"}
    tables = lambda: {n: sorted(map(repr, ledger.read_table(spark, root, n, s).collect())) for n, s in shapes.items()}
    first = tables()
    assert [len(first[n]) for n in shapes] == [4, 6, 4, 4, 3] and "OCR" not in repr(first["facts"])
    assert not build.build_batch(found, F.lit("2030-01-01").cast("timestamp"), root, "b1") and tables() == first
    # a try that died before its ledger entry doesn't show, and the next one replaces it
    build.build(found, F.current_timestamp())["facts"].write.parquet(f"{root}/facts/batch=b2")
    assert tables() == first
    assert build.build_batch(found, F.current_timestamp(), root, "b2") and len(tables()["facts"]) == 8


def test_candidates_are_clamped_and_keep_valid_spans(spark):
    shape = "document_id string, fact_type string, raw_value string, normalized_value string, confidence double, span_ids array<string>"
    rows = [("DOC-Ab12", "iban", "x", "x", 1.7, None), ("DOC-Ab12", "iban", "x", "y", 0.4, None), ("d", "iban", "x", "x", -1.0, ["0" * 32, "no"]), ("d", "", "x", "x", 1.0, []), ("d", "iban", "x", " ", 1.0, []), ("d", "bic", "x", "x", None, [])]
    got = {(r["document_id"], r["fact_type"]): r for r in build.candidates(spark.createDataFrame(rows, shape)).collect()}
    assert len(got) == 3 and got["DOC-Ab12", "iban"]["confidence"] == 1.0 and got["DOC-Ab12", "iban"]["span_ids"] == ["dcab12".ljust(32, "0")]
    assert got["d", "iban"]["confidence"] == 0.0 and got["d", "iban"]["span_ids"] == ["0" * 32] and got["d", "bic"]["confidence"] == 0.0


def test_import_goes_on_after_a_restart(spark, tmp_path):
    inbox, root, mark = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/mark"

    def put(entity, name, body):
        (inbox / entity).mkdir(parents=True, exist_ok=True)
        (inbox / entity / name).write_bytes(body)

    def run():
        imports.import_stream(spark, f"file://{inbox}", root, mark).awaitTermination()
        read = lambda n, s: ledger.read_table(spark, root, n, s)
        return sorted((r["entity_id"], os.path.basename(r["path"])) for r in read("documents", imports.STORED).collect()), sorted((os.path.basename(r["path"]), r["reason"]) for r in read("rejected", imports.REJECTED).collect())

    for entity, name, body in (("e1", "a.pdf", b"one"), ("e1", "b.PDF", b"one"), ("e2", "a.pdf", b"one"), ("e1", "c.exe", b"two"), ("e1", "d.png", b"")):
        put(entity, name, body)
    assert run() == ([("e1", "a.pdf"), ("e2", "a.pdf")], [("b.PDF", "twice"), ("c.exe", "extension")])
    put("e1", "e.txt.json", b"three")
    put("e1", "f.pdf", b"one")
    after = run()
    assert after == ([("e1", "a.pdf"), ("e1", "e.txt.json"), ("e2", "a.pdf")], [("b.PDF", "twice"), ("c.exe", "extension"), ("f.pdf", "stored")])
    assert run() == after


def chain_of(rows):
    out, last = {}, {}
    for s, n, own in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        before = last.get(s)
        last[s] = hashlib.sha256(((before or "") + (own or "")).encode()).hexdigest()
        out[s, n] = (before, last[s])
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_hash_chain_over_ranges(spark, ranges):
    r = random.Random(6)
    rows = [("hot" if i % 3 else r.choice(["a", "b", "zz", None]), i, None if i == 50 else f"{i:064x}") for i in range(400)]
    frame = spark.createDataFrame([(*x, "more") for x in rows], "s string, n int, own string, entry_hash_of string").repartition(5)
    want = chain_of(rows)
    got = fold.hash_chain(frame, "s", ["n"], "own", ranges).collect()
    assert {(x["s"], x["n"]): (x["previous_hash"], x["entry_hash"]) for x in got} == want and len(got) == len(rows)
    stored = spark.createDataFrame([(s, n, "changed" if n == 200 else own, want[s, n][1]) for s, n, own in rows], "s string, n int, own string, stored string")
    hit = next(s for s, n, _ in rows if n == 200)
    for x in fold.broken_chains(stored, "s", ["n"], "own", "stored", ranges).collect():
        later = sum(s == x["s"] and n >= 200 for s, n, _ in rows) if x["s"] == hit else 0
        assert (x["n_bad"], x["first_bad"]) == (later, 200 if later else None)
    assert fold.hash_chain(frame.where("false"), "s", ["n"], "own", ranges).count() == 0


def test_compact_json(spark):
    rows = [("a", "plain", 1, True), ("ä\"\\", "x\n\t\x01\x7f😀", None, False), (None, "", -5, None)]
    frame = spark.createDataFrame(rows, "b string, a string, n long, t boolean")
    got = [r["j"] for r in frame.select(fold.compact_json({k: F.col(k) for k in ("b", "a", "n", "t")}).alias("j")).collect()]
    assert got == [json.dumps(dict(zip(("b", "a", "n", "t"), r)), sort_keys=True, separators=(",", ":")) for r in rows]


EVENT = "job_id long, moment long, event_id long, action string, delay long"


def job_events():
    r = random.Random(9)
    kinds = ["enqueue", "lease", "requeue", "complete", "expire", "cancel", "fail", "lease", "odd"]
    return [(r.randrange(12), t, t, "enqueue" if t < 12 else r.choice(kinds), r.choice([None, 0, 5, 60])) for t in range(240)]


def states_of(events):
    jobs = {}
    for job, t, _, action, delay in sorted(events, key=lambda e: (e[1], e[2])):
        queues.job_step(jobs.setdefault(job, {}), {"moment": t, "action": action, "delay": delay})
    return {j: (s.get("status"), s.get("available_at"), s.get("retries")) for j, s in jobs.items()}


def test_job_step_by_step():
    job = {}
    does = lambda action, t, delay=None: queues.job_step(job, {"moment": t, "action": action, "delay": delay})
    assert not does("lease", 0)["applied"] and does("enqueue", 1)["status"] == "pending" and not does("enqueue", 2)["applied"] and not does("complete", 2)["applied"]
    assert does("lease", 2)["status"] == "leased" and not does("lease", 3)["applied"] and not does("expire", 3, 10)["applied"] and does("expire", 12, 10)["status"] == "pending"
    assert does("lease", 13)["applied"] and does("requeue", 14, 10)["available_at"] == 24 and not does("lease", 23)["applied"] and does("lease", 24)["applied"] and does("complete", 25)["retries"] == 1
    assert not does("lease", 26)["applied"] and does("cancel", 27)["status"] == "cancelled"


def test_queue_as_table_and_as_stream_through_a_restart(spark, tmp_path):
    events, parts = job_events(), 3
    now = queues.jobs_now(queues.job_history(spark.createDataFrame(events, EVENT).repartition(3))).collect()
    assert {r["job_id"]: (r["status"], r["available_at"], r["retries"]) for r in now} == states_of(events)
    inbox, found = tmp_path / "in", {}

    def keep(rows, _):
        found.update({r["job_id"]: (r["status"], r["available_at"], r["retries"]) for r in rows.collect()})

    for n in range(parts):  # each round is a query of its own that starts from the checkpoint
        spark.createDataFrame(events[80 * n : 80 * n + 80], EVENT).coalesce(1).write.mode("append").parquet(f"file://{inbox}")
        stream = queues.job_stream(spark.readStream.schema(EVENT).parquet(f"file://{inbox}"))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
        assert found == states_of(events[: 80 * n + 80])


def test_vault_versions(spark):
    ops = [("add_entity", None, None), ("add_entity", None, None), ("update_profile", None, "p1"), ("remove_entity", None, None), ("register_conflict", "c1", None), ("register_conflict", "c1", None), ("resolve_conflict", "c1", None), ("dismiss_conflict", "c1", None), ("remove_profile", None, None), ("remove_entity", None, None), ("odd", None, None)]
    rows = [(1, 7, i, op, c, v) for i, (op, c, v) in enumerate(ops)] + [(1, 8, 20, "update_profile", None, "x"), (1, 9, 21, "add_entity", None, None), (1, 9, 22, "remove_entity", None, None)]
    history = queues.vault_history(spark.createDataFrame(rows, "vault_id int, entity_id int, seq int, op string, conflict_id string, value string")).cache()
    assert [r["reason"] for r in history.orderBy("seq").collect()] == [None, "exists", None, "has_profile", None, "registered", None, "not_open", None, "has_conflicts", "unknown", "no_entity", None, None]
    seen = lambda seq: [tuple(r) for r in queues.vault_at(history, seq).collect()]
    assert seen(3) == [(1, 7, "p1", 0, 0, 2)] and seen(5) == [(1, 7, "p1", 1, 1, 4)] and seen(30) == [(1, 7, None, 1, 0, 8)]


def test_containment_without_pairs_of_all(spark):
    r = random.Random(2)
    words = ["alpha", "beta 12", "Gamma", "ab", "abc", "alpha beta 12 gamma", "", None, "delta;", " Delta "]
    items = [(d, i, r.sample(words, 2)) for d in range(6) for i in range(8)]
    known = [(d, i, i, r.sample(words, 2), bool(i % 2)) for d in range(5) for i in range(3)]
    a, b = spark.createDataFrame(items, "doc_id int, item_id int, texts array<string>"), spark.createDataFrame(known, "doc_id int, candidate_id int, ord int, texts array<string>, has_spans boolean")
    clean = lambda t: " ".join((t or "").lower().split()).strip(" \t\r\n:;,.|")

    def meets(s, c):
        return bool(s and c) and (s == c or (len(s) >= 4 and s in c) or (len(c) >= 4 and c in s))

    want = {}
    for d, i, texts in items:
        own = [k for k in known if k[0] == d]
        hit = next((k for k in own if any(meets(clean(s), clean(c)) for s in texts for c in k[3])), None)
        want[d, i] = (hit[1], "match") if hit else next(((k[1], "fallback") for k in own if k[4]), (None, None))
    found = evidence_match.match_evidence(a, b)
    assert {(x["doc_id"], x["item_id"]): (x["candidate_id"], x["how"]) for x in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tables_from_boxes(spark):
    boxes = [(1, 1, 0.0, 0.0, 10.0, 5.0, "a", 0.9), (1, 1, 20.0, 1.0, 10.0, 5.0, "b", 0.7), (1, 1, 0.0, 10.0, 5.0, 5.0, "c", 0.5), (1, 1, 6.0, 11.0, 3.0, 4.0, "d", 0.4), (1, 1, 21.0, 30.0, 5.0, 5.0, None, 0.3), (2, 1, None, 0.0, 1.0, 1.0, "x", 1.0)]
    frame = spark.createDataFrame(boxes, "doc_id int, page int, x double, y double, width double, height double, text string, confidence double")
    cells = ocr.table_cells(frame)
    assert sorted((r["row"], r["col"], r["text"], r["confidence"]) for r in cells.collect()) == [(0, 0, "a", 0.9), (0, 1, "b", 0.7), (1, 0, "c d", 0.45), (2, 1, "", 0.3)]
    stats = ocr.table_stats(cells).first()
    assert (stats["n_rows"], stats["n_columns"], stats["n_cells"], stats["mean_confidence"], stats["sure"], stats["poor"]) == (3, 2, 4, 0.5167, False, False)
    wanted = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 9, 9)], "doc_id int, page int, row int, col int")
    assert sorted((r["row"], r["text"]) for r in ocr.cell_at(cells, wanted).collect()) == [(0, "b"), (9, None)]


PASSPORT = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def test_zones_with_bad_characters(spark):
    texts = {"good": PASSPORT, "short": "\n".join(x[:-1] for x in PASSPORT.split("\n")), "letters": PASSPORT.replace("7408122", "74O8I22"), "number": PASSPORT.replace("L898902C3", "L8989O2C3"), "two_ways": PASSPORT.replace("L898902C3", "LB98902C3"), "lost": PASSPORT[:60], "spaced": PASSPORT.replace("<", " <").lower(), "card": "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6", "none": "", "null": None}
    frame = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r["k"]: r["z"] for r in frame.select("k", mrz.read_text(F.col("t")).alias("z")).collect()}
    assert got["good"]["status"] == "VALID" and got["good"]["kind"] == "TD3" and got["good"]["given_names"] == "ANNA MARIA" and got["spaced"]["status"] == "VALID"
    assert got["short"]["kind"] == "TD3" and got["short"]["confidence"] == 0.8 and got["short"]["status"] == "PARTIAL"
    assert got["letters"]["date_of_birth"] == "740812" and got["number"]["number_repaired"] == "L898902C3" and got["good"]["number_repaired"] is None and got["two_ways"]["number_repaired"] is None
    assert got["card"]["kind"] == "TD2" and got["card"]["status"] == "VALID" and got["lost"] is None and got["none"] is None and got["null"] is None


def test_passport_stages(spark):
    text = "REISEPASS\nSurname: Other.\nPlace of birth: Berlin.\nAusstellende Behörde: Stadt Residence\n" + PASSPORT
    frame = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "am 5.6.2021 in Köln"), (5, text)], "doc_id int, text string")
    rows = passport.passport_facts(frame, F.lit("2010-01-01").cast("date")).collect()
    facts = {(r["doc_id"], r["fact_type"]): (r["value"], r["confidence"], r["source"]) for r in rows if r["fact_type"] != "document_label"}
    assert facts[1, "surname"] == ("ERIKSSON", 0.95, "mrz") and facts[1, "place_of_birth"] == ("Berlin", 0.76, "ocr_label_value") and facts[1, "review_candidate"] == ("issuing_authority", 0.32, "ocr_label_value")
    assert facts[1, "document_keyword"] == ("REISEPASS", 0.45, "ocr_fallback") and facts[1, "date_of_birth"][0] == "1974-08-12" and facts[4, "possible_date"][0] == "2021-06-05" and facts[4, "possible_location"][0] == "Köln"
    assert not [k for k in facts if k[0] in (2, 3)] and {k[1]: v for k, v in facts.items() if k[0] == 1} == {k[1]: v for k, v in facts.items() if k[0] == 5}
