"""Queries opN_<name> over the whole tables, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import fim, fingerprint, langid, lattice, lexical, licenses, line_dedup, minhash, mixing, mtree, packing, pieces, suffix_dedup
from factloom.llm.common import load
from factloom.sources.tables import spread


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), size=2, threshold=80)


#: In the pipeline a repeated run of lines goes if it has this many bytes that are no white space.
LEAST_INK = 80
#: Targets of the mix: weights of domains and languages; sources of a leaf count alike.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def mix_levels() -> dict:
    """Domain (the source's number modulo 4), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]+)$", 1)
    domain = F.concat(F.lit("d"), F.when(number == "", 0).otherwise(F.substring(number, -4, 4).try_cast("int") % 4).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.classify(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.margin", "p.rejected")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))
    places = F.col("base_places")
    return found.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op4_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out(F.col("doc_id"), 5, 1)
    found = lattice.score(docs, ~held, tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score", "mean_mixed")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_substrings(load(spark, sf_dir, "documents"), length=400, keep_first=False)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage_starts")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs, pairs=True)
    cut_lines = F.aggregate("chunks_cut", F.lit(0).cast("long"), lambda n, c: n + c["n_lines"])
    return found.select("doc_id", F.size("chunks_cut").cast("long").alias("n_chunks_cut"), cut_lines.alias("n_lines_cut"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=0.75, max_epochs=3, seed=7)
    return found.select("doc_id", "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_take").alias("taken"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_neighbours(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path("word_bpe_49k.json"), cache_size=150_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op9_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", mtree.quantise(F.col("embedding")).alias("vector"))
    return mtree.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", pieces.round_trip(F.col("text"), path).alias("found")).select("doc_id", "found.ids", F.col("found.text").alias("decoded"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.rank(docs, load(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), c AS (
  SELECT count(*) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d WHERE len(terms) > 0
), p AS (
  SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_all
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h FROM documents
), k AS (
  SELECT *, len(units) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS k FROM d
), c AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain'
      WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.vector) = len(q.vector)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP3_SQL = """
WITH templates(t, label, txt, k) AS (VALUES
%s
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), tw AS (
  SELECT t, unnest(string_split(txt, ' ')) AS w, unnest(range(len(string_split(txt, ' ')))) AS p FROM templates
), df AS (
  SELECT w, count(*) AS n FROM (SELECT DISTINCT w FROM tw)
  JOIN (SELECT doc_id, unnest(list_distinct(words)) AS w FROM d) USING (w) GROUP BY w
), rare AS (
  SELECT * FROM (
    SELECT t, w, min(p) AS p, row_number() OVER (PARTITION BY t ORDER BY coalesce(any_value(n), 0), w) AS r
    FROM tw LEFT JOIN df USING (w) GROUP BY t, w) WHERE r <= 2
), dw AS (
  SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM d
), starts AS (
  SELECT doc_id, t, i - p AS s FROM dw JOIN rare USING (w) GROUP BY doc_id, t, i - p
  HAVING count(*) = (SELECT max(r) FROM rare x WHERE x.t = rare.t)
), counted AS (
  SELECT s.doc_id, s.t, s.s, count(*) AS size, count(*) FILTER (d.words[s.s + p + 1] = w AND s.s + p >= 0) AS same,
    bool_and(d.words[s.s + p + 1] = w AND s.s + p >= 0) FILTER (p >= ka AND p < ka + kn) AS keyed
  FROM starts s JOIN d USING (doc_id) JOIN tw USING (t)
  JOIN (SELECT t, len(string_split(rtrim(split_part(' ' || txt || ' ', ' ' || k || ' ', 1)), ' ')) - 1 AS ka, len(string_split(k, ' ')) AS kn FROM templates) USING (t)
  GROUP BY ALL
), m AS (
  SELECT *, label FROM counted JOIN templates USING (t) WHERE keyed AND same * 5 >= size * 4
), a AS (
  SELECT doc_id, count(*) FILTER (t < 4) AS n_base, min(s) FILTER (t < 4) AS first_word, max(s) FILTER (t < 4) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < 4) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(same / size) AS score
  FROM m GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (doc_id)
""" % ",\n".join(f"({n}, '{t.label}', '{t.words}', '{t.key}')" for n, t in enumerate([*licenses.BASE, *licenses.NOTICES]))

OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), p AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS again FROM p WHERE after IS NOT NULL
), c AS (
  SELECT l.*, coalesce(a.again, false) OR coalesce(b.again, false) AS cut FROM l
  LEFT JOIN r a ON a.doc_id = l.doc_id AND a.i = l.i LEFT JOIN r b ON b.doc_id = l.doc_id AND b.i = l.i - 1
), e AS (
  SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c
), s AS (
  SELECT doc_id, count(*) FILTER (begins) AS n_chunks_cut, count(*) FILTER (cut) AS n_lines_cut,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '')) AS kept_sha256
  FROM e GROUP BY doc_id
)
SELECT doc_id, coalesce(n_chunks_cut, 0) AS n_chunks_cut, coalesce(n_lines_cut, 0) AS n_lines_cut, kept_sha256
FROM documents LEFT JOIN s USING (doc_id)
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, text, lang, source, coalesce(source, '(null)') AS s, coalesce(lang, '(null)') AS l,
    'd' || coalesce(TRY_CAST(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 4) AS INT) % 4, 0) AS dom,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS n
  FROM documents
), leaves AS (
  SELECT dom, l, s, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * 3 AS BIGINT) AS capacity FROM d GROUP BY ALL
), root AS (SELECT CAST(floor(sum(tokens) * CAST(0.75 AS DOUBLE)) AS BIGINT) AS budget FROM leaves),
n1 AS (
  SELECT *, CAST(CASE dom WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS DOUBLE) AS w FROM (SELECT dom, sum(capacity) AS capacity FROM leaves GROUP BY dom), root
), b1 AS (
  SELECT dom, CAST(least(capacity, floor(w * max(CAST(budget - before AS DOUBLE) / weights) OVER ())) AS BIGINT) AS budget FROM (
    SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n1 WINDOW o AS (ORDER BY capacity / w, w, dom))
), n2 AS (
  SELECT *, CAST(CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM (SELECT dom, l, sum(capacity) AS capacity FROM leaves GROUP BY dom, l) JOIN b1 USING (dom)
), b2 AS (
  SELECT dom, l, CAST(least(capacity, floor(w * max(CAST(budget - before AS DOUBLE) / weights) OVER (PARTITION BY dom))) AS BIGINT) AS budget FROM (
    SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n2 WINDOW o AS (PARTITION BY dom ORDER BY capacity / w, w, l))
), n3 AS (
  SELECT leaves.*, b2.budget, CAST(1 AS DOUBLE) AS w FROM leaves JOIN b2 USING (dom, l)
), b3 AS (
  SELECT dom, l, s, tokens, CAST(least(capacity, floor(w * max(CAST(budget - before AS DOUBLE) / weights) OVER (PARTITION BY dom, l))) AS BIGINT) AS budget FROM (
    SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n3 WINDOW o AS (PARTITION BY dom, l ORDER BY capacity / w, w, s))
), p AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // greatest(tokens, 1) ELSE 0 END AS whole FROM b3
), o AS (
  SELECT d.*, whole, budget - whole * tokens AS rest, sum(n) OVER (PARTITION BY dom, l, s ORDER BY md5('7|' || whole || '|' || doc_id), text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before
  FROM d JOIN p USING (dom, l, s)
)
SELECT doc_id, lang, source, CAST(unnest(range(whole)) AS INTEGER) AS epoch, n AS n_tokens, n AS taken FROM o
UNION ALL
SELECT doc_id, lang, source, CAST(whole AS INTEGER) AS epoch, n AS n_tokens, CAST(least(n, rest - before) AS BIGINT) AS taken FROM o WHERE before < rest
"""

OP1_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), both_sets AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL
), links AS (
  SELECT u, v FROM both_sets WHERE 100 * c >= 80 * (nu + nv - c)
), two AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
r AS (
  WITH RECURSIVE x(node, seen) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT x.node, two.v FROM x JOIN two ON two.u = x.seen
  ) SELECT node, min(seen) AS component_id FROM x GROUP BY node
)
SELECT s.doc_id, len(s) AS n_shingles, component_id, component_id = s.doc_id AS kept FROM s JOIN r ON r.node = s.doc_id
"""

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op8_mixing": op8_mixing,
    "op4_lattice_scores": op4_lattice_scores,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op9_mtree_top_k": op9_mtree_top_k,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_lexical_search": op12_lexical_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {"op1_minhash_near_dedup": OP1_SQL, "op3_license_scan": OP3_SQL, "op5_line_dedup": OP5_SQL, "op8_mixing": OP8_SQL, "op9_mtree_top_k": OP9_SQL, "op12_lexical_search": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
