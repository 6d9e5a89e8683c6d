"""Quality gates over the documents, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import corpus, reuse
from touchline.plans.registry.common import rounded
from touchline.sources.derived import marked_documents, table, targets

N, TAU = 5, 0.8


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _facts(spark, sf_dir):
    """Customer names by key; some blank, some null."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('key', c_custkey) AS key",
        "CASE WHEN c_acctbal < 0 THEN '' WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS value",
    )


def _required(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("concat('key', o_custkey + 20) AS key")


def _targeted(spark, sf_dir):
    """Every document with one of all targets."""
    n = table(spark, sf_dir, "benchmark").count()
    return _docs(spark, sf_dir).withColumn("target_id", F.col("doc_id") % max(n, 1))


def _turns(spark, sf_dir, claims: bool):
    turns = table(spark, sf_dir, "conversations")
    return turns.filter((F.col("role") == "assistant") if claims else (F.col("role") != "assistant"))


QUERIES = {
    "placeholders": lambda s, d: corpus.placeholders(marked_documents(s, d)),
    "readiness": lambda s, d: corpus.readiness(marked_documents(s, d)),
    "length_band": lambda s, d: corpus.length_band(marked_documents(s, d)),
    "phrase_hits": lambda s, d: corpus.phrase_hits(_docs(s, d), ("license", "e-mail", "http", "the ", "password")),
    "evidence_density": lambda s, d: rounded(corpus.evidence_density(_docs(s, d))),
    "fact_gaps": lambda s, d: corpus.fact_gaps(_facts(s, d), _required(s, d)),
    "fill": lambda s, d: corpus.fill(marked_documents(s, d), _facts(s, d)),
    "term_containment": lambda s, d: rounded(corpus.term_containment(_targeted(s, d), targets(s, d))),
    "unsupported": lambda s, d: corpus.unsupported(_turns(s, d, True), _turns(s, d, False), "conv_id"),
    "copy_groups": lambda s, d: corpus.copy_groups(_docs(s, d), N),
    "near_duplicates": lambda s, d: rounded(corpus.near_duplicates(_docs(s, d), N, TAU)),
    "reuse_verdict": lambda s, d: corpus.reuse_verdict(_docs(s, d), N, TAU),
    "reuse_exists": lambda s, d: reuse.reuse_exists(_docs(s, d), N, TAU),
    "reuse_families": lambda s, d: reuse.families(_docs(s, d), N, TAU)[0],
}

_MARKED = r"""WITH marked AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('[FILL: key', doc_id % 5, '] ', text, ' [FILL: key', doc_id % 7, ']') ELSE text END AS text,
    CASE doc_id % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'motivation' ELSE 'job' END AS register, lang, source FROM documents),
found AS (SELECT *, regexp_extract_all(text, '\[FILL: ([^\]]*)\]', 1) AS marks FROM marked)"""


def _terms(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


_FACTS = """facts AS (SELECT concat('key', c_custkey) AS key,
  CASE WHEN c_acctbal < 0 THEN '' WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS value FROM customer)"""

_SHINGLES = f"""
WITH t AS (SELECT doc_id, {_terms("text")} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1),
        lambda i: array_to_string(list_slice(w, i, i + {N - 1}), ' ')))) AS sh FROM t WHERE len(w) > 0),
g AS (SELECT doc_id, sh, min(doc_id) OVER (PARTITION BY md5(array_to_string(sh, '|'))) AS rep_id FROM s)"""

_PAIRS = f"""
r AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM g WHERE doc_id = rep_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
  FROM r a JOIN r b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT * FROM p WHERE jaccard >= {TAU})"""

ORACLE = {
    "placeholders": f"""{_MARKED} SELECT doc_id, CAST(unnest(range(len(marks))) AS int) AS position, unnest(marks) AS marker FROM found""",
    "readiness": f"{_MARKED} SELECT doc_id, len(marks) AS n_markers, len(marks) = 0 AS ready FROM found",
    "length_band": rf"""{_MARKED},
      n AS (SELECT doc_id, register, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS int) AS n_words FROM marked),
      b(register, lo, hi) AS (VALUES ('cover', 320, 400), ('motivation', 500, 650), ('job', 220, 300))
      SELECT doc_id, register, n_words, CASE WHEN n_words < lo THEN 'short' WHEN n_words > hi THEN 'long' ELSE 'ok' END AS verdict,
        register = 'cover' AND n_words > 450 AS over_cap FROM n JOIN b USING (register)""",
    "phrase_hits": """WITH p(phrase) AS (VALUES ('license'), ('e-mail'), ('http'), ('the '), ('password'))
      SELECT doc_id, phrase FROM documents JOIN p ON contains(lower(text), phrase)""",
    "evidence_density": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
      k AS (SELECT doc_id, len(s) AS n_sentences, len(list_filter(s, lambda x: regexp_matches(x, '[0-9]'))) AS n_evident FROM s)
      SELECT doc_id, n_sentences, n_evident, CASE WHEN n_sentences > 0 THEN round(n_evident / n_sentences, 6) END AS density FROM k""",
    "fact_gaps": f"""WITH {_FACTS}, r AS (SELECT DISTINCT concat('key', o_custkey + 20) AS key FROM orders)
      SELECT r.key, CASE WHEN f.key IS NULL THEN 'missing' ELSE 'blank' END AS gap FROM r LEFT JOIN facts f USING (key)
      WHERE f.value IS NULL OR trim(f.value) = ''""",
    "fill": f"""{_MARKED}, {_FACTS},
      p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\[FILL: [^\\]]*\\]')) AS part, unnest(list_append(marks, NULL)) AS mark,
        unnest(range(len(marks) + 1)) AS i FROM found),
      v AS (SELECT p.*, f.value FROM p LEFT JOIN facts f ON f.key = p.mark AND trim(f.value) <> ''),
      j AS (SELECT doc_id, string_agg(part || coalesce(value, '[FILL: ' || mark || ']', ''), '' ORDER BY i) AS text,
        count(*) FILTER (mark IS NOT NULL AND value IS NULL) AS n_unresolved FROM v GROUP BY doc_id)
      SELECT doc_id, j.text, register, lang, source, n_unresolved FROM j JOIN found USING (doc_id)""",
    "term_containment": f"""WITH n AS (SELECT greatest(count(*), 1) AS n FROM benchmark), docs AS (SELECT *, doc_id % n AS target_id FROM documents, n),
      d AS (SELECT doc_id, target_id, unnest(list_distinct({_terms("text")})) AS term FROM docs),
      t AS (SELECT item_id AS target_id, unnest(list_distinct({_terms("text")})) AS term FROM benchmark),
      k AS (SELECT target_id, count(*) AS n_terms FROM t GROUP BY 1),
      h AS (SELECT doc_id, count(*) AS n_named FROM d JOIN t USING (target_id, term) GROUP BY 1)
      SELECT x.doc_id, x.target_id, k.n_terms, CASE WHEN k.n_terms > 0 THEN coalesce(h.n_named, 0) END AS n_named,
        round(coalesce(h.n_named, 0) / k.n_terms, 6) AS containment
      FROM docs x LEFT JOIN k USING (target_id) LEFT JOIN h ON h.doc_id = x.doc_id""",
    "unsupported": f"""SELECT DISTINCT conv_id, unnest({_terms("text")}) AS term FROM conversations WHERE role = 'assistant'
      EXCEPT SELECT conv_id, unnest({_terms("text")}) FROM conversations WHERE role <> 'assistant'""",
    "copy_groups": f"{_SHINGLES} SELECT doc_id, rep_id FROM t LEFT JOIN g USING (doc_id)",
    "near_duplicates": f"{_SHINGLES},{_PAIRS} SELECT doc_a, doc_b, round(jaccard, 6) AS jaccard FROM near",
    "reuse_exists": f"""{_SHINGLES},{_PAIRS},
      c AS (SELECT doc_id, rep_id, count(*) OVER (PARTITION BY rep_id) > 1 AS copied FROM g),
      e AS (SELECT DISTINCT unnest([doc_a, doc_b]) AS rep_id, true AS near FROM near)
      SELECT doc_id, coalesce(copied, false) OR coalesce(near, false) AS reusable FROM t LEFT JOIN c USING (doc_id) LEFT JOIN e USING (rep_id)""",
    "reuse_families": f"""{_SHINGLES.replace("WITH t AS", "WITH RECURSIVE t AS")},{_PAIRS},
      ways AS (SELECT doc_a AS a, doc_b AS b FROM near UNION ALL SELECT doc_b, doc_a FROM near),
      reach AS (SELECT DISTINCT rep_id AS node, rep_id AS root FROM g UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node),
      root AS (SELECT node AS rep_id, min(root) AS family_id FROM reach GROUP BY node)
      SELECT doc_id, family_id FROM t LEFT JOIN g USING (doc_id) LEFT JOIN root USING (rep_id)""",
    "reuse_verdict": f"""{_SHINGLES},{_PAIRS},
      c AS (SELECT doc_id, rep_id, count(*) OVER (PARTITION BY rep_id) - 1 AS n_copies FROM g),
      e AS (SELECT rep_id, count(*) AS n_near FROM (SELECT doc_a AS rep_id FROM near UNION ALL SELECT doc_b FROM near) GROUP BY 1)
      SELECT doc_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_near, 0) AS n_near,
        coalesce(n_copies, 0) > 0 OR coalesce(n_near, 0) > 0 AS reusable
      FROM t LEFT JOIN c USING (doc_id) LEFT JOIN e USING (rep_id)""",
}
