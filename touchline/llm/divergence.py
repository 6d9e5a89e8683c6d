"""How the sources of a language differ in their words, term by term and source by source.

A term is a run of letters (a to z after lower-casing A to Z only, and every
character beyond ASCII). A language keeps the V terms that at least `min_docs` of
its documents hold. A group (language and source, or the whole language) gives a
kept term p = 1 + floor(SCALE * (count + 1) / (N + V)), where N is the group's sum
of counts. f(p, q) = floor((p - q)^2 / q) adds up over all kept terms to the
distance of one source from another, and single values show which terms a source
has more of than its language. All arithmetic is on whole numbers.

Duplicate texts collapse before they are read: texts whose hash occurs once in
their language are split into terms where they lie; the others are grouped by
language and exact text with the number of copies in each source. Each different
text is split once and adds its counts and document frequencies by these weights.

Pairs are evaluated sparsely: with p0 the value of a term that a group lacks,
a pair's distance is V f(p0, q0) plus, for each term that either has, the
difference of f to that. Sources are cut into tiles and terms into blocks; a task
holds one block of terms for two tiles and emits one partial sum per pair.

Rows: null text, language and source are ''; texts without a term count for
nothing, but their group appears (in a language without a kept term all its pairs
have value 0); repeated rows count as often as they occur; a single source has no
pairs; an empty table gives an empty result; doc_id and other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import stored, table
from touchline.llm.copies import among, repeated, text_hash
from touchline.operators.skew import checked_broadcast

SCALE = 1_000_000_000
MIN_DOCS, TOP_TERMS = 3, 200
TILE = 64  # sources of a language in a tile
BLOCK_TERMS = 8192  # kept terms of a language in a block, about
HELD_TERMS = 300_000  # counters of a task before it emits them

#: Bytes of a term as they are counted; all others separate terms.
LETTERS = bytes(
    b + 32 if ord("A") <= b <= ord("Z") else b if b >= 0x80 or ord("a") <= b <= ord("z") else 32 for b in range(256)
)


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, raw (the bytes of a text) and sources (source and number of copies); the
    texts of a language whose hash repeats are rows of their own, once each."""
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    rows = docs.select(name("lang"), name("source"), name("text")).withColumn("hash", text_hash(F.col("text")))
    keys = ["lang", "hash"]
    found = repeated(rows.select(*keys), keys).drop("n_parts")
    one = F.array(F.struct("source", F.lit(1).cast("long").alias("n")))
    singles = among(rows, found, keys, "left_anti").select("lang", "text", one.alias("sources"))
    copies = among(rows, found, keys).groupBy("lang", "hash", "text", "source").agg(F.count("*").alias("n"))
    # At most one entry per source of the language; the result has a row per pair of them.
    merged = copies.groupBy("lang", "hash", "text").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    both = singles.unionByName(merged.select("lang", "text", "sources"))
    return both.select("lang", F.col("text").cast("binary").alias("raw"), "sources")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document frequencies per (lang, source, term), added up within the task."""
    counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def emitted() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms, frequency = list(own), docs[lang, source]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(terms), pa.string()),
                    "source": pa.array([source] * len(terms), pa.string()),
                    "term": pa.array(terms, pa.binary()).cast(pa.string()),
                    "n": pa.array(list(own.values()), pa.int64()),
                    "df": pa.array([frequency[t] for t in terms], pa.int64()),
                }
            )

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, raw in enumerate(batch.column(1)):
            words = raw.as_py().translate(LETTERS).split()
            different = set(words)
            for entry in sources[i]:
                key, n = (langs[i], entry["source"]), entry["n"]
                if n == 1:
                    counts[key].update(words)
                    docs[key].update(different)
                else:
                    counts[key].update({w: c * n for w, c in Counter(words).items()})
                    docs[key].update(dict.fromkeys(different, n))
                held += len(different)
            if held > HELD_TERMS:
                held = sum(map(len, counts.values()))
                if held > HELD_TERMS // 2:
                    yield from emitted()
                    counts.clear()
                    docs.clear()
                    held = 0
    yield from emitted()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total and by (source and count) of every kept term."""
    counted = collapsed(docs).mapInArrow(_count, "lang string, source string, term string, n long, df long")
    sums = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df")
    )
    terms = sums.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("by")
    )
    return terms.filter(F.col("df") >= min_docs).drop("df")


def smoothed(count: str, n: str, v: str) -> Column:
    """p, exact for any count: decimal arithmetic, rounded down once."""
    top = f"cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))"
    return F.when(F.col(v) > 0, F.expr(f"1 + cast(({top}) div cast({n} + {v} as decimal(20, 0)) as bigint)"))


def entries(terms: DataFrame) -> DataFrame:
    """One row per kept term and source that has it."""
    return terms.select("lang", "term", "total", F.explode("by").alias("_e")).select(
        "lang", "term", "total", F.col("_e.source").alias("source"), F.col("_e.n").alias("n")
    )


def group_table(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per (lang, source): its number i within the language, N, V, the language's
    N, and p0, the value of a term it lacks (null without kept terms)."""
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    sizes = entries(terms).groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("_v"), F.sum("total").alias("_all"))
    known = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    numbered = known.select(
        "lang", "source", F.coalesce("_n", zero).alias("n_own"), F.coalesce("_v", zero).alias("v"),
        F.coalesce("_all", zero).alias("n_lang"),
        (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("i"),
    )
    return numbered.withColumn("_none", zero).withColumn("p0", smoothed("_none", "n_own", "v")).drop("_none")


def _block_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of f over one block of terms for the sources of two tiles."""
    first = pdf.iloc[0]
    head = pdf["term"].isna().to_numpy()

    def side(number: int):
        rows = pdf[pdf["side"].isin((number, 2)).to_numpy() & head].sort_values("i")
        return rows["i"].to_numpy(), rows["p"].to_numpy(dtype="int64")

    (i_a, p0_a), (i_b, p0_b) = side(0), side(1)
    total = np.zeros((len(i_a), len(i_b)), dtype="int64")
    v = int(first["v"])
    if v > 0:
        body = pdf[~head]
        at, different = pd.factorize(body["term"])
        value, of, which = (body[c].to_numpy(dtype="int64") for c in ("p", "i", "side"))

        def dense(number: int, i: np.ndarray, p0: np.ndarray):
            rows = (which == number) | (which == 2)
            has = np.zeros((len(i), len(different)), dtype=bool)
            p = np.repeat(p0[:, None], len(different), axis=1)
            place = np.searchsorted(i, of[rows]), at[rows]
            has[place], p[place] = True, value[rows]
            return has, p

        (has_a, p_a), (has_b, p_b) = dense(0, i_a, p0_a), dense(1, i_b, p0_b)
        nothing = (p0_a[:, None] - p0_b[None, :]) ** 2 // p0_b[None, :]
        if first["block"] == 0:
            total += v * nothing
        for k in range(len(i_a)):
            t = np.flatnonzero(has_a[k])
            q = p_b[:, t]
            total[k] += ((p_a[k, t] - q) ** 2 // q).sum(axis=1) - len(t) * nothing[k]
        for k in range(len(i_b)):  # terms that only the second source has
            t = np.flatnonzero(has_b[k])
            q, absent = p_b[k, t], ~has_a[:, t]
            f = (p0_a[:, None] - q) ** 2 // q
            total[:, k] += np.where(absent, f, 0).sum(axis=1) - absent.sum(axis=1) * nothing[:, k]
    return pd.DataFrame(
        {
            "lang": first["lang"],
            "i": np.repeat(i_a, len(i_b)),
            "j": np.tile(i_b, len(i_a)),
            "value": total.ravel(),
        }
    )


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, i, j and value of every ordered pair of different sources of a language."""
    last = groups.groupBy("lang").agg(F.max("i").alias("_last"), F.max("v").alias("_v")).select(
        "lang", F.floor(F.col("_last") / TILE).cast("int").alias("_last_tile"),
        F.greatest(F.ceil(F.col("_v") / BLOCK_TERMS), F.lit(1)).cast("int").alias("_blocks"),
    )
    sized = stored(groups.join(last, "lang"))
    head = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block")).select(
        "lang", "block", "i", F.lit(None).cast("string").alias("term"), F.coalesce("p0", F.lit(0).cast("long")).alias("p"),
        "v", "_last_tile",
    )
    body = entries(terms).join(checked_broadcast(sized), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int").alias("block"), "i", "term",
        smoothed("n", "n_own", "v").alias("p"), "v", "_last_tile",
    )
    own = F.floor(F.col("i") / TILE).cast("int")
    place = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    others = F.filter(F.sequence(F.lit(0), F.col("_last_tile")), lambda t: t != own)
    places = F.concat(
        F.array(place(own, own, 2)),
        F.transform(others, lambda t: place(own, t, 0)),
        F.transform(others, lambda t: place(t, own, 1)),
    )
    sent = head.unionByName(body).withColumn("_p", F.explode(places)).select(
        "lang", "block", "_p.a", "_p.b", "_p.side", "i", "term", "p", "v"
    )
    sums = sent.groupBy("lang", "a", "b", "block").applyInPandas(_block_sums, "lang string, i int, j int, value long")
    return sums.filter("i <> j").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank; 'pair' holds every
    other source of the language, 'term' the `top` terms the source has more of."""
    terms = stored(kept_terms(docs, min_docs))
    groups = stored(group_table(docs, terms))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ("lang", "source", "part", "item", "value", "rank")

    name = lambda n, c: checked_broadcast(groups.select("lang", F.col("i").alias(n), F.col("source").alias(c)))
    named = pair_values(terms, groups).join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    pairs = named.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})

    known = entries(terms).join(checked_broadcast(groups), ["lang", "source"])
    valued = known.withColumns({"p": smoothed("n", "n_own", "v"), "q": smoothed("total", "n_lang", "v")})
    more = valued.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value")
    )
    ranked = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.select(*columns).unionByName(ranked.withColumn("part", F.lit("term")).select(*columns))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n_own FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + CAST({SCALE} AS hugeint) * (coalesce(c.n, 0) + 1) // (g.n_own + l.v) AS p,
             1 + CAST({SCALE} AS hugeint) * (k.total + 1) // (l.n_lang + l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS bigint) AS value, CAST(rank AS integer) AS rank
FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
