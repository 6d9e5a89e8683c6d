"""Quality rules whose cutoffs carry a guarantee: at most a stated share of good documents is lost.

Base rules reject texts that are too short or repeat themselves. Beyond them,
each rule rejects what exceeds a cutoff of one measure. A cutoff is used only if
labelled documents prove it harmless: of the n good ones of a stratum (a
language) that pass the base rules it rejects k, and the exact binomial
probability of so few rejections, were the true rate `alpha / rules` or more, is
at most `delta / tests`. `tests` counts every stratum, rule and cutoff looked at
(Bonferroni), so with probability 1 - delta no stratum loses more than `alpha` of
its good documents to all its rules together, whichever certified cutoffs are
taken. Of these, the one with the best balance of bad and good rejections is used,
and none if the balance is not positive. A stratum with too few labels certifies
nothing and keeps what passes the base rules.

DataFrame functions only. A text is measured inside its own row.

Rows: null text has no words; null or missing strata form one stratum; labels
without a quality are left out and repeated ones count once (the lower quality);
repeated documents are judged each; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import WORD_BREAK, stored, table
from touchline.operators.skew import checked_broadcast

WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more."""

    def spread(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
        twice = F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1))
        return bind(F.sort_array(F.transform(twice, lambda p: p["i"])), spread)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(unique, F.lit(0)).otherwise(bind(pairs, repeated))


def _word_counts(words: Column) -> Column:
    n = F.size(words)
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window))
    repeated = F.when(n >= WINDOW, bind(hashes, _covered)).otherwise(F.lit(0))
    return F.struct(n.cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))


def _line_counts(lines: Column) -> Column:
    filled = F.filter(lines, lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return bind(
        filled,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )


def measure(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The kept columns, the counts and base_failed of every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    rows = docs.select(
        *keep,
        bind(words, _word_counts).alias("_w"),
        bind(F.split(text, "\n"), _line_counts).alias("_l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    out = rows.select(
        *[rows[i] for i in range(len(keep))], "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines",
        "_w.n_repeat_words", "_l.n_lines",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def percent(part: str, whole: str) -> Column:
    """Whole percents, rounded down; 0 of nothing is 0."""
    return F.floor(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects what exceeds a cutoff; the cutoffs are fixed beforehand, not taken from the data."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]

    def value(self) -> Column:
        return percent(self.part, self.whole)


RULES = (
    Rule("symbols", "n_symbols", "n_words", (5, 10, 15, 20, 30, 50, 75, 100, 150, 200)),
    Rule("repeats", "n_repeat_words", "n_words", (2, 4, 6, 8, 10, 15)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (10, 20, 30, 50, 75)),
    Rule("long_words", "word_chars", "n_words", (800, 1000, 1200, 1500, 2000)),
)


@dataclass(frozen=True)
class Risk:
    """alpha: share of good documents that a stratum may lose; delta: chance that any
    stratum loses more; price: how many bad rejections, as a share, a good one outweighs."""

    alpha: float = 0.05
    delta: float = 0.05
    price: int = 5
    rules: tuple[Rule, ...] = field(default=RULES)


def log_factorial(n: Column) -> Column:
    """Exact up to 20!, then Stirling's series, whose error is below double precision there."""
    x = n.cast("double") + 1
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    stirling = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + series
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable, for k up to n p; 1 above, where nothing is certified.

    The terms are summed from k downwards. They fall faster and faster; those left
    out, beyond ten standard deviations, are below double precision.
    """
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    top = top + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k.cast("double"), F.ceil(10 * F.sqrt(n * F.lit(p))) + 100).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, j: Column) -> Column:
        i = (k - j + 1).cast("double")
        term = state["term"] * i / (n.cast("double") - i + 1) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, add, lambda state: state["total"])
    return F.when(k <= n * F.lit(p), F.least(F.exp(top) * total, F.lit(1.0))).otherwise(F.lit(1.0))


def trials(measured: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """Per stratum, rule and cutoff: labelled good and bad documents, and how many it rejects."""
    known = labels.filter(labels["quality"].isin(0, 1) & labels["doc_id"].isNotNull())
    known = known.groupBy(known["doc_id"].cast("long").alias("_id")).agg(F.min("quality").alias("_good"))
    labelled = measured.filter(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id"))
    tried = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(c).alias("cutoff"), (r.value() > c).alias("rejects"))
        for r in risk.rules
        for c in r.cutoffs
    ]
    rows = labelled.select("stratum", "_good", F.explode(F.array(*tried)).alias("t"))
    count = lambda good, hit: F.count_if((F.col("_good") == good) & hit)
    every, hit = F.lit(True), F.col("t.rejects")
    return rows.groupBy("stratum", "t.rule", "t.cutoff").agg(
        count(1, every).alias("good"), count(0, every).alias("bad"),
        count(1, hit).alias("good_rejected"), count(0, hit).alias("bad_rejected"),
    )


def certified(tried: DataFrame, risk: Risk) -> DataFrame:
    """One row per stratum and rule with a certified, useful cutoff."""
    tests = max(tried.count(), 1)
    p = at_most(F.col("good_rejected"), F.col("good"), risk.alpha / len(risk.rules))
    gain = F.col("bad_rejected") * F.col("good") - risk.price * F.col("good_rejected") * F.col("bad")
    sure = tried.filter(p <= risk.delta / tests)
    best = W.partitionBy("stratum", "rule").orderBy(F.desc("_gain"), F.desc("cutoff"))
    useful = sure.withColumn("_gain", gain).filter("_gain > 0")
    return useful.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("stratum", "rule", "cutoff")


def thresholds(measured: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """Wide table: `_stratum` and a cutoff `_cut_<rule>` per rule, null where none is certified."""
    risk = risk or Risk()
    chosen = certified(stored(trials(measured, labels, risk)), risk)
    cut = [F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_cut_{r.name}") for r in risk.rules]
    return stored(chosen.groupBy(F.col("stratum").alias("_stratum")).agg(*cut))


def judge(measured: DataFrame, cutoffs: DataFrame, risk: Risk | None = None) -> DataFrame:
    """Add `kept`."""
    risk = risk or Risk()
    rejected = F.lit(False)
    for r in risk.rules:
        rejected = rejected | F.coalesce(r.value() > F.col(f"_cut_{r.name}"), F.lit(False))
    joined = measured.join(checked_broadcast(cutoffs), F.col("stratum") == F.col("_stratum"), "left")
    dropped = ["_stratum", *[f"_cut_{r.name}" for r in risk.rules]]
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*dropped)


def stratum_of(docs: DataFrame, name: str = "lang") -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit("")) if name in docs.columns else F.lit("")


def quality(docs: DataFrame, labels: DataFrame, risk: Risk | None = None, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    keys = [docs["doc_id"].cast("long").alias("doc_id"), stratum_of(docs, stratum).alias("stratum")]
    measured = stored(measure(docs, keys))
    return judge(measured, thresholds(measured, labels, risk), risk).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk | None = None, stratum: str = "lang") -> DataFrame:
    """The kept documents with all their columns. The texts are measured again where
    they lie instead of being shuffled to their verdicts."""
    keys = [docs["doc_id"].cast("long").alias("doc_id"), stratum_of(docs, stratum).alias("stratum")]
    cutoffs = thresholds(stored(measure(docs, keys)), labels, risk)
    whole = [F.struct(*docs.columns).alias("_row"), stratum_of(docs, stratum).alias("stratum")]
    return judge(measure(docs, whole), cutoffs, risk).filter("kept").select("_row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _cutoff_values() -> str:
    return ", ".join(f"('{r.name}', {c})" for r in RULES for c in r.cutoffs)


_VALUE = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN 100 * {r.part} // greatest({r.whole}, 1)" for r in RULES) + " END"
_RISK = Risk()

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text
           FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS s
        FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY rid),
f AS (SELECT rid, doc_id, stratum, CAST(len(ws) AS bigint) AS n_words,
             CAST(length(array_to_string(ws, '')) AS bigint) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS bigint) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS bigint) AS n_repeat_words, CAST(len(ls) AS bigint) AS n_lines
      FROM w LEFT JOIN cov USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM f),
c(rule, cutoff) AS (VALUES {_cutoff_values()}),
t AS (SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad,
             count(*) FILTER (quality = 1 AND {_VALUE} > cutoff) AS gr,
             count(*) FILTER (quality = 0 AND {_VALUE} > cutoff) AS br
      FROM m JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id)
        USING (doc_id), c
      WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, {_RISK.alpha / len(RULES)!r} AS a,
             br * good - {_RISK.price} * gr * bad AS gain, {_RISK.delta} / count(*) OVER () AS level FROM t),
s AS (SELECT *, list_sum(list_transform(range(0, gr + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1)
             - lgamma(good - i + 1) + i * ln(a) + (good - i) * ln(1 - a)))) AS tail
      FROM p WHERE gr <= good * a AND gain > 0),
chosen AS (SELECT stratum, rule, cutoff FROM s WHERE tail <= level
           QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
rejected AS (SELECT DISTINCT rid FROM m JOIN chosen USING (stratum) WHERE {_VALUE} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
FROM m
"""
