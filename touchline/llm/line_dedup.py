"""Line deduplication by an exact set-similarity join.

A line with at least `min_tokens` different words is the set of its lower-cased
words. It is removed if an earlier line, by document id and then by place, has a
Jaccard similarity of at least `similarity`. Shorter lines are left alone.

Equal sets are one node, held by their earliest line. A set's words are ordered by
rarity (corpus-wide counts of 65,536 hash buckets, a table of fixed size), so two
similar sets share a word among the first few of both. Only those prefixes meet,
the longer set's in full and the shorter set's in its still shorter form; size and
position bound the overlap before a pair is made. Pairs are verified on all their
words, which come from the texts, and only for lines that are in a pair.

Signatures of 128 bits drop most pairs before that. Sets are named by 64 bits and words by
44 bits of a hash.

Rows: null text has no lines; documents without an id are returned as they are and match
nothing; rows with the same id and text count as one document; an empty table gives
an empty one; other columns are carried through by `dedup_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import chunks, ids_and_texts, map_chunks, release, stored
from touchline.llm.hashing import BLOCK_BYTES, mix, word_hashes

BUCKET_BITS, TOKEN_BITS = 16, 44


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    min_tokens: int = 5
    passes: int = 4  # the join takes the words in so many turns, which divides its shuffle

    @property
    def mille(self) -> int:
        return round(self.similarity * 1000)


def bucket_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each hash bucket by how many words of the corpus fall into it, rarest first."""
    size = 1 << BUCKET_BITS
    target = docs.sparkSession.createDataFrame([], "bucket int, n long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, texts in chunks(batches):
            for raw in blocks(texts):
                total += np.bincount(word_tokens(raw)[0] & (size - 1), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(size, np.int64)
    for at, n in docs.mapInArrow(run, target).groupBy("bucket").agg(F.sum("n")).collect():  # at most 65,536 rows
        counts[at] = n
    ranks = np.empty(size, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(size)
    return ranks


def blocks(texts: list[str]) -> Iterator[bytes]:
    """The texts, lower-cased (A-Z only) and joined by line ends, in blocks of whole lines."""
    raw = "\n".join(texts).encode().lower()
    start = 0
    while start < len(raw):
        end = len(raw)
        if end - start > BLOCK_BYTES:
            end = raw.rfind(b"\n", start, start + BLOCK_BYTES) + 1 or raw.find(b"\n", start) + 1 or len(raw)
        yield raw[start:end]
        start = end


def word_tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Token and line number of every word."""
    hashes, lines = word_hashes(raw)
    return (hashes & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64), lines


@dataclass(frozen=True)
class Sets:
    line: np.ndarray  # number of each line that takes part
    tokens: np.ndarray  # different tokens of all these lines, rarest first within each
    starts: np.ndarray  # where each line's tokens begin
    sizes: np.ndarray
    names: np.ndarray


def token_sets(raw: bytes, ranks: np.ndarray, least: int) -> Sets:
    """The lines with at least `least` different words, as sets."""
    tokens, line = word_tokens(raw)
    enough = np.bincount(line, minlength=1) >= least
    number = np.flatnonzero(enough)
    use = enough[line]
    tokens, line = tokens[use], (np.cumsum(enough) - 1)[line[use]]
    key = line << TOKEN_BITS | ranks[tokens & ((1 << BUCKET_BITS) - 1)] << TOKEN_BITS - BUCKET_BITS | tokens >> BUCKET_BITS
    key, first = np.unique(key, return_index=True)
    tokens, line = tokens[first], line[first]
    sizes = np.bincount(line, minlength=len(number))
    if (sizes < least).any():  # words that occur twice in a line
        keep = sizes >= least
        tokens, number, sizes = tokens[keep[line]], number[keep], sizes[keep]
    starts = np.cumsum(sizes) - sizes
    names = mix(np.add.reduceat(mix(tokens.astype(np.uint64)), starts)) if len(starts) else np.zeros(0, np.uint64)
    return Sets(number, tokens, starts, sizes, names.view(np.int64))


def signatures(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """128 parity bits per set, as two integers: two sets differ in at least as many words."""
    bit = tokens >> TOKEN_BITS - 7
    out = []
    for half in (0, 1):
        one = np.where(bit >> 6 == half, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0))
        out.append(np.bitwise_xor.reduceat(one, starts).view(np.int64) if len(starts) else np.zeros(0, np.int64))
    return out


def line_table(docs: DataFrame, ranks: np.ndarray, s: Settings) -> DataFrame:
    """doc_id, line, name, size, prefix (packed 32-bit tokens) and signature of every line that takes part."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ("doc_id", "line", "name", "size", "sig0", "sig1")

    def make():
        def work(ids: list, texts: list[str]) -> dict:
            counts = np.array([t.count("\n") + 1 for t in texts])
            before = np.cumsum(counts) - counts
            doc_of = np.repeat(np.arange(len(texts)), counts)
            ids = np.array(ids, np.int64)
            out: dict[str, list] = {c: [] for c in names}
            prefixes, at = [], 0
            for raw in blocks(texts):
                sets = token_sets(raw, shared.value, s.min_tokens)
                line = sets.line + at
                at += raw.count(b"\n")
                reach = sets.sizes - (s.mille * sets.sizes + 999) // 1000 + 1
                packed = (sets.tokens >> TOKEN_BITS - 32).astype("<u4").tobytes()
                ends = sets.starts + reach
                prefixes += [packed[4 * a : 4 * b] for a, b in zip(sets.starts.tolist(), ends.tolist(), strict=True)]
                doc = doc_of[line]
                sig0, sig1 = signatures(sets.tokens, sets.starts)
                for c, v in zip(names, (ids[doc], line - before[doc], sets.names, sets.sizes, sig0, sig1), strict=True):
                    out[c].append(v)
            return {c: np.concatenate(v) if v else [] for c, v in out.items()} | {"prefix": prefixes}

        return work

    schema = "doc_id long, line int, name long, size int, sig0 long, sig1 long, prefix binary"
    return map_chunks(docs.filter("doc_id IS NOT NULL"), make, schema)


def candidates(sets: DataFrame, s: Settings, turn: int) -> DataFrame:
    """Pairs of sets (a, b) that the prefix, size and position filters and the signatures
    leave, with their first places, for the words of one turn."""

    def postings(share_num: int, share_den: int):
        def run(batches):
            for batch in batches:
                sizes = batch.column(1).to_numpy().astype(np.int64)
                held = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)
                full = sizes - (s.mille * sizes + 999) // 1000 + 1
                reach = sizes - (share_num * sizes + share_den - 1) // share_den + 1
                row = np.repeat(np.arange(len(sizes)), full)
                place = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
                use = (place < reach[row]) & (held % s.passes == turn)
                row, place = row[use], place[use]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held[use]), pa.array(batch.column(0).to_numpy()[row]),
                        pa.array(sizes[row] << 32 | place), pa.array(batch.column(3).to_numpy()[row]),
                    ],
                    names=["token", "name", "where", "sig"],
                )

        sig = F.col("sig0").bitwiseXOR(F.col("sig1")).alias("sig")
        return sets.select("name", "size", "prefix", sig).mapInArrow(run, "token long, name long, where long, sig long")

    m = s.mille
    side = lambda df, x: df.select(
        F.col("token").alias(f"{x}_token"), F.col("name").alias(x), F.col("where").alias(f"{x}_where"), F.col("sig").alias(f"{x}_sig")
    )
    longer, shorter = side(postings(m, 1000), "a"), side(postings(2 * m, 1000 + m), "b")
    size = lambda x: F.shiftright(f"{x}_where", 32)
    place = lambda x: F.col(f"{x}_where").bitwiseAND(F.lit(0xFFFFFFFF))
    left = F.least(size("a") - place("a"), size("b") - place("b"))
    # Sets that differ in d words have (both sizes - d) / 2 in common; signatures bound d from below.
    differ = F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig")))
    on = (
        (F.col("a_token") == F.col("b_token"))
        & ((size("b") < size("a")) | ((size("b") == size("a")) & (F.col("b") < F.col("a"))))
        & (size("b") * 1000 >= size("a") * m)
        & (left * (1000 + m) >= (size("a") + size("b")) * m)
        & ((size("a") + size("b") - differ) * (1000 + m) >= 2 * m * (size("a") + size("b")))
    )
    pairs = longer.join(shorter, on).select("a", "b").distinct()
    known = lambda x: sets.select(*[F.col(c).alias(f"{x}_{c}") for c in ("name", "size", "sig0", "sig1", "first")])
    joined = pairs.join(known("a"), F.col("a") == F.col("a_name")).join(known("b"), F.col("b") == F.col("b_name"))
    differ = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in ("sig0", "sig1"))
    both = F.col("a_size") + F.col("b_size")
    possible = joined.filter((both - differ) * (1000 + m) >= 2 * m * both)
    return possible.select("a", "b", "a_first", "b_first")


def tokens_of(docs: DataFrame, wanted: DataFrame, ranks: np.ndarray) -> DataFrame:
    """name and tokens of wanted sets (name, doc_id, line), from the texts."""
    lists = wanted.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("line", "name")).alias("wanted")  # at most a document's lines
    )
    rows = docs.join(lists, docs["doc_id"] == lists["_id"]).select("wanted", "text")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        def work(keys: list, texts: list[str]) -> dict:
            out: dict[str, list] = {"name": [], "tokens": []}
            names, lines = [], []
            for key, text in zip(keys, texts, strict=True):
                split = text.split("\n")
                for w in key:
                    if w["line"] < len(split):
                        names.append(w["name"])
                        lines.append(split[w["line"]])
            at = 0
            for raw in blocks(lines):
                sets = token_sets(raw, shared.value, 1)
                ends = sets.starts + sets.sizes
                for k, i in enumerate((sets.line + at).tolist()):
                    if sets.names[k] == names[i]:  # another row may have the same id
                        out["name"].append(names[i])
                        out["tokens"].append(sets.tokens[sets.starts[k] : ends[k]])
                at += raw.count(b"\n")
            return out

        return work

    return map_chunks(rows, make, "name long, tokens array<bigint>")


def removed_lines(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id and line (from 0) of every line to remove. `docs` has doc_id and text."""
    s = s or Settings()
    ranks = bucket_ranks(docs)
    lines = stored(line_table(docs, ranks, s))
    first = F.min(F.struct("doc_id", "line")).alias("first")
    sets = stored(
        lines.groupBy("name").agg(
            first, F.max(F.struct("doc_id", "line")).alias("last"), 
            *[F.first(c).alias(c) for c in ("size", "sig0", "sig1", "prefix")],
        )
    )
    release(docs)
    parts = []
    for turn in range(s.passes):
        parts.append(stored(candidates(sets, s, turn)))
        release(docs)
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.union(part)
    pairs = pairs.distinct()
    ends = [pairs.select(F.col(x).alias("name"), f"{x}_first.*") for x in ("a", "b")]
    words = stored(tokens_of(docs, ends[0].union(ends[1]).distinct(), ranks))
    release(docs)
    side = lambda x: words.select(F.col("name").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - shared
    matched = both.filter(shared * 1000 >= union * s.mille)
    later = F.when(F.col("a_first") > F.col("b_first"), F.col("a")).otherwise(F.col("b"))
    gone = matched.select(later.alias("_gone")).distinct()
    known = sets.join(gone, F.col("name") == F.col("_gone"), "left").filter("_gone IS NOT NULL OR first <> last")
    known = known.select(F.col("name").alias("_name"), "first", F.col("_gone").isNotNull().alias("whole"))
    at = F.struct("doc_id", "line")
    found = lines.select("doc_id", "line", "name").join(known, F.col("name") == F.col("_name"))
    return stored(found.filter(F.col("whole") | (at != F.col("first"))).select("doc_id", "line").distinct())


def dedup_lines(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents with repeated lines taken out of `text`; `n_chars`, where present,
    follows the new text. Other columns stay."""
    plain = ids_and_texts(docs)
    gone = removed_lines(plain, s)
    release(docs)
    lists = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("line").alias("_gone"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("long").alias("_doc"))
    joined = whole.join(lists, F.col("_doc") == F.col("_id"), "left")
    text = kept_text(F.col("_row.text"), F.col("_gone"))
    columns = {
        "text": text, "n_chars": F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(F.length(text))
        if "n_chars" in docs.columns else None,
    }
    return joined.select(
        *[
            (columns[c] if columns.get(c) is not None else F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c)
            for c in docs.columns
        ]
    )


def kept_text(text, gone):
    """The text without the lines whose numbers are in `gone`."""

    def keep(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    kept = F.transform(F.array(F.split(text, "\n")), keep)[0]
    return F.when(gone.isNull(), text).otherwise(kept)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: characters before and after, whether lines were removed, and the text left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.select("doc_id", "text", F.length("text").cast("long").alias("chars_before"))
    clean = dedup_lines(before)
    after = F.length("text").cast("long")
    return clean.select("doc_id", "chars_before", after.alias("chars_after"), (after < F.col("chars_before")).alias("changed"), "text")
