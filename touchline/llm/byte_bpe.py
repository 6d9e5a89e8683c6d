"""Byte-level BPE: encoding and decoding of whole texts over Arrow batches.

Byte-level tokenizers write every byte as a printable character. Ids, byte
offsets and character offsets all follow from that table: a token covers as
many bytes as its written form has characters, and a character may be split
over several tokens, in which case they share its character offset.

A text falls into units, each a run of letters or of non-space characters with the
one space before it, or a run of space. No match of the tokenizers' pattern crosses
the border of two units, so a unit's ids do not depend on its neighbours; units seen
before are taken from two tables of bounded size, and only new ones are encoded.

Rows: null text counts as empty and gives no ids; repeated rows give repeated
results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ids_and_texts, map_chunks

# White space as the tokenizers' patterns see it: Python's, without four control characters.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# A run of these letters that no letter follows is a match of the pattern by itself.
LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\W\d_])"
UNIT = re.compile(rf" ?{LETTERS}| ?{OTHER}+|{SPACE}+(?!{OTHER})|{SPACE}+")
KEPT_UNITS = 500_000  # about 100 MB; a full table becomes the older one
LONGEST_KEPT = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable and no
    space, else the next free one from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def _from_ranks(path: str):
    """A tokenizer with the vocabulary of a rank file.

    Merging by rank joins the neighbours whose union has the lowest rank,
    however the union is split; so every split of a token into two tokens
    becomes a merge, in the order of the rank of the union.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = byte_characters()
    written = {token: "".join(table[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        splits = [(token[:i], token[i:]) for i in range(1, len(token))]
        splits = [(a, b) for a, b in splits if a in ranks and b in ranks]
        merges += [(written[a], written[b]) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
    model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return tokenizer


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = _from_ranks(path) if path.endswith(".tiktoken") else Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id."""
    table = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = load(path).get_vocab()
    tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for written, i in vocabulary.items():
        # A special token is written as it is, not byte by byte.
        known = all(c in table for c in written)
        tokens[i] = bytes(table[c] for c in written) if known else written.encode()
    return tokens


@lru_cache(maxsize=4)
def byte_widths(path: str) -> np.ndarray:
    return np.array([len(t) for t in token_bytes(path)], np.int64)


class Encoder:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept_units: int = KEPT_UNITS):
        self.tokenizer = load(path)
        self.widths = byte_widths(path)
        self.kept_units = kept_units
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encode unseen units many at a time: one after the other, or with a line
        break between where a unit has no space before it, they stay apart."""
        older = {u: self.older[u] for u in new if u in self.older}
        self.units.update(older)
        new = [u for u in new if u not in older]
        runs = [u for u in new if u.isspace()]
        for unit, encoded in zip(runs, self.tokenizer.encode_batch_fast(runs, add_special_tokens=False), strict=True):
            self.units[unit] = np.array(encoded.ids, "<u4").tobytes()
        words = [u if u[0] == " " else f"\n{u}" for u in new if not u.isspace()]
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = self.tokenizer.encode("".join(part), add_special_tokens=False).ids
            packed = np.array(ids, "<u4")
            ends = np.cumsum(np.fromiter((len(w.encode()) for w in part), np.int64, len(part)))
            cuts = np.searchsorted(np.cumsum(self.widths[packed]), ends) + 1
            raw, start = packed.tobytes(), 0
            for word, end in zip(part, (cuts * 4).tolist(), strict=True):
                own = word[0] == " "
                self.units[word if own else word[1:]] = raw[start if own else start + 4 : end]
                start = end

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        split = [UNIT.findall(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.units))
        self._learn(new)
        packed = [b"".join(map(self.units.__getitem__, units)) for units in split]
        for unit in new:
            if len(unit) > LONGEST_KEPT:
                del self.units[unit]
        if len(self.units) > self.kept_units:
            self.units, self.older = {}, self.units
        return packed


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that later tasks find the units of earlier ones."""
    return Encoder(path)


class Decoder:
    """Turns packed ids back into bytes through the reversed byte table."""

    def __init__(self, path: str):
        self.tokens, self.widths = token_bytes(path), byte_widths(path)

    def __call__(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Per token, the first character it touches and the one after its last."""
        raw = np.frombuffer(self(packed), np.uint8)
        ends = np.cumsum(self.widths[np.frombuffer(packed, "<u4")])
        begins = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return begins[starts] - 1 if len(ends) else starts, begins[ends - 1] if len(ends) else ends


def encode(docs: DataFrame, path: str, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers), n_tokens; on
    request starts and ends (character offsets) and decoded (bytes).

    The decoded bytes come from the ids alone, in the task that made them.
    """
    extra = ", starts array<int>, ends array<int>" if offsets else ""
    extra += ", decoded binary" if decoded else ""

    def make() -> Callable[[list, list[str]], dict]:
        to_ids, decoder = encoder(path), Decoder(path) if offsets or decoded else None

        def work(ids: list, texts: list[str]) -> dict:
            packed = to_ids(texts)
            columns = {"doc_id": ids, "ids": packed, "n_tokens": [len(p) // 4 for p in packed]}
            if offsets:
                pairs = [decoder.offsets(p) for p in packed]
                columns |= {"starts": [a.tolist() for a, _ in pairs], "ends": [b.tolist() for _, b in pairs]}
            if decoded:
                columns["decoded"] = [decoder(p) for p in packed]
            return columns

        return work

    return map_chunks(ids_and_texts(docs), make, "doc_id long, ids binary, n_tokens long" + extra)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (bytes) and text of packed ids. Bytes that end inside a
    character are kept in `decoded` and shown as replacement characters in `text`."""
    import pyarrow as pa

    rows = encoded.select("doc_id", "ids")
    target = rows.sparkSession.createDataFrame([], "doc_id long, decoded binary, text string").schema

    def run(batches):
        decoder = Decoder(path)
        for batch in batches:
            raw = [decoder(p or b"") for p in batch.column(1).to_pylist()]
            texts = [r.decode("utf-8", "replace") for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array(texts, pa.string())],
                names=["doc_id", "decoded", "text"],
            )

    return rows.mapInArrow(run, target)


def unpacked(packed: str = "ids"):
    """Column of packed ids as an array of integers."""
    digits = F.hex(packed)
    n = F.length(packed) / 4
    one = lambda i: F.conv(
        F.concat(*[F.substring(digits, (i * 8 + 7 - 2 * k).cast("int"), F.lit(2)) for k in range(4)]), 16, 10
    ).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), one)).otherwise(
        F.array().cast("array<long>")
    )


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document through encoding and back, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
