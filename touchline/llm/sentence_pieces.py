"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

The library merges the pair of neighbours whose union has the best score, the left
one of equals, until no union is a piece. The same pieces are found from left to
right: at each place the longest piece that starts there is tried, then its
shorter and shorter prefixes. A piece may follow another one only if merging the
characters of both again gives these two: then no merge ever crossed the border
between them, and if that holds at every border, the sequence is the encoding. A
place from which nothing fits is marked in a bitfield, and the piece before it is
tried again with the next shorter one, so no place fails twice.

An Aho-Corasick automaton over the pieces gives the longest piece at every place
in one pass. Pieces that merging would not produce are left out of it. A
character without a piece stands alone and becomes the pieces of its bytes.

Normalising is the library's. A text falls into units: white space marks and a run
of characters that pieces join, directly or through others. No piece crosses the
border of two units, so units seen before come from a table of bounded size. What
pieces join is read from the model when it is loaded.

Rows: null text counts as empty and gives the end id alone; repeated rows give
repeated results; a null doc_id stays null; an empty table gives an empty one;
other columns are not read. Memory beyond the text is a few numbers per character.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import chunks, ids_and_texts

MARK = "▁"  # fixed value: the library writes white space as this character
KEPT_UNITS, LONGEST_KEPT = 400_000, 64  # two tables of units, of about 50 MB each
KEPT_PAIRS = 1_000_000
PART_CHARS = 1_000_000  # of a text, split into units together
APART = "\uffff"  # fixed value: no character, so in no piece
NONE, NEVER = -1, float("-inf")


@lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """The pieces of a model: scores, ids, and what the search needs."""

    def __init__(self, path: str):
        import ahocorasick

        model = load(path)
        kinds = range(model.vocab_size())
        plain = [i for i in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = [i for i in kinds if model.is_byte(i)]
        self.end = model.eos_id()
        if len(self.bytes) != 256:
            raise ValueError("the model has no pieces for the 256 bytes")
        # Pieces with equal scores are equally good, so scores are kept as they are.
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        own_ids = {model.id_to_piece(i): i for i in plain}
        # What may stand in an encoding: pieces that merging gives, and single characters.
        letters = sorted(set(chain.from_iterable(self.score)))
        if APART in letters:
            raise ValueError("the model has pieces of what is no character")
        merged = {p: self.merge(p) for p in chain(letters, self.score)}
        whole = [p for p in self.score if len(p) > 1 and merged[p][0] == [p]]
        self.forms = letters + whole
        self.steps = [merged[f][1] for f in self.forms]
        self.ids = [array("I", [own_ids[f]] if f in own_ids else self.byte_ids(f)).tobytes() for f in self.forms]
        self.width = [len(f) for f in self.forms]
        place = {f: k for k, f in enumerate(self.forms)}
        self.shorter = [self._prefix(f, place) for f in self.forms]
        self.automaton = ahocorasick.Automaton()
        for form, k in place.items():
            self.automaton.add_word(form, k)
        self.automaton.make_automaton()
        self.unit = re.compile(self._units(whole))

    @staticmethod
    def _units(whole: list[str]) -> str:
        """A pattern for units. Characters that some piece joins are in one class."""
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while kind.setdefault(c, c) != c:
                c = kind[c]
            return c

        for piece in whole:
            for a, b in pairwise(piece):
                if b == MARK != a:
                    raise ValueError("a piece crosses a white space mark")
                if a != MARK:
                    kind[root(b)] = root(a)
        classes: dict[str, list[str]] = {}
        for c in kind:
            classes.setdefault(root(c), []).append(c)
        runs = ["[" + "".join(map(re.escape, sorted(k))) + "]+" for k in sorted(classes.values(), key=len, reverse=True)]
        return f"{MARK}*(?:{'|'.join([*runs, f'[^{MARK}]'])})|{MARK}+"

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8")]

    def merge(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The encoding by its definition, for short texts. Also, for every merge and for
        the end, its score (NEVER at the end) and the first and last part before it."""
        parts, steps = list(text), []
        while True:
            best, at = NEVER, NONE
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            steps.append((best, parts[0], parts[-1]))
            if at == NONE:
                return parts, steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @staticmethod
    def _prefix(form: str, place: dict[str, int]) -> int:
        for n in range(len(form) - 1, 0, -1):
            if form[:n] in place:
                return place[form[:n]]
        return NONE


class Segmenter:
    """Finds the encoding of a text by backtracking."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.fitting: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the characters of both again gives these two: their own merges
        go on side by side, the best first, unless one across the border is better.
        Of equals the left one comes first."""
        ours, theirs, score = self.pieces.steps[left], self.pieces.steps[right], self.pieces.score
        i = j = 0
        while True:
            a, _, tail = ours[i]
            b, head, _ = theirs[j]
            across = score.get(tail + head, NEVER)
            if across > a and across >= b and across != NEVER:
                known = False
                break
            if a == b == NEVER:
                known = True
                break
            if a >= b:
                i += 1
            else:
                j += 1
        if len(self.fitting) >= KEPT_PAIRS:
            self.fitting.clear()
        self.fitting[left, right] = known
        return known

    def __call__(self, text: str) -> list[int]:
        """Places in `forms`; NONE for a character that is in no piece."""
        size = len(text)
        width, shorter = self.pieces.width, self.pieces.shorter
        longest = array("l", [NONE]) * size
        for end, form in self.pieces.automaton.iter(text):  # ends ascend, so the longest comes last
            longest[end - width[form] + 1] = form
        hopeful = bytearray(b"\x01") * (size + 1)
        known, fits = self.fitting.get, self.fits
        path: list[int] = []
        at, last = 0, NONE
        while at < size:
            form = longest[at]
            if form == NONE:  # no piece holds this character, so nothing merges with it
                path.append(NONE)
                at, last = at + 1, NONE
                continue
            while True:
                while form != NONE:
                    end = at + width[form]
                    if hopeful[end]:
                        fit = last == NONE or known((last, form))
                        if fit or (fit is None and fits(last, form)):
                            break
                    form = shorter[form]
                if form != NONE:
                    break
                # Nothing fits from here: try the piece before with its next shorter one.
                hopeful[at] = 0
                form = path.pop()
                at -= width[form]
                form, last = shorter[form], path[-1] if path else NONE
            path.append(form)
            at, last = end, form
        return path


class Encoder:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.model, self.pieces = load(path), Pieces(path)
        self.segment = Segmenter(self.pieces)
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, joined: str) -> list[bytes]:
        """The ids of units that are joined by `APART`."""
        ids, width, done, out, at = self.pieces.ids, self.pieces.width, [], [], 0
        for form in self.segment(joined):
            if form != NONE:
                out.append(ids[form])
                at += width[form]
            elif joined[at] == APART:
                done.append(b"".join(out))
                out, at = [], at + 1
            else:
                out.append(array("I", self.pieces.byte_ids(joined[at])).tobytes())
                at += 1
        return [*done, b"".join(out)]

    def _learn(self, new: list[str]) -> None:
        """Encode unseen units together. Units of the older table are taken from there."""
        unseen = []
        for unit in new:
            ids = self.older.get(unit)
            if ids is not None:
                self.units[unit] = ids
            elif APART in unit:
                self.units[unit] = array("I", self.pieces.byte_ids(APART)).tobytes().join(self._encoded(unit))
            else:
                unseen.append(unit)
        if unseen:
            self.units.update(zip(unseen, self._encoded(APART.join(unseen)), strict=True))

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts that end where a mark begins, so that none holds up much memory."""
        start, border = 0, re.compile(f"[^{MARK}](?={MARK})")
        while len(text) - start > PART_CHARS:
            found = border.search(text, start + PART_CHARS)
            if found is None:
                break
            yield text[start : found.end()]
            start = found.end()
        yield text[start:]

    def __call__(self, text: str) -> bytes:
        packed = []
        for part in self._parts(self.model.normalize(text)):
            units = self.pieces.unit.findall(part)
            new = list(set(units).difference(self.units))
            self._learn(new)
            packed.append(b"".join(map(self.units.__getitem__, units)))
            for unit in new:
                if len(unit) > LONGEST_KEPT:
                    del self.units[unit]
            if len(self.units) > KEPT_UNITS:
                self.units, self.older = {}, self.units
        return b"".join(packed) + array("I", [self.pieces.end]).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that later tasks find the units of earlier ones."""
    return Encoder(path)


def _ids_column(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (the end id last); on request decoded, the text that the ids alone give."""
    extra = ", decoded string" if decoded else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path)
        for keys, texts in chunks(batches):
            packed = [to_ids(t) for t in texts]
            columns = {"doc_id": pa.array(keys, pa.int64()), "ids": _ids_column(packed)}
            if decoded:
                back = [to_ids.model.decode(np.frombuffer(p, "<i4").tolist()) for p in packed]
                columns["decoded"] = pa.array(back, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>" + extra)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op13_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document through encoding and back, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
