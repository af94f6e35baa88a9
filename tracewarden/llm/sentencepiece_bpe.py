"""Exact encoding with merge-type piece vocabularies by backtracking, and decoding.

At every position the longest piece that an Aho-Corasick automaton finds is tried first. A piece
may follow another only if merging the characters of the two anew gives just these two pieces;
where none fits, the walk steps back, and a bitfield of failed positions keeps it from trying a
position twice. A sequence whose neighbours are all compatible is the one that merging gives.

A text is normalised by the model's own rules. Characters without a piece become byte pieces and
part the text, as do white space marks: no piece of such a vocabulary has a mark after another
character (checked when the model is loaded), so words are encoded one by one, and the ids of a
word are kept in a bounded table.

Nulls: a null text is an empty text; it has the begin and end ids only. A null doc_id is kept.
Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from tracewarden.llm.common import text_or_empty, worker_cache

MARK = "▁"
#: Words whose result a worker remembers before it takes these for old ones and forgets the old ones
#: before them, and pairs of pieces remembered before it starts afresh.
WORDS_KEPT = 250_000
PAIRS_KEPT = 300_000


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as the machine's own 32-bit numbers, which must be little-endian")


class Encoder:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = sp.normalize
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = sp.piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.rank: dict[str, tuple[float, int]] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[piece] = (-sp.get_score(i), i)
        self.value = {i: b for b, i in self.byte.items()}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("pieces with a white space mark inside: words can't be encoded one by one")
        # a piece that merging its own characters doesn't give is never part of a result
        self.reached = {p: i for p, (_, i) in self.rank.items() if len(p) == 1 or self.merged(p) == [p]}
        self.find = ahocorasick.Automaton()
        for piece in self.reached:
            self.find.add_word(piece, piece)
        self.find.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reached), None) for p in self.reached}
        self.known = "".join(p for p in self.rank if len(p) == 1)
        self.unknown = re.compile(f"[^{re.escape(self.known)}]") if self.known else re.compile("(?s).")
        self.dummy = self.normalise("a").startswith(MARK)
        self.plain_piece = [p.replace(MARK, " ") for p in self.pieces]
        self.special = {*self.control, *self.value, self.unk}
        self.ends = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        self.fits: dict[tuple[str, str], bool] = {}
        self.packed: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged by rank, leftmost first."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, a: str, b: str) -> bool:
        out = self.fits.get((a, b))
        if out is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            out = self.fits[a, b] = self.merged(a + b) == [a, b]
        return out

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text of known characters."""
        n = len(text)
        longest = [""] * n
        for end, piece in self.find.iter(text):  # by ascending end: the longest of a start comes last
            longest[end - len(piece) + 1] = piece
        failed, any_failed = bytearray(n // 8 + 1), False
        fits, shorter = self.fits, self.shorter
        path: list[str] = []
        pos, last, piece = 0, None, longest[0]
        while True:
            while piece:
                end = pos + len(piece)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if last is None:
                        break
                    ok = fits.get((last, piece))
                    if ok or (ok is None and self.compatible(last, piece)):
                        break
                piece = shorter[piece]
            if piece:
                path.append(piece)
                if end == n:
                    return path
                pos, last, piece = end, piece, longest[end]
            else:
                # nothing may follow the last piece here: this position is out, and that piece gets shorter
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                if not path:
                    raise ValueError("no sequence of pieces covers the text")
                piece = path.pop()
                pos -= len(piece)
                last = path[-1] if path else None
                piece = shorter[piece]

    def encode_word(self, word: str) -> list[int]:
        reached = self.reached
        if not self.unknown.search(word):
            return [reached[p] for p in self.backtrack(word)]
        out: list[int] = []
        at = 0
        for hole in self.unknown.finditer(word):
            if hole.start() > at:
                out += [reached[p] for p in self.backtrack(word[at : hole.start()])]
            out += [self.byte[b] for b in hole.group().encode()] if self.byte else [self.unk]
            at = hole.end()
        if at < len(word):
            out += [reached[p] for p in self.backtrack(word[at:])]
        return out

    def words(self, text: str) -> tuple[str, list[str]]:
        """The normalised text cut before every run of marks: what stands before the first mark, and
        the words without the first mark of each. Byte pieces never touch across a cut, as a mark
        has a piece of its own."""
        first, *rest = self.normalise(text).split(MARK)
        if "" not in rest:
            return first, rest
        out, marks = [], ""
        for k, w in enumerate(rest):
            if w or k + 1 == len(rest):
                out.append(marks + w)
                marks = ""
            else:
                marks += MARK
        return first, out

    def learn(self, word: str) -> tuple[bytes, str | None]:
        """Ids of a mark and a word as bytes, and the text that they decode to inside a longer text if it isn't the word itself."""
        packed = self.old[0].get(word)
        if packed is not None:
            plain = self.old[1].get(word)
        else:
            ids = self.encode_word(MARK + word)
            packed, plain = array("I", ids).tobytes(), self.decode(ids, inside=True)
            if plain == " " + word.replace(MARK, " "):
                plain = None
        if len(word) <= 64:
            if len(self.packed) >= WORDS_KEPT:
                self.old = self.packed, self.odd
                self.packed, self.odd = {}, {}
            self.packed[word] = packed
            if plain is not None:
                self.odd[word] = plain
        return packed, plain

    def coded(self, text: str) -> tuple[bytes, str]:
        """Ids of the text with begin and end as little-endian 32-bit numbers, and what they decode to."""
        first, words = self.words(text) if text else ("", [])
        packed = list(map(self.packed.get, words))
        odd = {}
        if self.odd and not self.odd.keys().isdisjoint(words):
            odd = {k: self.odd[w] for k, w in enumerate(words) if w in self.odd}
        if None in packed:
            for k, w in enumerate(words):
                if packed[k] is None:
                    packed[k], plain = self.learn(w)
                    if plain is not None:
                        odd[k] = plain
        if odd:
            out = "".join([odd[k] if k in odd else " " + w.replace(MARK, " ") for k, w in enumerate(words)])
        else:
            out = (" " + " ".join(words)).replace(MARK, " ") if words else ""
        if first:
            ids = self.encode_word(first)
            packed.insert(0, array("I", ids).tobytes())
            out = self.decode(ids) + out
        if self.dummy and words and not first:
            out = out[1:]
        return self.ends[0] + b"".join(packed) + self.ends[1], out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coded(text)[0], "<u4").tolist()

    def decode(self, ids: list[int], inside: bool = False) -> str:
        """Text of ids: pieces with marks as spaces, bytes as UTF-8 with replacement characters; the
        dummy space at the start goes unless the ids come from inside a text."""
        if inside and self.special.isdisjoint(ids):
            return "".join([self.plain_piece[i] for i in ids])
        out: list[str] = []
        raw = bytearray()
        started = inside
        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(replaced(bytes(raw)))
                raw.clear()
                started = True
            if i in self.control:
                continue
            piece = " ⁇ " if i == self.unk else self.pieces[i]
            if not started and self.dummy and piece.startswith(MARK):
                piece = piece[1:]
            started = True
            out.append(piece.replace(MARK, " ") if i != self.unk else piece)
        if raw:
            out.append(replaced(bytes(raw)))
        return "".join(out)


def replaced(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that isn't part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a model file."""
    known = worker_cache("sentencepiece")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row."""

    def run(batches):
        coder = encoder(path)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                texts = b.column("text").slice(s, 256).to_pylist()
                packed, plain = zip(*map(coder.coded, texts))
                ids = pa.array([np.frombuffer(x, "<i4") for x in packed], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, 256), ids, pa.array(plain, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("ids", ArrayType(IntegerType())).add("decoded", "string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit numbers), decoded_sha256.

    The digests are taken where the ids are made, so that ids and texts needn't leave the worker.
    """

    def run(batches):
        coder = encoder(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for b in batches:
            n, one, two = [], [], []
            for text in b.column("text"):
                packed, plain = coder.coded(text.as_py())
                n.append(len(packed) // 4)
                one.append(sha(packed))
                two.append(sha(plain.encode()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    fields = rows.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return rows.mapInArrow(run, fields)
