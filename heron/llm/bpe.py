"""BPE by a backtracking encoder, and decoding by an offset table.

A vocabulary with word ends is read as strings over 512 symbols: each byte, and each byte that ends
a word. An Aho-Corasick automaton gives all tokens that start at each place of a word. The encoder
takes the longest, keeps it if it is compatible with the token before (that is, merging the two
tokens' parts in rank order would not cross their boundary), else a shorter one, else steps back;
a place that led nowhere is not tried again, so the work is linear in the word. The result is the
one that merging by rank gives.

Text is split on blanks first, as no token crosses one; normalised and cut into words like the
tokenizer file says. Encodings of recent pieces and words are held in tables of a bounded size.

Cases: null counts as empty; empty text has no ids and decodes to the empty text. Special tokens'
strings are their ids, as the library reads them. Texts of any length are encoded whole. Repeated
rows give equal rows; null ids are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heron.llm.common import pieces
from heron.session import ship

#: Entries of each of the two tables of recent encodings in a worker (a full one is put aside, and what
#: is asked for again is taken over), and of pairs that were looked at.
HELD, PAIRS = 120_000, 300_000
#: The same where memory is dearer than time.
LEAN = 30_000
ROWS = 256
#: Two ranks make one key.
SHIFT = 24
#: Printable ASCII and the letters of Latin-1.
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE with a word-end suffix)."""

    def __init__(self, path: str) -> None:
        self.held = HELD
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        letters, vocab = byte_letters(), model["vocab"]

        def symbols(token: str) -> str:
            body, last = (token.removesuffix(end), True) if token.endswith(end) and token != end else (token, False)
            out = [letters[c] for c in body]
            out[-1] += 256 * last
            return "".join(map(chr, out))

        # tokens are handled by rank: single symbols first, then each merge's result in order
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        rank = {t: i for i, t in enumerate(base)} | {a + b: len(base) + i for i, (a, b) in enumerate(merges)}
        self.ids = [0] * len(rank)
        self.parts: list[tuple[int, int]] = [(0, 0)] * len(rank)
        self.pairs: dict[int, int] = {}
        self.by_symbols: dict[str, int] = {}
        self.width = [0] * len(rank)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, r in rank.items():
            s = symbols(t)
            self.ids[r], self.parts[r], self.width[r], self.by_symbols[s] = vocab[t], (r, r), len(s), r
            self.automaton.add_word(s, (len(s), r))
        self.automaton.make_automaton()
        for i, (a, b) in enumerate(merges):
            self.parts[len(base) + i] = left, right = rank[a], rank[b]
            self.pairs[left << SHIFT | right] = len(base) + i
        self.compatible: dict[int, bool] = {}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        # the offset table: all token strings in one, with where each id's begins
        strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        listed = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.blob, self.offset = "".join(listed), np.cumsum([0, *map(len, listed)]).tolist()
        own = Tokenizer.from_file(path)
        self.normalize = own.normalizer.normalize_str
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the library's \s leaves out the separators 1C to 1F, which Python's has
        self.cut = regex.compile(cut.replace(r"\s", r"\p{White_Space}"))
        self.cut_ascii = re.compile(cut.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\s\p{L}\p{N}", r" \t\n\r\v\fa-z0-9"))
        self.cut_latin = re.compile(self.cut_ascii.pattern.replace("a-z", "a-zß-öø-ÿ"))
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.names = [self.spell([i]) for i in self.ids]
        self.words: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.old_words: dict[str, tuple[bytes, str]] = {}
        self.old_pieces: dict[str, tuple[bytes, str]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at one edge of a token (0 left, 1 right), each with the rank that takes it up."""
        out, end = [], len(self.ids)
        while True:
            out.append((token, end))
            part = self.parts[token][side]
            if part == token:
                return out
            end, token = token, part

    def fits(self, left: int, right: int) -> bool:
        """Whether merging left and right by rank leaves the boundary between them.

        A part lives from its own rank until that of the part that takes it up. A merge crosses the
        boundary if its rank falls in the lives of a part at the right edge of left and of one at the
        left edge of right. Of merges of one rank the leftmost comes first: the crossing one loses to
        one inside left and wins over one inside right.
        """
        key = left << SHIFT | right
        if (known := self.compatible.get(key)) is not None:
            return known
        get = self.pairs.get
        over = self.spine(right, 0)
        fit = not any((m := get(x << SHIFT | y)) is not None and m < x_end and m <= y_end for x, x_end in self.spine(left, 1) for y, y_end in over)
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        self.compatible[key] = fit
        return fit

    def encode_symbols(self, word: str) -> list[int]:
        """Ranks of the tokens of one word, by longest matches and backtracking."""
        if (whole := self.by_symbols.get(word)) is not None and whole < 512:
            return [whole]
        fits = self.fits
        greedy = [r for _, (_, r) in self.automaton.iter_long(word)]  # the path without a step back
        if all(map(fits, greedy, greedy[1:])):
            return greedy
        n = len(word)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(word):
            starts[last - match[0] + 1].append(match)  # by growing end, so the longest is last
        known = self.compatible.get
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []  # which match of each place on the path
        pos, k = 0, len(starts[0]) - 1
        while pos < n:
            while k >= 0:
                size, r = starts[pos][k]
                if not dead[pos + size]:
                    if not out:
                        break
                    fit = known(out[-1] << SHIFT | r)
                    if fit or (fit is None and fits(out[-1], r)):
                        break
                k -= 1
            if k >= 0:
                out.append(r)
                tried.append(k)
                pos += size
                k = len(starts[pos]) - 1 if pos < n else 0
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                pos -= self.width[out.pop()]
                k = tried.pop() - 1
        return out

    def encode_word(self, word: str) -> tuple[bytes, str]:
        made = self.old_words.get(word) or self._encoded(word)
        if len(word) < 64:
            if len(self.words) >= self.held:
                self.words, self.old_words = {}, self.words
            self.words[word] = made
        return made

    def _encoded(self, word: str) -> tuple[bytes, str]:
        if word.isascii():
            symbols = word[:-1] + chr(256 + ord(word[-1]))
        else:
            raw = word.encode()
            symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        ranks = self.encode_symbols(symbols)
        return b"".join([self.packed[r] for r in ranks]), " ".join([self.names[r] for r in ranks])

    def spell(self, ids: list[int]) -> str:
        """Token strings by the offset table, blanks between."""
        blob, at = self.blob, self.offset
        return " ".join([blob[at[i] : at[i + 1]] for i in ids])

    def known(self, piece: str) -> tuple[bytes, str]:
        """Ids and decoded text of a piece without special tokens."""
        made = self.old_pieces.get(piece) or self._cut(piece)
        if len(piece) < 64:
            if len(self.pieces) >= self.held:
                self.pieces, self.old_pieces = {}, self.pieces
            self.pieces[piece] = made
        return made

    def _cut(self, piece: str) -> tuple[bytes, str]:
        if piece.isascii():
            found = self.cut_ascii.findall(piece.lower())
        elif LATIN.fullmatch(piece):  # composed letters, which normalising only lower-cases
            found = self.cut_latin.findall(piece.lower())
        else:
            found = self.cut.findall(self.normalize(piece))
        words = [self.words.get(w) or self.encode_word(w) for w in found]
        return words[0] if len(words) == 1 else (b"".join([w[0] for w in words]), " ".join([w[1] for w in words]))

    def encode_bytes(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        parts = self.special.split(text) if self.special and any(s in text for s in self.specials) else [text]
        get, known = self.pieces.get, self.known
        made: list[tuple[bytes, str]] = []
        for part in parts:
            if part in self.specials:
                made.append((self.specials[part].to_bytes(4, "little"), part))
            else:
                made += [m for piece in part.replace("\n", " ").split(" ") if piece and (m := get(piece) or known(piece))[0]]
        return b"".join([m[0] for m in made]), " ".join([m[1] for m in made])

    def forget(self) -> None:
        """Empties the tables of recent encodings and returns their memory: a worker outlives its task."""
        for table in (self.words, self.old_words, self.pieces, self.old_pieces):
            table.clear()
        self.compatible.clear()
        returned()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids)


def returned() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(1)
def codec(path: str) -> Codec:
    made = Codec(path)
    returned()  # what reading the file took, about as much as the codec itself
    return made


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with tokens (array of ids), which takes the place of a column of that name."""
    docs = docs.drop("tokens")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = codec(path), docs_columns.index("text")
        for batch in pieces(batches, at):
            for some in range(0, batch.num_rows, ROWS):
                part = batch.slice(some, ROWS)
                ids = [np.frombuffer(c.encode_bytes(t or "")[0], "<u4").astype(np.int32) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*docs_columns, "tokens"])
        c.forget()

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.limit(0).withColumn("tokens", F.array().cast("array<int>")).schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with tokens) with decoded, the text of its tokens."""
    encoded = encoded.drop("decoded")
    columns = encoded.columns
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = codec(path), columns.index("tokens")
        for batch in batches:
            for some in range(0, batch.num_rows, ROWS):
                part = batch.slice(some, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.decode(x) for x in part.column(at).to_pylist()], pa.string())], names=[*columns, "decoded"])

    return encoded.mapInArrow(run, encoded.limit(0).withColumn("decoded", F.lit("")).schema)


def digests(docs: DataFrame, path: str, tokens: bool = False, lean: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and tokens) of every text, encoded and decoded in one pass.

    lean: workers hold smaller tables.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        c.held = LEAN if lean else HELD
        for batch in pieces(batches, 1):
            for some in range(0, batch.num_rows, ROWS):
                part = batch.slice(some, ROWS)
                n, a, b, held = [], [], [], []
                for t in part.column(1):
                    ids, spelt = c.encode_bytes(t.as_py() or "")
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(spelt.encode()).hexdigest())
                    held.append(np.frombuffer(ids, "<i4"))
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
                yield pa.RecordBatch.from_pydict(columns | ({"tokens": pa.array(held, pa.list_(pa.int32()))} if tokens else {}))
        c.forget()

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * tokens
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)
