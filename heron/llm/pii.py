"""Personal data: fixed base patterns, and a linear-chain CRF over word shapes that adds spans.

Base spans (email, ip, card, phone) are found leftmost and without overlap within a kind; a match
that fails its check is dropped and not tried again. The CRF tags every word of
a text: features are the shapes of a word and its neighbours and whether they
are cue words; tags are begin and inside of the four kinds. It is trained on a small labelled table
(maximum likelihood, fixed steps) and decoded by Viterbi in numpy over all texts of a batch at once. Its
spans are added where they overlap no base span.

Cases: null counts as empty; empty texts have no spans. Offsets are code points, end exclusive.
Repeated rows give equal rows; null ids are kept; an empty table gives no rows; extra columns are
ignored. Whole texts are read, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import pieces
from heron.session import ship

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. The look-behind spares a run of digits from being tried at each of its digits.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """One look at each at sign: the local part runs back to the first other character or the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", a, b) for a, b in ips(text)]
        out += [("card", a, b) for a, b in cards(text)]
        out += [("phone", a, b) for a, b in phones(text)] if "+" in text else []
    return out


#: The labelled table: words, and the kinds of those in braces.
LABELLED = """
write to {email:anna.lee at example dot com} today
mail me : {email:j.doe [at] example [dot] org} thanks
email {email:sam_w(at)mail.example.net} for details
contact {email:info@localhost} please
reach us by e-mail {email:kim@intranet} now
correo {email:ana arroba example punto es} gracias
server {ip:10.0.0.1:8080} was down
host {ip:2001:db8:0:0:1:0:0:5} replied
address {ip:192.168.1.20/24} is local
ip {ip:fe80::1ff:fe23:4567:890a} seen
card {card:4111 1111 1111} ends soon
visa {card:4012-8888-8888-188} declined
card number {card:3782 822463 10005} on file
tarjeta {card:5500 0000 0000} caducada
call {phone:(415) 555-0132} after six
tel {phone:030 555 0192} bitte
phone {phone:415-555-0177} works
fax {phone:020 7946 0018} only
ring {phone:07700 900123} at noon
téléphone {phone:01 55 50 12 34} merci
telefon {phone:0049 30 555 0143} bitte
the year 2019 was warm
in 1998 he left for 3 days
page 12 of 340 was torn
room 42 on floor 7
total 1,250.00 was paid on 12 may
chapter 3 section 4.2 item 17
it took 90 minutes and 15 seconds
version 2.4.1 was released
about 100 000 people came
see figure 8 and table 19
the score was 3-2 at half time
on 2021-05-17 at 10:30 we met
about 75% of 300 cases
it is @ home now
they met at noon in town
he sat at home and slept
it was dark. At night he came
look at the sea, at last
the shop is open. At weekends, they rest
not at all what the others said
of the door. At first, nobody came
prices rose 4.5 percent in 2020
licensed under version 2.0 of the terms
id 88213 was closed
"""

CUES = {w: k for k, words in enumerate(("email mail e-mail write contact correo reach", "ip server host address", "card visa number tarjeta mastercard karte carte", "call tel phone fax ring telefon teléfono téléphone", "at (at) [at] arroba", "dot [dot] punto", "version page year section chapter item figure table id")) for w in words.split()}
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
BUCKETS = 4096
STEPS, RATE, DECAY = 120, 0.3, 1e-3
WORD = re.compile(r"\S+")
#: Words of a part of a longer text, by how many words parts overlap, and words whose scores are held at once.
LONG, MARGIN, TOGETHER = 4096, 256, 1 << 19


#: Longer words are looked at anew each time, so that the table of known words stays small.
KNOWN_WORD = 64


CLASSES = str.maketrans({chr(c): "d" if chr(c).isdigit() else "X" if chr(c).isupper() else "x" for c in range(128) if chr(c).isalnum()})
MARKS = set("@.:-()[]+/%,")


def _hashes(named: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") for f in named)


_known_hashes = lru_cache(100_000)(_hashes)


def _shape(word: str) -> tuple[int, ...]:
    """Hashed features of one whole word: shape, short shape, digits, marks, cue."""
    if word.isascii():
        long = word.translate(CLASSES)
        digits = long.count("d")
    else:
        long = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
        digits = sum(c.isdigit() for c in word)
    short = re.sub(r"(.)\1+", r"\1", long)
    marks = "" if word.isalnum() else "".join(sorted(MARKS.intersection(word)))
    named = (f"l{long}" if digits else "l", f"s{short}", f"n{min(digits, 20)}", f"m{marks}", f"c{CUES.get(word.lower().strip(':,'), '')}")
    return _known_hashes(named) if len(word) <= KNOWN_WORD else _hashes(named)


_known_shape = lru_cache(100_000)(_shape)


def shape(word: str) -> tuple[int, ...]:
    return _known_shape(word) if len(word) <= KNOWN_WORD else _shape(word)


WIDE = 15


def features(words: list[str]) -> np.ndarray:
    """(words, WIDE) buckets: the features of the word, of the one before and of the one after."""
    own = np.array([shape(w) for w in words], np.uint64)
    edge = np.zeros((1, own.shape[1]), np.uint64)
    sides = (own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]))
    return np.hstack([((s * np.uint64(2 * k + 1) + np.uint64(977 * k)) % np.uint64(BUCKETS)).astype(np.int32) for k, s in enumerate(sides)])


def labelled() -> Iterator[tuple[list[str], list[int]]]:
    for line in LABELLED.strip().splitlines():
        words, tags = [], []
        for kind, held, plain in re.findall(r"\{(\w+):([^}]*)\}|(\S+)", line):
            for k, w in enumerate(held.split() if kind else [plain]):
                words.append(w)
                tags.append(TAGS.index(f"{'I' if k else 'B'}-{kind}") if kind else 0)
        yield words, tags


@dataclass
class Crf:
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, tags) scores of the words of one text after another; an empty word stands for an edge."""
        ids: dict[str, int] = {"": 0}
        row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
        own = np.array([shape(w) if w else (0,) * (WIDE // 3) for w in ids], np.uint64)
        by_place = [self.emit[((own * np.uint64(2 * k + 1) + np.uint64(977 * k)) % np.uint64(BUCKETS)).astype(np.int32)].sum(1) for k in range(3)]
        f = by_place[0][row]
        f[1:] += by_place[1][row[:-1]]
        f[:-1] += by_place[2][row[1:]]
        f[0] += by_place[1][0]
        f[-1] += by_place[2][0]
        return f

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best tags of every whole sequence, by Viterbi over many at once.

        Sequences of over LONG words are decoded in parts that overlap by MARGIN words on both sides, far
        more than a best path needs to settle.
        """
        parts = [(i, max(0, a - MARGIN), a, min(len(s), a + LONG)) for i, s in enumerate(sequences) for a in range(0, len(s), LONG)]
        tags: list[list[np.ndarray]] = [[] for _ in sequences]
        at = 0
        while at < len(parts):
            to, n = at, 0
            while to < len(parts) and (to == at or n + parts[to][3] - parts[to][1] <= TOGETHER):
                n += parts[to][3] - parts[to][1]
                to += 1
            found = self._decode([sequences[i][lo : hi + MARGIN] for i, lo, _, hi in parts[at:to]])
            for (i, lo, a, hi), t in zip(parts[at:to], found, strict=True):
                tags[i].append(t[a - lo : hi - lo])
            at = to
        return [np.concatenate(t) if t else np.zeros(0, int) for t in tags]

    def _decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        scores_of = self.emissions([w for s in sequences for w in (*s, "")])
        sizes = np.array([len(s) for s in sequences])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        order = np.argsort(-sizes, kind="stable")  # the sequences that still go on come first
        start, size = begin[order], sizes[order]
        left = np.searchsorted(-size, -np.arange(size[0]), "left")
        back = np.zeros(scores_of.shape, np.int8)
        best, into = scores_of[start], np.ascontiguousarray(self.move.T)
        for t in range(1, len(left)):
            n = left[t]
            through = best[:n, None, :] + into
            at = start[:n] + t
            back[at] = k = through.argmax(2)
            best[:n] = np.take_along_axis(through, k[:, :, None], 2)[:, :, 0] + scores_of[at]
        tags, state = np.empty(len(scores_of), np.int8), best.argmax(1)
        for t in range(len(left) - 1, -1, -1):
            n = left[t]
            at = start[:n] + t
            tags[at] = state[:n]
            state[:n] = back[at, state[:n]]
        return [tags[a : a + n].astype(int) for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@lru_cache(1)
def trained() -> Crf:
    """Fits the CRF to the labelled table by gradient steps on the log-likelihood."""
    rows = [(features(w), np.array(t)) for w, t in labelled()]
    k = len(TAGS)
    emit, move = np.zeros((BUCKETS, k)), np.zeros((k, k))
    for i, tag in enumerate(TAGS):
        if tag[0] == "I":  # inside follows only begin or inside of its kind
            move[[j for j in range(k) if TAGS[j] not in (tag, "B" + tag[1:])], i] = -30.0
    for step in range(STEPS):
        ge, gm = -DECAY * emit, -DECAY * np.where(move > -30, move, 0)
        for f, y in rows:
            s = emit[f].sum(1)
            fore, aft = [s[0]], [np.zeros(k)]
            for t in range(1, len(y)):
                fore.append(_logsum(fore[-1][:, None] + move, 0) + s[t])
                aft.insert(0, _logsum(move + (s[-t] + aft[0])[None], 1))
            fore, aft = np.array(fore), np.array(aft)
            z = _logsum(fore[-1], 0)
            miss = -np.exp(fore + aft - z)
            miss[np.arange(len(y)), y] += 1
            np.add.at(ge, f, miss[:, None, :])
            for t in range(1, len(y)):
                gm -= np.exp(fore[t - 1][:, None] + move + (s[t] + aft[t])[None] - z)
                gm[y[t - 1], y[t]] += 1
        rate = RATE / (1 + step / 40)
        emit += rate * ge / 4
        move = np.where(move > -30, move + rate * gm / 4, move)
    return Crf(emit, move)


def sequences(text: str) -> list[tuple[str, int, int]]:
    """Every word of a text with its start and end."""
    return [(x.group(), x.start(), x.end()) for x in WORD.finditer(text)]


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], crf: Crf) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, tags in enumerate(crf.decode([t.split() for t in texts])):  # split() parts at what WORD leaves out
        begins = np.flatnonzero(tags % 2 == 1)
        if not len(begins):
            continue
        run = sequences(texts[i])
        for t in begins.tolist():
            kind, start, tag = TAGS[tags[t]][2:], run[t][1], tags[t]
            while t + 1 < len(run) and tags[t + 1] == tag + 1:
                t += 1
            word, a, b = run[t]
            stop = b - (len(word) - len(word.rstrip(".,;:!?")))
            if stop > start and all(stop <= x or start >= y for _, x, y in bases[i]):
                out[i].append((kind, start, stop))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) of every text."""
    crf = trained()
    ship(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in pieces(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = added_spans(texts, bases, crf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(as_rows, bases), span), pa.array(map(as_rows, added), span)], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def masked(docs: DataFrame) -> DataFrame:
    """docs with clean, the text with each span replaced by its kind in brackets."""
    crf = trained()
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts):
        held = [t or "" for t in texts]
        bases = [base_spans(t) for t in held]
        out = []
        for t, base, more in zip(held, bases, added_spans(held, bases, crf), strict=True):
            at, parts = 0, []
            for kind, a, b in sorted(base + more, key=lambda s: s[1]):
                if a >= at:
                    parts += [t[at:a], f"[{kind}]"]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return texts.__class__(out, dtype=object)

    return docs.withColumn("clean", mask(F.coalesce("text", F.lit(""))))
