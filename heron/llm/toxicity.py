"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns the words of a clause into classes: insult, threat, target, negation,
reporting verb, other. Three transducers rewrite that class string: negation weakens what follows
within its scope, reported speech does so to the end of the clause, a target before or after
strengthens it (read from right to left first). They
are composed into one machine, and a last layer weighs what it puts out, so that a clause is scored
as a whole. A document's score is a logistic function of its matched clauses.

Insult words and stems are learned from the labelled sample (words and prefixes that mark label 1
beyond chance), next to a small fixed list; each entry's weight is its evidence. Entries that the
sample contradicts are dropped.

Cases: null counts as empty; empty texts and texts without a match get the lowest score, the share
of label 1 among training texts without a match. Without labels, or with one label only, the fixed
list alone decides. Repeated rows give equal rows; null ids are kept and never held out; an empty
table gives no rows; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import pieces
from heron.llm.training import SAMPLE_ROWS, held_out, labelled_sample
from heron.session import ship

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "IHTNRo"
#: Weight of a listed entry that the sample says nothing about.
PRIOR = 1.0
SHORTEST, LONGEST = 4, 7

LISTED = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting imbecile bastard dummkopf abschaum connard crétin ordure idiota imbécil basura escoria",
    THREAT: "kill hurt destroy punish strangle töten schlagen umbringen tuer frapper détruire matar golpear destruir",
    TARGET: "you your you're they them he she him her u du dich dir ihr sie tu te toi vous ils elles tú ti usted ustedes ellos ellas",
    NEGATION: "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says wrote quoted called reported sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, output); what isn't listed stays and is copied."""

    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)
    states: int = 1

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds first's output to second."""
    arcs, seen, todo = {}, {(0, 0): 0}, [(0, 0)]
    while todo:
        at = todo.pop()
        for symbol in alphabet:
            a, out = first.step(at[0], symbol)
            b, out = second.step(at[1], out)
            if (a, b) not in seen:
                seen[a, b] = len(seen)
                todo.append((a, b))
            arcs[seen[at], symbol] = seen[a, b], out
    return Transducer(arcs, len(seen))


#: Outputs of the grammar: an insult or threat, plain, aimed, negated or reported.
PLAIN = {INSULT: "I", THREAT: "H"}
AIMED = {"I": "J", "H": "K"}
#: What the machine reads: word classes, and insults and threats that a target follows in the clause.
ALPHABET = "IHJKTNRo"
WEAK = {"I": "i", "H": "h", "J": "j", "K": "k"}
WEIGHT = {"I": 1.0, "J": 1.4, "i": 0.5, "j": 0.7, "H": 0.8, "K": 1.6, "h": 0.2, "k": 0.4}
SCOPE = 3


def aiming() -> Transducer:
    """An insult or threat is aimed once a target has been read."""
    return Transducer({(0, TARGET): (1, TARGET)} | {(1, x): (1, y) for x, y in AIMED.items()}, 2)


def grammar() -> Transducer:
    """target, then negation, then reported speech, over the class alphabet, from left to right."""
    aimed = aiming()
    negated = Transducer(states=SCOPE + 1)
    for s in range(SCOPE + 1):
        negated.arcs[s, NEGATION] = SCOPE, NEGATION
        if s:
            negated.arcs |= {(s, x): (s - 1, x) for x in (OTHER, TARGET, REPORT)}
            negated.arcs |= {(s, x): (s, y) for x, y in WEAK.items()}
    reported = Transducer({(0, REPORT): (1, REPORT)} | {(1, x): (1, y) for x, y in WEAK.items()}, 2)
    return compose(compose(aimed, negated, ALPHABET), reported, ALPHABET)


@dataclass
class Model:
    words: dict[str, tuple[str, float]]
    stems: dict[str, float]
    clause: tuple[float, float, float] = (-4.0, 6.0, 0.0)
    nothing: float = 0.02

    def __post_init__(self) -> None:
        self.machine, self.backward = grammar(), aiming()
        strong = sorted((w for w, (c, _) in self.words.items() if c in PLAIN), key=len, reverse=True)
        stems = sorted(self.stems, key=len, reverse=True)
        found = [rf"(?:{'|'.join(map(re.escape, strong))})(?![^\W\d_])"] * bool(strong) + [rf"(?:{'|'.join(map(re.escape, stems))})"] * bool(stems)
        self.seek = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(found)})") if found else None

    def classify(self, word: str) -> tuple[str, float]:
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
            if (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        return OTHER, 0.0

    def clause_score(self, clause: str) -> float:
        found = [self.classify(word) for word in WORD.findall(clause)]
        # from right to left first, for targets that come after
        state, marked = 0, []
        for symbol, _ in reversed(found):
            state, out = self.backward.step(state, symbol)
            marked.append(out)
        state, total = 0, 0.0
        for symbol, (_, weight) in zip(reversed(marked), found, strict=True):
            state, out = self.machine.step(state, symbol)
            total += WEIGHT.get(out, 0.0) * weight
        return total

    def clauses(self, text: str) -> tuple[float, int]:
        """Sum of the scores of the matched clauses, and their number."""
        low = text.lower()
        if self.seek is None or not self.seek.search(low):
            return 0.0, 0
        total, n, end = 0.0, 0, -1
        for m in self.seek.finditer(low):
            if m.start() < end:
                continue  # in the clause just scored
            begin = max((low.rfind(c, 0, m.start()) for c in ".!?;:\n"), default=-1) + 1
            stop = CLAUSE.search(low, m.end())
            end = stop.start() if stop else len(low)
            if (s := self.clause_score(low[begin:end])) > 0:
                total, n = total + s, n + 1
        return total, n

    def score(self, text: str) -> float:
        total, n = self.clauses(text)
        if not n:
            return self.nothing
        a, b, c = self.clause
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * math.log1p(n)))))


def _patterns(word: str) -> set[str]:
    return {word + "$"} | {word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)}


def learn(sample: list[tuple[str, int]]) -> Model:
    """Lexicon evidence, then the weights of the clause features, from (text, label) rows."""
    words = {w: (c, PRIOR) for c, listed in LISTED.items() for w in listed.split()}
    positives = sum(y for _, y in sample)
    if not 0 < positives < len(sample):
        return Model(words, {})
    # patterns that mark label 1 thrice or are listed are counted everywhere; of the others only how many there are at most
    bad = Counter(p for text, y in sample if y for p in set().union(*map(_patterns, set(WORD.findall(text.lower())))))
    told = {p for p, n in bad.items() if n >= 3} | {f"{w}$" for w in words}
    seen, vocabulary = Counter(), set()
    for text, _ in sample:
        found = set(WORD.findall(text.lower()))
        vocabulary |= found
        seen.update(set().union(*map(_patterns, found)) & told)
    base = positives / len(sample)
    surprise = math.log(len(vocabulary) + 1) + 4

    def evidence(p: str) -> float:
        n, k = seen[p], bad[p]
        r = (k + base) / (n + 1)
        return k * math.log(r / base) + (n - k) * math.log((1 - r) / (1 - base)) if r > base else -1.0

    # copies of a text repeat its words: what counts is the number of distinct neighbourhoods
    likely = {p for p in bad if bad[p] >= 3 and bad[p] >= 0.8 * seen[p] and evidence(p) > surprise}
    around: dict[str, set[tuple[str, str]]] = {p: set() for p in likely}
    for text, y in sample:
        found = WORD.findall(text.lower()) if y else []
        for before, word, after in zip(["", *found], found, [*found[1:], ""], strict=False):
            for p in _patterns(word) & likely:
                around[p].add((before, after))
    for p in likely:
        k = min(bad[p], len(around[p]))
        seen[p] += k - bad[p]
        bad[p] = k
    # a longer stem that is as frequent on label 1 and rarer elsewhere takes the place of a shorter one
    for p in sorted(likely, key=len):
        if any(q != p and q.startswith(p) and bad[q] >= 0.9 * bad[p] and seen[q] - bad[q] < 0.5 * (seen[p] - bad[p]) for q in likely if not q.endswith("$")):
            likely.discard(p)
    strong = {p: math.log((bad[p] + 0.5) / (seen[p] - bad[p] + 0.5) * (1 - base) / base) for p in likely if bad[p] >= 0.8 * seen[p] and evidence(p) > surprise}
    stems: dict[str, float] = {}
    for p in sorted(strong, key=len):
        if p.endswith("$"):
            continue
        # a stem that only one word has is that word
        if not any(p[:n] in stems for n in range(SHORTEST, len(p))):
            stems[p] = min(strong[p], 6.0) / 4
    for p, w in strong.items():
        if p.endswith("$") and not any(p[:n] in stems for n in range(SHORTEST, len(p))):
            words[p[:-1]] = INSULT, min(w, 6.0) / 4
    for w, (c, _) in list(words.items()):
        n, k = seen[w + "$"], bad[w + "$"]
        if c in PLAIN and w + "$" not in strong and n >= 3 and k < 0.5 * n:
            del words[w]
    model = Model(words, stems)
    x, y = np.array([model.clauses(t) for t, _ in sample], float), np.array([y for _, y in sample], float)
    matched = x[:, 1] > 0
    model.nothing = min(0.45, float(y[~matched].sum() + 0.5) / (float((~matched).sum()) + 1))
    if matched.any():
        f = np.c_[np.ones(matched.sum()), np.log1p(x[matched])]
        t, prior = y[matched], np.array(model.clause)
        w = prior.copy()
        for _ in range(60):  # Newton steps towards the prior's neighbourhood
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            h = (f * (p * (1 - p))[:, None]).T @ f + 0.05 * np.eye(3)
            w -= np.clip(np.linalg.solve(h, f.T @ (p - t) + 0.05 * (w - prior)), -2, 2)
        model.clause = tuple(map(float, w))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most `rows` labelled documents outside the held-out fold."""
    return learn(labelled_sample(docs, labels, "toxic", rows))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            s = [model.score(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxic(text: Column, model: Model) -> Column:
    """Whether the model rejects a text."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py() or "") >= 0.5 for t in texts], pa.bool_())

    return judge(F.coalesce(text, F.lit("")))
