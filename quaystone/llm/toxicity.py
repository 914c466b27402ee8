"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, report, intensifier, other). Small transducers read a
clause's classes and write the same classes with marks:

* target:   an insult or threat with an addressed person within a few words is marked as aimed, before or behind;
* negation: one with a negation within a few words, on either side, is marked as denied;
* report:   one with a verb of speech or a quotation mark anywhere in the clause is marked as reported;
* strong:   an insult right behind an intensifier is marked as strong.

Those that look at what comes before are composed into one machine that reads from the left, those that look at what
comes behind into one that reads from the right; a clause runs through both, which is linear in its length. The
insult and threat transducers then weigh what has been marked: an insult counts by the weight of its word, little
unless it is aimed; a threat counts only if its target follows; denied and reported matches count little.

The document's score is a logistic function of what its clauses sum to, their maximum, their number and their
density. The insult class is a seed list plus words learnt from labelled rows: those that mark toxic texts. Both the
lexicon and the logistic weights are fitted on at most ``max_labels`` labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm._common import stash

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STRONG = range(7)
CLASSES = 8
#: Marks of a match; a symbol is a class plus CLASSES times its marks.
AIMED_BEFORE, AIMED_BEHIND, DENIED, REPORTED, STRENGTHENED = (1 << i for i in range(5))
SYMBOLS = CLASSES * 32

SEED_WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb scum loser losers pathetic worthless disgusting trash clown imbecile "
    "idioten dummkopf trottel abschaum widerlich imbécile crétin abruti ordure débile idiota idiotas imbécil estúpido estúpida basura escoria",
    THREAT: "kill hurt destroy beat punch stab shoot murder töten umbringen verprügeln tuer frapper détruire matar golpear destruir",
    TARGET: "you your u yourself he she they him her them these those people everyone du dich dir ihr euch sie er "
    "tu toi vous te lui ils elles ella él usted ustedes ellos ellas ti",
    NEGATION: "not no never isn't aren't wasn't don't doesn't without kein keine nicht nie ne pas jamais sin nunca",
    REPORT: "said says say told called calls wrote claimed quoted quote reported allegedly sagte sagt nannte schrieb "
    "dit disait appelé écrit dijo dice llamó escribió",
    STRONG: "very really so such total complete absolute sehr total völlig très vraiment muy tan",
}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
CLAUSE_END = re.compile(r"[.!?;\n]")
REACH = 4  # words between a match and what changes it


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: arcs[state][symbol] is the next state and the symbol that is written. State 0 is the start."""

    arcs: tuple[tuple[tuple[int, int], ...], ...]

    def run(self, symbols: list[int]) -> list[int]:
        state, out, arcs = 0, [], self.arcs
        for x in symbols:
            state, y = arcs[state][x]
            out.append(y)
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other one reads. Only states that can be reached."""
        numbers, arcs, waiting = {(0, 0): 0}, [], [(0, 0)]
        for a, b in waiting:
            row = []
            for x in range(SYMBOLS):
                a2, y = self.arcs[a][x]
                b2, z = other.arcs[b][y]
                if (a2, b2) not in numbers:
                    numbers[a2, b2] = len(waiting)
                    waiting.append((a2, b2))
                row.append((numbers[a2, b2], z))
            arcs.append(tuple(row))
        return Transducer(tuple(arcs))


def marker(cause: int, matches: tuple[int, ...], mark: int, reach: int | None) -> Transducer:
    """Marks symbols of the classes ``matches`` that come at most ``reach`` symbols behind one of class ``cause``; without reach, any that comes behind."""
    far = 1 if reach is None else reach
    arcs = []
    # state 0: no cause within reach; state k: the cause lies k symbols back
    for state in range(far + 1):
        row = []
        for x in range(SYMBOLS):
            kind = x % CLASSES
            onward = 0 if not state else state if reach is None else (state + 1) % (far + 1)
            row.append((1 if kind == cause else onward, (x | CLASSES * mark) if state and kind in matches else x))
        arcs.append(tuple(row))
    return Transducer(tuple(arcs))


MATCHES = (INSULT, THREAT)
FROM_LEFT = (
    marker(TARGET, MATCHES, AIMED_BEFORE, REACH), marker(NEGATION, MATCHES, DENIED, REACH), marker(REPORT, MATCHES, REPORTED, None), marker(STRONG, (INSULT,), STRENGTHENED, 1),
)
FROM_RIGHT = (marker(TARGET, MATCHES, AIMED_BEHIND, REACH), marker(NEGATION, MATCHES, DENIED, REACH), marker(REPORT, MATCHES, REPORTED, None))


@dataclass
class Grammar:
    """Weights of insults, and the factors of marks. Both composed machines are made once."""

    insults: dict[str, float] = field(default_factory=dict)
    aimed_factor: float = 1.5
    unaimed_factor: float = 0.4
    strong_factor: float = 1.25
    denied_factor: float = 0.25
    reported_factor: float = 0.35
    threat_weight: float = 2.0

    def __post_init__(self) -> None:
        self.classes = {w: c for c, words in SEED_WORDS.items() for w in words.split()}
        self.classes |= dict.fromkeys(self.insults, INSULT)
        self.classes |= dict.fromkeys("\"“”«»", REPORT)
        self.left, self.right = (reduce(Transducer.then, machines) for machines in (FROM_LEFT, FROM_RIGHT))
        self.weights = [self.weight(x) for x in range(SYMBOLS)]
        self._finder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_finder": None}

    def weight(self, symbol: int) -> float:
        """What a marked symbol counts."""
        kind, marks = symbol % CLASSES, symbol // CLASSES
        if kind == INSULT:
            out = (self.aimed_factor if marks & (AIMED_BEFORE | AIMED_BEHIND) else self.unaimed_factor) * (self.strong_factor if marks & STRENGTHENED else 1.0)
        else:
            out = self.threat_weight if kind == THREAT and marks & AIMED_BEHIND else 0.0
        return out * (self.denied_factor if marks & DENIED else 1.0) * (self.reported_factor if marks & REPORTED else 1.0)

    def clause(self, words: list[str]) -> float:
        """What the matches of a clause count together."""
        kinds = [self.classes.get(w, OTHER) for w in words]
        marked = self.left.run(self.right.run(kinds[::-1])[::-1])
        return sum(self.weights[x] * self.insults.get(w, 1.0) for w, x in zip(words, marked, strict=True) if self.weights[x])

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Of the whole text: log(1 + sum of clause scores), largest clause score, log(1 + matched clauses), the sum for each word, with ten words more."""
        if not text:
            return 0.0, 0.0, 0.0, 0.0
        text = text.lower()
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for w, c in self.classes.items():
                if c in MATCHES:
                    self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        total = most = 0.0
        matched, done = 0, 0
        for end, size in self._finder.iter(text):
            start = end - size + 1
            if start < done or start and text[start - 1].isalpha() or end + 1 < len(text) and text[end + 1].isalpha():
                continue
            left = max(text.rfind(c, done, start) for c in ".!?;\n") + 1
            right = m.start() if (m := CLAUSE_END.search(text, end + 1)) else len(text)
            score = self.clause(WORD.findall(text, max(left, done), right))
            done = right
            if score:
                total, most, matched = total + score, max(most, score), matched + 1
        return math.log1p(total), most, math.log1p(matched), 10.0 * total / (11 + text.count(" ") + text.count("\n"))


@dataclass
class ToxicityModel:
    grammar: Grammar
    weights: tuple[float, ...]

    def score(self, text: str | None) -> float:
        x = self.grammar.features(text)
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))

    def column(self, text: Column) -> Column:
        """The score (double) of a text column."""

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield pd.Series([self.score(t) for t in batch], dtype=float)

        return score(text)


DEFAULT_WEIGHTS = (-3.0, 2.0, 1.0, 0.5, 0.5)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labels: int = 20_000,
    min_share: float = 0.01,
    min_log_odds: float = 2.5,
) -> ToxicityModel:
    """Learns the insult lexicon and the score's weights from labelled rows of docs.

    If there are more than ``max_labels`` labelled rows, those whose hashed id is smallest are used. A word is
    learnt if it occurs in at least ``min_share`` of the distinct toxic texts (three at least) and its log odds
    reach ``min_log_odds``. So the words that reach the driver are at most 1 / min_share for each distinct word of a
    toxic text of average length; features of at most max_labels rows do. Labels that are null, and ids that have two labels,
    are left out. Without labelled rows the seed lexicon and default weights remain.
    """
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    chosen = stash(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select("doc_id", "toxic"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # at most max_labels rows of two numbers: small whatever the input
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("text").alias("text"))
    rows = stash(rows.select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(Grammar(), DEFAULT_WEIGHTS)
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+"))).alias("word")).where("length(word) > 2")
    counts = words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    learnt = counts.where((F.col("pos") >= max(3, min_share * toxic)) & (odds >= min_log_odds)).select("word", odds.alias("odds"))
    grammar = Grammar({r["word"]: min(4.0, r["odds"]) / 2 for r in learnt.collect()})

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([list(grammar.features(t)) for t in texts])

    sample = rows.select(features("text").alias("x"), "toxic").collect()
    return ToxicityModel(grammar, _logistic(np.array([r["x"] for r in sample]), np.array([r["toxic"] for r in sample], float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression with a small ridge; weights of features stay at zero or above.

    Newton's method on the weights that are free to move; every step is halved until the penalised loss falls,
    so labels that the features separate cannot throw the weights off.
    """
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * w @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * w
        free = np.r_[True, (w[1:] > 0) | (gradient[1:] < 0)]
        h = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + ridge * np.eye(free.sum())
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h, gradient[free])
        for halving in range(40):
            moved = w - step * 0.5**halving
            moved[1:] = np.maximum(moved[1:], 0)
            if (then := loss(moved)) < now:
                break
        else:
            break
        gained, w, now = now - then, moved, then
        if gained <= 1e-9 * (1 + now):
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs; null and empty texts get the score of a text without matches.

    Rows are scored one by one: repeated rows and rows with equal or null ids each have theirs. Time is linear in a text's
    length. Other columns are ignored. No rows give no rows.
    """
    return docs.select(F.col(id_col).alias("doc_id"), model.column(F.col(text_col)).alias("score"))
