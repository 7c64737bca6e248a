"""Toxicity by a weighted finite-state pattern grammar.

Words are read by a composition of transducers. The first ones have one state each and
give a word its class and weight: threats, insults (fixed words, learned words and
learned stems), intents, targets, negations and reports. The others remember what
stood before, in the same clause: they mark insults and threats that are negated,
reported, intended or aimed at a target (that one reads the clause both ways). A
clause is scored by the symbols that come out, never a word by itself: an insult that
is denied, or that someone else is said to have used, counts as such, and a threat
counts by who is to suffer it. A logistic model over the scores of the matched
clauses, and the share of clauses that match, gives the score of the document.

Learning reads a bounded sample of labelled rows (sample_of: the rows with the
smallest hashes). Words and stems are counted where the texts are; the lexicon holds
the `terms` strongest of them, a size of the model, and only these and the sample's
feature rows reach the driver. A term counts only if toxic documents that are no
copies of each other have it. Scoring is one map over Arrow batches, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, take, words_of
from .common import release, settle
from .shingles import shingles, word_hashes

#: White space besides the space and the line feed, at which words_of splits.
SPACE = "\r\n|[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LETTERS = regex.compile(r"\p{L}+(?:['’]\p{L}+)?")
STEM_LENGTHS = (4, 5, 6)
#: Bytes of text that are read at a time; each distinct word of them is classified once.
SLICE = 5 << 20
#: What ends a clause.
ENDS = tuple(".!?;:")
#: Fixed words of the grammar, in the languages of the corpus.
TARGETS = frozenset("you your you're they them he she this these those people du ihr dich euch sie tu vous toi tes il elle ils usted ustedes tú ellos ella él".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't nobody without nicht kein keine nie niemals pas jamais ne sans nunca jamás sin".split())
REPORTS = frozenset("said says wrote writes called calls quoted quotes reported claimed according sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según".split())
INSULTS = frozenset("idiot moron clown loser scum worthless pathetic disgusting stupid trash".split())
THREATS = frozenset("kill hurt destroy burn shoot stab punish umbringen töten tuer frapper matar golpear".split())
INTENTS = frozenset("will shall gonna going i'll we'll werde werden wird vais va allons voy vamos".split())
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, INTENT = range(8)
#: How many words a negation, a report and an intent reach, and a target reaches either way.
REACH = {"negation": 3, "report": 8, "target": 4, "intent": 3}


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter-to-letter transducer: step(state, symbol) gives the next state and the symbol written."""

    start: tuple
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""

        def step(state: tuple, symbol: tuple) -> tuple[tuple, tuple]:
            mine, written = self.step(state[0], symbol)
            its, out = other.step(state[1], written)
            return (mine, its), out

        return Transducer((self.start, other.start), step)

    def __call__(self, symbols: list[tuple]) -> list[tuple]:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out.append(written)
        return out


def marking(trigger: int, mark: str, reach: int) -> Transducer:
    """Marks insults and threats that stand at most `reach` words after a trigger, in one clause. A symbol is (class, marks, weight, ...)."""

    def step(state: tuple, symbol: tuple) -> tuple[tuple, tuple]:
        left, kind = state[0], symbol[0]
        if kind == END:
            return (0,), symbol
        if kind == trigger:
            return (reach,), symbol
        if left and kind in (INSULT, THREAT):
            return (left - 1,), (kind, symbol[1] | {mark}, *symbol[2:])
        return (max(0, left - 1),), symbol

    return Transducer((0,), step)


def reading(kind: int, weigh: Callable[[str], float | None]) -> Transducer:
    """Gives words that no transducer before it has read a class and a weight, where weigh finds one. A symbol is (class, marks, weight, word)."""

    def step(state: tuple, symbol: tuple) -> tuple[tuple, tuple]:
        weight = weigh(symbol[3]) if symbol[0] == OTHER else None
        return state, symbol if weight is None else (kind, symbol[1], weight, symbol[3])

    return Transducer((), step)


def _fixed(words: frozenset[str]) -> Callable[[str], float | None]:
    return lambda word: 0.0 if word in words else None


FORWARD = marking(NEGATION, "negated", REACH["negation"]).then(marking(REPORT, "reported", REACH["report"])).then(marking(TARGET, "targeted", REACH["target"])).then(marking(INTENT, "intended", REACH["intent"]))
BACKWARD = marking(TARGET, "targeted", REACH["target"])
FUNCTION_WORDS = reading(TARGET, _fixed(TARGETS)).then(reading(NEGATION, _fixed(NEGATIONS))).then(reading(REPORT, _fixed(REPORTS))).then(reading(INTENT, _fixed(INTENTS)))
FEATURES = ("bias", "hits", "targeted", "negated", "reported", "threats", "clauses", "strongest")


@dataclass
class Grammar:
    """Learned weights of words and stems, and of the clause scores."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (-2.0, 2.0, 0.5, -1.0, -0.5, 0.5, 0.5, 0.3)
    insult_weight: float = 3.0

    def insult(self, word: str) -> float | None:
        weight = self.words.get(word)
        if weight is None and word in INSULTS:
            return self.insult_weight
        if weight is None and self.stems:
            return next((self.stems[word[:n]] for n in STEM_LENGTHS[::-1] if len(word) >= n and word[:n] in self.stems), None)
        return weight

    def lexicon(self) -> Transducer:
        """Threats, insults and function words, one after the other. It has one state, so a word is read alike wherever it stands."""
        threats = reading(THREAT, lambda word: self.words.get(word, 1.0) if word in THREATS else None)
        return threats.then(reading(INSULT, self.insult)).then(FUNCTION_WORDS)

    def read(self, chunks: list[str]) -> list[list[tuple[int, float]]]:
        """(class, weight) of each word of each piece between white space, in order; one for a piece without words."""
        found = [LETTERS.findall(chunk.lower()) for chunk in chunks]
        names = list({word for words in found for word in words})
        known = {word: (symbol[0], symbol[2]) for word, symbol in zip(names, self.lexicon()([(OTHER, frozenset(), 0.0, word) for word in names]), strict=True)}
        out = []
        for chunk, words in zip(chunks, found, strict=True):
            own = [known[word] for word in words] or [(OTHER, 0.0)]
            if chunk[-1:] in ENDS and own[-1][0] == OTHER:
                own[-1] = (END, 0.0)
            out.append(own)
        return out

    def features(self, matched: list[list[tuple]], clauses: int) -> list[float]:
        """Scores of the matched clauses of a document that has so many."""
        hits = targeted = negated = reported = threats = strongest = 0.0
        for clause in matched:
            out = BACKWARD(FORWARD(clause)[::-1])
            score = 0.0
            for kind, marks, weight in out:
                if kind not in (INSULT, THREAT):
                    continue
                if "negated" in marks:
                    negated += weight
                elif "reported" in marks:
                    reported += weight
                elif kind == THREAT:
                    threat = weight * (0.5 + ("intended" in marks) * 0.5 + ("targeted" in marks))
                    threats, score = threats + threat, score + threat
                else:
                    aimed = weight * ("targeted" in marks)
                    hits, targeted, score = hits + weight, targeted + aimed, score + weight + aimed
            strongest = max(strongest, score)
        return [1.0, *(math.log1p(x) for x in (hits, targeted, negated, reported, threats, 100.0 * len(matched) / max(1, clauses), strongest))]

    def score(self, features: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(w * x for w, x in zip(self.weights, features, strict=True))))))


def _document_features(grammar: Grammar, texts: pa.Array) -> Iterator[list[float]]:
    """Features of each text. Of a clause with an insult or a threat, only the words that can reach one are run through the marks."""
    chunks, at, bounds = words_of(pc.replace_substring_regex(pc.fill_null(texts, ""), SPACE, " "))
    names = chunks.to_pylist()
    per_chunk = grammar.read(names)
    lengths = np.array([len(x) for x in per_chunk], np.int64)
    known = [x for own in per_chunk for x in own]
    at, got = take(np.arange(len(known)), lengths, at)
    bounds = np.concatenate([[0], np.cumsum(got)])[bounds]
    kinds = np.array([k for k, _ in known], np.int8)
    ended = np.zeros(len(known), bool)
    ended[np.cumsum(lengths) - 1] = [c[-1:] in ENDS for c in names]
    codes, ends = kinds[at], np.flatnonzero(ended[at])
    hot = np.flatnonzero((codes == INSULT) | (codes == THREAT))
    clause_of = np.searchsorted(ends, hot)
    reach = max(REACH.values())
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        a, b = np.searchsorted(hot, [low, high]).tolist()
        clauses: list[list[tuple]] = []
        while a < b:
            # the clause around hot[a]: after the end before it, up to the end at or after it
            e = int(clause_of[a])
            first = max(low, int(ends[e - 1]) + 1 if e else low)
            last = min(high, int(ends[e]) + 1 if e < len(ends) else high)
            c = a + int(np.searchsorted(hot[a:b], last))
            near = np.zeros(last - first, bool)
            for i in hot[a:c].tolist():
                near[max(0, i - first - reach) : i - first + reach + 1] = True
            clause, before = [], first - 1
            for j in (first + np.flatnonzero(near)).tolist():
                if j != before + 1:  # what lies between reaches no word here
                    clause.append((END, frozenset(), 0.0))
                clause.append((int(codes[j]), frozenset(), known[at[j]][1]))
                before = j
            clauses.append(clause)
            a = c
        inside = np.searchsorted(ends, [low, high]).tolist()
        yield grammar.features(clauses, inside[1] - inside[0] + 1)


def _terms(text: str) -> tuple[set[str], set[str]]:
    words = {w.lower() for w in LETTERS.findall(text)}
    return words, {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, is a stem, label, documents, kinds): kinds has a bit for each hash of a document's least shingle, which copies share."""
    counts: Counter = Counter()
    kinds: dict[tuple, int] = defaultdict(int)
    for batch in batches:
        for part in slices(batch, 0, SLICE):
            hashes, bounds = word_hashes(part.column(0))
            for i, (text, label) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                words, stems = _terms(text or "")
                own = shingles(hashes[bounds[i] : bounds[i + 1]], 5)
                bit = 1 << (int(own.min()) % 62 if len(own) else 0)
                for stem, terms in ((False, words), (True, stems)):
                    for t in terms:
                        counts[t, stem, label] += 1
                        if label:
                            kinds[t, stem, label] |= bit
    rows = list(counts.items())
    for low in range(0, len(rows), 100_000):
        part = rows[low : low + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.bool_()), pa.array([k[2] for k, _ in part], pa.int32()), pa.array([n for _, n in part], pa.int64()), pa.array([kinds.get(k, 0) for k, _ in part], pa.int64())],
            names=["term", "stem", "label", "n", "kinds"],
        )


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; the first column is the bias and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], l2 * max(1, len(y)) / 100)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - shrink * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hessian, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "label", terms: int = 4_000, least_documents: int = 5, least_odds: float = 3.0) -> Grammar:
    """A grammar from rows of (text, 0 or 1), a table of bounded size (see sample_of).

    Two thirds of the rows give the lexicon, the others the weights of the clause
    scores. A word or stem enters it if at least `least_documents` toxic documents have
    it that are no copies of each other, and its log-odds are at least `least_odds`; of
    equally strong ones the first in the alphabet come first. Rows without a label are
    left out, repeated ones count once. With no rows, or rows of one label only, the
    grammar has its fixed words and weights.
    """
    rows = settle(
        labelled.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
        .where("label in (0, 1)")
        .dropDuplicates()
        .withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3)))
    )
    sizes = {r["label"]: r["n"] for r in rows.where("part <> 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    grammar = Grammar()
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return grammar
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    counted = (
        rows.where("part <> 0")
        .select("text", "label")
        .mapInArrow(_count_terms, "term string, stem boolean, label int, n long, kinds long")
        .groupBy("term", "stem")
        .agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("n1"), F.sum(F.expr("if(label = 0, n, 0)")).alias("n0"), F.bit_or("kinds").alias("kinds"))
        .where((F.col("n1") >= least_documents) & (F.bit_count("kinds") >= least_documents))
        .select("term", "stem", "n1", "n0", odds.alias("odds"))
        .where(F.col("odds") >= least_odds)
        .orderBy(F.desc(F.col("odds") * F.log1p("n1")), "term", "stem")
        .limit(terms)
        .collect()
    )
    grammar.words = {r["term"]: float(r["odds"]) for r in counted if not r["stem"]}
    grammar.stems = {r["term"]: float(r["odds"]) for r in counted if r["stem"]}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                found = list(_document_features(grammar, part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), part.column(1)], names=["x", "label"])

    seen = rows.where("part = 0").select("text", "label").mapInArrow(features, "x array<double>, label int").collect()
    release(rows)
    if len({r["label"] for r in seen}) == 2:
        grammar.weights = tuple(float(w) for w in fit_logistic(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float)))
    return grammar


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int, text_col: str = "text") -> DataFrame:
    """(text, label) of the `sample` labelled ids with the smallest hashes (a bounded table, so it may be broadcast); an id labelled both ways counts as 1."""
    named = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label")).where("__id is not null and label is not null")
    chosen = named.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id").select("text", "label")


def score(df: DataFrame, grammar: Grammar, keys: list[str], text_col: str = "text") -> DataFrame:
    """The key columns and `score`, 0 to 1, of every row's whole text.

    A null or empty text has no clause that matches and scores as such; a very long one
    is read whole. Rows are neither dropped nor merged; an empty table gives no rows. Other columns of df are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keys), SLICE):
                scores = [grammar.score(x) for x in _document_features(grammar, part.column(len(keys)))]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], pa.array(scores, pa.float64())], names=[*keys, "score"])

    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "score double"])
    return df.select(*keys, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def accepted(df: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose text scores below the threshold, with all their columns; null and empty texts stay."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE):
                keep = [grammar.score(x) < threshold for x in _document_features(grammar, part.column(at))]
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
