"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insults by strength (S, M, W), threats (T), targets (P), negations (N), reporting words (R),
intention (G) and others (o). Four letter transducers, composed into one machine, rewrite the symbols of a clause:
negation turns insults in its scope into negated ones, reported speech marks what it introduces, the target
transducer turns insults near a target into addressed ones, the threat transducer keeps threats with an intention.
A clause counts by its heaviest live match (a threat, an addressed insult or one that stands alone); matches that negation
or reported speech has spent never raise a score. Clauses, counted by kind over the whole text, are weighed by a logistic
model.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _give_back, forget, held_out, worker_state, written

#: Labelled rows that the lexicon and the weights are fitted on, at most: those with the smallest hashed ids.
SAMPLE = 7_000
#: A learned unit (a word, or a beginning of words) has to stand in so many toxic documents of the sample.
SUPPORT = 5
PREFIXES = (3, 4, 5, 6, 7)
#: Log-odds of a unit from which its words are weak, medium or strong insults.
TIERS = ((1.5, "W"), (2.75, "M"), (4.25, "S"))

#: Words of the hand-written part of the lexicon; function words in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid dumb fool clown loser losers pathetic worthless disgusting trash scum filth vermin imbecile bastard garbage"
THREATS = "kill hurt destroy beat burn attack shoot stab crush murder"
TARGETS = """you your yours yourself he him his she her they them their people these those everyone
du dich dir dein deine ihr euch euer sie ihn ihm ihnen leute alle tu toi te ton ta tes vous votre vos il elle ils elles lui eux gens tous
tú ti usted ustedes vosotros vuestro él ella ellos ellas gente todos"""
NEGATIONS = "not never no neither nor hardly nicht nie niemals kein keine keinen weder noch ne pas jamais aucun aucune ni nunca jamás tampoco ningún ninguna"
REPORTS = """said says wrote called quoted claimed reported alleged according shouted
sagte sagt schrieb nannte zitierte behauptete berichtete laut dit écrit appelé cité affirmé selon dijo dice escribió llamó citó afirmó según"""
INTENTIONS = "will gonna going ll should must want werde werden wird soll muss vais va allons doit veux voy vamos debe quiero"

SYMBOLS = {w: s for s, words in (("T", THREATS), ("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("G", INTENTIONS)) for w in words.split()}
#: Letters, with an apostrophe between letters; a colon doesn't end a clause, as what it introduces may be reported.
WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;\n]")
#: Symbols before an insult that can change its kind.
REACH = 6

#: (state, symbol) -> (state, output); "*" is any other symbol and, as output, the symbol itself.
Rules = dict[tuple[int, str], tuple[int, str]]


def _scope(opener: str, changed: dict[str, str], length: int) -> Rules:
    """A transducer that rewrites ``changed`` symbols for ``length`` symbols after ``opener``."""
    rules: Rules = {(0, "*"): (0, "*")}
    for state in range(length + 1):
        rules[state, opener] = (length, opener)
        if state:
            rules[state, "*"] = (state - 1, "*")
            rules |= {(state, a): (state - 1, b) for a, b in changed.items()}
    return rules


NEGATION = _scope("N", {"S": "n", "M": "n", "W": "n", "T": "n"}, 3)
REPORTING = _scope("R", {"S": "r", "M": "r", "W": "r", "T": "r"}, REACH)
TARGETING = _scope("P", {"S": "A", "M": "B", "W": "C"}, 4)
THREATENING = _scope("G", {"T": "X"}, 3) | {(0, "T"): (0, "t")}


def _step(rules: Rules, state: int, symbol: str) -> tuple[int, str]:
    to, out = rules.get((state, symbol)) or rules.get((state, "*")) or (0, "*")
    return to, symbol if out == "*" else out


class Machine:
    """The composition of letter transducers: each one reads what the one before it writes. States are made on demand."""

    def __init__(self, *parts: Rules):
        self.parts, self.table = parts, {}

    def outputs(self, symbols: str) -> str:
        state, out = (0,) * len(self.parts), []
        for symbol in symbols:
            if (state, symbol) not in self.table:
                new, passed = [], symbol
                for rules, s in zip(self.parts, state):
                    to, passed = _step(rules, s, passed)
                    new.append(to)
                self.table[state, symbol] = (tuple(new), passed)
            state, written = self.table[state, symbol]
            out.append(written)
        return "".join(out)


GRAMMAR = Machine(NEGATION, REPORTING, TARGETING, THREATENING)
#: Reads what the first machine wrote from its end: a target that follows an insult ("idiots like you") addresses it.
FOLLOWING = Machine(_scope("P", {"S": "A", "M": "B", "W": "C"}, 2))


def transduce(symbols: str) -> str:
    """The clause's symbols as the grammar rewrites them."""
    return FOLLOWING.outputs(GRAMMAR.outputs(symbols)[::-1])[::-1]


#: Symbols of live matches by rising weight (addressed ones after others of their strength), and of spent ones.
LIVE, SPENT = "WCMBSAX", "tnr"
#: What the logistic model weighs: clauses by their heaviest live match; strong and medium live matches in them, whether
#: there are any, and medium and weak ones for the text's length; spent matches, which never raise a score; the length; a
#: constant.
NAMES = (*LIVE, "strong matches", "medium matches", "any strong", "any medium", "medium share", "weak share", *SPENT, "size", "bias")


def units(text: str) -> set[tuple[int, str]]:
    """The text's words (0) and their beginnings, by length."""
    words = set(WORD.findall(text.lower()))
    return {(0, w) for w in words} | {(k, w[:k]) for w in words for k in PREFIXES if len(w) > k}


class Toxicity:
    """``words`` and ``starts`` map learned units to log-odds; ``weights`` are the logistic model's, bias last."""

    def __init__(self, rows: list[tuple[str, int]]):
        toxic = Counter(u for text, y in rows if y for u in units(text))
        toxic = Counter({u: c for u, c in toxic.items() if c >= SUPPORT})
        clean = Counter(u for text, y in rows if not y for u in units(text) if u in toxic)
        self.learn_units(toxic, clean, sum(y for _, y in rows), len(rows))
        self.weigh(np.array([self.vector(t) for t, _ in rows]), np.array([y for _, y in rows], float))

    def learn_units(self, toxic: Counter, clean: Counter, n: int, total: int) -> None:
        """From the toxic and the clean rows that each unit is in; n of all rows are toxic."""
        self.words: dict[str, float] = {}
        self.starts: dict[str, float] = {}
        self.cache: dict[str, str] = {}
        base = math.log((n + 1) / (total - n + 1))
        for (k, u), c in toxic.items():
            odds = math.log((c + 0.25) / (clean[k, u] + 0.25)) - base
            if odds >= TIERS[0][0]:
                (self.starts if k else self.words)[u] = odds
        for w in INSULTS.split():
            self.words[w] = max(self.words.get(w, 0.0), 4.5)

    def symbol(self, word: str) -> str:
        """The word's symbol; insults by the whole word where it is known, else by its best known beginning. Of a word with
        an apostrophe those of its parts, but "n't" is a negation."""
        if not word.isalpha():
            parts = re.split("['\u2019]", word)
            return "N" if parts[-1] == "t" and parts[-2].endswith("n") else "".join(map(self.symbol, parts))
        odds = self.words.get(word)
        if odds is None:
            odds = max((self.starts.get(word[:k], 0.0) for k in PREFIXES if len(word) > k), default=0.0)
        found = "".join(s for least, s in TIERS if odds >= least)[-1:] or SYMBOLS.get(word, "o")
        if len(self.cache) > 150_000:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = found
        return found

    def clauses(self, text: str | None) -> Counter:
        """The matched clauses of the whole text, by their heaviest live match; their strong and medium live
        matches; and matches that negation, reported speech or a missing intention has spent."""
        out: Counter = Counter()
        known = self.cache
        for clause in CLAUSE.split((text or "").lower()):
            symbols = "".join([known.get(w) or self.symbol(w) for w in WORD.findall(clause)])
            if symbols.strip("oPNRG"):
                written = transduce(symbols)
                live = [s for s in written if s in LIVE]
                if live:
                    out[max(live, key=LIVE.index)] += 1
                    out["strong matches"] += sum(s in "SAX" for s in live)
                    out["medium matches"] += sum(s in "MB" for s in live)
                    out["weak matches"] += sum(s in "WC" for s in live)
                out.update(s for s in written if s in SPENT)
        return out

    def vector(self, text: str | None) -> np.ndarray:
        n = self.clauses(text)
        size = math.log1p(len(text or "") / 1000)
        x = {k: math.log1p(n[k]) for k in (*LIVE, *SPENT, "strong matches", "medium matches")}
        x |= {"any strong": float(n["strong matches"] > 0), "any medium": float(n["medium matches"] > 0), "medium share": math.log1p(n["medium matches"]) / (1 + size), "weak share": math.log1p(n["weak matches"]) / (1 + size), "size": size, "bias": 1.0}
        return np.array([x[k] for k in NAMES])

    def weigh(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 200) -> None:
        """Ridge logistic regression by Newton steps. Live matches don't lower a score and spent ones don't raise it:
        weights of the wrong sign are held at 0 until the slope turns."""
        self.weights = np.zeros(len(NAMES))
        at = {k: i for i, k in enumerate(NAMES)}
        if not len(y):
            self.weights[[at["X"], at["any strong"], at["bias"]]] = 8.0, 6.0, -3.0  # the hand-written lexicon alone
            return
        keep = np.full(x.shape[1], ridge * 50)
        keep[-1] = 1e-6
        sign = np.array([1 if k in LIVE or k.startswith(("strong", "any")) or k == "medium matches" else -1 if k in SPENT else 0 for k in NAMES])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            g = x.T @ (p - y) + keep * self.weights
            free = ~((self.weights == 0) & (sign * g > 0))  # a step would give the wrong sign
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
            step = np.zeros(len(g))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            new = self.weights - step
            new = np.where(sign * new < 0, 0.0, new)
            moved, self.weights = np.abs(new - self.weights).max(), new
            if moved < 1e-8:
                break

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.vector(text) @ self.weights))))))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Toxicity:
    """Fit on at most ``sample`` labelled documents outside the held-out quarter, those with the smallest hashed ids. Of
    several texts of one id the smallest is taken, so the model doesn't depend on the order of rows."""
    usable = labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    chosen = usable.orderBy(F.xxhash64(key), key).limit(sample)
    chosen = df.sparkSession.createDataFrame([(r[0], int(r[1])) for r in chosen.collect()], "__k long, __y int")
    texts = df.select(F.col(key).alias("__k"), F.col(text).alias("__t")).where(F.col("__t").isNotNull())
    rows = written(texts.join(F.broadcast(chosen), "__k").groupBy("__k", "__y").agg(F.min("__t").alias("__t")), "labelled")  # at most ``sample``
    n, total = rows.agg(F.coalesce(F.sum("__y"), F.lit(0)), F.count("*")).first()
    model = Toxicity([])
    if total:
        toxic = _counted(rows.where("__y <> 0"), None, SUPPORT)
        model.learn_units(toxic, _counted(rows.where("__y = 0"), frozenset(toxic), 1), n, total)
        seen = sorted(_vectors(rows, model).collect())
        model.weigh(np.array([r[2] for r in seen]), np.array([r[1] for r in seen], float))
    forget(rows)
    _give_back()
    return model


def _counted(rows: DataFrame, known: frozenset | None, least: int) -> Counter:
    """The rows that each unit (of ``known`` ones) is in, from ``least`` on."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = shared.value
        for batch in batches:
            n = Counter(u for t in batch.column(0).to_pylist() for u in units(t) if some is None or u in some)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.int32()), pa.array([u for _, u in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["k", "u", "n"])

    found = rows.select("__t").mapInArrow(count, "k int, u string, n long").groupBy("k", "u").agg(F.sum("n").alias("n"))
    return Counter({(k, u): n for k, u, n in found.where(F.col("n") >= least).collect()})


def _vectors(rows: DataFrame, model: Toxicity) -> DataFrame:
    """``__k, __y, x`` for each row: what the logistic model weighs."""
    shared, made = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = worker_state(("toxicity vectors", made), lambda: shared.value).vector
        for batch in batches:
            x = [vector(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64()))], names=["__k", "__y", "x"])

    return rows.select("__k", "__y", "__t").mapInArrow(read, "__k long, __y int, x array<double>")


def score_toxicity(df: DataFrame, model: Toxicity, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) for each row's whole text.

    Null counts as the empty text, which gets the score of a text without matches. Equal texts get equal scores;
    columns of these names are replaced; an empty table stays empty.
    """
    shared, made = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    carried = f"text-{made}"  # clashes with no column

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = worker_state(("toxicity", made), lambda: shared.value).score
        for batch in batches:
            at = batch.schema.get_field_index(carried)
            rest = [i for i in range(batch.num_columns) if i != at]
            got = pa.array([one(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), got], names=[*(batch.schema.names[i] for i in rest), "score"])

    kept = df.drop("score", "predicted")
    scored = kept.withColumn(carried, F.col(text)).mapInArrow(score, kept.schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
