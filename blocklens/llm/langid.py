"""Hierarchical language identification: families by linear SVMs, then one-versus-one SVMs inside a family."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _give_back, held_out, worker_state

#: Labelled rows that the model is fitted on, at most: those with the smallest hashed ids.
SAMPLE = 2_500
#: Hashed character 1-, 2- and 3-gram features.
FEATURES = 1 << 13
#: Rows whose vectors are spread out at a time.
SLAB = 256

#: Families of languages by ISO 639-1 code. Any other label is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "sinitic": "zh yue wuu",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "malayo-polynesian": "id jv ms tl mi",
    "dravidian": "kn ml ta te",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_letters: list = []


def _letter_table() -> np.ndarray:
    """The lower-case code point of each letter; 0 for all that is no letter."""
    if not _letters:
        table = np.zeros(0x110000, "uint32")
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square roots of n-gram counts over the whole text; None if the text has no letter."""
    if not text:
        return None
    c = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if not c.any():
        return None
    keep = c != 0
    keep[1:] |= keep[:-1]  # a run of other characters counts as one
    c = np.concatenate([[0], c[keep], [0]]).astype("uint32")
    two = (c[:-1] * np.uint32(40503)) ^ (c[1:] * np.uint32(2654435761))
    three = (two[:-1] * np.uint32(2246822519)) ^ (c[2:] * np.uint32(3266489917))
    shift = np.uint32(32 - 13)
    hashed = np.concatenate([(c * np.uint32(2654435761)) >> shift, (two * np.uint32(3266489917)) >> shift, (three * np.uint32(668265263)) >> shift])
    v = np.sqrt(np.bincount(hashed, minlength=FEATURES).astype("float32"))
    return v / np.linalg.norm(v)


def packed(text: str | None) -> bytes | None:
    """The text's ``features`` that aren't 0, with their places, in few bytes."""
    v = features(text)
    if v is None:
        return None
    at = np.flatnonzero(v)
    return zlib.compress(at.astype("<u2").tobytes() + v[at].astype("<f4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n = len(data) // 6
    return np.frombuffer(data, "<u2", n), np.frombuffer(data, "<f4", n, 2 * n)


class _Rows:
    """Unit vectors by their entries that aren't 0; ``slabs`` spreads out the rows asked for, a bounded number at a time."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows

    def slabs(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(0, len(which), SLAB):
            some = which[k : k + SLAB]
            x = np.zeros((len(some), FEATURES), "float32")
            for out, i in zip(x, some):
                at, value = self.rows[i]
                out[at] = value
            yield k, x

    def products(self) -> np.ndarray:
        """Of each row with each other, and 1 for the bias."""
        every = np.arange(len(self.rows))
        out = np.empty((len(every), len(every)), "float32")
        for i, x in self.slabs(every):
            for j, y in self.slabs(every[: i + SLAB]):
                out[i : i + len(x), j : j + len(y)] = x @ y.T + 1
                out[j : j + len(y), i : i + len(x)] = out[i : i + len(x), j : j + len(y)].T
        return out

    def combined(self, which: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sum of the rows by weight, and of the weights for the bias."""
        out = np.zeros(FEATURES + 1)
        for k, x in self.slabs(which):
            out[:-1] += weights[k : k + len(x)] @ x
        out[-1] = weights.sum()
        return out.astype("float32")


def _svm(products: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 80) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient steps; classes weigh the same. The steps begin at 0 and stay in
    the rows' span, so they are taken by the rows' ``products`` alone, and give the weight of each row."""
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype("float32")
    w = v = np.zeros(len(y), "float32")
    step = np.float32(1 / (2 * cost * 2 + 1))
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (products @ v))
        new = v - step * (v - np.float32(2 * cost) * (each * y * gap))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


#: Share of a language's n-grams that may be any, when their log-likelihood is taken.
ANY = 0.05


def _likelihood(rows: _Rows, own: np.ndarray) -> np.ndarray:
    """For each feature the log of its share in the rows' n-grams over its share if all were as frequent."""
    share = np.zeros(FEATURES)
    for _, x in rows.slabs(own):
        share += np.einsum("ij,ij->j", x, x, dtype="float64")
    return np.log((share / share.sum() * FEATURES + ANY) / (1 + ANY)).astype("float32")


def _floor(rows: _Rows, own: np.ndarray) -> tuple[float, float]:
    """Least mean log-likelihood of a long text in the language of the rows, and the spread of its n-grams: each half
    of the rows is measured by the other, so neither depends on how many languages there are. A single row sets none."""
    if len(own) < 2:
        return -np.inf, 0.0
    mean, square = [], []
    for k in (0, 1):
        likely = _likelihood(rows, own[1 - k :: 2])
        for _, x in rows.slabs(own[k::2]):
            counts = x**2
            mean.append(counts @ likely)
            square.append(counts @ likely**2)
    m = np.concatenate(mean)
    spread = float(np.sqrt(np.maximum(0, np.concatenate(square) - m * m)).mean())
    return float(m.mean()) - spread, spread


class Hierarchy:
    """``families``: label lists. ``top``: a weight row for each family; ``inside``: for each pair in a family.
    ``likely`` and ``floors`` tell by language whether a text looks like it at all."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.learn(list(map(packed, texts)), labels)

    def learn(self, vectors: list[bytes | None], labels: list[str]) -> None:
        """From ``packed`` vectors; those without a letter are left out."""
        rows = _Rows([unpacked(v) for v in vectors if v is not None])
        label = np.array([name for v, name in zip(vectors, labels) if v is not None], object)
        self.labels = sorted(set(label))
        self.families: dict[str, list[str]] = {}
        for code in self.labels:
            self.families.setdefault(FAMILY_OF.get(code, code), []).append(code)
        self.names = sorted(self.families)
        if not len(label):
            return
        family, every = np.array([FAMILY_OF.get(k, k) for k in label], object), np.arange(len(label))
        products = rows.products() if len(self.labels) > 1 else None
        sign = lambda yes: np.where(yes, 1.0, -1.0).astype("float32")
        self.top = np.array([rows.combined(every, _svm(products, sign(family == f))) for f in self.names]) if len(self.names) > 1 else None
        self.pairs, weights = [], []
        for f in self.names:
            for a, b in combinations(self.families[f], 2):
                own = np.flatnonzero((label == a) | (label == b))
                self.pairs.append((a, b))
                weights.append(rows.combined(own, _svm(products[np.ix_(own, own)], sign(label[own] == a))))
        self.inside = np.array(weights, "float32") if weights else None
        self.likely, self.floors = {}, {}
        for code in self.labels:
            own = np.flatnonzero(label == code)
            self.likely[code], self.floors[code] = _likelihood(rows, own), _floor(rows, own)

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if self.labels else None
        return ("und", 0.0) if v is None else self._best(v)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """The prediction, and whether the text's n-grams are as likely in that language as those of labelled rows are;
        the fewer letters, the more they may stray."""
        v = features(text) if self.labels else None
        if v is None:
            return "und", 0.0, False
        code, score = self._best(v)
        floor, spread = self.floors[code]
        mean = float((v * v) @ self.likely[code])
        return code, score, mean >= floor or mean >= floor - spread / max(1, sum(map(str.isalpha, text))) ** 0.5

    def _best(self, v: np.ndarray) -> tuple[str, float]:
        family, sure = self.names[0], 1.0
        if self.top is not None:
            margin = self.top[:, :-1] @ v + self.top[:, -1]
            p = np.exp(4 * (margin - margin.max()))
            k = int(margin.argmax())
            family, sure = self.names[k], float(p[k] / p.sum())
        best = self.families[family]
        if len(best) > 1:
            wins, total = dict.fromkeys(best, 0.0), dict.fromkeys(best, 0.0)
            for (a, b), m in zip(self.pairs, self.inside[:, :-1] @ v + self.inside[:, -1]):
                if a in wins:
                    p = 1 / (1 + np.exp(-4 * float(m)))
                    wins[a], wins[b] = wins[a] + (p >= 0.5), wins[b] + (p < 0.5)
                    total[a], total[b] = total[a] + p, total[b] + 1 - p
            chosen = max(best, key=lambda c: (wins[c], total[c]))
            return chosen, sure * total[chosen] / (len(best) - 1)
        return best[0], sure


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Hierarchy:
    """Fit on at most ``sample`` labelled rows outside the held-out quarter (those with the smallest hashed keys). Tasks read
    their texts; the driver gets the entries of their vectors that aren't 0."""
    usable = df.where(~held_out(key) & F.col(lang).isNotNull()).withColumn("__h", F.xxhash64(key))
    first = [r[0] for r in usable.select("__h").orderBy("__h").limit(sample).collect()]
    model = Hierarchy([], [])
    if not first:
        return model

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(map(packed, batch.column(0).to_pylist())), pa.binary())], names=["h", "lang", "tie", "vector"])

    chosen = usable.where((F.col("__h") <= first[-1]) & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col("__h").alias("h"), F.col(lang).alias("lang"), F.xxhash64(text).alias("tie"))
    rows = chosen.mapInArrow(read, "h long, lang string, tie long, vector binary").orderBy("h", "lang", "tie").limit(sample).collect()
    rows.sort(key=lambda r: r[:3])
    model.learn([r[3] for r in rows], [r[1] for r in rows])
    del rows
    _give_back()
    return model


def identify_language(df: DataFrame, model: Hierarchy, text: str = "text", known: str | None = None) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` from the whole text, and whether it looks like that language as ``known``.

    Null and empty texts and those without a letter are ``und`` with score 0, and so is every text when no labelled
    row was learned from. Repeated rows get equal values; columns of these names are replaced.
    """
    shared, made = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    carried = f"text-{made}"  # clashes with no column

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state(("language", made), lambda: shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(carried)
            got = list(map(own.judge if known else own.predict, batch.column(at).to_pylist()))
            rest = [i for i in range(batch.num_columns) if i != at]
            columns = [*(batch.column(i) for i in rest), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), *([pa.array([g[2] for g in got], pa.bool_())] if known else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in rest), *added])

    added = ["lang_pred", "score", *([known] if known else [])]
    kept = df.drop(*added)
    schema = kept.schema.add("lang_pred", "string").add("score", "double")
    return kept.withColumn(carried, F.col(text)).mapInArrow(predict, schema.add(known, "boolean") if known else schema)
