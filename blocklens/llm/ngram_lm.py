"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, new_path, worker_state, written

#: Of UTF-8 bytes after A-Z are lower-cased.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: What stands before a text's first word and what ends it: blanks, so no words.
BEGIN, END = (int.from_bytes(xxhash.xxh3_64_digest(x), "big") for x in (b" ", b"\n"))
END_BYTES = END.to_bytes(8, "big")
#: Tokens that are counted, or scored, together in a task; training tokens for each shard of the model; words for each
#: shard; one row in SAMPLE is read first to find the number of shards and the words that are spread over all of them.
CHUNK, PER_SHARD, WORDS_PER_SHARD, SAMPLE = 1_500_000, 2_000_000, 500_000, 64
#: Pairs in one row of a shuffle.
PIECE = 8192


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of rows that the model doesn't learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the whole text's words and of its end."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)) + END_BYTES, ">u8").astype("u8")


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two words' hashes in their order."""
    x = (v * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shard_of(v: np.ndarray, pair: np.ndarray, shards: int, frequent: np.ndarray) -> np.ndarray:
    """A pair's shard: by ranges of its first word's hash; of frequent first words by ranges of the pair's own."""
    by = v
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)
        by = np.where(frequent[at] == v, pair, v)
    return ((by >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype("int64")


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more, by how many counts are 1, 2, 3 and 4; halves of 1, 2 and 3 where that
    gives nothing between 0 and the count."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else -1.0
        out.append(d if 0 < d < k else k / 2)
    return out[0], out[1], out[2]


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


# files: arrays one after the other behind their lengths; a worker maps them where the folder is mounted, else a copy


def _store(path: str):
    """The file system and the place in it that a path with a scheme names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """Write aside and then rename, so that a task that is run twice leaves one file, the same."""
    store, place = _store(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    aside = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        for a in (np.array([len(a) for a in arrays], "<i8"), *arrays):
            out.write(np.ascontiguousarray(a).tobytes())
    store.move(aside, place)


class Shards:
    """What a worker has mapped of a model's files."""

    def __init__(self) -> None:
        self.maps: dict[str, list[np.ndarray]] = {}
        self.copies: tempfile.TemporaryDirectory | None = None

    def get(self, path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
        if path not in self.maps:
            self.maps[path] = self._map(path, kinds)
        return self.maps[path]

    def _map(self, path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
        from pyarrow import fs

        store, place = _store(path)
        if store.get_file_info(place).type == fs.FileType.NotFound:  # a shard without rows
            return [np.empty(0, k) for k in kinds]
        if not isinstance(store, fs.LocalFileSystem):
            self.copies = self.copies or tempfile.TemporaryDirectory()
            local = os.path.join(self.copies.name, uuid.uuid4().hex)
            fs.copy_files(place, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            place = local
        whole = np.memmap(place, "u1", "r")
        head = whole[: 8 * len(kinds)].view("<i8")
        out, at = [], 8 * len(kinds)
        for n, kind in zip(head.tolist(), kinds):
            size = n * np.dtype(kind).itemsize
            out.append(np.asarray(whole[at : at + size]).view(kind))
            at += size
        return out


PAIR_FILE = ("<u8", "<u8", "<i8", "u1")  # pairs; those counted 255 times or more and their counts; counts up to 255
WORD_FILE = ("<u8", "<i8", "<f8", "<f8")  # words; their counts; their probability alone; what a word leaves to it


@dataclass
class Model:
    """``tokens`` N and ``words`` V of the training rows, discounts of pairs and of words alone; arrays are files in ``path``."""

    path: str
    shards: int
    word_shards: int
    frequent: np.ndarray
    tokens: int
    words: int
    discount: tuple[float, float, float]
    unseen: float


def _local_uri(df: DataFrame, path: str) -> str:
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows ordered by their first column as (value, rows), holding one value's rows at a time."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def _grouped_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The same for rows of numbers, as (value, the other columns)."""
    now, held = None, []
    for batch in batches:
        first, *columns = (c.to_numpy() for c in batch.columns)
        edges = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                if first[a] != now and held:
                    yield now, [np.concatenate(c) for c in zip(*held)]
                    held = []
                now = int(first[a])
                held.append([c[a:b].copy() for c in columns])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each column's sums over equal ones."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values)


def _pairs(batches: Iterator[pa.RecordBatch], column: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and second words of all pairs of some texts, some ``chunk`` of them at a time."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(column).to_pylist():
            held.append(token_hashes(text))
            size += len(held[-1])
            if size >= chunk:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w = np.concatenate(texts)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.concatenate([[0], np.cumsum([len(t) for t in texts[:-1]], dtype="int64")])] = BEGIN
    return v, w


def fit(df: DataFrame, text: str = "text") -> Model:
    """Count the pairs of words of all rows of ``df``, whole texts, and write the model's arrays.

    Each task sorts and counts its own pairs and sends them, as packed arrays, to their shards: ranges of the first
    word's hash, but pairs of frequent first words (more than half a shard's part of a sample of rows, which decides
    the spread, never a count) go to ranges of their own hash. A shard's counts become one file, sorted by hash; what
    they add to each word (how often it comes first, how many of its pairs have count 1, 2 and more, how many words come
    before it) is summed by word. Words and pairs are told apart by 64-bit hashes.

    Null and empty texts are an end alone; repeated rows count each time; an empty table gives a model to which all words
    are unknown. Other columns aren't read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, _ in _pairs(batches, 0, CHUNK):
            word, n = np.unique(v, return_counts=True)
            for a in range(0, len(word), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(word[a : a + 65536].view("i8")), pa.array(n[a : a + 65536])], names=["word", "n"])

    some = written(rows.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(SAMPLE)) == 0).mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample")
    seen = some.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-seen * SAMPLE // PER_SHARD))
    frequent = np.sort(np.array([r.word for r in some.where(F.col("n") > seen / (2 * shards)).select("word").toLocalIterator()], "i8").view("u8"))  # fewer than twice the shards
    forget(some)
    path = _local_uri(df, new_path(spark, "ngrams"))
    held = spark.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, w in _pairs(batches, 0, CHUNK):
            pair = pair_hash(v, w)
            order = np.argsort(pair)
            pair = pair[order]
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            n = np.diff(np.append(starts, len(pair)))
            pair, v, w = pair[starts], v[order[starts]], w[order[starts]]
            shard = shard_of(v, pair, shards, held.value)
            order = np.argsort(v)
            order = order[np.argsort(shard[order], kind="stable")]  # by shard, then by first word
            shard, v, w, n = shard[order], v[order], w[order], n[order]
            edges = np.flatnonzero(np.diff(shard)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(v)]):
                out += [(int(shard[a]), v[k : min(k + PIECE, b)].tobytes(), w[k : min(k + PIECE, b)].tobytes(), n[k : min(k + PIECE, b)].astype("<i8").tobytes()) for k in range(a, b, PIECE)]
            for a in range(0, len(out), 64):
                s, *rest = zip(*out[a : a + 64])
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], names=["shard", "v", "w", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in _grouped(batches):
            v, w, n = (np.frombuffer(b"".join(r[k] for r in own), kind) for k, kind in ((0, "<u8"), (1, "<u8"), (2, "<i8")))
            del own
            pair = pair_hash(v, w)
            order = np.argsort(pair)
            pair = pair[order]
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair, v, w, n = pair[starts], v[order[starts]], w[order[starts]], np.add.reduceat(n[order], starts)
            many = n >= 255
            _save(f"{path}/pairs-{shard}", [pair, pair[many], n[many], np.minimum(n, 255).astype("u1")])
            of = [int((n == k).sum()) for k in (1, 2, 3, 4)]
            del pair, order, starts
            first, *each = _sums(v, n, (n == 1).astype("i8"), (n == 2).astype("i8"), (n > 2).astype("i8"))
            second, before = _sums(w, np.ones(len(w), "i8"))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([x], pa.int64()) for x in (0, *of, 0))], names=["word", "n", "n1", "n2", "n3", "n4", "before"])
            none = np.zeros(max(len(first), len(second)), "i8")
            for word, columns in ((first, (*each, none[: len(first)], none[: len(first)])), (second, (*[none[: len(second)]] * 5, before))):
                for a in range(0, len(word), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 65536]) for c in (word.view("i8"), *columns)], names=["word", "n", "n1", "n2", "n3", "n4", "before"])

    names = ("n", "n1", "n2", "n3", "n4", "before")
    packed = rows.mapInArrow(count, "shard int, v binary, w binary, n binary").repartition(shards, "shard").sortWithinPartitions("shard")
    merged = packed.mapInArrow(merge, "word long, " + ", ".join(f"{c} long" for c in names))
    table = written(merged.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]), "words")

    # all that the driver gets: a row of sums
    is_word = F.col("word").isNotNull()
    sums = [F.sum(F.when(is_word, F.col(c))).alias(c) for c in ("n", "before")] + [F.count(F.when(is_word & (F.col("before") > 0), 1)).alias("words")]
    sums += [F.count(F.when(is_word & (F.col("before") == k), 1)).alias(f"m{k}") for k in (1, 2, 3, 4)] + [F.max(F.when(~is_word, F.col(f"n{k}"))).alias(f"k{k}") for k in (1, 2, 3, 4)]
    sums += [F.sum(F.when(F.col("word") == _signed(BEGIN), F.col("n"))).alias("texts")]
    t = table.agg(*sums).first()
    tokens, types, vocabulary, texts = (x or 0 for x in (t.n, t.before, t.words, t.texts))
    of_pairs, of_words = discounts([t[f"k{k}"] or 0 for k in (1, 2, 3, 4)]), discounts([t[f"m{k}"] for k in (1, 2, 3, 4)])
    left = (of_words[0] * t.m1 + of_words[1] * t.m2 + of_words[2] * (vocabulary - t.m1 - t.m2)) / types if types else 1.0
    unseen = left / (vocabulary + 1)  # each word's part of what is left, one more for the unknown
    word_shards = max(1, -(-vocabulary // WORDS_PER_SHARD))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (word, n, n1, n2, n3, before) in _grouped_columns(batches):
            word = word.view("u8")
            order = np.argsort(word)
            word, n, n1, n2, n3, before = (c[order] for c in (word, n, n1, n2, n3, before))
            alone = discounted(before, of_words) / max(types, 1) + unseen
            leaves = (of_pairs[0] * n1 + of_pairs[1] * n2 + of_pairs[2] * n3) / np.maximum(n, 1)
            _save(f"{path}/words-{shard}", [word, np.where(word == np.uint64(END), texts, n), alone, leaves])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], names=["shard"])

    of_word = F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(word, 32) * {word_shards}, 32) as int)")
    ranged = table.where(is_word).select(of_word.alias("shard"), "word", "n", "n1", "n2", "n3", "before")
    ranged.repartition(word_shards, "shard").sortWithinPartitions("shard").mapInArrow(store, "shard long").collect()  # a row for each shard
    forget(table)
    return Model(path, shards, word_shards, frequent, tokens, vocabulary, of_pairs, unseen)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def delete(df: DataFrame, model: Model) -> None:
    """Delete a model's files when nothing reads them any more."""
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(model.path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def _found(keys: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys`` and whether the query is there."""
    if not len(keys):
        return np.zeros(len(queries), int), np.zeros(len(queries), bool)
    at = np.minimum(np.searchsorted(keys, queries), len(keys) - 1)
    return at, keys[at] == queries


def _word_values(files: Shards, model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted words their count, probability alone, and what they leave to it when they come first."""
    n, alone, leaves = np.zeros(len(words), "i8"), np.full(len(words), model.unseen), np.ones(len(words))
    shard = shard_of(words, words, model.word_shards, np.empty(0, "u8"))
    edges = np.searchsorted(shard, np.arange(model.word_shards + 1)) if model.word_shards <= len(words) else None
    for s in np.unique(shard).tolist():
        own = slice(edges[s], edges[s + 1]) if edges is not None else slice(*np.searchsorted(shard, [s, s + 1]))
        keys, *columns = files.get(f"{model.path}/words-{s}", WORD_FILE)
        at, there = _found(keys, words[own])
        for out, column in zip((n, alone, leaves), columns):
            out[own][there] = column[at[there]]
    return n, alone, leaves


def _pair_counts(files: Shards, model: Model, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    pair = pair_hash(v, w)
    shard = shard_of(v, pair, model.shards, model.frequent)
    order = np.argsort(pair)
    order = order[np.argsort(shard[order], kind="stable")]
    shard, pair = shard[order], pair[order]
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    n = np.zeros(len(pair), "i8")
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        keys, many, counts, small = files.get(f"{model.path}/pairs-{int(shard[a])}", PAIR_FILE)
        at, there = _found(keys, pair[a:b])
        own = np.where(there, small[at] if len(small) else 0, 0).astype("i8")
        full = np.flatnonzero(own == 255)
        own[full] = counts[np.searchsorted(many, pair[a:b][full])] if len(full) else 0
        n[a:b] = own
    out = np.empty_like(n)
    out[order] = n
    return out


def log_probabilities(files: Shards, model: Model, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token ``w`` after ``v``, and the token's count in training.

    p(w | v) = (c(v w) less its discount) / c(v) + what v leaves * p(w); p(w) is by the number of words that come before
    it, discounted alike, plus an equal part of what that leaves for each word and for unknown ones together. After a
    word that training never saw p(w) holds alone.
    """
    words, at = np.unique(w, return_inverse=True)
    n, alone, _ = _word_values(files, model, words)
    n, alone = n[at], alone[at]
    firsts, at = np.unique(v, return_inverse=True)
    total, _, leaves = _word_values(files, model, firsts)
    total, leaves = total[at], leaves[at]
    pairs = np.zeros(len(w), "i8")
    both = np.flatnonzero((n > 0) & (total > 0))
    pairs[both] = _pair_counts(files, model, v[both], w[both])
    p = np.where(total > 0, discounted(pairs, model.discount) / np.maximum(total, 1) + leaves * alone, alone)
    return np.log10(p), n


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, n_known, base_score, score, perplexity`` of each row of ``df``.

    Tokens are the whole text's words and its end; known ones have been seen in training; ``base_score`` adds
    log10((c + 0.5) / (N + 0.5 (V + 1))) of each, ``score`` the model's log10 probabilities. Null and empty texts are an
    end alone; repeated rows get equal scores; null keys stay null; other columns are left out; a table without rows gives
    none. Workers map the arrays that a task's tokens fall into, so the system keeps of them what memory allows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # the arrays' place and a few numbers

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, m = worker_state(("ngrams", held.value.path), Shards), held.value
        keys, texts, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k), texts.append(token_hashes(t))
                size += len(texts[-1])
                if size >= CHUNK:
                    yield one(files, m, keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield one(files, m, keys, texts)

    def one(files: Shards, m: Model, keys: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        logs, n = log_probabilities(files, m, *_joined(texts))
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        base = np.add.reduceat(np.log10((n + 0.5) / (m.tokens + 0.5 * (m.words + 1))), starts)
        logs, known = np.add.reduceat(logs, starts), np.add.reduceat((n > 0).astype("i8"), starts)
        columns = [pa.array(keys, pa.int64()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(logs), pa.array(10 ** np.minimum(-logs / sizes, 300))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(rate, "key long, n_tokens long, n_known long, base_score double, score double, perplexity double").withColumnRenamed("key", key)


def score_digest(df: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row; learns from those not held out."""
    df = df.select("doc_id", "text")
    model = fit(df.where(~held_out()))
    scores = written(score(df, model), "scores")
    delete(df, model)
    return scores.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
