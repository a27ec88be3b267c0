import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blocklens.llm import ngram_lm, resampling, whitening
from blocklens.llm.common import new_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# 11


def test_jacobi_small_eigenvalues():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    scale = np.geomspace(1, 1e-6, 30)
    a = scale[:, None] * (q @ np.diag(np.linspace(1, 2, 30)) @ q.T) * scale  # graded: its small eigenvalues are well determined
    values, vectors, sweeps = whitening.jacobi(a)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-15) and np.allclose(vectors.T @ vectors, np.eye(30), atol=1e-13)
    inverse = (q @ np.diag(1 / np.linspace(1, 2, 30)) @ q.T) / np.outer(scale, scale)  # whose largest eigenvalues belong to the smallest
    assert np.allclose(1 / values[-10:], np.linalg.eigvalsh(inverse)[-10:], rtol=1e-9) and (np.diff(values) <= 0).all() and sweeps < 15
    assert np.array_equal(whitening.jacobi(np.eye(3))[0], np.ones(3)) and len(whitening.jacobi(np.zeros((0, 0)))[0]) == 0


def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    out = [(i, [float(c) for c in v], "x", 1.5) for i, v in enumerate(x)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0], "x", 1.5) for i in range(150)]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1.0, 2.0], [1e300] + [0.0] * 4]
    return out + [(1000 + i, v, None, None) for i, v in enumerate(bad)] + [(None, [0.5] * 5, "x", 0.0)]


VECTORS = "vec_id long, embedding array<double>, whitened string, n double"


def test_whitening_by_hand(spark):
    df = spark.createDataFrame(vectors(), VECTORS).repartition(4)
    got = whitening.whitening_digest(df, 3).collect()
    x = np.array([np.floor(np.array(v) * 1024) + 100000 for _, v, *_ in vectors() if v and len(v) == 5 and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e100]).astype("int64")
    n, s = len(x), x.sum(axis=0)
    values, directions = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, directions = values[::-1], directions[:, ::-1]
    assert len(got) == 3 * n and all(r.n == n and r.identity_error < 1e-12 for r in got)
    assert sorted(r.deviation for r in got if r.component == 2) == sorted(((n * x - s) ** 2).sum(axis=1).tolist())
    z = (x - x.mean(axis=0)) @ directions / np.sqrt(values)
    for k in range(3):
        own = np.sort([r.whitened for r in got if r.component == k + 1])
        assert min(np.abs(own - np.sort(z[:, k])).max(), np.abs(own - np.sort(-z[:, k])).max()) < 1e-9
        assert math.isclose(next(r.explained for r in got if r.component == k + 1), values[k] / values.sum(), rel_tol=1e-9)
    assert all(len(set(v)) == 1 for v in _by(got, lambda r: (r.vec_id is None, r.component), lambda r: r.explained).values())


def _by(rows, key, value):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(value(r))
    return out


def test_whitening_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whitening_digest(none).count() == 0 and whitening.whitening_digest(none).columns[0] == "vec_id"
    same = spark.createDataFrame([(1, [1.0, 2.0], "", 0.0)] * 4, VECTORS)
    assert whitening.whitening_digest(same).count() == 0 and len(whitening.fit(same).values) == 0
    assert [r.deviation for r in whitening.whiten(same, whitening.fit(same)).collect()] == [0] * 4
    far = spark.createDataFrame([(i, [float(i % 2) * 1e9, float(i)], "", 0.0) for i in range(40)], VECTORS)  # products beyond 64 bits
    x = np.array([[math.floor(i % 2 * 1e9 * 1024) + 100000, i * 1024 + 100000] for i in range(40)], object)
    want = [sum((40 * a - b) ** 2 for a, b in zip(row, x.sum(axis=0))) for row in x]
    assert sorted(int(r.deviation) for r in whitening.whiten(far, whitening.fit(far)).collect()) == sorted(want)
    assert {r.deviation for r in whitening.whitening_digest(far).collect()} == {None}


# 12


def plain_model(texts):
    """Probabilities of a pair of words by the textbook's formulas."""
    one, two = Counter(), Counter()
    for ws in texts:
        one.update(ws), two.update(zip([" ", *ws], ws))
    follow, before = defaultdict(Counter), Counter()
    for (a, b), n in two.items():
        follow[a][n] += 1
        before[b] += 1

    def discounts(n):
        y, out = (n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0), [0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else -1
            out.append(d if 0 < d < k else k / 2)
        return out

    d2, d1 = discounts(Counter(two.values())), discounts(Counter(before.values()))

    def alone(b):
        if not two:
            return 1.0
        left = sum(d1[min(n, 3)] for n in before.values()) / len(two)
        return (before[b] - d1[min(before[b], 3)]) / len(two) + left / (len(one) + 1)

    def pair(a, b):
        total = sum(n * k for n, k in follow[a].items()) if a in follow else 0
        if not total:
            return alone(b)
        return (two[a, b] - d2[min(two[a, b], 3)]) / total + sum(d2[min(n, 3)] * k for n, k in follow[a].items()) / total * alone(b)

    return one, pair


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_the_formulas(docs, monkeypatch, small):
    if small:  # many shards, blocks and spread words
        for name, value in (("CHUNK", 300), ("PER_SHARD", 400), ("WORDS_PER_SHARD", 50), ("SAMPLE", 2), ("PIECE", 16)):
            monkeypatch.setattr(ngram_lm, name, value)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    one, pair = plain_model([tokens(t) for k, t in rows if not held(k)])
    n, v = sum(one.values()), len(one)
    want = []
    for k, t in rows:
        ws = tokens(t)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((k if k is not None else -1, held(k), len(ws), sum(one[w] > 0 for w in ws), n, base, sum(math.log10(pair(a, b)) for a, b in zip([" ", *ws], ws))))
    got = [(r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score_digest(docs).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    words = [*one, "never seen"]
    assert math.isclose(sum(pair("the", w) for w in words), 1) and math.isclose(sum(pair("never seen", w) for w in words), 1)


def test_scores_of_frequent_pairs_and_edges(spark, none):
    rows = [(i, "a b " * 300) for i in range(0, 8)] + [(8, None), (9, ""), (10, "q" * 100_000), (10, "A  B\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens): r for r in ngram_lm.score_digest(df).collect()}
    one, pair = plain_model([tokens(t) for k, t in rows if not held(k)])
    for k, t in rows:
        ws = tokens(t)
        assert math.isclose(got[k, len(ws)].score, sum(math.log10(pair(a, b)) for a, b in zip([" ", *ws], ws)), rel_tol=1e-9)  # counts above 255
    assert ngram_lm.score_digest(none).count() == 0
    lonely = spark.createDataFrame([(k, "x y") for k in range(60) if held(k)], "doc_id long, text string")  # nothing to learn from
    assert {(r.n_known, r.train_tokens, r.score, r.base_score) for r in ngram_lm.score_digest(lonely).collect()} == {(0, 0, 0.0, 0.0)}


def test_files_of_another_store_are_copied(spark, monkeypatch):
    from pyarrow import fs

    model_path = new_path(spark, "shards")
    place = ngram_lm._local_uri(spark.range(1), model_path)
    ngram_lm._save(f"{place}/words-0", [np.arange(3, dtype="u8"), np.arange(3), np.ones(3), np.zeros(3)])

    monkeypatch.setattr(ngram_lm, "_store", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), path.removeprefix("file:///")))
    got = ngram_lm.Shards().get(f"{place}/words-0", ngram_lm.WORD_FILE)
    assert got[0].tolist() == [0, 1, 2] and got[2].tolist() == [1, 1, 1]
    assert [len(a) for a in ngram_lm.Shards().get(f"{place}/words-9", ngram_lm.WORD_FILE)] == [0] * 4


# 13


def plain_resample(rows, target, least=20, share=(5, 100)):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]

    own = [(k, *features(t)) for k, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for k, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-x[3], x[0] is None, x[0] or 0) for x in out if x[4] >= least)
    return [x[:4] for x in out], able[: share[0] * len(able) // share[1]]


def test_resample(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(1000 + i, f"copied text {'of words ' * 20}") for i in range(200)] + [(2000, "é0é Z\x7fz ß" * 3)]
    target = [rows[7][1][:500], "of words and copied TEXT", None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want, drawn = plain_resample(rows, target)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r[:4]) for r in got), key=key) == sorted(want, key=key)
    ranks = sorted((r["rank"], -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r["rank"] is not None)
    assert [r[1:] for r in ranks] == drawn and [r[0] for r in ranks] == list(range(1, len(drawn) + 1)) and len(drawn) > 5
    assert resampling.resample(none, spark.createDataFrame([("x",)], "text string")).count() == 0
    assert resampling.resample(df, none).where("rank is not null").count() == len(drawn)
    tied = resampling.resample(spark.createDataFrame([(5, "w " * 30)] * 40, "doc_id long, text string"), none, drawn=(50, 100)).collect()
    assert sorted(r["rank"] or 0 for r in tied) == [0] * 20 + list(range(1, 21)) and len({(r.weight, r.score) for r in tied}) == 1


# 6, 3


def test_frames_of_several_huffman_tables(spark, monkeypatch):
    """Files whose frames bring tables of their own are read by them, in any order and together."""
    from blocklens.llm import media

    payloads = [bytes((7 * i * k) % 251 for i in range(64 * 90)) for k in range(1, 4)]
    files = media.encode(payloads[:1])
    symbols = [s for n in sorted(media.BY_LENGTH) for s in media.BY_LENGTH[n]]
    turned, at = {}, 0
    for n in sorted(media.BY_LENGTH):  # the same code lengths for other differences
        turned[n] = tuple(symbols[::-1][at : at + len(media.BY_LENGTH[n])])
        at += len(media.BY_LENGTH[n])
    if max(n + s for n in turned for s in turned[n]) > 16:
        turned = {4: tuple(symbols)}  # all codes of one length
    own, writing = media.BY_LENGTH, media._WRITE
    monkeypatch.setattr(media, "BY_LENGTH", turned)
    monkeypatch.setattr(media, "_WRITE", media._writing_table())
    files += media.encode(payloads[1:])
    monkeypatch.setattr(media, "BY_LENGTH", own)
    monkeypatch.setattr(media, "_WRITE", writing)
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        got = media.decode([files[i] for i in order])
        assert [media.payload(p, f) for p, f in got] == [payloads[i] for i in order]


def test_frames_that_claim_too_much(spark):
    from blocklens.llm import media

    good = media.encode([bytes(64 * 8)])[0]
    at = good.index(b"\xff\xc3") + 5
    bad = good[:at] + b"\xff\xff" + good[at + 2 :]
    rows = media.clips(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad)), (3, None)], "doc_id long, media binary")).collect()
    assert {r.doc_id for r in rows if r.error is None} == {1} and [r.doc_id for r in rows if r.error and "claims" in r.error] == [2]


def test_the_table_of_pre_tokens_decides_no_count(spark, docs, monkeypatch):
    from blocklens.llm import token_count

    whole = sorted((r.doc_id or -1, r.n_tokens) for r in token_count.count_tokens(docs).collect())
    for name, value in (("SAMPLE", 3), ("SAMPLERS", 2), ("REPORT", 5)):
        monkeypatch.setattr(token_count, name, value)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_count.count_tokens(docs).collect()) == whole
