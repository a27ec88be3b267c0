import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blocklens.llm import jaccard, langid, media, mixing, packing, sharding, simhash, token_count, token_files, toxicity
from blocklens.llm.common import new_path, tokenizer_path

from .conftest import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def encoded(name, text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# 1


@pytest.mark.parametrize("first", [0, 3_474_701_531, (1 << 32) - 3, 3 << 34])
def test_points_of_far_slots(spark, first):
    """Slots beyond what a product of 64 bits holds."""
    got = spark.range(first, first + 6).selectExpr("id", f"{mixing.point('id')} as x").collect()
    assert [(r.id, r.x) for r in got] == [(i, i * mixing.GOLDEN % mixing.UNIT) for i in range(first, first + 6)]


def test_targets():
    assert mixing.targets([100, 100], [3, 1]) == [200.0, 100.0]
    assert mixing.targets([10, 100, 0], [3, 1, 2]) == [20.0, 145.0, 0.0]
    assert mixing.targets([0, 0], [3, 1]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_mix(docs, none):
    got = mixing.mix_digest(docs, block=16)
    again = {(r.doc_id, r.source): r.taken for r in mixing.mix_digest(docs.repartition(2), block=16).collect()}
    rows_ = got.collect()
    assert len(rows_) == docs.count() and all(again[r.doc_id, r.source] == r.taken for r in rows_ if r.doc_id != 9)
    taken, target = Counter(), {}
    for r in rows_:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    con = duckdb.connect()
    documents = docs.where("doc_id is null or doc_id <> 9").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con.sql("create table documents as select * from documents")
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(((None if r[0] is None else int(r[0]), r[-1]) for r in con.sql(mixing.oracle(16)).fetchall()), key=key)
    mine = mixing.mix_digest(docs.where("doc_id is null or doc_id <> 9"), block=16)
    assert sorted(((r.doc_id, r.taken) for r in mine.collect()), key=key) == want
    assert mixing.mix_digest(none).count() == 0


# 2


def test_token_files(spark, docs, none):
    path = new_path(spark, "t")
    token_files.write_token_files(docs, path, "word_bpe_49k.json", 1, spaced=False)
    got = sorted(token_files.token_digest(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, want in zip(got, order, strict=True):
        ids = encoded("word_bpe_49k.json", want[1])
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want[0], at, len(ids), crc(ids))
        at += len(ids)
    some = token_files.read_token_files(spark, path, token_files.F.col("doc_id") == 8).select("ids").collect()
    assert [r.ids for r in some] == [encoded("word_bpe_49k.json", "one two three")]
    empty = new_path(spark, "t")
    token_files.write_token_files(none, empty, "word_bpe_49k.json", 1, spaced=False)
    assert token_files.token_digest(spark, empty).count() == 0


# 3


def test_token_counts(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for table in (50, 0):
        got = token_count.count_tokens(docs, table=table or 1).collect()
        assert len(got) == len(rows())
        for r in got:
            assert r.n_tokens == len(model.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 4096)
    assert token_count.count_tokens(none).count() == 0


def test_token_counts_of_many_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = ["\U0001F9FF" * 64, "\U00012345" * 64, "a " + "\U00012345" * 64 + " b"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert max(len(model.encode(t)) for t in texts) > 256
    assert sorted(r.n_tokens for r in token_count.count_tokens(df).collect()) == sorted(len(model.encode(t)) for t in texts)


# 4


def check_pieces(pieces, window):
    by_doc, by_seq = {}, {}
    for key, at, ids, total, seq, offset in pieces:
        by_doc.setdefault(key, []).append((at, ids, total))
        by_seq.setdefault(seq, []).append((offset, len(ids)))
    for own in by_seq.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end and n > 0
            end += n
        assert end <= window
    return {k: (sum((list(i) for _, i, _ in sorted(v, key=lambda x: x[0])), []), v[0][2]) for k, v in by_doc.items()}, [sum(n for _, n in v) for v in by_seq.values()]


def test_packing(docs, none):
    got = packing.pack_documents(docs.where("doc_id <> 9"), "byte_bpe_50k.json", 1, spaced=True, window=64).collect()
    whole, sizes = check_pieces([(r.doc_id, r.start, r.ids, r.doc_tokens, r.sequence_id, r.offset) for r in got], 64)
    for r in rows():
        if r[0] is not None and r[0] != 9:
            ids = encoded("byte_bpe_50k.json", r[1])
            assert whole[r[0]] == (ids, len(ids))
    assert all(n & (n - 1) == 0 for n in sizes)
    digest = packing.packing_digest(packing.pack_documents(docs, "byte_bpe_50k.json", 1, spaced=True, binary=True))
    texts = {r[0]: r[1] for r in rows()}
    for r in digest.where("doc_id <> 9").collect():
        assert r.ids_crc32 == crc(encoded("byte_bpe_50k.json", texts[r.doc_id])[r.start : r.start + r.length])
    assert digest.where("doc_id = 9").count() == 2 and digest.where("doc_id = 3 and ids_crc32 = %d" % crc([1])).count() == 1
    assert packing.pack_documents(none, "byte_bpe_50k.json", 1, spaced=True).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([2, 5, 100]))
def test_sum_of_squares(sizes, most):
    p, out = packing.SumOfSquares(32, most), []
    for k, n in enumerate(sizes):
        free = [h for h in range(1, 32) if p.levels[h] > 0]
        if n < 32 and p.n_open < most:
            def after(h):
                c = p.levels.copy()
                c[32] = 0
                if h:
                    c[h] -= 1
                if h + n < 32:
                    c[h + n] += 1
                return (c**2).sum()

            assert after(p.best(n)) == min(after(h) for h in [0, *free] if h + n <= 32)
        out += list(p.add(k, np.full(n, k, "<u4").tobytes()))
        assert p.n_open <= most
    out += list(p.finish())
    pieces = []
    for s, seq in enumerate(out):
        offset = 0
        for key, at, ids, total in seq:
            pieces.append((key, at, np.frombuffer(ids, "<u4").tolist(), total, s, offset))
            offset += len(ids) // 4
    whole, lengths = check_pieces(pieces, 32)
    assert whole == {k: ([k] * n, n) for k, n in enumerate(sizes)} and all(n & (n - 1) == 0 for n in lengths)


# 5


def test_grammar():
    g = toxicity.GRAMMAR
    assert g.outputs("PoS") == "PoA" and g.outputs("NS") == "Nn" and g.outputs("RooS") == "Roor" and g.outputs("S") == "S"
    assert g.outputs("GT") == "GX" and g.outputs("oT") == "ot" and g.outputs("NooooS") == "NooooS" and g.outputs("PNS") == "PNn"


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("you idiot", "A"), ("he said: you idiot", "r"), ("you aren't an idiot", "n"), ("You\u2019re not an idiot", "n"), ("idiots like you", "A"), ("idiots came. you left", "S"),
        ("they'll kill you", "X"), ("kill the lights", "t"), ("er sagte: du idiot", "r"), ("du bist kein idiot", "n"), ("vous idiot", "A"), ("il n'est pas idiot", "n"), ("eres idiot, todos", "A"),
    ],
)
def test_grammar_of_clauses(text, kinds):
    found = toxicity.Toxicity([]).clauses(text)
    assert {k for k in toxicity.LIVE + toxicity.SPENT if found[k]} == set(kinds)
    assert bool(found["strong matches"] + found["medium matches"] + found["weak matches"]) == any(k in toxicity.LIVE for k in kinds)


def sentences(seed, n):
    """Prose with a sentence that has an insult: addressed or bare (toxic), or negated or reported (clean)."""
    r, out = np.random.default_rng(seed), []
    for k in range(n):
        word = ("idiot", "moron", "loser", "scum")[r.integers(4)]
        spent = (f"he was never a {word}", f"they aren't {word}", f"she said that a {word} came", f"it is not the {word}")[r.integers(4)]
        live = (f"you {word}", f"what a {word}", f"every {word} left", f"{word} like you")[r.integers(4)]
        out.append((f"{prose(seed + k, 30)}. {spent if k % 2 else live}. {prose(seed + k + 1, 30)}.", int(k % 2 == 0)))
    return out


def test_score_comes_from_the_grammar(monkeypatch):
    """Without the grammar's rewriting, spoken and denied insults are taken for the real thing; with it they aren't."""
    train, test = sentences(0, 200), sentences(5000, 100)

    def wrong(model):
        return sum((model.score(t) >= 0.3) != bool(y) for t, y in test)

    model = toxicity.Toxicity(train)
    assert wrong(model) <= 3
    at = {k: float(w) for k, w in zip(toxicity.NAMES, model.weights)}
    assert all(at[k] <= 0 for k in toxicity.SPENT) and all(at[k] >= 0 for k in toxicity.LIVE)
    base = model.score(prose(1, 60))
    assert model.score(prose(1, 60) + ". he is not an idiot") <= base + 1e-9 and model.score(prose(1, 60) + ". you idiot") > base
    monkeypatch.setattr(toxicity, "transduce", lambda symbols: symbols)
    assert wrong(toxicity.Toxicity(train)) >= 10


@settings(max_examples=200, deadline=None)
@given(st.text("SMWTPNRGo", max_size=14))
def test_composed_machine(symbols):
    """The composition gives what the transducers give one after the other, each in a pass of its own."""

    def alone(rules, text):
        state, out = 0, ""
        for x in text:
            to, y = rules.get((state, x)) or rules.get((state, "*")) or (0, "*")
            state, out = to, out + (x if y == "*" else y)
        return out

    plain = symbols
    for rules in (toxicity.NEGATION, toxicity.REPORTING, toxicity.TARGETING, toxicity.THREATENING):
        plain = alone(rules, plain)
    assert toxicity.GRAMMAR.outputs(symbols) == plain
    assert toxicity.transduce(symbols)[::-1] == alone(toxicity.FOLLOWING.parts[0], plain[::-1])


def test_names_that_clash(spark, none):
    """Input columns by the names that operators once used for themselves, and a long text."""
    df = spark.createDataFrame([(1, prose(3, 30_000), "en", "u"), (2, None, None, None)], "doc_id long, text string, lang string, __text string")
    assert token_count.count_tokens(df).columns == ["doc_id", "text", "lang", "__text", "n_bytes", "n_tokens", "over_limit"]
    assert [r.doc_id for r in token_count.count_tokens(df).orderBy("doc_id").collect()] == [1, 2]
    assert toxicity.score_toxicity(df, toxicity.Toxicity([])).where("score between 0 and 1").count() == 2
    assert langid.identify_language(df, langid.Hierarchy([], [])).where("lang_pred = 'und'").count() == 2


def test_toxicity(spark, docs, none):
    train = [(k, prose(k, 60) + (".\nzzbad you idiot" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(300)]
    df = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int")))
    out = toxicity.score_toxicity(df, model).collect()
    assert all(r.predicted == r.toxic for r in out)
    edge = toxicity.score_toxicity(docs, model)
    assert edge.count() == len(rows()) and edge.where("score is null or score < 0 or score > 1").count() == 0
    assert edge.where("doc_id in (3, 4)").select("score").distinct().count() == 1
    assert toxicity.score_toxicity(none, model).count() == 0
    bare = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert bare.score("you idiot") > 0.3 > bare.score("a fine day")


# 6


def test_media(docs, none):
    got = media.media_digest(media.store_texts(docs)).collect()
    assert len(got) == len(rows())
    for r in got:
        text = next((x[1] or "").encode() for x in rows() if x[0] == r.doc_id)
        data = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert media.media_digest(media.store_texts(none)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=9000), min_size=1, max_size=4))
def test_media_round_trip(texts):
    data = [t + bytes(-len(t) % 64 or (0 if t else 64)) for t in texts]
    files = media.encode(data)
    assert [media.payload(*x) for x in media.decode(files)] == data
    p = media.parse(files[0])
    assert p["frame_us"] == 40_000 and all(files[0][a : a + 2] == b"\xff\xd8" and files[0][a + n - 2 : a + n] == b"\xff\xd9" for a, n in p["frames"])


def test_long_media_in_slices():
    """A text of many slices; what coding needs besides the text and the file is bounded."""
    import tracemalloc

    rng = np.random.RandomState(0)
    big = rng.randint(0, 256, 6_000_064).astype("uint8").tobytes()
    media.decode(media.encode([big[:64]]))
    tracemalloc.start()
    files = media.encode([big, b"a" * 64])
    parsed = media.decode(files)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert media.payload(*parsed[0]) == big and media.payload(*parsed[1]) == b"a" * 64
    assert len(media.shots(parsed[0][1])) >= 1
    assert peak < 150e6  # 25 bytes a byte of text before


def test_shots_and_bad_media(spark):
    frames = np.zeros((12, 64, 64), "uint8")
    frames[4:8], frames[8:] = 100, 200
    assert media.shots(frames) == [(0, 4), (4, 8), (8, 12)] and media.shots(frames[:0]) == []
    good = media.encode([frames.tobytes()])[0]
    out = media.clips(spark.createDataFrame([(1, good), (2, b"junk"), (3, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.first_frame, r.last_frame, r.start_ms) for r in out if r.error is None] == [(1, 0, 3, 0.0), (1, 4, 7, 160.0), (1, 8, 11, 320.0)]
    assert [r.doc_id for r in out if r.error] == [2]


# 7


def test_language(spark, docs, none):
    alphabets = {"en": "abcdefgh", "de": "abcdxyzä", "fr": "mnopqrsé", "es": "mnoptuvñ"}
    rng = np.random.RandomState(0)
    train = [(k, " ".join("".join(rng.choice(list(alphabets[c]), 5)) for _ in range(40)), c) for k, c in enumerate(list(alphabets) * 40)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert all(r.lang_pred == r.lang for r in langid.identify_language(df, model).collect())
    out = langid.identify_language(docs, model).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out) and {r.doc_id for r in out if r.lang_pred == "und"} == {3, 4, 5, 6}
    assert langid.identify_language(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify_language(docs, langid.fit(none)).collect()} == {"und"}


# 8


def test_places(docs):
    """Slots by a plain hash of the key, shards by the table."""
    import xxhash

    table = sharding.fill_table(list(sharding.SHARDS))
    for r in sharding.place(docs).collect():
        h = xxhash.xxh64(str(r.doc_id).encode(), seed=42).intdigest() if r.doc_id is not None else 42
        slot = (h - (1 << 64) * (h >> 63)) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])


def test_language_by_hand(spark):
    """Families by the largest margin, then votes of pairs, summed term by term."""
    rows_ = [(prose(k, 20) + w, lang) for k in range(30) for lang, w in (("en", " the"), ("de", " \u00fcber und"), ("fr", " \u00e7a et"), ("es", " ni\u00f1o"))]
    model = langid.Hierarchy([t for t, _ in rows_], [lang for _, lang in rows_])

    def margin(weights, v):
        return sum(float(w) * float(x) for w, x in zip(weights, v)) + float(weights[-1])

    for text, _ in rows_[::7]:
        v = langid.features(text)
        family = max(model.names, key=lambda f: margin(model.top[model.names.index(f)], v))
        wins = dict.fromkeys(model.families[family], 0)
        for (a, b), w in zip(model.pairs, model.inside):
            if a in wins:
                wins[a if margin(w, v) >= 0 else b] += 1
        assert model.predict(text)[0] == max(wins, key=wins.get)


def test_sharding(docs, none):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    counts = Counter(table)
    assert len(table) == 1009 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.35 * 1009
    # plain version: each shard's whole preference list
    lists = [[(sharding._number(s, "offset") % 1009 + k * (sharding._number(s, "skip") % 1008 + 1)) % 1009 for k in range(1009)] for s in names]
    plain, turn = {}, 0
    while len(plain) < 1009:
        slot = next(x for x in lists[turn % 7] if x not in plain)
        plain[slot] = turn % 7
        turn += 1
    assert table == [plain[i] for i in range(1009)]
    out = sharding.place(docs).collect()
    assert len(out) == len(rows()) and len({r.shard for r in out if r.doc_id == 9}) == 1
    assert sharding.place(none).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 1000)


# 9


@pytest.mark.parametrize("per_bucket", [1, 5, 1000])
def test_fingerprints(docs, per_bucket):
    got = {(r.doc_id, r.edited_sha256): r for r in simhash.fingerprint_digest(docs, per_bucket).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    prints = {r.doc_id: r.fingerprint for r in got.values()}
    assert simhash.fingerprint_digest(docs, per_bucket).count() == len(order)
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[key, hashlib.sha256(edited.encode()).hexdigest()]
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r.n_chars == len(text) and r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, prints[after[0]])
    assert prints[0] == prints[1] and prints[3] == prints[4] == prints[5] == "0" * 16


def test_no_fingerprints(none, spark):
    assert simhash.fingerprint_digest(none).count() == 0
    one = simhash.fingerprint_digest(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_near_counts(spark):
    """Rows whose id 2 divides, against all rows, by brute force."""
    rows_ = [(k, prose(k % 7, 60) + (f" w{k}" if k % 3 else "")) for k in range(80)] + [(None, prose(3, 60)), (7, None)]
    got = simhash.fingerprint_digest(spark.createDataFrame(rows_, "doc_id long, text string"), radius=6, every=2).collect()
    fps = {int(r.fingerprint, 16) for r in got}
    assert len(got) == len(rows_) and any(r.n_near for r in got)
    for r in got:
        own = int(r.fingerprint, 16)
        assert r.n_near == (sum(0 < (own ^ f).bit_count() <= 6 for f in fps) if r.doc_id is not None and r.doc_id % 2 == 0 else None)


def test_fingerprint_bits(spark):
    """Each bit by a plain vote of the weighted terms."""
    import xxhash

    def h64(word, seed):
        return xxhash.xxh64(word.encode(), seed=seed % (1 << 64)).intdigest()

    texts = ["", "one", "one two", "The cat sat on THE mat", prose(1, 300), "a b a b a b c", "\u00e9t\u00e9 na\u00efve caf\u00e9"]
    rows_ = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), ["k"]).collect()
    for r in rows_:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", texts[r.k].lower()) if w]
        terms = [(h64(b, h64(a, 42)), min(15, len(a) + len(b))) for a, b in zip(words, words[1:])] or [(h64(w, 42), min(15, len(w))) for w in words]
        total = sum(w for _, w in terms)
        want = sum(1 << b for b in range(64) if 2 * sum(w for h, w in terms if h >> b & 1) > total)
        assert r.fp % (1 << 64) == want, texts[r.k]


def test_near_pairs(spark):
    rng = np.random.RandomState(1)
    base = [int(x) for x in rng.randint(-(2**62), 2**62, 40)]
    fps = [*base, *[b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False) if k < 63) for b in base for n in (1, 3, 5)], base[0]]
    signed = sorted(set(fps))
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.near_pairs(spark.createDataFrame([(f,) for f in fps] + [(None,)], "fp long"), 3).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 40


# 10


def plain_sets(texts):
    out = {}
    for k, t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_components(sets):
    comp = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    return comp


def test_components_on_edges(docs, none):
    got = jaccard.jaccard_components(docs).collect()
    sets = plain_sets([(r[0], r[1]) for r in rows() if r[0] is not None])
    comp = plain_components(sets)
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id]), r
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_components_of_families(spark, block):
    """Families whose members lie about the threshold, a shared passage, and blocks smaller than the families."""
    rng = np.random.RandomState(3)
    passage, out = prose(999, 60), []
    for f in range(6):
        base = prose(f, 80).split()
        for m in range(12):
            w = list(base)
            for k in rng.choice(80, rng.randint(0, 5), replace=False):
                w[k] = f"edit{rng.randint(10**6)}"
            out.append((len(out) * 3, " ".join(w) + ("\n" + passage if f % 2 else "")))
    out += [(1000 + k, prose(500 + k, 40) + " " + passage) for k in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(out, "doc_id long, text string"), block=block, hot=50).collect()}
    sets = plain_sets(out)
    comp = plain_components(sets)
    assert got == {k: (len(sets[k]), comp[k]) for k in sets}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), max_size=40), min_size=1, max_size=60), st.booleans())
def test_tree_join(raw, sided):
    sets = [np.array(sorted((x * 0x9E3779B97F4A7C15) % (1 << 64) for x in s), "uint64") for s in raw]
    sides = [i % 2 for i in range(len(sets))] if sided else None
    pairs = {(i, j) for i in range(len(raw)) for j in range(i + 1, len(raw)) if raw[i] and raw[j] and 5 * len(raw[i] & raw[j]) >= 4 * len(raw[i] | raw[j]) and (sides is None or sides[i] != sides[j])}

    def united(edges):
        up = list(range(len(raw)))
        for a, b in edges:
            low, high = sorted((up[a], up[b]))
            up = [low if v == high else v for v in up]
        return up

    assert united(jaccard.join_by_tree(sets, list(range(len(sets))), sides)) == united(pairs)
    signed = [jaccard.signatures(s) for s in sets]
    may = jaccard.may_link([len(s) for s in sets], [x[0] for x in signed], [x[1] for x in signed], list(range(len(sets))), sides)
    assert all(may[i] and may[j] for i, j in pairs)
    leaf = jaccard.may_link([len(s) for s in sets], None, [x[1] for x in signed], list(range(len(sets))), sides)
    assert all(leaf[i] and leaf[j] for i, j in pairs)
    assert all(jaccard._two_may_link((len(sets[i]), signed[i][1]), (len(sets[j]), signed[j][1])) for i, j in pairs)


def test_tree_drops_unlike_documents():
    """Of many random sets the trees and sketches keep the copies alone."""
    rng = np.random.RandomState(1)
    sets = [np.unique(rng.randint(0, 1 << 62, rng.randint(150, 260)).astype("uint64")) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[5:], rng.randint(0, 1 << 62, 3).astype("uint64")])) for s in sets[:10]]
    signed = [jaccard.signatures(s) for s in sets]
    may = jaccard.may_link([len(s) for s in sets], [x[0] for x in signed], [x[1] for x in signed], list(range(len(sets))))
    assert may.nonzero()[0].tolist() == [*range(10), *range(300, 310)]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 3, 2), (3, 2, 1, 0)])
def test_repeated_ids_keep_all_links(spark, order):
    """A doc_id whose rows have different texts has the links of each, in any order of the rows."""
    a, b = prose(1, 60), prose(2, 60)
    rows_ = [(1, a), (1, b), (5, a + " x y"), (6, b + " x y")]
    df = spark.createDataFrame([rows_[k] for k in order] + [(9, prose(3, 60)), (1, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()) == [(1, 1), (1, 1), (1, 1), (5, 1), (6, 1), (9, 9)]


def test_long_documents_in_blocks(spark, monkeypatch):
    """Cells are split by sizes, too: near copies of very different lengths, with blocks of few shingles."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)
    rng, out = np.random.RandomState(5), []
    base = prose(77, 300).split()
    for k in range(60):
        w = base[: 60 + 4 * k]
        w[rng.randint(len(w))] = f"edit{k}"
        out.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(out, "doc_id long, text string"), block=8, hot=30).collect()}
    sets = plain_sets(out)
    comp = plain_components(sets)
    assert got == {k: (len(sets[k]), comp[k]) for k in sets}


def test_prefixes_meet():
    rng = np.random.RandomState(0)
    for _ in range(200):
        a = np.unique(rng.randint(0, 10**9, rng.randint(1, 60)).astype("uint64"))
        b = np.unique(np.concatenate([a[rng.rand(len(a)) < 0.93], rng.randint(0, 10**9, 2).astype("uint64")]))
        if jaccard.linked(a, b):
            hot = np.sort(rng.permutation(np.union1d(a, b))[:10])
            rank = rng.permutation(len(hot))
            assert len(np.intersect1d(*(np.concatenate(jaccard.prefix(x, hot, rank)) for x in (a, b))))
