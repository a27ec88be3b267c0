"""The pipeline's stages against plain versions of their decisions."""

import random

import corpus_pipeline
from blocklens.llm import jaccard, langid, mixing, toxicity

from .conftest import prose
from .test_operators import encoded, plain_components, plain_sets


def test_stages(spark, tmp_path):
    rows = [(k, prose(k, 40 + k % 7) + (" you zzbad idiot" if k % 6 == 0 else ""), "en" if k % 2 else "fr", "s%d" % (k % 3)) for k in range(120)]
    rows += [(500, rows[5][1], "en", "s0"), (501, "123 456", None, None), (502, None, "en", "s1"), (503, rows[5][1] + " tail", None, "s0")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 6 == 0), 1) for k in range(120)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mix", "pack"]
    one = corpus_pipeline.language(spark, docs, str(tmp_path)).cache()
    model = langid.fit(docs)
    want = {r[0] for r in rows if model.judge(r[1])[2]}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns and not want & {501, 502}

    two = corpus_pipeline.toxic(spark, one, str(tmp_path)).cache()
    scores = toxicity.fit(one, spark.read.parquet(str(tmp_path / "labels.parquet")))
    kept = {r.doc_id for r in one.collect() if scores.score(r.text) < corpus_pipeline.TOXIC}
    assert {r.doc_id for r in two.collect()} == kept and two.columns == docs.columns and not any(k % 6 == 0 and k < 500 for k in kept)

    three = corpus_pipeline.near_duplicates(spark, two, str(tmp_path)).cache()
    comp = plain_components(plain_sets([(r.doc_id, r.text) for r in two.collect()]))
    assert sorted(r.doc_id for r in three.collect()) == sorted(k for k, v in comp.items() if k == v) and three.columns == docs.columns

    four = corpus_pipeline.mix(spark, three, str(tmp_path)).cache()
    source = {r.doc_id: (r.text, r.source) for r in three.collect()}
    wanted = {r.source: r.target for r in mixing.mix_digest(three).collect()}
    words, got = dict.fromkeys(wanted, 0), {}
    for r in four.collect():
        words[r.source] += len(r.text.split())
        got.setdefault(r.doc_id, []).append(r)
        assert source[r.doc_id][0].startswith(r.text) and r.n_chars == len(r.text)
    assert four.columns == docs.columns and all(abs(words[s] - wanted[s]) <= 1 for s in wanted)
    assert all(sum(r.text != source[k][0] for r in rs) <= 1 for k, rs in got.items())

    five = corpus_pipeline.pack(spark, four, str(tmp_path)).collect()
    assert sum(r.length for r in five) == sum(len(encoded("byte_bpe_50k.json", r.text)) for rs in got.values() for r in rs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert jaccard.N == 5


def test_language_stage_rejects_unlearned_languages(spark, tmp_path):
    syllables = {"en": "the and ing ion ent for tha nde has wh er at", "de": "ein sch ung der ich und che zu ver ä ß gen", "fr": "les eau ment que oir des é è tion aux en la", "es": "ción que los ñ ado de ar os mente ez la ll", "pl": "się nie prz ów ło wie czy ą dz ny ie go"}

    def text(lang: str, seed: int, words: int) -> str:
        r = random.Random(f"{lang}{seed}")
        return " ".join("".join(r.choices(syllables[lang].split(), k=r.randint(1, 3))) for _ in range(words))

    foreign = ["Москва является столицей России и крупнейшим городом страны.", "日本語の文章はここにあります。これはテストです。", "xqzv kkkj wrtp zzxq bvcm plkj qqqw", "Suomi on tasavalta ja sen pääkaupunki on Helsinki, jossa asuu paljon ihmisiä."]
    for learned in (["en", "de", "fr", "es"], ["en", "de", "fr", "es", "pl"]):
        rows = [(len(learned) * k + i, text(lang, k, 5 + 7 * (k % 9)), lang) for k in range(60) for i, lang in enumerate(learned)]
        clean = [(10_000 + 100 * i + k, text(lang, 1_000 + k, 2 + k % 3), None) for i, lang in enumerate(learned) for k in range(20)]
        odd = [(20_000 + k, t, None) for k, t in enumerate(foreign)]
        docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows + clean + odd], "doc_id long, text string, lang string, source string, n_chars long")
        kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
        assert kept == {r[0] for r in rows + clean}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_edges(spark, tmp_path):
    """Nulls in any column, blank and repeated rows, ties, clashing columns, and empty tables, through each stage."""
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, b, None, None), (2, a + " x", "en", "t"), (3, None, None, None), (4, " ", "en", "s"), (None, b + " y", "en", "s"), (None, None, None, None)]
    wide = COLUMNS + ", score double, size string, taken int, k int, known string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 1, 2, "z") for r in rows], wide)
    none = spark.createDataFrame([], wide)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        out.collect()
        assert name == "pack" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept == sorted([(1, a), (3, None), (4, " "), (None, b + " y"), (None, None)], key=str)
    # repeated rows each get their share
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed if not (r.text or "").strip()} == {3, 4, None}
    taken = sum(r.taken for r in mixing.mix_digest(docs).collect())
    assert sum(len((r.text or "").split()) for r in mixed) == taken
