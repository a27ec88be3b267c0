import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blocklens.llm.common import tokenizer_path
from blocklens.llm.tokens import PieceCounts, pre_tokens, word_ids

HARD = ["", " ", "  a", "a ", "a  b", "\n\n a", "a \n b", "a\nb\nc", "\na", "a\n", "x▁y ▁ z", "<|endoftext|> a<|endoftext|>  b", "<|ENDOFTEXT|> a", "a.<|endoftext|>,", "a\tb", "\x1c a",
        "日本 語。", "I'm  don't", "end.\nStart, of", "İstanbul ΣΑΣ", "é å", "x²! 3.14%%% a1,", "word!!''s it's, 's", "ΟΔΟΣ. ΟΔΟΣ", "ſ Ǆ ŉ", "A" * 300 + " b", "ﬁ ½."]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
class TestWordIds:
    def same(self, name, spaced, text):
        w = word_ids(name, spaced)
        want = np.asarray(w.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert w.ids(text) == want, text
        assert w.ids(text) == want, text  # from the tables

    def test_hard(self, name, spaced):
        for text in HARD:
            self.same(name, spaced, text)
        assert word_ids(name, spaced).ids(None) == b""

    def test_many_lines(self, name, spaced):
        lines = [f"{'wort日本x'[k % 7]}{k}" for k in range(10_000)]
        for text in ("\n".join(lines), "a " + "\n".join(lines) + " b", "\n\n".join(lines[:700]) + "\n" + "\n".join(lines), "語。\n" * 5_000 + "x", "<|endoftext|>\n" + "\n".join(lines)):
            self.same(name, spaced, text)

    def test_any(self, name, spaced):
        @settings(max_examples=300, deadline=None)
        @given(st.text(alphabet=st.one_of(st.sampled_from(list("abT Eé'.,!\n\t<|>sßİΣ1²▁ ")), st.characters(exclude_categories=["Cs"])), max_size=40))
        def check(text):
            self.same(name, spaced, text)

        check()


def test_piece_counts():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, counts = sentencepiece.SentencePieceProcessor(model_file=path), PieceCounts(path, {})

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(list("abT é.\n▁ ")), st.characters(exclude_categories=["Cs"])), max_size=40))
    def check(text):
        assert (sum(map(counts.__getitem__, pre_tokens(text))) if text else 0) == len(model.encode(text))

    check()
    for text in HARD:
        assert (sum(map(counts.__getitem__, pre_tokens(text))) if text else 0) == len(model.encode(text)), text
