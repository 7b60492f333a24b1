"""Token counts beside the library's on odd strings, and what a worker remembers of them."""

import random

import pytest

pytest.importorskip("matchgrain.llm")
import public_tokenizers
from tokenizers import Tokenizer

from matchgrain.llm import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["word", "Word", "s", "'s", "don't", "é", "ñ", "³", "12", "_", ".", ",", "...", "?!", ";:", "\n", "\r\n", " ", "  ", "\t", "　", "\xa0", "\x00", "漢字", "ไทย", "हिन्दी", "é", "👩‍🚀", "ǅ", "\U00013000", "<|endoftext|>", "<|end", "x" * 120, "ab" * 60 + "."]


@pytest.fixture
def loaded():
    return byte_bpe.load.__wrapped__(VOCABULARY)


@pytest.mark.parametrize("size", [byte_bpe.MEMO_SIZE, 4])
def test_counts_equal_the_library_whatever_is_remembered(loaded, monkeypatch, size):
    monkeypatch.setattr(byte_bpe, "MEMO_SIZE", size)
    r, library = random.Random(4), Tokenizer.from_file(VOCABULARY)
    for _ in range(4000):
        text = r.choice([" ", " ", "", "\n"]).join(r.choice(PARTS) for _ in range(r.randrange(9)))
        assert byte_bpe.count_tokens(text, *loaded) == len(library.encode(text, add_special_tokens=False).ids), text


def test_memo_is_bounded_where_white_space_is_mixed(loaded, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_SIZE", 5)
    memo, added = loaded
    byte_bpe.count_tokens(" \n".join(f"{'ab' * i}_{i}" for i in range(50)), memo, added)
    assert len(memo) <= 5 and len(memo.pieces) <= 5


def test_word_in_use_outlives_a_full_memo(loaded, monkeypatch):
    merged, merge = [], byte_bpe.merge_count
    monkeypatch.setattr(byte_bpe, "MEMO_SIZE", 4)
    monkeypatch.setattr(byte_bpe, "merge_count", lambda *args: merged.append(args[0]) or merge(*args))
    words = [w for i in range(20) for w in ("often", "rare" + "x" * i)]
    byte_bpe.count_tokens(" ".join(["first", *words]), *loaded)
    assert len(merged) == 1 + 1 + 20
