"""Very long texts: whole results, in time that grows with the length."""

import random
import time

import numpy as np
from panelforge.llm.packing import EndToEnd, Windows
from panelforge.llm.tokens import PIECE, WordTokenizer, public_vocabulary


def test_ids_of_odd_words_equal_the_plain_encoding():
    t = WordTokenizer(public_vocabulary("word_bpe_49k.json"), words=200)
    letters, r = "aAéÉßİıŒœŸ'.,-0½ªµ́­×ǅΣσςs l t<|>x\xa0\x85", random.Random(5)
    texts = ["".join(r.choice(letters) for _ in range(150)) for _ in range(300)] + ["", " ", None]
    plain = [np.array(t._plain(x or ""), dtype="<u4").tobytes() for x in texts]
    assert t.encode(texts) == plain
    assert [t.encode([x])[0] for x in texts[:60]] == plain[:60]


def test_a_text_over_several_blocks_equals_its_words():
    t = WordTokenizer(public_vocabulary("word_bpe_49k.json"))
    base = "Überall the Quick, brown-fox "
    one, many = t.encode([base])[0], 2 * PIECE // len(base) + 5
    long, small = t.encode([base * many, base])
    assert small == one and long == one * many


def test_windows_are_linear_in_a_text():
    def seconds(megabytes):
        ids = np.arange(megabytes << 18, dtype="<u4").tobytes()
        state, begun = Windows(4096, 8, 32, 0), time.perf_counter()
        state.add(1, 0, ids, len(ids) // 4)
        assert b"".join(x[3] for x in state.done) == ids
        assert [x[1] for x in state.done] == list(range(0, len(ids) // 4, 4096))
        return time.perf_counter() - begun

    seconds(4)
    assert seconds(128) < 5


def test_end_to_end_cuts_one_long_piece():
    state = EndToEnd(16, 0)
    ids = np.arange(16 * 9 + 5, dtype="<u4").tobytes()
    state.add(7, 3, ids, 99)
    state.finish()
    assert b"".join(x[3] for x in state.done) == ids
    assert [x[2] for x in state.done] == [16] * 9 + [4, 1]
    assert [x[1] for x in state.done] == [3 + 16 * k for k in range(10)] + [3 + 148]


def test_the_tokenizer_holds_few_words_whatever_a_text_has():
    tokenizer = WordTokenizer(public_vocabulary("word_bpe_49k.json"))
    letters = "abcdefghijklmnop"
    name = lambda i: "".join(letters[i >> 4 * k & 15] for k in range(5))
    text = " ".join(name(i) for i in range(450_000))
    whole = tokenizer.encode([text])[0]
    assert len(tokenizer.new) + len(tokenizer.old) <= 300_000
    assert whole[-4000:] == WordTokenizer(public_vocabulary("word_bpe_49k.json")).encode([text[-12000:]])[0][-4000:]
