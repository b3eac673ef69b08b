from collections import Counter

import numpy as np

from turnout.llm.pieces import Ragged


def coded(texts):
    return np.array([ord(c) for t in texts for c in t], "<u4"), np.array([len(t) for t in texts], np.int64)


def letters(values):
    return ["".join(map(chr, np.frombuffer(v, "<u4"))) for v in values]


TEXTS = ["", "one two, two. two one", "a  b", " lead", "end ", "x\ny z", "-- ,, 12! é?", "two one", "\n", "one"]


def test_texts_are_gathered_from_pieces_that_are_encoded_once():
    asked = Counter()

    def spaced(pieces):
        asked.update(pieces)
        return coded([" " + p for p in pieces])
    own = Ragged(coded, spaced)
    for _ in range(2):
        assert letters(own.values(TEXTS * 30)) == TEXTS * 30
    assert max(asked.values()) == 1 and {"one", "two", "z"} <= asked.keys() and not {"two,", "two.", ""} & asked.keys()


def test_remembered_pieces_are_bounded():
    own = Ragged(coded, lambda pieces: coded([" " + p for p in pieces]), limit=50)
    for n in range(40):
        texts = [" ".join(f"w{n + k}{'.' * (k % 2)}" for k in range(20)), *TEXTS]
        assert letters(own.values(texts)) == texts
        assert len(own.known) + len(own.heads) < 110
