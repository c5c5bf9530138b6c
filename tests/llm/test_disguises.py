"""Disguises that the channel models reach its decoder."""

import random

import numpy as np
import pytest

from timberline.llm import toxicity

from .test_python import words

DISGUISES = {
    "i.d.1.0.t": "idiot", "l_0_s_3_r": "loser", "s*t*u*p*1*d": "stupid", "1-d-1-o-t": "idiot",
    "iddioot": "idiot", "mooron": "moron",
    "los€r": "loser", "c£own": "clown", "£oser": "loser", "m€an": "mean", "mol€": "mole",
    "b a d": "bad", "b  a  d": "bad", "i  d  i  o  t": "idiot", "i . d . i . o . t": "idiot", "b.a.d": "bad", "b a  d": "bad", "b @ d": "bad",
}


@pytest.fixture(scope="module")
def restorer():
    rng = random.Random(12)
    corpus = [words(rng, 60) + " stupid loser idiot moron clown trash bad mean mole " for _ in range(200)]
    return toxicity.Restorer(toxicity.costs(toxicity.gram_counts(corpus).astype(float)))


@pytest.mark.parametrize("token", DISGUISES)
def test_disguise_is_marked_and_restored(restorer, token):
    want = DISGUISES[token].encode()
    for text, out in ((token, want), (f"bada {token} mola", b"bada " + want + b" mola"), (f"({token})", b"(" + want + b")")):
        assert next(restorer([text]))[2] == [out]
    # Texts beside it stay apart from it.
    assert next(restorer(["bada", token, "mola"]))[2] == [b"bada", want, b"mola"]


def test_plain_text_stays(restorer):
    for text in ["12.5 (a) b", "bada mola, 4370598173842409!", "€5 and £10, 50€", "1 2 3 4", "1.2.3.4", "bada€€€ mola$$$", "€", "a", "a b", ""]:
        assert next(restorer([text]))[2] == [text.encode()]
    spans = toxicity.disguised(np.frombuffer("bada-mola don't rato/mola ".encode(), np.uint8))
    assert not len(spans[0])
