"""Disguised words of any length, with signs at their edges, and spaced signs."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("matchgrain.llm")
from matchgrain.llm import toxicity


@pytest.fixture(scope="module")
def restorer():
    text = " the stupid moron and an idiot say shit here this is with that bit hit fit it as if in " * 50
    c = np.array([0, 0, *map(toxicity.letter_class, " ".join(text.split())), 0])
    return toxicity.Restorer(toxicity.CharModel(np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3)))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("m" + "o" * 70 + "ron", "moron"), ("sh!+", "shit"), ('"sh!+",', "shit"), ("!d!0t", "idiot"), ("|diot", "idiot"), ("$ t u p i d", "stupid"), ("m 0 r o n", "moron"), ("! d ! 0 t", "idiot"), ("s h ! +", "shit"), ("b i t", "bit"), ("moron!", "moron"), ("m0r0n+", "moron")],
)
def test_disguised_words_are_restored(restorer, written, meant):
    assert meant in restorer.words(f"say {written} here")


def test_long_chunks_are_decoded_whole(restorer):
    assert restorer.words("m0r0n-" * 5000) == {"moron"}


def readings(model, lattice):
    """Every reading of a lattice with its cost, letter by letter."""
    out = {}
    for path in itertools.product(*lattice, [(" ", 0.0)]):
        a, b, total = 0, 0, 0.0
        for letters, extra in path:
            total += extra
            for c in letters:
                z = toxicity.letter_class(c)
                if z == b == 0:
                    continue
                total += model.cost[a][b][z]
                a, b = b, z
        text = "".join(letters for letters, _ in path).strip()
        out[text] = min(total, out.get(text, total))
    return out


def test_decoded_readings_are_the_cheapest_of_all(restorer):
    r, decoded = random.Random(6), 0
    chunks = ["sh1t", "!d!0t", "m00ron", "id1|t", "b-i-t", "é3ß", "5tup1d", "$h1+", "aabb", "0", "-"] + ["".join(r.choice("mornshtid0135$!|+-.é") for _ in range(r.randrange(1, 8))) for _ in range(300)]
    for chunk in chunks:
        for lattice in (toxicity.letters_lattice(chunk), toxicity.spaced_lattice(" ".join(c for c in chunk if c.isalnum() or c in toxicity.LEET))):
            if not lattice or np.prod([len(o) for o in lattice]) > 20_000:
                continue
            of = readings(restorer.model, lattice)
            found, least = restorer.model.decode(lattice), min(of.values())
            assert of[found] == pytest.approx(least, abs=1e-9), (chunk, found)
            decoded += 1
    assert decoded > 400
