"""The split against the pattern, one text at a time."""

import random

import public_tokenizers as P
import regex

from boxoffice.llm import splitting


def test_same_as_the_pattern():
    assert splitting.PATTERN == P.PATTERN
    rng = random.Random(8)
    alphabet = list("aZé1٣²'''stredvlm  \n\t\r\x0b\x85\xa0　 !?.-#漢か한🙂") + ["'s", "'ll", "'re", "  ", "\n\n", " '", "ve"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(4000)]
    texts += ["", "'", "'s", "s'", "'l", "'l", "l", " ", "  ", "'r", "e", "I'm  he'll\n 'tis", "x" * 5000, " " * 5000]
    texts = [t for t in texts if splitting.is_settled(t)]
    data, starts, first = splitting.split(texts)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        cuts = starts[first[i] : first[i + 1] + 1].tolist() if first[i] < first[i + 1] else []
        got = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        assert got == regex.findall(P.PATTERN, text), repr(text)


def test_unsure():
    assert splitting.is_settled("plain é 漢字 🙂") and not splitting.is_settled("a\U0001e6d0") and not splitting.is_settled("ਪ")
    assert [len(x) for x in splitting.split([])] == [8, 1, 1] and [len(x) for x in splitting.split(["", ""])] == [8, 1, 3]
