"""Names of sections are found without going through every character and name of long lines."""

import random
import unicodedata
from difflib import SequenceMatcher

from tessera.operators import sections as S


def _plainly(line, language):
    """The rule as it is written: every name in order."""
    text = S.plain(line)
    if not text:
        return None, 0.0
    words, best, found = set(filter(None, S.SPLIT.split(text))), 0.0, None
    for section, name, own in S.names(language):
        near = 1.0 if text == name else S.HOLDS if name in text else max(len(words & own) / max(len(own), 1), SequenceMatcher(a=text, b=name).ratio() if 2 * min(len(text), len(name)) / (len(text) + len(name)) >= S.LEAST_NAME else 0.0)
        if near > best:
            best, found = near, section
    return (found, best) if best >= S.LEAST_NAME else (None, 0.0)


def test_lines_of_any_length_come_to_the_same_names():
    rng = random.Random(4)
    for language in ("en", "de", "fr", "xx"):
        vocabulary = [w for _, _, own in S.names(language) for w in sorted(own)] + ["of", "zz", "Éa", "ﬁn", "ß", "ạ́", "·"]
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 9, 40)))) for _ in range(150)] + [name[:-1] + "x" for _, name, _ in S.names(language)]
        assert [S.closest(x, language) for x in lines] == [_plainly(x, language) for x in lines]


def test_long_lines_cost_few_looks(monkeypatch):
    looked = []

    class Marks:
        normalize = staticmethod(unicodedata.normalize)

        @staticmethod
        def combining(c):
            looked.append(c)
            return unicodedata.combining(c)

    monkeypatch.setattr(S, "unicodedata", Marks)
    assert S.plain("Über  á " * 200) == ("uber a " * 200).strip()
    assert S.plain("plain words " * 200) == ("plain words " * 200).strip()
    assert len(looked) <= 4
