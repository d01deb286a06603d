import difflib
import random
import time

import pytest

from lingloom.operators import diff


def reference(a, b):
    return [tuple(op[1:]) for op in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op[0] != "equal"]


@pytest.mark.parametrize("few", [0, diff.FEW])
def test_edits_are_those_of_the_sequence_matcher(few, monkeypatch):
    """Small alphabets, so that longest parts are tied and repeated; few = 0 sends all of them through the automaton."""
    monkeypatch.setattr(diff, "FEW", few)
    r = random.Random(5)
    for k in range(4000):
        letters = ("ab", "abc ", "一二三四五六七八")[k % 3]
        a = "".join(r.choices(letters, k=r.randint(0, 40)))
        if k % 2:
            b = "".join(c for c in a if r.random() > 0.1)
        else:
            b = "".join(r.choices(letters, k=r.randint(0, 40)))
        assert diff.edits(a, b) == reference(a, b), (a, b)


def test_repeated_word_with_losses():
    r = random.Random(6)
    words = ["Orre"] * 1200
    lost = ["Ore" if r.random() < 0.1 else w for w in words]
    a, b = " ".join(words), " ".join(lost)
    assert diff.edits(a, b) == reference(a, b)


def test_long_repetitive_text_ends():
    """33,000 characters of one word with 648 losses: under two seconds."""
    r = random.Random(7)
    words = [f"{'Orre' * (1 + k % 3)}tion" for k in range(3300)]
    chosen = set(r.sample(range(3300), 648))
    b = " ".join(w.replace("tion", "ton") if k in chosen else w for k, w in enumerate(words))
    a, began = " ".join(words), time.process_time()
    found = diff.edits(a, b)
    assert time.process_time() - began < 2
    rebuilt, at = [], 0
    for i, j, k, n in found:
        rebuilt += [a[at:i], b[k:n]]
        at = j
    assert "".join([*rebuilt, a[at:]]) == b


def test_nothing_in_common():
    assert diff.edits("abc", "xyz") == [(0, 3, 0, 3)]
    assert diff.edits("", "") == [] == diff.edits("ab", "ab")
    assert diff.edits("", "a") == [(0, 0, 0, 1)] and diff.edits("a", "") == [(0, 1, 0, 0)]


def test_seeded_matches_are_the_longest():
    """Texts with a few edits and returning words: what the pieces find is what the sequence matcher finds, also of equals."""
    r, found = random.Random(9), 0
    words = ["nation", "station", "na", "tion", "on on", "été"]
    for _ in range(1500):
        a = " ".join(r.choices(words, k=r.randint(1, 12)))
        b = a
        for _ in range(r.randint(1, 4)):
            i = r.randrange(len(b) + 1)
            b = b[:i] + r.choice(("", "", "n", "x")) + b[i + r.randint(0, 2) :]
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        got = diff.seeded_match(a, b)
        found += got is not None
        assert got in (None, (m.a, m.b, m.size)), (a, b)
        assert diff.edits(a, b) == reference(a, b), (a, b)
    assert found > 700


def test_sentences_that_lost_a_letter_are_compared_fast():
    r = random.Random(10)
    rows = []
    for _ in range(2000):
        a = " ".join("".join(r.choices("abcdefghiklmnoprstu", k=r.randint(2, 9))) for _ in range(18)) + " nation."
        rows.append((a, a.replace("tion", "ton")))
    began = time.process_time()
    assert all(diff.edits(a, b) for a, b in rows)
    ours, began = time.process_time() - began, time.process_time()
    assert all(reference(a, b) for a, b in rows[:200])
    assert ours < 4 * (time.process_time() - began)  # ten times the pairs
