"""Where the field of op4 looks, and long windows."""

from korvex.llm import pii


def test_windows_of_few_digits():
    for entity in ("8[.]8[.]8[.]8", "10 . 7 . 2 . 5", "1 dot 2 dot 3 dot 4", "1 2 3 4", "5.5.5.5", "1234"):
        text = "plain words " * 20 + entity + " plain words" * 20
        at = text.index(entity)
        assert any(a <= at and at + len(entity) <= b for a, b in pii.windows(text)), entity
    assert pii.windows("1, 2, 3, 4, 567 words without any more") == []


def test_long_windows_are_decoded_whole():
    w = pii.trained_weights()
    for lead in range(0, 12, 3):
        text = "x " * lead + " ".join(f"call (988) 555-{2000 + i} or 10 . 7 . 2 . {i % 9} now" for i in range(60))
        assert len(pii.windows(text)) == 1
        tokens = pii.tokens_of(text, 0, len(text))
        starts, ends, x = pii.lattice(tokens)
        base = pii.base_spans(text)
        want = [(kind, tokens[starts[s]][1], tokens[ends[s] - 1][2]) for s, kind in pii.decode(len(tokens), starts, ends, x @ w - 1.0)]
        want = [s for s in want if not any(a < s[2] and s[1] < b for _, a, b in base)]
        assert len(tokens) > 3 * pii.MAX_WINDOW and sorted(pii.added_spans(text, base, w)) == sorted(want) and len(want) > 50
