import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): invented words, copies, near copies, shared passages, empty and null texts, one long text."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(900)]
    words = lambda n: [r.choice(vocab[: 40 + 860 * (r.random() < 0.5)]) for _ in range(n)]
    passage = words(60)
    rows = []
    for i in range(160):
        w = words(r.randint(0, 160))
        if i % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[: 34 + i % 9] if i % 2 else passage
        rows.append((i, " ".join(w) if i % 3 else "\n".join(w).title()))
    long = " ".join(words(6000))
    rows += [(160, long), (161, long), (162, long + " x"), (163, ""), (164, None), (165, "  \t "), (166, "one"), (167, "a a a a " * 30), (None, rows[3][1]), (168, rows[3][1]), (169, rows[3][1]), (3, rows[3][1])]
    for i in range(170, 190):
        w = rows[5 + 10 * (i % 2)][1].split()
        if w:
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    return rows
