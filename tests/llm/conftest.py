from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, chunk string, node string, content string, replica string, place string, start string, rank string, `group` string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A frame of (doc_id, text[, source]) rows, with columns whose names the operators use inside."""

    def make(rows):
        rows = [(*r, "s0")[:3] for r in rows]
        return spark.createDataFrame([(i, t, None if i == 3 else "en", s, None if t is None else len(t), *"abcdefghi") for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, long, short, blank, null and repeated rows, and null ids."""
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(12)]
    passage = words(rng, 70)
    rows: list[tuple] = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[0]) for i in range(5)]
    for i in range(6):
        own = base[1].split(" ")
        own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((30 + i, " ".join(own)))
    rows += [(40 + i, words(rng, 40) + " " + passage + "\n" + words(rng, 30)) for i in range(4)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one two"), (54, "one two"), (55, words(rng, 6000) + " " + passage), (56, "x" * 300 + " " + words(rng, 30) + "\x0b \x0c" + words(rng, 30)), (57, "same " * 90)]
    rows += [(58, base[2]), (58, base[2]), (58, base[3]), (None, base[4]), (None, base[5] + " more"), (-7, base[6])]
    return rows
