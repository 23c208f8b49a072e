"""Chunks against a plain account of the rules."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from resona.operators import chunking as ch


def plain(text, most, overlap, separators):
    """The rules, one at a time, on lists of pieces."""
    sep = [s for s in separators if s in text][0]
    finer = separators[separators.index(sep) + 1 :]
    if sep:
        parts, rest = [], text
        while (k := rest.find(sep, 1 if parts or rest.startswith(sep) else 0)) > 0:
            parts.append(rest[:k])
            rest = rest[k:]
        parts.append(rest)
    else:
        parts = list(text)
    groups, run = [], []
    for p in parts:
        if max(1, len(p) // 4) < most:
            run.append(p)
        else:
            groups += [run, p]
            run = []
    groups.append(run)
    out = []
    for g in groups:
        if isinstance(g, str):
            out += plain(g, most, overlap, finer) if finer else [g]
            continue
        held = []
        size = lambda x: sum(max(1, len(p) // 4) for p in x)
        for p in g:
            if held and size(held) + size([p]) > most:
                out.append("".join(held))
                while size(held) > overlap or (held and size(held) + size([p]) > most):
                    held.pop(0)
            held.append(p)
        if held:
            out.append("".join(held))
    return [x.strip() for x in out if x.strip()]


WORDS = st.lists(st.sampled_from(["\n# ", "\n## ", "\n### ", "\n\n", "\n", ". ", " ", "word", "a", "longerwordthanothers", "é"]), max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.integers(2, 12), st.integers(0, 4))
def test_rules(text, most, overlap):
    if not text:
        return
    got = ch.split(text, most, overlap)
    assert got == plain(text, most, overlap, ch.SEPARATORS)
    if not overlap:
        assert "".join("".join(got).split()) == "".join(text.split())


def test_headings_come_first():
    text = "intro " * 3 + "\n# One\n" + "alpha. " * 12 + "\n# Two\nshort"
    got = ch.split(text, 24)
    assert got[0] == "intro intro intro" and got[1].startswith("# One") and got[-1] == "# Two\nshort"


def test_documents_add_up(spark, tmp_path):
    rows = [(1, "one two. three\n\nfour " * 40), (2, None), (3, " \n"), (4, ""), (5, "x"), (None, "null key"), (1, "again"), (6, "# H\n" + "word " * 3000)]
    docs = spark.createDataFrame([(k, t, "en", "c") for k, t in rows], "doc_id long, text string, lang string, chunk_id string")
    found = ch.chunks(docs, parent=100, child=20, overlap=5).collect()
    assert sorted((r.doc_id, r.text) for r in found if r.kind == "rejected") == [(2, "no text"), (3, "blank"), (4, "blank")]
    maker = ch.Chunker(100, 20, 5)
    want = [(k, *row) for k, t in rows for row in maker.rows(str(k) if k is not None else None, t)]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))
    kept, rejected = ch.write_chunks(docs, str(tmp_path), parent=100, child=20, overlap=5)
    assert (kept, rejected) == (5, 3) and kept + rejected == len(rows)
    assert spark.read.parquet(f"{tmp_path}/rejected").count() == 3 and spark.read.parquet(f"{tmp_path}/chunks").count() == len(found) - 3
