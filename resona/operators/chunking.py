"""Parents and children of documents, by a table function that also returns what it rejects."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.sources.held import held

#: Headings first, then paragraphs, lines, sentences, words, characters.
SEPARATORS = ("\n# ", "\n## ", "\n### ", "\n\n", "\n", ". ", " ", "")
RESULT = "kind string, parent_id string, chunk_id string, place int, text string, tokens int"


def tokens(text: str) -> int:
    """Estimate: a quarter of the characters, at least one."""
    return max(1, len(text) // 4)


def pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, which stays with what follows it; single characters for an empty one."""
    if not separator:
        return list(text)
    return [p for p in re.split(f"(?={re.escape(separator)})", text) if p] if separator in text else [text]


def joined(parts: list[str], most: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to `most` tokens; each result but the first begins with up to `overlap` tokens of the one before."""
    out, held_, sizes, total = [], [], [], 0
    for part in parts:
        n = tokens(part)
        if held_ and total + n > most:
            out.append("".join(held_).strip())
            cut = 0
            while total > overlap or (total and total + n > most):
                total -= sizes[cut]
                cut += 1
            held_, sizes = held_[cut:], sizes[cut:]
        held_.append(part)
        sizes.append(n)
        total += n
    out.append("".join(held_).strip())
    return [p for p in out if p]


def split(text: str, most: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about `most` tokens: cut at the coarsest separator that occurs, pieces that are still too long at finer ones.

    A piece of `most` tokens or more is cut further on its own, so its neighbours aren't joined across it.
    """
    at = next(k for k, s in enumerate(separators) if s in text)
    finer = separators[at + 1 :]
    out, good = [], []
    for part in pieces(text, separators[at]):
        if tokens(part) < most:
            good.append(part)
            continue
        if good:
            out += joined(good, most, overlap)
            good = []
        out += split(part, most, overlap, finer) if finer else [part]
    return out + joined(good, most, overlap) if good else out


class Chunker:
    """Table function: the parents of a text and, after each, its children; or one row of kind rejected, its text the reason."""

    def __init__(self, parent: int, child: int, overlap: int) -> None:
        self.parent, self.child, self.overlap = parent, child, overlap

    def rows(self, name: str | None, text: str | None) -> Iterator[tuple]:
        if text is None or not text.strip():
            yield "rejected", None, None, 0, "no text" if text is None else "blank", 0
            return
        for n, parent in enumerate(split(text, self.parent)):
            parent_id = f"{name}_parent_{n}"
            yield "parent", None, parent_id, n, parent, tokens(parent)
            for k, child in enumerate(split(parent, self.child, self.overlap)):
                yield "child", parent_id, f"{parent_id}_child_{k}", k, child, tokens(child)


def chunks(docs: DataFrame, key: str = "doc_id", parent: int = 1500, child: int = 200, overlap: int = 20) -> DataFrame:
    """key, kind (parent, child, rejected), parent_id, chunk_id, place, text, tokens.

    Parents have up to `parent` tokens, children up to `child` with `overlap` of them shared between neighbours. Null and blank texts
    are rejected, so each document has a parent or is rejected. Names are made of the key; rows of one key have like names.
    """
    made = Chunker(parent, child, overlap)

    class Rows:
        def eval(self, name, text):
            yield from made.rows(name, text)

    cut = F.udtf(Rows, returnType=RESULT)
    named = docs.select(F.col(key), F.col(key).cast("string").alias("_name"), F.col("text").alias("_text"))
    return named.lateralJoin(cut(F.col("_name").outer(), F.col("_text").outer())).drop("_name", "_text")


def write_chunks(docs: DataFrame, folder: str, **sizes: int) -> tuple[int, int]:
    """Chunks below folder/chunks and rejected documents below folder/rejected, cut in one pass; how many documents went to each."""
    found = held(chunks(docs, **sizes), "chunked")
    found.where("kind <> 'rejected'").write.mode("append").partitionBy("kind").parquet(f"{folder}/chunks")
    found.where("kind = 'rejected'").withColumnRenamed("text", "reason").write.mode("append").parquet(f"{folder}/rejected")
    n = found.agg(F.count_if((F.col("kind") == "parent") & (F.col("place") == 0)), F.count_if(F.col("kind") == "rejected")).first()
    return n[0], n[1]
