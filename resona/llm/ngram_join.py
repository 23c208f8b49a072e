"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A document is the set of its runs of five words. Documents with equal sets are one class; the forest holds a class
once. Each of TREES prefix tries is a table of the classes' labels of DEPTH min-hashes, sorted, so that the classes under a
trie's node are neighbours. Two classes of similarity t share a prefix of length d in some trie with probability
1 - (1 - t**d) ** TREES. The prefix is the longest at which that, for a pair of the very threshold, is the recall asked for; no
count of the data enters it. Pairs of that depth whose whole signatures agree well enough are candidates; they are compared
exactly, by products of tiles of their sets, and only counts and a spanning forest of the true links leave a task.

Large prefixes and large groups of candidates are split into blocks; each pair of blocks is work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm import scratch
from resona.llm.groups import components, forest, grouped

TREES, DEPTH = 16, 8
SIGNED = "doc_id long, content binary, node binary, size long, signature binary"
#: Classes of a shared prefix, and shingles of a candidate group, that one block holds.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 17
#: Sets on either side of a tile: the part of a block pair whose dense counts are in memory at once.
TILE = 1024
#: Of `shortened`, which the join doesn't use: classes that are asked when recall is measured, those of the smallest hashes, classes of one prefix that they are compared with, and the width of a band.
PROBES, PARTNERS, BAND = 1_000, 256, 0.05


def found_at(similarity: float, depth: int, least: int = 0) -> float:
    """The probability that two classes of that similarity share a prefix of `depth` in some trie and that `least` of all their min-hashes agree."""
    n = TREES * DEPTH
    agree = sum(comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(least, n + 1)) if least else 1.0
    return (1 - (1 - similarity**depth) ** TREES) * agree


def settled(threshold: float, recall: float) -> int:
    """The longest prefix at which pairs of the very threshold, and so all over it, are found with the probability `recall`."""
    return next((d for d in range(DEPTH, 1, -1) if found_at(threshold, d, agreement(threshold)) >= recall), 1)


def agreement(threshold: float) -> int:
    """How many min-hashes of two classes at the threshold agree at least, but for chances of about 1 in 300,000 (4.5 deviations)."""
    n = TREES * DEPTH
    return int(np.floor(n * max(0.0, threshold - 4.5 * (threshold * (1 - threshold) / n) ** 0.5)))


def measured_recall(pairs: dict[int, int], depth: int, threshold: float) -> float:
    """The least recall of a band of similarity, given how many pairs were found with each number of agreeing min-hashes.

    A pair's similarity is estimated by its agreeing min-hashes, at least the threshold; 1 where no pair is found.
    """
    bands: dict[int, list[float]] = {}
    for agree, n in pairs.items():
        t = min(1.0, max(threshold, agree / (TREES * DEPTH)))
        own = bands.setdefault(int((t - threshold) / BAND + 1e-9), [0.0, 0.0])
        own[0] += n
        own[1] += n / found_at(t, depth, agreement(threshold))
    return min((f / total for f, total in bands.values()), default=1.0)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, one of none is empty."""
    from resona.llm.hashing import column_bytes, slices, window_hashes, word_hashes, word_spans

    data, offsets = column_bytes(texts)
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        words = word_hashes(part, starts, ends, 1)
        windows = window_hashes(words, width)
        for a, b in zip(bounds, bounds[1:], strict=False):
            out.append(np.unique(windows[a : b - width + 1]) if b - a >= width else window_hashes(words[a:b], int(b - a)) if b > a else words[:0])
    return out


def digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _factors() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, TREES * DEPTH).astype(np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """TREES * DEPTH min-hashes, 16 bits of each."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 4096):
        least = np.minimum(least, (factors[:, None] * shingles[None, lo : lo + 4096]).min(1))
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype("<u2")


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    factors = _factors()
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):  # the sets of a few rows at a time are in memory
            batch = whole.slice(lo, 512)
            sets = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s, factors).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "content", "node", "size", "signature"])


def blocks(counted: DataFrame, blocks: str) -> DataFrame:
    """Rows exploded over the pairs (i, j), i <= j, of blocks that their own block is in; adds i, j and side (its own block)."""
    own = counted.withColumn("n_blocks", F.expr(blocks)).withColumn("side", F.expr("cast(pmod(xxhash64(node), n_blocks) as int)"))
    each = own.withColumn("k", F.explode(F.expr("sequence(0, cast(n_blocks as int) - 1)")))
    return each.withColumns({"i": F.least("side", "k"), "j": F.greatest("side", "k")}).drop("k", "n_blocks")


def _near(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the pairs of a bucket whose signatures agree in at least `agree` places."""
    for _, table in grouped(batches):
        nodes = table.column("node").to_pylist()
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(nodes), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = np.array(table.column("side").to_pylist()) == i
        left, right = (np.flatnonzero(side), np.flatnonzero(~side)) if i != j else (np.arange(len(nodes)),) * 2

        joined, links = Joined(len(nodes)), []
        for a in left:
            others = right[right > a] if i == j else right
            if len(others):
                links += joined.add(int(a), others[(signs[others] == signs[a]).sum(1) >= agree])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in links], pa.binary()), pa.array([nodes[b] for _, b in links], pa.binary())], ["a", "b"])


def _agreeing(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """(agree, deepest common prefix in any trie, weight) of the rows (weight, signature, signature) whose signatures agree in at least `agree` places."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (1, 2))
            same = a == b
            depth = np.logical_and.accumulate(same.reshape(-1, TREES, DEPTH), 2).sum(2).max(1)
            hit = pa.array(np.flatnonzero(same.sum(1) >= agree))
            yield pa.RecordBatch.from_arrays([pa.array(same.sum(1)).take(hit), pa.array(depth).take(hit), batch.column(0).take(hit)], ["agree", "depth", "weight"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right, as a matrix product over shared shingles."""
    every = np.concatenate(left + right)
    names, at = np.unique(every, return_inverse=True)
    cut = sum(map(len, left))
    both = np.flatnonzero((np.bincount(at[:cut], minlength=len(names)) > 0) & (np.bincount(at[cut:], minlength=len(names)) > 0))
    column = np.full(len(names), -1)
    column[both] = np.arange(len(both))
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    at = column[at]
    rows, at = rows[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    step = max(64, (2 << 20) // max(1, len(left) + len(right)))
    for lo in range(0, len(both), step):
        a, b = np.searchsorted(at, [lo, lo + step])
        dense = np.zeros((len(left) + len(right), step), np.float32)
        dense[rows[a:b], at[a:b] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def tiles(left: list[int], right: list[int], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of left and right in parts of at most TILE by TILE; where both are one list, each pair of parts once."""
    for a in range(0, len(left), TILE):
        for b in range(a if same else 0, len(right), TILE):
            yield np.array(left[a : a + TILE]), np.array(right[b : b + TILE])


class Joined:
    """Trees that grow with each row of links; finds the links that join two trees without a step per link."""

    def __init__(self, n: int) -> None:
        self.tree = np.arange(n)
        self.members: dict[int, np.ndarray] = {}

    def add(self, a: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Those of the links from a to others that are needed to connect the same points."""
        found, first = np.unique(self.tree[others], return_index=True)
        out = []
        for t, k in zip(found.tolist(), first.tolist(), strict=True):
            own = int(self.tree[a])
            if t != own:
                out.append((a, int(others[k])))
                x, y = (self.members.pop(z, np.array([z])) for z in (own, t))
                large, small = (own, y) if len(x) >= len(y) else (t, x)
                self.tree[small] = large
                self.members[large] = np.concatenate([x, y])
        return out


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """node and its shingles, of rows (node, text); a key may have other texts too, which are left out."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = [(n, s.tobytes()) for n, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), width), strict=True) if len(s) and digest(s) == n]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["node", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, links): a row per class with the documents it has links to (b null), and a spanning forest of its links."""
    for _, table in grouped(batches):
        rows = zip(table.column("node").to_pylist(), table.column("shingles").to_pylist(), table.column("copies").to_pylist(), table.column("side").to_pylist(), strict=True)
        sets = {n: (np.frombuffer(s, np.uint64), copies, side) for n, s, copies, side in rows}
        nodes = sorted(sets)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = [n for n in nodes if sets[n][2] == i]
        right = left if i == j else [n for n in nodes if sets[n][2] == j]
        if not left or not right:
            continue
        names = left if i == j else left + right
        place = {n: k for k, n in enumerate(names)}
        copies = np.array([sets[n][1] for n in names], np.int64)
        size = np.array([len(sets[n][0]) for n in names], np.float64)
        counts, tree, joined = np.zeros(len(names), np.int64), [], Joined(len(names))
        for x, y in tiles([place[n] for n in left], [place[n] for n in right], i == j):
            common = overlaps([sets[names[k]][0] for k in x], [sets[names[k]][0] for k in y])
            link = common * (1 + threshold) >= threshold * (size[x][:, None] + size[y][None, :]) - 1e-6
            same = i == j and x[0] == y[0]
            if same:
                np.fill_diagonal(link, False)
            counts[x] += link @ copies[y]
            if not same:
                counts[y] += link.T @ copies[x]
            for k, row in zip(x, link, strict=True):
                tree += joined.add(int(k), y[row])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array([names[k] for k in some] + [names[x] for x, _ in tree], pa.binary()), pa.array([None] * len(some) + [names[y] for _, y in tree], pa.binary()),
            pa.array(counts[some].tolist() + [0] * len(tree), pa.int64()),
        ], ["a", "b", "links"])


def content(text: str = "text") -> Column:
    """What tells rows of one key apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def planted(classes: DataFrame) -> DataFrame:
    """The sorted tries: label (a byte for the tree, then DEPTH min-hashes of two bytes) and node."""
    tree = F.explode(F.expr(f"sequence(0, {TREES - 1})")).alias("tree")
    label = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * DEPTH})"))
    return classes.select("node", "signature", tree).select(label.alias("label"), "node").sortWithinPartitions("label")


def under(label: str, depth: int) -> Column:
    """The trie's node at `depth` that a label lies under."""
    return F.expr(f"substring({label}, 1, {1 + 2 * depth})")


def shortened(classes: DataFrame, tries: DataFrame, threshold: float, recall: float, probes: int = PROBES) -> int:
    """A report, on which no result depends: the longest prefix at which the recall measured for a sample of classes reaches the target.

    At most `probes` classes are asked.
    Prefixes need not be shorter than the depth at which pairs of the very threshold are found often enough; the sample is
    compared with all that share such a prefix, and each pair counts for the levels down to its deepest common node. Of a prefix that
    many classes share, about PARTNERS stand for all, each with its weight. The driver sees one number for each depth
    and number of agreeing min-hashes.
    """
    least = agreement(threshold)
    floor = settled(threshold, recall)
    asked = scratch.keep(classes.select("node", "signature").orderBy(F.xxhash64("node"), "node").limit(probes), "probes")
    asked_at = planted(asked).select(F.col("node").alias("probe"), under("label", floor).alias("prefix"))
    at = tries.select("node", under("label", floor).alias("prefix"))
    sizes = at.join(asked_at.select("prefix").distinct(), "prefix").groupBy("prefix").agg(F.ceil(F.log2(F.count("*") / PARTNERS)).alias("halvings"))
    # halvings are nested, so that a pair found in several tries has the weight of its smallest prefix
    some = at.join(sizes, "prefix").where("halvings <= 0 or pmod(xxhash64(node, 7), shiftleft(1L, cast(halvings as int))) = 0")
    near = asked_at.join(some, "prefix").where("probe <> node").groupBy("probe", "node").agg(F.expr("shiftleft(1L, cast(greatest(0, min(halvings)) as int))").alias("weight"))
    pairs = near.join(classes.select("node", F.col("signature").alias("other")), "node").join(asked.select(F.col("node").alias("probe"), "signature"), "probe").select("weight", "signature", "other")
    counted = pairs.mapInArrow(lambda b: _agreeing(b, least), "agree long, depth long, weight long").groupBy("agree", "depth").agg(F.sum("weight").alias("n")).collect()
    for depth in range(DEPTH, floor, -1):
        found: dict[int, int] = {}
        for r in counted:
            if r.depth >= depth:
                found[r.agree] = found.get(r.agree, 0) + r.n
        if len(found) == len({r.agree for r in counted}) and measured_recall(found, depth, threshold) >= recall:
            return depth
    return floor


def _joined(docs: DataFrame, threshold: float, recall: float, width: int, key: str) -> tuple[DataFrame, DataFrame]:
    """signed (a row per document) and named (node, group, class_id, copies, links: a row per distinct set)."""
    signed = scratch.keep(docs.select(F.col(key).cast("long").alias("doc_id"), "text", content().alias("content")).mapInArrow(lambda b: _signed(b, width), SIGNED), "signed")
    classes = scratch.keep(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")), "classes")

    tries, agree = scratch.keep(planted(classes), "tries"), agreement(threshold)
    prefixed = tries.select("node", under("label", settled(threshold, recall)).alias("prefix"))
    shared = scratch.keep(prefixed.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    buckets = blocks(prefixed.join(shared, "prefix"), f"ceil(n / {BLOCK_CLASSES})").withColumn("bucket", F.concat(F.col("prefix"), F.encode(F.format_string("/%d/%d", "i", "j"), "utf-8")))
    buckets = buckets.join(classes.select("node", "signature"), "node").select("bucket", "node", "signature", "i", "j", "side")
    near = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _near(b, agree), "a binary, b binary")
    candidates = scratch.keep(components(near, "near"), "candidates")

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    chosen = candidates.join(classes.select("node", "first"), "node").join(texts, F.col("first").eqNullSafe(F.col("doc_id"))).select("node", "text")
    sets = scratch.keep(chosen.mapInArrow(lambda b: _sets(b, width), "node binary, shingles binary"), "sets")  # repeated rows give a set twice
    sized = candidates.join(classes.drop("signature"), "node")
    totals = scratch.keep(sized.groupBy("root").agg(F.sum("size").alias("total")), "totals")
    placed = blocks(sized.join(totals, "root"), f"ceil(total / {BLOCK_SHINGLES})").withColumn("cluster", F.concat_ws("/", F.hex("root"), "i", "j"))
    compared = placed.join(sets, "node").select("cluster", "node", "copies", "i", "j", "side", "shingles")
    # comparing costs more than its few bytes say, so these partitions are not merged by size
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(compared.repartition(tasks, "cluster").sortWithinPartitions("cluster").mapInArrow(lambda b: _verified(b, threshold), "a binary, b binary, links long"), "verified")

    roots = components(found.where("b is not null").select("a", "b"), "true")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = scratch.keep(classes.select("node", "first", "copies").join(roots, "node", "left").join(links, "node", "left"), "linked")
    heads = scratch.keep(linked.where("root is not null").groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = linked.join(heads, "root", "left").select("node", F.coalesce("root", "node").alias("group"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("head")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return signed, scratch.keep(named, "named")


def ngram_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995, width: int = 5, key: str = "doc_id") -> DataFrame:
    """doc_id, class_id, n_links, n_copies: a row per input row.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least `threshold`. n_links:
    how many other documents this one is linked to, exact copies included. n_copies: how many have its very
    set, itself included. class_id: the least key of those connected by links.

    Texts of 1 to width - 1 words are one shingle; null, empty and blank texts are linked to nothing and have
    themselves as class. Rows of one key are documents of their own; null keys are compared as any others, and a class
    of null keys only has a null id. Extra columns are not read. An empty table gives an empty result.
    """
    signed, named = _joined(docs, threshold, recall, width, key)
    out = signed.select("doc_id", "node").join(named, "node", "left")
    return out.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995, width: int = 5, key: str = "doc_id") -> DataFrame:
    """The rows of docs without near duplicates: of all that links connect, the one of the least key (then text digest).

    A null key is chosen only where no other is there. Texts without words stay. Of rows equal in key and
    text one stays.
    """
    signed, named = _joined(docs, threshold, recall, width, key)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    chosen = signed.where("node is not null").join(named.select("node", "group"), "node").groupBy("group").agg(F.min(row).alias("row"))
    heads = chosen.select("row.doc_id", "row.content").union(signed.where("node is null").select("doc_id", "content").distinct())
    heads = scratch.keep(heads.toDF("_key", "_content"), "chosen")
    # joined and made distinct by one column, so that the rows are dealt out once
    same = F.md5(F.concat_ws(":", F.col("_key").cast("string"), F.hex("_content")).cast("binary"))
    rows = docs.withColumn("_content", content()).withColumn("_key", F.col(key).cast("long")).withColumn("_same", same).drop("_content", "_key")
    return rows.join(heads.select(same.alias("_same")), "_same", "left_semi").dropDuplicates(["_same"]).drop("_same")
