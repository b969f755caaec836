"""Near-duplicate join of documents by the Jaccard index of their word n-grams, through a MinHash LSH forest.

Each tree of the forest orders documents by a signature of its own, DEPTH values long, and is a trie of signature
prefixes. Matched prefixes are shortened adaptively. At full depth few unlike documents meet, so depth is first given up
only until a pair at the threshold shares a prefix in some tree with a chance of FLOOR. The links verified there then
tell how many more there are: a link of similarity s is found at depth d with the chance P(s, d), so it stands for
1 / P(s, d) links. While the links found are less than the target recall of those, prefixes are one value shorter.

Documents with the same n-grams are one class; classes that share a prefix belong to one candidate component. Within a
component all pairs of classes are verified exactly, in blocks of bounded size dealt over tasks, so a pair that meets in
many trees is verified once, and a large component is no single task's. Counts of links, and edges that keep a block's
components together, are all that leaves a block.

Words are split at white space in lower case; a document of fewer than n words is one n-gram, one without
words links with nothing. N-grams are compared by 64-bit hashes, classes are known by a 128-bit hash of theirs.

Edge cases: null text is the empty text; repeated rows and copies are one class; rows that repeat an id with another
text are documents of their own; ties (which document stands for a class or component) go to the smallest id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.common import components, cut, hook

TREES, DEPTH = 28, 8
#: Chance with which a pair at the threshold is found at the depth that the search starts from.
FLOOR = 0.999
#: Classes in a block of a candidate component.
BLOCK = 1024
#: A hash multiplier and increment, odd and fixed, that word hashes are chained with.
CHAIN = np.uint64(0x9E3779B97F4A7C15)


def chance(similarity, depth: int, trees: int = TREES):
    """Chance that two documents share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def first_depth(threshold: float, floor: float = FLOOR, trees: int = TREES, depth: int = DEPTH) -> int:
    while depth > 1 and chance(threshold, depth, trees) < floor:
        depth -= 1
    return depth


def orders(trees: int, depth: int) -> np.ndarray:
    """For each tree the MinHash functions that its values come from: the first half of them are its own, the second half
    are taken from as many other trees, one of each."""
    own = -(-depth // 2)
    t, level = np.arange(trees)[:, None], np.arange(depth)[None, :]
    return np.where(level < own, t * own + level, (t + 5 * (level - own + 1)) % trees * own + level % own)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct n-gram hashes of texts; word hashes are kept for words met before."""

    def __init__(self, n: int, most_words: int = 500_000):
        self.n, self.most, self.words = n, most_words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        known, hashed, digest = self.words, [], xxhash.xxh64_intdigest
        for w in (text or "").lower().split():
            if (h := known.get(w)) is None:
                h = digest(w)
                if len(known) < self.most:
                    known[w] = h
            hashed.append(h)
        if not hashed:
            return np.empty(0, np.uint64)
        a = np.array(hashed, np.uint64)
        n = min(self.n, len(a))
        out = np.full(len(a) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * CHAIN + a[k : len(a) - n + 1 + k]
            out ^= out >> np.uint64(29)
        return np.unique(mixed(out))


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of each MinHash function."""
    least = np.full(seeds.shape[1], np.iinfo(np.uint32).max, np.uint32)
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for at in range(0, len(low), 512):
        part = low[at : at + 512, None] * seeds[0] + seeds[1]
        part ^= part >> np.uint32(15)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def prefix_keys(signatures: np.ndarray, trees: int, depth: int, full: int = DEPTH) -> np.ndarray:
    """One key for each signature and tree: the hash of the tree's prefix of ``depth`` values."""
    key = np.broadcast_to(np.arange(trees, dtype=np.uint64) + np.uint64(1), (len(signatures), trees))
    for column in orders(trees, full).T[:depth]:
        key = mixed(key * CHAIN + signatures[:, column].astype(np.uint64))
    return key.view(np.int64)


def sketches(docs: DataFrame, n: int, trees: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col, version, c1, c2, sig``: a hash of the text, a 128-bit hash of the n-gram set and its MinHash values (none
    without words)."""
    count = trees * -(-DEPTH // 2)

    def run(batches):
        import xxhash

        rng = np.random.default_rng(5)
        seeds = np.stack([rng.integers(0, 2**31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count).astype(np.uint32)])
        shingler = Shingler(n)
        for batch in batches:
            first, second, found = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingler(text)
                whole = xxhash.xxh128_digest(s.tobytes())
                first.append(int.from_bytes(whole[:8], "little", signed=True))
                second.append(int.from_bytes(whole[8:], "little", signed=True))
                found.append(signature(s, seeds).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(found, pa.binary())], names=[id_col, "version", "c1", "c2", "sig"])

    return docs.select(id_col, F.xxhash64(text_col).alias("version"), text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, version long, c1 long, c2 long, sig binary")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many n-grams each of ``a`` shares with each of ``b``, or of ``a``: frequent n-grams by a matrix product, rare
    ones by their lists of members."""
    sets = a if b is None else [*a, *b]
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    size = np.diff(np.concatenate([first, [len(every)]]))
    left = len(a)
    width, off = (left, 0) if b is None else (len(b), left)
    counts = np.zeros((left, width), np.float32)
    dense = np.flatnonzero(size >= 12)
    for at in range(0, len(dense), 2048):
        some = dense[at : at + 2048]
        wide = size[some]
        places = np.arange(wide.sum()) + np.repeat(first[some] - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide)
        matrix = np.zeros((len(sets), len(some)), np.float32)
        matrix[owner[places], np.repeat(np.arange(len(some)), wide)] = 1
        counts += matrix[:left] @ matrix[off:].T
    for z in range(2, 12):
        who = owner[first[size == z][:, None] + np.arange(z)]
        met = [(who[:, p], who[:, q]) for p in range(z) for q in range(p + 1, z)] if len(who) else []
        if met:
            x, y = (np.concatenate(c) for c in zip(*met))  # owners rise within an n-gram, so x < y
            if b is not None:
                x, y = x[keep := (x < left) & (y >= left)], y[keep]
            part = np.bincount(x * width + y - off, minlength=left * width).reshape(left, width)
            counts += part if b is not None else part + part.T
    return counts


def block_links(one: pd.DataFrame, two: pd.DataFrame | None, threshold: float, depth: int, trees: int):
    """Links between two blocks, or within one, of ``c, copies, grams``: (classes, links) of either side, spanning edges,
    the number of pairs and how many more that number stands for at this depth."""
    a = [np.frombuffer(x, np.uint64) for x in one["grams"]]
    b = None if two is None else [np.frombuffer(x, np.uint64) for x in two["grams"]]
    common = shared_counts(a, b)
    na = np.fromiter(map(len, a), np.float32, len(a))
    nb = na if b is None else np.fromiter(map(len, b), np.float32, len(b))
    linked = (common > 0) & (common >= np.float32(threshold) * (na[:, None] + nb[None, :] - common) - 1e-3)
    if b is None:
        np.fill_diagonal(linked, False)
    ids = one["c"].to_numpy() if b is None else np.concatenate([one["c"].to_numpy(), two["c"].to_numpy()])
    other = one if b is None else two
    links = [(one["c"].to_numpy(), linked @ other["copies"].to_numpy(np.float64))]
    if b is not None:
        links.append((two["c"].to_numpy(), linked.T @ one["copies"].to_numpy(np.float64)))
    x, y = np.nonzero(linked if b is not None else np.triu(linked))
    found = chance(common[x, y].astype(np.float64) / (na[x] + nb[y] - common[x, y]), depth, trees)
    y = y + (0 if b is None else len(a))
    labels = np.arange(len(ids))
    hook(labels, x, y)
    moved = np.flatnonzero(labels != np.arange(len(ids)))
    return links, np.stack([ids[moved], ids[labels[moved]]], axis=1), len(x), float((1 / found - 1).sum())


def links_at(classes: DataFrame, docs: DataFrame, depth: int, n: int, threshold: float, trees: int, id_col: str, text_col: str) -> DataFrame:
    """What is linked among candidates at this depth, in rows ``src, dst, n, more``: counts (no dst), edges, and totals of
    pairs (no src)."""

    def keyed(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            keys = prefix_keys(sig, trees, depth)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, trees), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["c", "keys"])

    node = classes.select("c", "sig").mapInArrow(keyed, "c long, keys array<long>").select("c", F.explode("keys").alias("key"))
    shared = node.groupBy("key").agg(F.min("c").alias("lead"), F.count("*").alias("n")).where("n > 1")
    touching = node.join(shared, "key").where("c <> lead").select(F.col("c").alias("src"), F.col("lead").alias("dst"))
    candidates = components(touching)
    # members of a candidate component are numbered within parts of it, and parts make its blocks
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = candidates.join(sizes, "component").select(F.col("node").alias("c"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    members = members.join(classes.select("c", "copies", "least"), "c")
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_version"), F.col(text_col).alias("_text"))
    texts = members.join(whole, (F.col("least.id") == F.col("_id")) & (F.col("least.version") == F.col("_version"))).dropDuplicates(["c"])

    def grams(batches):
        shingler = Shingler(n)
        for b in batches:
            at = b.schema.get_field_index("_text")
            sets = pa.array([shingler(t).tobytes() for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [sets], names=[x for x in b.schema.names if x != "_text"] + ["grams"])

    sets = cut(texts.select("component", "blocks", "block", "c", "copies", "_text").mapInArrow(grams, "component long, blocks int, block int, c long, copies long, grams binary"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.withColumn("o", other).select("component", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "c", "copies", "grams")

    def verify(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        one = rows[rows["block"] == i]
        links, edges, count, more = block_links(one, None if i == j else rows[rows["block"] == j], threshold, depth, trees)
        out = [pd.DataFrame({"src": ids, "dst": None, "n": k.astype("int64"), "more": 0.0}) for ids, k in links]
        out.append(pd.DataFrame(edges, columns=["src", "dst"]).assign(n=0, more=0.0))
        out.append(pd.DataFrame({"src": [None], "dst": [None], "n": [count], "more": [more]}))
        out = pd.concat([x.astype({"src": "Int64", "dst": "Int64"}) for x in out])
        return out[(out["n"] > 0) | out["dst"].notna()]

    return cut(pairs.groupBy("component", "i", "j").applyInPandas(verify, "src long, dst long, n long, more double"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, class_id`` (smallest id with the same n-grams), ``n_links`` (other
    documents at the threshold or above, copies included), ``component_id`` (smallest id reached by links), ``kept``
    (whether it is that document) and ``version``, the xxhash64 of its text."""
    sketched = cut(sketches(docs, n, trees, id_col, text_col))
    some = sketched.where("sig is not null")
    classes = cut(some.groupBy("c1", "c2").agg(F.min(F.struct(F.col(id_col).alias("id"), "version")).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig")).withColumn("c", F.xxhash64("c1", "c2")))
    depth = first_depth(threshold, trees=trees)
    while True:
        found = links_at(classes, docs, depth, n, threshold, trees, id_col, text_col)
        total = found.where("src is null").agg(F.sum("n").alias("n"), F.sum("more").alias("more")).first()
        if depth == 1 or (total["n"] or 0) >= recall * ((total["n"] or 0) + (total["more"] or 0)):
            break
        depth -= 1
    linked = found.where("src is not null and dst is null").groupBy(F.col("src").alias("c")).agg(F.sum("n").alias("others"))
    joined = components(found.where("dst is not null").select("src", "dst")).withColumnRenamed("node", "c")
    told = classes.select("c1", "c2", "c", "least", "copies").join(linked, "c", "left").join(joined, "c", "left")
    told = cut(told.select("c1", "c2", F.col("least.id").alias("_class"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "c").alias("_component")))
    named = told.groupBy("_component").agg(F.min("_class").alias("_stays"))
    rows = sketched.join(told.join(named, "_component"), ["c1", "c2"], "left")
    alone = F.col("sig").isNull()
    return rows.select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(F.col("_class")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("_links")).cast("long").alias("n_links"),
        F.when(alone, F.col(id_col)).otherwise(F.col("_stays")).alias("component_id"),
        "version",
    ).select(id_col, "class_id", "n_links", "component_id", (F.col(id_col) == F.col("component_id")).alias("kept"), "version")
