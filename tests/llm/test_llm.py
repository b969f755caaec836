"""The training-data operators against brute force, on small tables with hard rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxledger.llm import bpe, common, langid, line_dedup, near_vectors, ngram_join, packing, quality, secret_scan, topk, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " ", "a", "a  b \n\n c", "naïve café 　 x\t\ty", "<|endoftext|>x <|endoftext|>", "日本語" * 40, "x" * 3000, "same text here", "same text here", "😀 it's 'll 12345 \x1c\x85 end "]


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def docs_of(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_transducer_is_the_tokenizer(spark):
    reference, rng = Tokenizer.from_file(BYTE), random.Random(1)
    texts = HARD + ["".join(rng.choice("etaoin srhld'\n,1é日") for _ in range(rng.randrange(900))) for _ in range(40)] + ["".join(rng.choice("abcde") for _ in range(2500))]
    rows = bpe.encode_decode(docs_of(spark, texts), BYTE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, reference.decode(ids, skip_special_tokens=False))


def test_stream_emits_before_the_end():
    t = bpe.Transducer(BYTE)
    raw, given = b"ab" * 3000, []

    def chunks():
        for i in range(0, len(raw), 100):
            given.append(i)
            yield raw[i : i + 100]

    stream = t.stream(chunks())
    next(stream)
    assert len(given) < 20
    assert len(next(stream)) and b"".join(t.stream([raw])) == raw


def test_packing_places_every_piece(spark):
    rng = random.Random(2)
    texts = HARD + [words(rng, rng.choice([3, 30, 300, 1500])) for _ in range(60)]
    rows = packing.pack_documents(docs_of(spark, texts), WORD).collect()
    reference = Tokenizer.from_file(WORD)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= max(-(-sum(r["length"] for r in rows) // 2048), sum(r["length"] > 1024 for r in rows)) + 1


def test_packing_of_no_rows(spark):
    assert packing.pack_documents(docs_of(spark, []), WORD).count() == 0


def test_filling_is_best():
    rng = random.Random(3)
    for _ in range(60):
        count = {rng.randrange(1, 60): rng.randrange(1, 3) for _ in range(8)}
        room = rng.randrange(1, 100)
        items = [x for x, n in count.items() for _ in range(n)]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        found = packing.best_filling(sorted(count, reverse=True), count, room)
        assert sum(found) == best and all(found.count(x) <= count[x] for x in set(found))


def test_near_vectors_are_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = [base[i // 2] + 0.25 * rng.normal(size=16) for i in range(300)] + [base[0]] * 5
    vectors = [[float(x) for x in v] for v in rows] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    x = np.array(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    root = roots(len(x), zip(*np.nonzero(linked)))
    assert linked.sum() > 50
    assert got == {i: (int(linked[i].sum()), root[i], root[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(len(x), len(vectors))}


def test_ngram_join_is_all_pairs(spark):
    rng = random.Random(5)
    texts = list(HARD)
    for _ in range(12):
        w = words(rng, 60).split()
        for _ in range(rng.randrange(1, 6)):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = "new"
            texts.append(" ".join(v))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root, links = roots(len(sets), edges), [0] * len(sets)
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (links[i], root[i]) for i in range(len(sets))}


def test_line_dedup_is_all_pairs(spark):
    rng = random.Random(6)
    lines = [words(rng, 14, 3000) for _ in range(40)]
    texts = [None, "", " \n\n", "short\nshort"]
    for _ in range(30):
        some = rng.sample(lines, 5)
        k = rng.randrange(5)
        some[k] = some[k][:-1] + "q"
        texts.append("\n".join(some))
    docs = docs_of(spark, texts)
    occ = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    distinct = sorted({o[2] for o in occ})
    sets = [{s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in distinct]
    root = roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    first = {}
    for i, n, line in occ:
        first.setdefault(root[distinct.index(line)], (i, n))
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.line_components(docs).where("kept").collect()}
    assert got == set(first.values())
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert left[0] is None and left[1] == "" and left[2] == " \n\n" and left[3] == "short"
    assert set(left) == {0, 1, 2} | {i for i, _ in first.values()}


def test_secrets(spark):
    key, access = "0123456789abcdef01234567", "AKIA" + "Q" * 16
    text = f'password = "{key}"\n{access} xAKIA12\nBASE = "Zx9$kLm2!pQr"\nmy_secret_key = BASE\nToKeN: abc'
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs_of(spark, [*HARD, text]), digests=True).collect()}
    r = rows[len(HARD)]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    start = text.index("password")
    base = f"assign:{start}:{start + 12 + len(key)},hex:{start + 12}:{start + 12 + len(key)},access:{text.index(access)}:{text.index(access) + 20}"
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    where = text.index("Zx9")
    assert f"lexed:{where}:{where + 12}" in r["spans"]
    assert rows[0]["spans"] == "" and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert key not in secret_scan.redacted(text, secret_scan.all_spans(text)) and access not in secret_scan.redacted(text, secret_scan.all_spans(text))


def test_topk_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(400, 12)).round(1)
    rows[10:14] = rows[9]
    vectors = [v.tolist() for v in rows] + [None, [float("inf")] * 12, [None] * 12]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(frame.where("vec_id % 20 = 0"), frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    v = np.floor(256 * rows).astype(int)
    for q in range(0, 400, 20):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert got[q] == {k + 1: (i, s[i]) for k, i in enumerate(best)}
    assert set(got) == set(range(0, 400, 20))


def test_topk_with_few_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(frame.where("vec_id = 0"), frame).collect()] == [(0, 1, 1, 256 * 512)]


def test_language(spark):
    texts = {"aa": "anna banana kana", "bb": "otto robot motor"}
    frame = spark.createDataFrame([(i, texts[k] + " " + texts[k][: i % 9 + 4], k) for i in range(40) for k in ("aa", "bb")], "doc_id long, text string, lang string")
    model = langid.train(frame)
    rows = langid.predict(frame.limit(20).unionByName(spark.createDataFrame([(-1, None, None), (-2, "12 !", None)], frame.schema)), model).collect()
    assert all(r["lang_pred"] == (r["lang"] or "und") for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("n", [0, 60])
def test_quality(spark, n):
    rng = random.Random(8)
    rows = [(i, words(rng, 50) if i % 2 else "### $$$ !!! " * 20, i % 2) for i in range(n)] + [(1000, None, None), (1001, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, y int")
    stats = common.cut(quality.with_statistics(frame))
    scored = {r["doc_id"]: r["score"] for r in quality.predict(stats, quality.fit(stats, "y")).collect()}
    assert all((scored[i] > 0.5) == bool(i % 2) for i in range(n)) and len(scored) == n + 2 and all(0 <= s <= 1 for s in scored.values())


def test_toxicity(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice("aeioulmrt") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    rows = [(i, " ".join(rng.sample([*rng.sample(plain, 30), *(["dreadful", "nastyword"] if i % 4 == 0 else [])], 30))) for i in range(300)]
    docs, labels = docs_of(spark, [t for _, t in rows]), spark.createDataFrame([(i, int("dreadful" in t or "nastyword" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum((scored[i] >= 0.5) == truth[i] for i in scored) >= 0.98 * len(scored)
    assert {r["score"] for r in toxicity.predict(docs_of(spark, [None, ""]), model).collect()} == {float(model.score([[0.0] * 5])[0])}
    assert toxicity.Lexicon({"nastyword": 5.0}).find("nasztywrd") == (5.0, 2)
    assert toxicity.learn(docs, labels.where("toxic = 0")).weights == {}


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    root = roots(341, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: root[i] for i in nodes}
