"""Periodic runs, ranked search and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomline.llm import packing, periodic, queries, ranking

SCHEMA = "doc_id long, text string, start int, length string, term string, shard int, words long, sequence_id int"
TOKENIZER = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def texts():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Été,", "ÉTÉ", "don't", "a,b", "x\x0by", "nb sp", "日本語", "é"]
    out = [None, "", " \t\n", "one", "a a a", "ab " * 30, ("x y z " * 11).strip(), "\n".join("abc" * 9)]
    out += [" ".join(r.choice(words) for _ in range(r.randint(1, 300))) for _ in range(60)]
    for _ in range(60):  # periods inside other text, next to each other and within each other
        parts = []
        for _ in range(r.randint(1, 5)):
            unit = [r.choice(words[:4]) for _ in range(r.randint(1, 14))] * r.randint(1, 9)
            parts += unit[: r.randint(1, len(unit))] + [r.choice(words) for _ in range(r.randint(0, 9))]
        out.append(r.choice([" ", "  ", "\n"]).join(parts))
    inner = " ".join(["p q q"] * 10)
    return out + [" ".join([inner, "end"] * 6), " ".join(r.choice(words) for _ in range(2000)), out[20], out[20]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "l", "t", 2, 3, 4) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[12], rows[3], (None, "ab " * 30, 1, "l", "t", 2, 3, 4), (None, None, None, None, None, None, None, None)], SCHEMA).repartition(3).cache()


def plain_runs(w):
    n, found = len(w), {}
    for p in range(1, n // 3 + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and w[e] == w[e + p]:
                e += 1
            if e + p - s >= max(24, 3 * p):
                found.setdefault((s, e + p), p)
            s = max(e, s) + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda x: (x[0], x[2]))


def plain_periodic(text):
    w = [x.decode() for x in (text or "").encode().split()]
    runs = plain_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda x: (Fraction(-x[1], x[2]), x[0], x[2]), default=None)
    return len(w), runs, top, " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("gather", "pairs", "block", "short"), [(1 << 19, 1 << 18, 16, 8), (40, 5, 2, 1), (1000, 64, 16, 2)])
def test_periodic_runs_match_brute_force(docs, monkeypatch, gather, pairs, block, short):
    for name, value in (("GATHER", gather), ("PAIRS", pairs), ("BLOCK", block), ("SHORT", short)):
        monkeypatch.setattr(periodic, name, value)
    n_runs = 0
    for r in docs.collect():
        w = (r["text"] or "").encode().split()
        codes = {x: i for i, x in enumerate(dict.fromkeys(w))}
        s, e, p = periodic.find(np.array([codes[x] for x in w], np.int64), np.array([len(w)]))
        runs = plain_runs(w)
        assert sorted(zip(s.tolist(), (e - s).tolist(), p.tolist(), strict=True), key=lambda x: (x[0], x[2])) == runs
        n_runs += len(runs)
    assert n_runs > 60


def test_periodic_operator_and_query_match_brute_force(spark, docs, tmp_path):
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), None if r["top"] is None else tuple(r["top"]), r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    want = Counter((r["doc_id"], n, tuple(runs), top, kept) for r in docs.collect() for n, runs, top, kept in [plain_periodic(r["text"])])
    assert got == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = []
    for r in docs.collect():
        w = [x.decode() for x in (r["text"] or "").encode().split()]
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        _, runs, top, kept = plain_periodic(" ".join(w))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        rows.append((r["doc_id"], len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2], digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(kept)))
    assert Counter(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect())) == Counter(rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))) > 5


def test_periodic_runs_of_long_texts(spark):
    """A text of one word, one beyond the words that are taken together, and what stands around a run."""
    long = [f"u{i}" for i in range(700_000)]
    rows = [(1, "a " * 50_000), (2, " ".join([*long, *["x", "y"] * 20, *long[:9]]))]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["runs"] == [(0, 50_000, 1)] and got[1]["collapsed"] == "a"
    assert got[2]["runs"] == [(700_000, 40, 2)] and got[2]["collapsed"] == " ".join([*long, "x", "y", *long[:9]])


def plain_ranks(rows, items, k=20):
    terms = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n, total, df = len(counts), sum(m for *_, m in counts), Counter(x for _, c, _ in counts for x in c)
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for x, d in df.items()}
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c, m in counts:
            size = 100 - 25 + (25 * m * n) // total
            score = sum(weight[x] * ((1_000_000_000 * c[x]) // (1000 * c[x] + 12 * size)) for x in terms(text) if x in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return Counter(out)


ITEMS = [("i1", "w1 w2 w3 W4 w1"), ("i2", "日本語 don't"), ("i3", "absent"), ("i4", None), ("i5", ""), ("i1", "w1 w2 w3 W4 w1"), (None, "ab été ÉTÉ"), ("i6", " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("k", [20, 3])
def test_ranks_match_brute_force(spark, docs, k):
    benchmark = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id string, text string, term int")
    got = ranking.rank(docs, benchmark, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], [x for x in ITEMS if x[1] is not None], k)


def test_ranks_with_many_shards_windows_and_blocks(spark, docs, monkeypatch):
    """Shards of a few documents in one task, and queries in many blocks."""
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 20)
    monkeypatch.setattr(ranking, "SHARD_WORDS", 500)
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = ranking.rank(docs.repartition(9), benchmark)
    assert Counter(map(tuple, got.collect())) == plain_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], [x for x in ITEMS if x[1] is not None])


def test_search_skips_documents_that_cannot_count(monkeypatch):
    """The best of each window equal those of all documents, and fewer than all are scored."""
    monkeypatch.setattr(ranking, "WINDOW", 64)
    r = np.random.default_rng(3)
    words = r.integers(20, 400, 3000).astype(np.int32)
    lists = ranking.Lists(np.arange(3000), np.ones(3000, bool), words, 3000, int(words.sum()))
    scores = np.zeros(3000, np.int64)
    for weight, share in ((5000, 0.01), (4000, 0.02), (900, 0.3), (300, 0.6), (50, 0.9)):
        d = np.flatnonzero(r.random(3000) < share).astype(np.int32)
        counts = r.integers(1, 9, len(d)).astype(np.int32)
        peaks = np.array([(c, words[d[counts == c]].min()) for c in np.unique(counts)], np.int32)
        lists.add(weight, d, counts, peaks)
        np.add.at(scores, d, ranking.share(weight, counts.astype(np.int64), lists.sizes[d]))
    best = ranking.Best(10)
    scored = lists.search([(i, 1) for i in range(5)], best)
    want = np.lexsort((np.arange(3000), -scores))[:10]
    assert best.doc.tolist() == want.tolist() and best.score.tolist() == scores[want].tolist()
    assert scored < 1000


def test_pieces_hold_every_token_once(spark, docs):
    tokenizer = Tokenizer.from_str(TOKENIZER)
    got = packing.pack(docs, TOKENIZER)
    rows = got.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in rows)
    whole = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    pieces, found = {}, Counter()
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(tuple(np.frombuffer(r["ids"], "<u4").tolist()))
    for (doc, n), at in pieces.items():
        copies = len(at[0])
        assert all(len(x) == copies and len(set(x)) == 1 for x in at.values()) or doc is None
        for c in range(copies):
            ids = tuple(t for s in sorted(at) for t in at[s][c])
            assert len(ids) == n
            found[doc, ids] += 1
    assert found == whole
    for length in {r["length"] for r in rows}:  # sequences of one length are one range of ids
        mine = [r["sequence_id"] for r in rows if r["length"] == length]
        assert not [r for r in rows if r["length"] != length and min(mine) <= r["sequence_id"] <= max(mine)]
    again = packing.batches(got, 4096).collect()
    assert sum(r["sequences"] for r in again) == len(rows) and all(r["sequences"] * r["length"] <= 4096 for r in again)


@pytest.mark.parametrize("full", [2048, 8, 1])
def test_cuts(full):
    n = np.array([1, 5, full, full + 1, 3 * full + full // 2 + 1, 7])
    which, start, length = packing.cuts(n, full)
    for d, m in enumerate(n.tolist()):
        at = [(s, x) for w, s, x in zip(which, start, length, strict=True) if w == d]
        assert [s for s, _ in at] == np.cumsum([0] + [x for _, x in at])[:-1].tolist() and sum(x for _, x in at) == m
        assert len(at) == m // full + (m % full).bit_count() and all(x & (x - 1) == 0 for _, x in at)


def test_tokens_of_words_are_those_of_texts():
    """Accents that join, signs, apostrophes, white space of every kind, special tokens, the sign between words, a full table."""
    r = random.Random(2)
    pool = [*"abAB zZhHjJ\t\n\x0b\x0c\r\x00\x1c\x1f\x85 　 é̸̱́ẛ̣한ㄱ각ΣςİıßK''’1²½日本<|>.,;_-~=×÷ÀÿÃ🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "don't "]
    tokenizer, table = Tokenizer.from_str(TOKENIZER), packing.Vocabulary(TOKENIZER, table_bytes=60_000)
    for turn in range(30):
        some = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(300)]
        some = [t.replace("<|", "<") for t in some] if turn % 3 else some
        got = table.tokens([t.encode() for t in some])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids + [1] for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert not periodic.periodic_runs(none).collect() and not packing.pack(none, TOKENIZER).collect()
    assert not ranking.rank(none, items).collect()
    assert not ranking.rank(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(0)).collect()
    assert not ranking.rank(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), items).collect()
