"""Resampling, SimHash and fill-in-the-middle against brute force, on whole small tables and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from test_edges import LONG, documents, odd
from turnstone.llm import fill_middle, queries as Q, resample, simhash
from turnstone.llm.base import table

TEXT = st.text(alphabet=st.sampled_from(list("abZ09 \t\n<>PSMé\U0001f600_-")), max_size=60)


# ------------------------------------------------------------------------------------------------ resampling
def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, order=2):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def crc(text):
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 4))
def test_ngram_crcs(text, order):
    ends, sizes = resample.running(text.encode())
    got, _ = resample.ngram_crcs(ends, sizes, np.zeros(len(ends), np.int64), order)
    assert got.tolist() == [crc(g) for g in grams(text, order)]


def test_crcs_of_long_words_and_runs(monkeypatch):
    monkeypatch.setattr(resample, "RUN", 7)
    text = "x" * 100_000 + " ab " + " ".join(f"w{i}" for i in range(50))
    ends, sizes = resample.running(text.encode())
    assert resample.ngram_crcs(ends, sizes, np.zeros(len(ends), np.int64))[0].tolist() == [crc(g) for g in grams(text)]


def brute_sample(docs, target, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(crc(g) % 10_000 for g in grams(text))
    for text in target:
        t.update(crc(g) % 10_000 for g in grams(text))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)}
    rows = []
    for d, text in docs:
        g = [gain[crc(x) % 10_000] for x in grams(text)]
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(g) // len(g) if g else 0
        rows.append([d, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resampling_is_the_brute_force_sample(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = brute_sample(docs, [r.text for r in table(spark, sf, "benchmark").collect()])
    got = Q.op11_prefix_crc_resampling(spark, sf)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert sorted(map(tuple, got.collect()), key=repr) == want and sum(r[4] is not None for r in want) > 20


def test_resampling_of_odd_rows(spark):
    target = spark.createDataFrame([("r1 r2 r3",), (None,), ("",)], "text string").selectExpr("text", "1 AS doc", "2 AS rank")
    docs = odd(spark)
    got = sorted(map(tuple, resample.resample(docs, target).collect()), key=repr)
    want = brute_sample([(r.doc_id, r.text) for r in docs.collect()], ["r1 r2 r3"])
    assert got == want and len(got) == 13
    assert resample.resample(docs.filter("false"), target).collect() == []
    assert len(resample.resample(docs, target.filter("false")).collect()) == 13


# ------------------------------------------------------------------------------------------------ simhash
def brute_print(text, n=4):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(n, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, bits=4):
    """Smallest id reachable of (id, print) rows."""
    found = sorted(set(p for _, p in prints))
    x = np.array(found, np.uint64)
    up = {p: p for p in found}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(found):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= bits):
            a, b = top(p), top(found[i + 1 + j])
            up[max(a, b)] = min(a, b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[top(p)] = min(d, least.get(top(p), d))
    return sorted(((d, f"{p:016x}", least.get(top(p))) for d, p in prints), key=repr)


def test_simhash_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    prints = [(r.doc_id, brute_print(r.text)) for r in table(spark, sf, "documents").collect()]
    got = sorted(map(tuple, Q.op12_simhash_pivots(spark, sf).collect()), key=repr)
    assert got == brute_groups(prints) and sum(c != d for d, _, c in got) > 10


def test_simhash_of_odd_rows(spark):
    docs = odd(spark)
    want = brute_groups([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want and {c for d, _, c in got if d in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(docs.filter("false")).collect() == []
    nobody = documents(spark, [(None, "a b", "en", "s", 1), (None, "", "en", "s", 1)])
    assert {r.component_id for r in simhash.near_duplicates(nobody).collect()} == {None}


def planted(rng, centres=12, each=60):
    """Prints around centres, 0 to 6 bits away, and single ones."""
    out = list(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(each):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            out.append(np.uint64(int(c) ^ sum(1 << int(b) for b in flips)))
    return np.array(out)


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_connect_all_near_prints(spark, tile):
    x = planted(np.random.default_rng(3))
    nodes = spark.createDataFrame([(int(p),) for p in np.unique(x).view(np.int64)], "print long")
    edges = [(r.a, r.b) for r in simhash.links(nodes, tile=tile).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in edges)
    rows = [(i, int(p)) for i, p in enumerate(np.unique(x))]
    up = {p: p for _, p in rows}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in edges:
        a, b = top(a & (1 << 64) - 1), top(b & (1 << 64) - 1)
        up[max(a, b)] = min(a, b)
    least = {}
    for i, p in rows:
        least.setdefault(top(p), i)
    assert [(i, least[top(p)]) for i, p in rows] == sorted((i, c) for i, _, c in brute_groups(rows))


def test_forest_is_no_larger_than_its_nodes():
    x = np.arange(2000, dtype=np.uint64)                    # one dense group
    a, b = simhash.forest(x, np.zeros(2000, np.int64))
    assert len(a) == 1999 and (np.bitwise_count(x[a] ^ x[b]) <= 4).all()


# ------------------------------------------------------------------------------------------------ fill in the middle
def brute_fim(d, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digest = len(units), hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return d, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return d, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return d, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def batch_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(0, 10_000))
def test_scatter_and_gather(texts, first):
    h = [np.array([int(hashlib.sha256(f"42:{first + i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for i in range(len(texts))]) for k in range(4)]
    n, form, head, middle, out, borders = fill_middle.scatter(*batch_of(texts), h, rate=90, spm=50)
    want = [brute_fim(first + i, t, 90, 50) for i, t in enumerate(texts)]
    assert [out[a:b].tobytes().decode() for a, b in zip(borders, borders[1:])] == [w[5] for w in want]
    assert [(a, b) for a, b in zip(n.tolist(), form.tolist())] == [w[1:3] for w in want]
    assert all((a, b) == w[3:5] for a, b, w in zip(head, middle, want) if w[3] is not None)
    back, borders = fill_middle.gather(out, borders, form)
    assert [back[a:b].tobytes().decode() for a, b in zip(borders, borders[1:])] == texts


def test_fill_in_middle_of_odd_rows(spark, monkeypatch):
    docs = odd(spark).unionByName(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(["<P>", "a <M", ">", " x<S>y ", "<", " \t ", LONG, "a " * 900] * 3, 20)]))
    cut = fill_middle.fill_in_middle(docs)
    want = sorted((brute_fim(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, cut.collect()), key=repr) == want
    back = fill_middle.restore(cut, ["doc_id"]).collect()
    assert sorted((repr(r.doc_id), r.restored) for r in back) == sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
    assert cut.filter("false").collect() == [] and fill_middle.restore(fill_middle.fill_in_middle(docs.filter("false")), ["doc_id"]).collect() == []
