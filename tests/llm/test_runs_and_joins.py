"""Periodic runs, spelling variants and the Jaccard join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from railbird.llm import jaccard, periodic, spelling
from tests.llm.test_operators import NASTY, docs_of, rows_of


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, NASTY).where("false")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rewritten(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_runs(words):
    """(start, length, period): every period, every place; a stretch with a smaller period is that one's."""
    n, ids = len(words), np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.empty(0, int)
    out = []
    for p in range(1, n // 4 + 1):
        same = np.concatenate([[False], ids[:-p] == ids[p:], [False]])
        change = np.flatnonzero(np.diff(same.astype(int)))
        for s, e in zip(change[::2], change[1::2], strict=True):
            if e - s + p >= max(6, 4 * p) and not any(p % q == 0 and (ids[s : e + p - q] == ids[s + q : e + p]).all() for q in range(1, p)):
                out.append((int(s), int(e - s + p), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = rewritten(doc_id, words_of(text))
    runs = brute_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def stitch(pieces):
    """What ``periodic.stitched`` does, in Python."""
    by, out = defaultdict(list), []
    for ps, ss, es in pieces:
        for p, s, e in zip(ps.tolist(), ss.tolist(), es.tolist(), strict=True):
            by[p].append((s, e))
    for p, found in by.items():
        found.sort()
        s, e = found[0]
        for a, z in [*found[1:], (1 << 60, 0)]:
            if a > e:
                if e - s + p >= max(6, 4 * p):
                    out.append((s, e - s + p, p))
                s, e = a, z
            e = max(e, z)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shared", [1, 2, 4])
def test_runs_across_small_tiles(monkeypatch, shared):
    monkeypatch.setattr(periodic, "CORE", 16)
    monkeypatch.setattr(periodic, "SHARED", shared)
    rnd = random.Random(shared)
    for _ in range(400):
        letters, parts = rnd.choice(["a", "ab", "abc", "abcdefghijkl"]), []
        while sum(map(len, parts)) < rnd.randrange(1, 300):
            unit = [rnd.choice(letters) for _ in range(rnd.randrange(1, 30))]
            parts.append(unit * rnd.choice([1, 1, 2, 4, 5, 9]) + unit[: rnd.randrange(len(unit))])
        words = [w for p in parts for w in p]
        ids = periodic.numbers_of([w.encode() for w in words])
        want = brute_runs(words)
        assert stitch(f for t in periodic.tiles_of(ids) for f in periodic.solve(*t)) == want
        assert periodic.may_run(ids) or not want


def test_runs_of_documents(spark, docs):
    rnd = random.Random(3)
    odd = [f"w{rnd.randrange(10**6)}" for _ in range(30_000)]
    unit = [f"u{rnd.randrange(10**6)}" for _ in range(3000)]
    extra = [
        (50, "a " * 20_000), (51, " ".join(odd[:7000] + unit * 4 + odd[7000:9000])), (52, " ".join(odd[:8190] + ["x", "y"] * 6 + odd[8200:20_000])),
        (53, " ".join((["p", "q", "q"] * 5 + ["r"]) * 4)), (54, "A a A a A a"), (55, "a a a a a a"), (56, "a b a b a b a"), (57, "a b a b a b a b"), (58, "é x " * 9),
    ]
    rows = NASTY + extra + [(r.doc_id + 1000, r.text) for r in docs.collect() if len(r.text or "") < 30_000]
    rows = [(i, t) for i, t in rows] + [(i, t) for i, t in NASTY[:5]]
    got = periodic.report(docs_of(spark, rows))
    assert rows_of(got, *RUN_COLUMNS) == sorted((brute_row(i, t) for i, t in rows), key=str)
    assert sum(r.n_runs > 0 for r in got.collect()) > 10


def test_runs_of_a_text_of_megabytes(spark):
    rnd = random.Random(4)
    unit = [f"u{rnd.randrange(10**6)}" for _ in range(40_000)]
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200_000)] + unit * 4 + ["z"] * 100_000
    i = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    (row,) = periodic.report(docs_of(spark, [(i, " ".join(words))])).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 360_000, 100_000, 1, 100_000_000)
    runs = [(200_000, 160_000, 40_000), (360_000, 100_000, 1)]
    assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(words[:240_000] + ["z"]).encode()).hexdigest()


def test_no_rows(spark, empty):
    assert periodic.report(empty).collect() == [] and spelling.variants(empty).collect() == [] and jaccard.components(empty).collect() == []


# --- spelling --------------------------------------------------------------------------------


def brute_vocabulary(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_variants(known):
    by_length, out, forms = defaultdict(list), [], {}
    for w in known:
        by_length[len(w)].append(w)
    found = {w: [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if v != w and abs(len(v) - len(w)) <= 1 and near(w, v)] for w in known}
    for w, others in found.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        forms[w] = best if best is not None and known[best] >= 2 * known[w] else None
    for w in known:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, known[w], len(found[w]), known[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def test_spelling_variants(spark):
    rnd = random.Random(5)
    roots = ["aabba", "aaaaa", "abcdef", "straße", "naïveté", "colour", "ÀÉÎöü", "x" * 600, "ab" * 256, "×÷×÷×"]
    rows = []
    for i in range(400):
        said = []
        for _ in range(30):
            w = rnd.choice(roots)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcÉ") + w[k:], w[:k] + rnd.choice("abx") + w[k + 1 :]])
            said.append(rnd.choice([w, w.upper().replace("SS", "ß"), w]))
        rows.append((rnd.choice([i, None]), rnd.choice([" ", "-", "1"]).join(said)))
    rows += [(r, t) for r, t in NASTY] + NASTY
    want = brute_variants(brute_vocabulary(rows))
    assert rows_of(spelling.variants(docs_of(spark, rows)), "word", "form", "root", "n", "n_near", "form_n") == want
    assert len(want) > 100 and any(r[1] != r[2] and r[1] for r in want)


def test_spelling_of_documents(spark, docs):
    want = brute_variants(brute_vocabulary([tuple(r) for r in docs.collect()]))
    assert rows_of(spelling.variants(docs), "word", "form", "root", "n", "n_near", "form_n") == want


# --- Jaccard join ----------------------------------------------------------------------------


def brute_components(rows, size=3, percent=90):
    sets = []
    for _, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holds[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holds[g] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                top[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rnd, words, share):
    return [f"e{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words]


def test_jaccard_components(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    bases = [[rnd.choice(words) for _ in range(n)] for n in (3, 4, 12, 13, 40, 120, 400, 3000)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = list(NASTY)
    for k in range(400):
        base = rnd.choice(bases)
        share = rnd.choice([0, 0, 0.005, 0.01, 0.02])
        said = edited(rnd, base, share)
        if rnd.random() < 0.2:
            said = said + passage
        if rnd.random() < 0.2:
            said = said[: rnd.randrange(1, len(said) + 1)]
        rows.append((rnd.choice([k + 100, k + 100, None]), rnd.choice([" ", "\n", "  "]).join(said)))
    rows += rows[-20:]
    want = brute_components(rows)
    assert rows_of(jaccard.components(docs_of(spark, rows)), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_of_documents(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_jaccard_blocks_lose_no_link(spark, percent):
    """Many near copies of one text, with blocks far smaller than a group."""
    rnd = random.Random(percent)
    base = [f"b{k}" for k in range(200)]
    rows = [(k, " ".join(edited(rnd, base, rnd.choice([0.004, 0.01, 0.03])))) for k in range(150)]
    df = docs_of(spark, rows)
    levels = jaccard.slot_levels(df, "text", 3)
    sets = jaccard.prefixes(df, levels, "doc_id", "text", 3, percent).selectExpr("id as node", "text_key", "n", "common", "ranges", "prefix").cache()
    links = [tuple(r) for r in jaccard.similar_pairs(df, sets, "text", 3, percent, block=7).collect()]
    top = {k: k for k, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    assert sorted((k, find(k)) for k, _ in rows) == sorted((d, c) for d, _, c in brute_components(rows, percent=percent))


def test_needed_overlap_is_exact():
    for p in (50, 80, 90):
        for a in range(1, 60):
            for b in range(1, 60):
                least = next(i for i in range(200) if 100 * i >= p * (a + b - i))
                assert jaccard.needed(a, b, p) == least
        assert all(jaccard.prefix_length(n, p) == n - -(-n * p // 100) + 1 for n in range(1, 300))
