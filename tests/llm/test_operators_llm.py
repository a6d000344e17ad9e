"""Each corpus operator against brute force, with edge rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, exact_dedup, hmm_score, html_extract, language_id, mixing, near_dedup, quality, suffix_dedup, token_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(t):
    return (t or "").translate(LOW)


# ---- language identification


def py_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter(c for w in words for c in w)
    for n in (2, 3, 4):
        for w in words:
            w = f" {w} "
            # A border only at the ends; single letters between borders are no four-gram.
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def test_gram_counts_match_brute_force():
    for text in ("a", "ab", "Abc abc", "x-y É", "one two three " * 30, "", "12 !", "𐐀𐐁 a𐐁𐐁b 𐐁𐐀𐐁𐐀 \u0428\u0429"):
        codes, counts = language_id.gram_counts(text)
        assert sorted(counts.tolist()) == sorted(py_grams(text).values())


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_gram_counts_of_slices(monkeypatch, size):
    monkeypatch.setattr(language_id, "SLICE", size)
    for text in ("a", "ab cd", "one two three " * 30, "wordwithoutblanks" * 9, "", "é𐐁𐐀x " * 5):
        codes, counts = language_id.gram_counts(text)
        assert sorted(counts.tolist()) == sorted(py_grams(text).values()) and len(set(codes.tolist())) == len(codes)


def test_language_ties_and_repeated_rows(spark):
    rows = [(1, "ab", "yy"), (2, "ab", "xx"), (2, "ab", "xx"), (3, "ab", None), (3, "ab", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = language_id.identify(d, language_id.train_profiles(d)).collect()
    assert len(out) == 5 and {r.lang_pred for r in out} == {"xx"}  # equal distances: the first name


def test_language_id(spark, empty):
    r = random.Random(2)
    stock = {"aa": "wah koo mib tas".split(), "bb": "eun lof zir pex".split()}
    rows = [(i, " ".join(r.choice(stock[k]) for _ in range(30)), k) for i, k in enumerate("aa bb".split() * 20)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 !!", None), (103, "wah wah tas", None), (104, "lof pex " * 300_000, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("row", F.lit(1)).withColumn("gram", F.lit(2))
    p = language_id.train_profiles(d)
    out = {r.doc_id: r for r in language_id.identify(d, p).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:40])
    assert [out[i].lang_pred for i in range(100, 105)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.lang_score <= 1 for r in out.values()) and out[104]["row"] == 1
    # Distances by the definition.
    top = lambda t: language_id.ranked(*language_id.gram_counts(t), p.size).tolist()
    total = defaultdict(Counter)
    for _, t, k in rows[:40]:
        codes, counts = language_id.gram_counts(t)
        total[k].update(dict(zip(codes.tolist(), counts.tolist())))
    profile = {k: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: p.size])} for k, c in total.items()}
    grams = top("wah wah tas")
    dist = {k: sum(abs(i - q[g]) if g in q else p.size for i, g in enumerate(grams)) for k, q in profile.items()}
    assert min(dist, key=dist.get) == "aa" and out[103].lang_score == pytest.approx(1 - dist["aa"] / (len(grams) * p.size))
    none = language_id.train_profiles(d.where("lang = 'zz'"))
    assert {r.lang_pred for r in language_id.identify(d, none).collect()} == {"und"}
    assert language_id.identify(empty, p).count() == 0


# ---- exact duplicates


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("bound", [exact_dedup.BROADCAST_GROUPS, 0])
def test_exact_groups(docs, corpus, keep, weak, bound, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", bound)
    h = (lambda c: F.substring(F.md5(c), 1, 1)) if weak else F.md5
    groups = defaultdict(list)
    for i, t in corpus:
        groups[low(t)].append(i)
    best = min if keep == "smallest" else max
    want = Counter((i, best(groups[low(t)]), len(groups[low(t)]), i == best(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in corpus)
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs, keep=keep, hash_of=h).collect()) == want


def test_exact_dedup_rows(spark, docs, corpus, empty):
    more = docs.withColumns({c: F.lit(1) for c in ("_h", "_salt", "keep_id", "row")})
    out = exact_dedup.dedup(more)
    assert out.columns == more.columns
    assert sorted(low(r.text) for r in out.collect()) == sorted({low(t) for _, t in corpus})
    out = exact_dedup.dedup(more, hash_of=lambda c: F.substring(F.md5(c), 1, 1))
    assert sorted(low(r.text) for r in out.collect()) == sorted({low(t) for _, t in corpus})
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (1, "A"), (None, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(nulls).collect()} == {(None, 1), (1, 1), (None, None)}


# ---- near duplicates


def py_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    smallest = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(smallest[find(i)], d)
    return [(d, len(s), smallest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_components(docs, corpus, size):
    got = near_dedup.components(docs, size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(py_components(corpus, size, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block, stream", [(near_dedup.BLOCK, near_dedup.STREAM), (3, 4)])
def test_near_components_of_a_spread_group(spark, monkeypatch, block, stream):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "STREAM", stream)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        v = list(base)
        for _ in range(r.randrange(0, 6)):
            v[r.randrange(60)] = f"u{r.random()}"
        rows.append((i, " ".join(v)))
    r.shuffle(rows)
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == Counter(py_components(rows, 2, 80))


def test_near_dedup_rows(spark, docs, empty):
    more = docs.withColumns({c: F.lit(1) for c in ("nid", "label", "raw", "_raw", "b")})
    out = near_dedup.dedup(more, 2)
    assert out.columns == more.columns
    kept = {r.doc_id for r in near_dedup.components(docs, 2).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == kept
    assert near_dedup.components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "q r s"), (None, "zz")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or -1, r.component_id or -1) for r in near_dedup.components(odd, 2).collect()))
    assert got == [(-1, -1), (-1, 3), (-1, 3), (3, 3), (3, 3)]


def test_bitmaps_refuse_no_similar_pair():
    r = np.random.default_rng(0)
    for n in (1, 2, 30, 147, 600):
        base = r.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = []
        for share in r.random(10) * 0.4:
            v = base.copy()
            k = r.random(n) < share
            v[k] = r.integers(0, 1 << 63, int(k.sum()), dtype=np.uint64)
            sets.append(np.unique(v[: max(1, int(n * (1 - share / 2)))]))
        for a, b in itertools.product(sets, sets):
            maybe = near_dedup.may_be_similar(near_dedup.bitmap(a)[None, :], np.array([len(a)]), near_dedup.bitmap(b), len(b), 80)[0]
            assert maybe or not near_dedup.similar(a, b, 80)


def test_circulant_signature():
    s = near_dedup.Shingler(2)
    x = s.shingles(b"a b c d e f".split())
    windows = near_dedup.second_permutation(near_dedup.ROWS * near_dedup.BANDS)
    slots = (near_dedup._mixed(x) >> np.uint64(44)).astype(int)
    first = np.concatenate((windows[:, 0], windows[:200, 0]))
    assert s.signature(x).tolist() == [int(min(first[slots + k])) for k in range(near_dedup.ROWS * near_dedup.BANDS)]


# ---- decontamination


def py_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def py_report(docs, bench, size, min_items):
    wins = defaultdict(set)
    for i, t in bench:
        w = py_words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = py_words(t)
        hit, items = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    items |= wins[tuple(w[k : k + n])]
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), sha, len(items) >= min_items))
    return Counter(out)


def _bench(corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 15]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    return [(1, cut(texts[0], 2, 14)), (2, cut(texts[1], 0, 8)), (3, cut(texts[1], 4, 13)), (10, "Word"), (11, cut(texts[2], 3, 6)), (12, None), (13, " "), (None, cut(texts[4], 1, 12)), (2, cut(texts[6], 0, 9))]


@pytest.mark.parametrize("max_broadcast", [decontaminate.MAX_BROADCAST, 0])  # beyond the bound: by shuffle
def test_decontamination_report(spark, docs, corpus, max_broadcast):
    bench = _bench(corpus)
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontaminate.report(docs, b, 8, 2, max_broadcast=max_broadcast)
    assert Counter(tuple(r) for r in got.collect()) == py_report(corpus, bench, 8, 2)


def test_decontaminate_rows(spark, docs, corpus, empty):
    bench = spark.createDataFrame(_bench(corpus), "item_id bigint, text string")
    bad = {r.doc_id for r in decontaminate.report(docs, bench).where("contaminated").collect()}
    assert bad
    more = docs.withColumns({c: F.lit(1) for c in ("_w", "_p", "_id", "_key")})
    out = decontaminate.decontaminate(more, bench)
    assert out.columns == more.columns and {r.doc_id for r in out.collect()} == {i for i, _ in corpus} - bad
    cut = decontaminate.decontaminate(docs, bench, mode="spans")
    assert cut.count() == len(corpus)
    before = dict(corpus)
    left = decontaminate.report(docs, bench)
    words = {r.doc_id: r.n_words - r.n_hit for r in left.collect()}
    for r in cut.collect():
        assert len(py_words(r.text)) == words[r.doc_id] if r.doc_id in bad else r.text == before[r.doc_id]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(docs, none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.report(empty, bench).count() == 0


# ---- repeated passages


def py_passages(rows):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def test_repeated_passages(docs, corpus, empty):
    assert Counter(tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()) == py_passages(corpus)
    assert suffix_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3, 0])
def test_repeated_passages_over_small_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(3)
    unit = ["ab" * 40, "x" * 120, "é" * 60, "".join(r.choice("abc") for _ in range(200))]
    rows = [(i, "".join(r.choice(unit) + r.choice("\0pq ") for _ in range(r.randrange(1, 4)))) for i in range(60)]
    rows += [(i + 60, t) for i, t in rows[:10]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert Counter(tuple(x) for x in suffix_dedup.repeated_passages(d).collect()) == py_passages(rows)
    odd = spark.createDataFrame([(None, unit[3]), (5, unit[3]), (5, unit[3]), (None, "s")], "doc_id bigint, text string")
    assert sorted((x.doc_id or 0, x.n_removed) for x in suffix_dedup.repeated_passages(odd).collect()) == [(0, 0), (0, 200), (5, 0), (5, 0)]


def test_repeated_passages_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARE", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2_000)
    r = random.Random(6)
    unit = ["".join(r.choice("abcd ") for _ in range(r.randrange(40, 160))) for _ in range(30)]
    rows = [(i, " ".join(r.choice(unit) for _ in range(r.randrange(1, 5)))) for i in range(120)]
    parts, subs = suffix_dedup._deal(sum(len(t) for _, t in rows))
    assert parts > 1024 and subs > 2
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(tuple(x) for x in suffix_dedup.repeated_passages(d).collect()) == py_passages(rows)


def test_work_of_a_block_does_not_grow_with_the_parts():
    data = np.random.default_rng(1).integers(97, 123, 1 << 20, dtype=np.uint8)
    began = time.process_time()
    block = suffix_dedup.Block(np.array([1]), np.array([0, len(data)]), data)
    opened = time.process_time() - began
    size = np.bincount((block.distinct % np.uint64(4_096)).astype(np.int64), minlength=4_096)
    replies = [{"part": p, "bits": np.packbits(np.full((2, n), p % 2 == 0)).tobytes()} for p, n in enumerate(size.tolist()) if n]
    began = time.process_time()
    marked, hot = suffix_dedup._marks(block, 4_096, replies)
    assert time.process_time() - began < 2 * opened  # 5 times as long as opening when every part looked at all anchors
    assert (marked == (block.distinct % np.uint64(2) == 0)).all() and (hot == marked).all()


def test_loser_tree_merges():
    r = random.Random(4)
    for k in (1, 2, 3, 5, 8, 16):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(6)) for _ in range(r.randrange(0, 30))}) for _ in range(k)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 6)
        shared = [[0, *(common(a, b) for a, b in zip(x, x[1:]))][: len(x)] for x in runs]
        which, same = suffix_dedup.merge_runs([[int.from_bytes(v) for v in x] for x in runs], shared, 6)
        at = [0] * k
        out = []
        for w in which:
            out.append(runs[w][at[w]])
            at[w] += 1
        assert out == sorted(itertools.chain(*runs))
        assert same == [0, *(common(a, b) for a, b in zip(out, out[1:]))][: len(out)]


# ---- token counts


def test_token_counts(spark, docs, corpus, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(6)
    parts = [*"abzAZ09'.,!\n\t\r ", "é", "ß", "中", "🙂", "\x1c", "\x85", " ", "½", "'s", "'LL", "<|endoftext|>", "aaaa", "  "]
    rows = [*corpus, *((500 + i, "".join(r.choice(parts) for _ in range(r.randrange(60)))) for i in range(300)), (900, "a" * 3000), (901, " " * 2000), (902, "one two " * 200_000)]
    want = {i: len(e.ids) for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False))}
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k", F.lit(1)), path).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for x in got:
        assert (x.n_tokens, x.n_bytes, x.over_limit) == (want[x.doc_id], len((text[x.doc_id] or "").encode()), want[x.doc_id] > 1024)
    assert token_counts.token_counts(empty, path).count() == 0


# ---- mixing


def test_rates_solve_the_least_squares(spark):
    r = np.random.default_rng(1)
    post = r.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = r.integers(1, 500, 200)
    rows = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, post)], "_tokens bigint, _post array<double>")
    for targets in ([0.6, 0.3, 0.1], [0.9, 0.1, 0.0], [0.2, 0.2, 0.2]):
        found = mixing.solve_rates(rows, targets)
        got = np.array([x.r for x in rows.select(found.rate.alias("r")).collect()])
        assert (got >= 0).all()
        share = (got * tokens) @ post / tokens.sum()
        assert share == pytest.approx(found.reached) and found.residual == pytest.approx(np.linalg.norm(share - targets))
        best = np.ones(200)
        for _ in range(20_000):
            best = np.maximum(0, best - 0.9 * post @ ((best * tokens) @ post / tokens.sum() - targets))
        least = np.linalg.norm((best * tokens) @ post / tokens.sum() - targets)
        assert np.linalg.norm(share - targets) <= least + 1e-5
    # Few documents, of which no mixture gives the targets.
    rows = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.8, 0.2]), (5, [1.0, 0.0])], "_tokens bigint, _post array<double>")
    found = mixing.solve_rates(rows, [0.2, 0.7])
    a, b = np.array([[9.0, 16.0, 5.0], [1.0, 4.0, 0.0]]) / 35, np.array([0.2, 0.7])
    least = np.linalg.norm(b)
    for used in ([0], [1], [2], [0, 1], [0, 2], [1, 2]):  # the best rates have some documents at 0 and solve the rest
        x = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
        least = min(least, np.linalg.norm(a[:, used] @ x - b)) if (x >= 0).all() else least
    assert found.residual == pytest.approx(least, abs=1e-5)
    kept = mixing.solve_rates(rows, [0.5, 0.1], whole=[0])
    assert kept.targets == pytest.approx([30 / 35, 30 / 35 / 5]) and kept.residual < 1e-5


def test_posteriors_are_naive_bayes(spark):
    prior, features = [math.log(0.5), math.log(0.3), math.log(0.2)], {f"w{i}": [i * 0.1, -i * 0.2, 0.05 * i * i] for i in range(1, 90)}
    r = random.Random(8)
    rows = [[f"w{r.randrange(120)}" for _ in range(r.randrange(12))] for _ in range(60)] + [[], ["éé"]]
    rows = [sorted(set(w)) for w in rows]
    got = spark.createDataFrame([(w,) for w in rows], "w array<string>").select("w", mixing.posteriors(F.col("w"), prior, features).alias("p")).collect()
    for x in got:
        logits = np.array(prior) + sum((np.array(features[w]) for w in x.w if w in features), np.zeros(3))
        e = np.exp(logits - logits.max())
        assert x.p == pytest.approx(list(e / e.sum()))


def test_mixing_finds_domains(spark, empty):
    r = random.Random(7)
    kinds = {"good": "alpha beta gamma".split(), "poor": "junk spam ###".split(), "toxic": "vile nasty alpha".split()}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(12)), k) for i, k in enumerate(["good"] * 60 + ["poor"] * 30 + ["toxic"] * 30)]
    rows += [(500, None, "good"), (501, "", "poor")]
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("_row", "_w", "rate_", "_post")})
    labels = spark.createDataFrame([(i, k) for i, _, k in rows[::2]] + [(None, "good")], "doc_id bigint, domain string")
    out = mixing.mix(d, labels, {"good": 0.5, "poor": 0.1, "toxic": 0.05})
    assert out.columns == [*d.columns, "n_tokens", "posteriors", "rate", "copies"]
    got = {x.doc_id: x for x in out.collect()}
    assert all(max(got[i].posteriors.asDict(), key=got[i].posteriors.asDict().get) == k for i, _, k in rows[:120])
    assert all(abs(sum(x.posteriors) - 1) < 1e-9 and x.rate >= 0 and abs(x.copies - x.rate) <= 1 for x in got.values())
    assert got[500].n_tokens == 0
    rows2, found = mixing.assign(d, labels, {"good": 0.5, "poor": 0.1, "toxic": 0.05})
    assert found.residual < 1e-5
    total = sum(x.n_tokens for x in got.values())
    for k, target in (("good", 0.5), ("poor", 0.1), ("toxic", 0.05)):
        assert sum(x.rate * x.n_tokens * x.posteriors[k] for x in got.values()) / total == pytest.approx(target, abs=1e-5)
    twice = d.union(d)
    again = mixing.mix(twice, labels, {"good": 0.5, "poor": 0.1, "toxic": 0.05}).collect()
    assert len(again) == 2 * len(got) and len({(x.doc_id, x.rate, x.copies) for x in again}) == len(got)
    clash = d.withColumns({c: F.lit("x") for c in mixing.ADDED})
    assert mixing.mix(clash, labels, {"good": 0.5, "poor": 0.5}).columns == [*d.columns, *mixing.ADDED]
    assert mixing.mix(empty, labels, {"good": 0.5, "poor": 0.5}).count() == 0
    none = mixing.mix(d, labels.where("false"), {"good": 0.5, "poor": 0.5})
    assert {round(x.posteriors.good, 6) for x in none.collect()} == {0.5}


def test_mixing_plan_is_native(spark, docs):
    labels = spark.createDataFrame([(1, "good")], "doc_id bigint, domain string")
    plan = mixing.mix(docs, labels, {"good": 0.5, "poor": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- hidden Markov scores


def _model(states, symbols, seed=1):
    r = np.random.default_rng(seed)
    return hmm_score.Model(r.dirichlet(np.ones(states), 2), r.dirichlet(np.ones(states), states), r.dirichlet(np.ones(symbols), states).T)


def test_forward_is_exact():
    m, r = _model(3, 7), np.random.default_rng(2)

    def plain(s):
        a, total = m.start[0] * m.emit[s[0]], 0.0
        for t in s[1:]:
            a = (a @ m.move) * m.emit[t]
            total += math.log10(a.sum())
            a = a / a.sum()
        return total + math.log10(a.sum())

    seqs = [r.integers(0, 7, n) for n in (1, 5, 3, 700, 40_000, 5)]
    assert hmm_score.score(m, seqs) == pytest.approx([plain(s) for s in seqs], rel=1e-10)


def test_expected_counts_are_exact():
    m, r = _model(3, 7), np.random.default_rng(3)
    seqs = [r.integers(0, 7, n) for n in (1, 4, 3)]
    start, move, emit, ll = hmm_score.expected_counts(m, seqs, np.array([False, False, True]))
    want_start, want_move, want_emit, want_ll = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((7, 3)), 0.0
    for k, s in zip((0, 0, 1), seqs):
        paths = {}
        for p in itertools.product(range(3), repeat=len(s)):
            w = m.start[k][p[0]] * m.emit[s[0]][p[0]]
            for i in range(1, len(s)):
                w *= m.move[p[i - 1], p[i]] * m.emit[s[i]][p[i]]
            paths[p] = w
        total = sum(paths.values())
        want_ll += math.log10(total)
        for p, w in paths.items():
            want_start[k, p[0]] += w / total
            for i in range(len(s)):
                want_emit[s[i], p[i]] += w / total
            for i in range(1, len(s)):
                want_move[p[i - 1], p[i]] += w / total
    assert np.allclose(start, want_start, rtol=1e-4) and np.allclose(move, want_move, rtol=1e-4) and np.allclose(emit, want_emit, rtol=1e-4, atol=1e-6)
    assert ll == pytest.approx(want_ll, rel=1e-5)


def test_scores(spark, docs, corpus, empty):
    held = F.col("doc_id") % 5 == 2
    got = hmm_score.scores(docs, held, states=3, head=8, rounds=3).collect()
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"]) for i, t in corpus]
    c = Counter(w for i, t in tokens if i % 5 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, i % 5 == 2, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm_score.scores(empty, held, states=2, head=4, rounds=1).count() == 0
    untrained = hmm_score.scores(docs, F.lit(True), states=2, head=4, rounds=1).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}


def test_scores_match_brute_force(spark, docs, corpus):
    held = F.col("doc_id") % 5 == 2
    fitted = hmm_score.fit(docs, held, states=3, head=8, rounds=2)
    v, m = fitted.vocabulary, fitted.model
    c = Counter(w.encode() for i, t in corpus if i % 5 != 2 for w in re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"])
    first = len(v.head)
    assert first in (8, 9) and [v.counts[v.head[w]] for w in v.head] == [c[w] for w in v.head]
    assert sorted(v.counts[1:], reverse=True)[:7] == sorted((n for w, n in c.items() if w != b"\n"), reverse=True)[:7]
    groups = defaultdict(list)
    for w in c:
        if w not in v.head:
            groups[hmm_score.word_class(w)].append(w)

    def chances(w):
        if w in v.head:
            return m.emit[v.head[w]]
        k = hmm_score.word_class(w)
        return m.emit[first + k] * (c[w] + 1) / (sum(c[x] for x in groups[k]) + len(groups[k]) + 1)

    # All words and one unknown word of each class have all the chances there are.
    unknown = sum(m.emit[first + k] / (sum(c[x] for x in groups[k]) + len(groups[k]) + 1) for k in range(hmm_score.CLASSES))
    assert sum(chances(w) for w in c) + unknown == pytest.approx(np.ones(3))
    got = {r.doc_id: r.score for r in hmm_score.scored(fitted).collect()}
    for i, t in corpus:
        a, out = None, 0.0
        for w in [*(low(t).encode().split()), b"\n"]:
            a = chances(w) * (m.start[0] if a is None else a @ m.move)
            out += math.log10(a.sum())
            a = a / a.sum()
        assert got[i] == pytest.approx(out, rel=1e-9)


@pytest.mark.parametrize("wide", [0, 12, hmm_score.WIDE])
def test_scores_do_not_depend_on_the_words_sent(spark, docs, corpus, monkeypatch, wide):
    held = F.col("doc_id") % 5 == 2
    rows = lambda: sorted(tuple(r) for r in hmm_score.scored(hmm_score.fit(docs, held, 2, 8, 1)).collect())
    monkeypatch.setattr(hmm_score, "FLUSH", 5)
    expected = rows()
    monkeypatch.setattr(hmm_score, "WIDE", wide)
    got = rows()
    assert len(got) == len(corpus)
    assert all(x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-12) for x, y in zip(got, expected))
    # Words with counts that were sent to the tasks do not meet the table of counts again.
    fitted = hmm_score.fit(docs, held, 2, 8, 1)
    joined = {bytes(w) for r in fitted.encoded.select("words").collect() for w in r.words}
    c = Counter(w.encode() for i, t in corpus if i % 5 != 2 for w in low(t).split(" ") if w)
    left = [w for w in joined if c[w] > 0]
    assert len(fitted.vocabulary.wide) <= wide and not joined & fitted.vocabulary.wide.keys()
    assert not left if wide > len(c) else left


def test_pieces_count_every_transition_once(spark, monkeypatch):
    """Counts of texts in pieces with context are those of whole texts, but for what the context leaves open."""
    m, r = _model(3, 5), np.random.default_rng(6)
    seqs = [r.integers(0, 5, n) for n in (1, 40, 161, 64)]
    start, move, emit, _ = hmm_score.expected_counts(m, seqs, np.zeros(4, bool))
    pieces = []
    for s in seqs:
        for at in range(0, len(s), 32):
            low_, high = max(0, at - 24), min(at + 56, len(s))
            pieces.append((s[low_:high], low_ > 0, (at - low_, min(at + 32, len(s)) - low_)))
    parts = hmm_score.expected_counts(m, [p for p, _, _ in pieces], np.array([x for _, x, _ in pieces]), [i for _, _, i in pieces])
    assert parts[1].sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-5) and parts[2].sum() == pytest.approx(sum(map(len, seqs)), rel=1e-5)
    assert np.allclose(parts[0][0], start[0], rtol=1e-3) and np.allclose(parts[1], move, rtol=1e-3) and np.allclose(parts[2], emit, rtol=1e-3)


def test_scores_of_null_ids(spark):
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    d = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id bigint, text string")
    out = hmm_score.scores(d, fold == 2, states=2, head=4, rounds=1).collect()
    assert len(out) == 3 and sorted((r.doc_id or 0, r.held_out, r.n_tokens) for r in out) == [(0, False, 3), (0, False, 3), (1, zlib.crc32(b"1") % 7 == 2, 1)]


def test_training_raises_the_likelihood(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcd" if i % 2 else "wxyz") for _ in range(40))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    total = lambda n: d.sparkSession.createDataFrame(hmm_score.scores(d, F.lit(False), 2, 16, n).collect()).agg(F.sum("score")).first()[0]
    one, ten = total(1), total(10)
    base = hmm_score.scores(d, F.lit(False), 2, 16, 0).agg(F.sum("base_score")).first()[0]
    assert ten > one and ten > base


# ---- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><div class="top-nav"><a href="/">Home</a></div>
<div class="box">Same on every page</div><div id="content"><h2>Head {i}</h2><p>First&nbsp;&amp; <b>bo</b>ld<br>line {i}</p>loose {i} text<ul><li>one {i}</li><li>two {i}</li></ul></div>
<div class="links"><a href="a">link a</a> <a href="b">link b</a></div><div class="comments"><p>Nice!</p></div><form>f <input></form><footer>&copy; x</footer></body></html>"""


def test_html_template(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(6)] + [(9, "http://lone.example/", PAGE.format(i=9))]
    rows += [(20, None, None), (21, "u", ""), (22, "http://h.example/x", "plain &lt;text&gt;  only"), (23, "http://a.example/", "<article><header><h1>H</h1></header><p>b<p>c<aside>no</aside><!-- x --></article><p>out")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows[:6] + rows[6:7] + rows[7:9] + rows[10:], "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"Head {i}\n\nFirst & bold line {i}\n\nloose {i} text\n\none {i}\n\ntwo {i}" and got[i].n_chars == len(got[i].text)
    assert "Same on every page" in got[9].text  # one page is no template
    assert (got[20].text, got[21].text, got[20].url) == ("", "", None)
    assert got[23].text == "H\n\nb\n\nc"
    plain = html_extract.extract(spark.createDataFrame([rows[9]], "page_id bigint, url string, html string")).first()
    assert plain.text == "plain <text> only"
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_frame_is_the_class_of_ones(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(4)]
    p = spark.createDataFrame(rows, "_key bigint, url string, html string").withColumn("_host", F.lit("h"))
    frame = html_extract.templates(p).first()._frame
    roles = [t for t in frame if not t.startswith("#")]
    assert roles[:3] == ["/html", "/html/body", "/html/body/div.top-nav"] and "/html/body/div.content/ul/li" not in roles
    assert sum(t.startswith("#text") for t in frame) >= 1


def _html(spark, pages):
    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)]
    return [r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]


def test_html_template_text_in_article_goes(spark):
    page = "<body><article><h1>Head {i}</h1><p>Get our app</p><p>Text {i}</p></article></body>"
    assert _html(spark, [page.format(i=i) for i in range(4)]) == [f"Head {i}\n\nText {i}" for i in range(4)]
    assert _html(spark, [page.format(i=0)] * 4) == ["Head 0\n\nGet our app\n\nText 0"] * 4  # copies of one page show no template


def test_html_nested_classes(spark):
    page = "<body><h1>Head {i}</h1>{a}<p>Text {i}</p>{b}<p>End {i}</p></body>"
    share = "<p>Share this</p>"
    # Missing on one page of five, and twice a page.
    assert _html(spark, [page.format(i=i, a=share if i else "", b="") for i in range(5)]) == [f"Head {i}\n\nText {i}\n\nEnd {i}" for i in range(5)]
    assert _html(spark, [page.format(i=i, a=share, b=share) for i in range(5)]) == [f"Head {i}\n\nText {i}\n\nEnd {i}" for i in range(5)]
    # Text that two articles of five share stays.
    assert [t.count("Share") for t in _html(spark, [page.format(i=i, a=share if i < 2 else "", b="") for i in range(5)])] == [1, 1, 0, 0, 0]


def test_html_frame_has_one_order():
    swapped = "<body><h2>a</h2><h1>b</h1><h3>c</h3></body>"
    assert html_extract.out_of_order(swapped, ["/body", "/body/h1", "/body/h2", "/body/h3"]) in (["/body/h1"], ["/body/h2"])
    assert html_extract.out_of_order(swapped, ["/body", "/body/h2", "/body/h1", "/body/h3"]) == []


@pytest.mark.parametrize("name", ["has-sidebar", "page-header-fixed", "search-layout", "header", "search"])
def test_html_layout_words_keep_the_article(name):
    page = f"<body><div class='{name}'><p>menu</p><article><h1>H</h1><p>a</p></article></div></body>"
    assert html_extract.article_text(page, []) == "H\n\na"


def test_html_words_inside_articles():
    for name in ("discussion", "related-work", "legal"):
        assert html_extract.article_text(f"<article><p>a</p><section class='{name}'><p>b</p></section></article>", []) == "a\n\nb"
    for name in ("comments", "ad", "share", "newsletter-box", "top-nav"):
        assert html_extract.article_text(f"<article><p>a</p><div class='{name}'><p>b</p></div></article>", []) == "a"
    assert html_extract.article_text("<article><p>a</p></article><div class='comments'><article><p>b</p></article></div>", []) == "a"
    assert html_extract.article_text("<nav><div class='search'><article>b</article></div></nav><p>a</p>", []) == "a"


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "iframe"])
def test_html_unclosed_raw_element(tag):
    page = f"<body><div><{tag}>x</div><article><p>a</p><{tag}>y</article><p>z</p></body>"
    assert html_extract.article_text(page, []) == "a"
    assert html_extract.article_text(f"<body><{tag}>x<p>a</p></body>", []) == "a"
    assert html_extract.article_text(f"<div><{tag}>x<div>y</div></{tag}>a</div>", []) == "a"


# ---- quality


def test_ordinal_fit_orders_grades(spark, empty):
    r = random.Random(8)
    words = {0: "vile nasty", 1: "meh junk", 2: "fine good"}
    rows = [(i, " ".join(r.choice(words[i % 3].split() + ["the", "of"]) for _ in range(15)), i % 3) for i in range(600)]
    d = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, "")], "doc_id bigint, text string").withColumn("features", F.lit(1))
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows[:450]] + [(None, 1), (900, 0), (5, 7)], "doc_id bigint, grade int")
    model = quality.train(d, ratings, 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = {x.doc_id: x for x in quality.grade(d, model).collect()}
    assert sum(abs(got[i].expected_grade - g) < 0.5 for i, _, g in rows[450:]) >= 0.95 * 150
    assert all(0 <= x.tail_prob <= 1 and 0 <= x.expected_grade <= 2 and x.kept == (x.tail_prob >= 0.5) for x in got.values())
    assert got[900].expected_grade == got[901].expected_grade
    assert quality.grade(empty, model).count() == 0
    none = quality.train(d, ratings.where("false"), 3)
    assert {round(x.expected_grade, 6) for x in quality.grade(d, none).collect()} == {1.0}


def test_ordinal_sample_is_bounded(spark):
    texts = [(i, f"word{i % 3} common") for i in range(30)] + [(5, "word1 again and again")] * 3
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_id bigint, grade int")
    fitted = []

    class Seen(quality.OrdinalModel):
        pass

    original = quality.OrdinalModel.fit
    quality.OrdinalModel.fit = classmethod(lambda cls, rows, grades, **k: fitted.append(rows) or original.__func__(cls, rows, grades, **k))
    try:
        quality.train(d, ratings, 3)
        quality.train(d, ratings, 3, sample=10)
        quality.train(d, ratings, 3, budget=40)
    finally:
        quality.OrdinalModel.fit = original
    assert len(fitted[0]) == 33 and 0 < len(fitted[1]) <= 10 and 0 < sum(len(f) for _, f in fitted[2]) <= 40


def test_ordinal_fit_is_the_maximum():
    r = np.random.default_rng(4)
    rows = []
    for _ in range(2000):
        has = r.random(4) < 0.5
        score = 1.5 * has[0] - 2.0 * has[1] + 0.8 * has[2] + r.logistic()
        rows.append((int(score > -0.5) + int(score > 1.0), [i for i in range(4) if has[i]]))
    model = quality.OrdinalModel.fit(rows, 3, steps=3000, rate=0.02)
    used = sorted(model.weights)

    def loss(theta):
        b, w = theta[:2], dict(zip(used, theta[2:]))
        out = 0.0
        for g, f in rows:
            tail = [1.0, *[1 / (1 + math.exp(-(sum(w.get(i, 0.0) for i in f) - x))) for x in b], 0.0]
            out -= math.log(max(tail[g] - tail[g + 1], 1e-12))
        return out + sum(x * x for x in theta[2:])

    best = np.array([*model.thresholds, *[model.weights[i] for i in used]])
    least = loss(best)
    assert model.thresholds[0] < model.thresholds[1] and {0, 1} <= set(used)
    for i in range(len(best)):
        for step in (-0.05, 0.05):  # the objective is convex: no neighbour along an axis is better
            other = best.copy()
            other[i] += step
            assert loss(other) > least - 1e-6


def test_quality_of_long_and_repeated_texts(spark):
    d = spark.createDataFrame([(1, "good words " * 50_000), (1, "good words " * 50_000), (2, "?" * 300_000), (3, None), (4, "")], "doc_id bigint, text string")
    out = quality.grade(d, quality.OrdinalModel({}, np.array([-1.0, 1.0]))).collect()
    assert len(out) == 5 and len({(r.expected_grade, r.tail_prob) for r in out}) == 1


@pytest.mark.parametrize("page", ["<i " * 100_000, "<div>" * 100_000, "<button>" * 50_000, '<a "' * 50_001 + ">", "<p>" * 100_000, "<ul>" * 50_000 + "</x>" * 50_000])
def test_html_time_grows_with_length(page):
    import time

    t = time.time()
    blocks, elements = html_extract.read_page(page + "<article><p>text here</p></article>")
    assert time.time() - t < 5 and all(len(e) < 400 for e in elements)


def test_html_text_comes_from_the_template(spark):
    """Pages without article or main; the text that all have in one place is the template's."""
    pages = [(i, "http://h/x", f"<body><div><h2>Site name</h2><p>Body of page {i} with words.</p><p>All rights kept here</p></div></body>") for i in range(5)]
    d = spark.createDataFrame(pages + [pages[0]], "page_id bigint, url string, html string")
    out = html_extract.extract(d).collect()
    assert len(out) == 6 and all(r.text == f"Body of page {r.page_id} with words." for r in out)
    # Without a template nothing is cut.
    assert html_extract.article_text(pages[0][2], []) == "Site name\n\nBody of page 0 with words.\n\nAll rights kept here"


def test_html_frame_matches_brute_force(spark):
    r = random.Random(5)
    pages = []
    for i in range(8):
        extra = "".join(f"<p>own {i} {k}</p>" for k in range(r.randrange(3)))
        pages.append((i, "http://b/", f"<div><h1>Top</h1>{extra}<p>{r.choice(['x', 'y'])}</p><footer>End</footer><span>in</span></div>"))
    rows = [(u, h) for _, u, h in pages]
    found = html_extract.templates(spark.createDataFrame(rows, "_host string, html string")).first()
    counts = [Counter(t for t, _ in html_extract.events(*html_extract.read_page(h)) if t) for _, h in rows]
    want = {t for t in set().union(*counts) if all(c[t] == 1 for c in counts)}
    assert set(found._frame) == want
