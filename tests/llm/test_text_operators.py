"""Fingerprints, quality, near-duplicates, packing and licences on small inputs, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from weftgraph.llm import gam_quality, license_scan, lp_packing, lz_fingerprint, queries, simhash_dedup
from weftgraph.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long, turn int, fp string, bucket string, border string, key string, epoch string, quality_score double"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, *rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y", "z", "k", "e", 0.5) for i, t in rows], DOCS)


ODD = [(3, "a b c d e f g"), (None, "no id"), (1, None), (2, ""), (3, "a b c d e f g"), (5, "x" * 30_000), (4, "é ü 漢字 \t\n tail"), (7, "a b c d e f g")]


# --- Lempel-Ziv fingerprints


def phrases(text):
    seen, start, size = set(), 0, 1
    while start + size <= len(text):
        if text[start : start + size] in seen:
            size += 1
        else:
            seen.add(text[start : start + size])
            start, size = start + size, 1
    return seen


def test_phrases_are_those_of_the_plain_parse():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 100, 3000):
        for letters in ("a", "ab", "abcdefgh é"):
            text = "".join(r.choice(letters) for _ in range(n))
            ends, seen = [], set()
            lz_fingerprint.extend(text, 0, n, seen, ends)
            assert seen == phrases(text)
            assert len(set(lz_fingerprint.hashes(text, ends).tolist())) == len(seen)


def test_likeness_follows_the_phrase_sets():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    a = " ".join(r.choices(words, k=900))
    b = a[: len(a) // 2] + " ".join(r.choices(words, k=450))
    exact = len(phrases(a) & phrases(b)) / len(phrases(a) | phrases(b))
    assert abs(lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b)) - exact) < 0.15
    short, other = "abcabc", "abcxyz"
    want = len(phrases(short) & phrases(other)) / len(phrases(short) | phrases(other))
    assert lz_fingerprint.likeness(lz_fingerprint.fingerprint(short), lz_fingerprint.fingerprint(other)) == want
    assert lz_fingerprint.likeness(lz_fingerprint.fingerprint(""), lz_fingerprint.fingerprint("")) == 1.0
    assert lz_fingerprint.likeness(lz_fingerprint.fingerprint(""), lz_fingerprint.fingerprint("a")) == 0.0


def slow_signature(text):
    """The fingerprint's hashes, from the phrases one by one."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    found = {mixed(sum(mixed(ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(p)) & mask) >> 32 for p in phrases(text)}
    return sorted(found)[:128]


def slow_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted(set(a) | set(b))
    union = union[:128] if 128 in (len(a), len(b)) else union
    return len([x for x in union if x in set(a) and x in set(b)]) / len(union)


def test_signatures_and_likeness_against_a_plain_version():
    r = random.Random(5)
    texts = ["", "a", "abab", "é漢🙂 " * 9] + ["".join(r.choice("abcde ") for _ in range(n)) for n in (30, 400, 4000)]
    texts.append(texts[-1][:3000] + "xyz" * 200)
    slow = [slow_signature(t) for t in texts]
    fast = [lz_fingerprint.fingerprint(t) for t in texts]
    assert [f.tolist() for f in fast] == slow
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert lz_fingerprint.likeness(fast[i], fast[j]) == slow_likeness(slow[i], slow[j])


def check_fingerprints(rows, table):
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for k, (i, _) in enumerate(order):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        f, g, h = map(lz_fingerprint.fingerprint, (a, edited, b))
        want.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.as_text(f), lz_fingerprint.as_text(g), lz_fingerprint.likeness(f, g), lz_fingerprint.likeness(f, h)))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_fingerprints_of_odd_tables(spark):
    check_fingerprints(lz_fingerprint.fingerprint_documents(docs(spark, *ODD)).collect(), ODD)
    check_fingerprints(lz_fingerprint.fingerprint_documents(docs(spark, (9, "only one"))).collect(), [(9, "only one")])
    assert lz_fingerprint.fingerprint_documents(docs(spark, *ODD).limit(0)).count() == 0
    nulls = [(None, "b"), (None, "a")]
    check_fingerprints(lz_fingerprint.fingerprint_documents(docs(spark, *nulls)).collect(), nulls)


def test_op3_query(spark, data):
    table = [(r["doc_id"], r["text"]) for r in read(spark, data, "documents").collect()]
    check_fingerprints(queries.QUERIES["op3_lz_fingerprint"](spark, data).collect(), table)


# --- quality


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_gam_quality"](spark, sf).collect()}
    ids = [r["doc_id"] for r in read(spark, sf, "documents").select("doc_id").collect()]
    assert sorted(got) == sorted(ids)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in ids)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in read(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(3, 1), (4, None), (None, 1), (3, 0)], "doc_id long, quality int")
    out = gam_quality.classify(docs(spark, *ODD), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert gam_quality.classify(docs(spark, *ODD).limit(0), labels.limit(0)).count() == 0
    kept = gam_quality.keep_good(docs(spark, *ODD), labels)
    assert kept.columns == docs(spark, *ODD).columns
    assert [f for f in gam_quality.features("") if not np.isfinite(f)] == []


def test_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = np.zeros((2000, len(gam_quality.FEATURES)))
    x[:, 0], x[:, 1] = r.random(2000), r.random(2000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam_quality.fit(x, y)
    assert (1, 0) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


def test_a_score_is_the_sum_of_its_bins():
    r = np.random.default_rng(2)
    x = r.random((500, len(gam_quality.FEATURES)))
    m = gam_quality.fit(x, (x[:, 0] + x[:, 3] * x[:, 4] > 0.8).astype(float))
    for row in x[:40]:
        at = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges, strict=True)]
        total = m.base + sum(m.single[j][k] for j, k in enumerate(at)) + sum(t[at[i], at[j]] for (i, j), t in m.pairs.items())
        assert abs(m.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    assert m.pairs


def test_trees_are_the_best_of_their_kind():
    r = np.random.default_rng(7)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for n in (2, 3, 8):
        g, h = r.normal(size=n), r.random(n) + 0.1
        first = max(range(1, n), key=lambda k: gain(g[:k], h[:k]) + gain(g[k:], h[k:]))
        spans = [(0, first), (first, n)]
        second = max(((gain(g[a:k], h[a:k]) + gain(g[k:b], h[k:b]) - gain(g[a:b], h[a:b]), a, k, b) for a, b in spans for k in range(a + 1, b)), default=None)
        if second and second[0] > 1e-9:
            spans = [s for s in spans if s != (second[1], second[3])] + [(second[1], second[2]), (second[2], second[3])]
        want = np.zeros(n)
        for a, b in spans:
            want[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        assert np.allclose(gam_quality._steps(g, h), want)
    g, h = r.normal(size=(4, 5)), r.random((4, 5)) + 0.1
    cuts = [(g[:i, :j], h[:i, :j], g[:i, j:], h[:i, j:], g[i:, :j], h[i:, :j], g[i:, j:], h[i:, j:]) for i in range(1, 4) for j in range(1, 5)]
    best = max(sum(gain(c[k], c[k + 1]) for k in range(0, 8, 2)) for c in cuts) - gain(g, h)
    found, table = gam_quality._quadrants(g, h)
    assert abs(found - best) < 1e-9 and len(np.unique(table)) == 4


def test_learning_does_not_hang_on_the_order_of_repeated_ids(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, ("good words here. " if i % 2 else "!!! 123 ") * (1 + i % 5)) for i in range(60)] + [(i, "other text " * k) for i in range(60) for k in (1, 2, 3)]
    models = [gam_quality.train(docs(spark, *x), labels) for x in (rows, rows[::-1])]
    x = np.array([gam_quality.features(t) for _, t in rows])
    assert np.allclose(models[0].score(x), models[1].score(x))


# --- near-duplicates


def groups(fps):
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    u = list(parent)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_components(rows):
    fps = [int(r["fingerprint"], 16) for r in rows]
    root = groups(fps)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r["doc_id"] is not None:
            least[root[f]] = min(least.get(root[f], r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(root[f]) for r, f in zip(rows, fps, strict=True))


def slow_fingerprint(text):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_bits():
    for text in ("", " ", "One", "one TWO", "a b c", "A b c a B c a b c é Ü", "a\x0bb\x0cc\rd e f g " * 50):
        assert simhash_dedup.fingerprint(text.encode()) == slow_fingerprint(text)


def test_op6_query_and_odd_tables(spark, data):
    rows = queries.QUERIES["op6_simhash_dedup"](spark, data).collect()
    assert len(rows) == read(spark, data, "documents").count()
    check_components(rows)
    odd = simhash_dedup.near_duplicates(docs(spark, *ODD)).collect()
    assert len(odd) == len(ODD)
    check_components(odd)
    assert simhash_dedup.near_duplicates(docs(spark, *ODD).limit(0)).count() == 0
    kept = simhash_dedup.keep_one(docs(spark, *ODD))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, None)]
    assert kept.columns == docs(spark, *ODD).columns


@pytest.mark.parametrize("crowd", [128, 3])
def test_links_are_complete(spark, monkeypatch, crowd):
    """Chains, and crowds that share a half, with and without the two-bit variants."""
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(20)}
    for f in list(fps)[:6]:
        for _ in range(25):
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(f)
    base = r.getrandbits(32) << 32
    fps |= {base | r.getrandbits(32) for _ in range(40)} | {base | 1 << k for k in range(10)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert len(got) == len(want) and {(x["a"], x["b"]) for x in got} == want
    root = dict(map(tuple, simhash_dedup.components(spark.createDataFrame(list(want), "a long, b long")).collect()))
    same = groups(list(fps))
    linked = [f for f in signed if f in root]
    unsigned = lambda f: f & (1 << 64) - 1
    assert all((root[a] == root[b]) == (same[unsigned(a)] == same[unsigned(b)]) for a in linked for b in linked)


# --- packing


def check_packing(rows, table, whole):
    by_doc = {}
    for i, text in table:
        by_doc.setdefault(i, []).append(np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    assert sum(r["length"] for r in rows) == sum(len(x) for v in by_doc.values() for x in v)
    for r in rows:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in by_doc[r["doc_id"]])
        assert r["length"] == 2048 or r["piece"] == 0
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), -(-sum(r["length"] for r in rows) // 2048)


def test_op9_query_and_odd_tables(spark, data):
    whole = Tokenizer.from_file(BPE)
    table = [(r["doc_id"], r["text"]) for r in read(spark, data, "documents").collect()]
    used, bound = check_packing(queries.QUERIES["op9_lp_packing"](spark, data).collect(), table, whole)
    assert used <= bound + 1
    check_packing(lp_packing.pack_documents(docs(spark, *ODD), BPE).collect(), ODD, whole)
    assert lp_packing.pack_documents(docs(spark, *ODD).limit(0), BPE).count() == 0


def test_ids_are_those_of_the_tokenizer():
    whole = Tokenizer.from_file(BPE)
    plain = "".join(chr(c) for c in [*range(32, 127), *range(160, 592), 8211, 8217, 8230, 8364])
    for text in ("", "Hello world", "<|endoftext|> x", "  a\n\n b\t\tc ", "don't I'LL 12ab3", plain, " ".join(plain), "漢字 かな 🙂", "a" * 6000, " " * 6000 + "x", "\x00\x1c\x85 "):
        assert lp_packing.token_ids(text, BPE).tolist() == whole.encode(text, add_special_tokens=False).ids
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(plain + "  \n\t''") for _ in range(80))
        assert lp_packing.token_ids(text, BPE).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_plans_cover_the_histogram_exactly():
    r = random.Random(8)
    cases = [{}, {1: 5}, {2048: 3}, {1025: 10, 1023: 10}, {683: 3000, 682: 100, 1366: 50}, {n: r.randrange(40) for n in range(1, 1500, 7)}]
    for h in cases:
        covered = {}
        for pattern, times in lp_packing.plan(h):
            assert sum(k * n for k, n in pattern.items()) <= 2048 and times > 0
            for k, n in pattern.items():
                covered[k] = covered.get(k, 0) + n * times
        assert covered == {k: n for k, n in h.items() if n}
    used = sum(n for _, n in lp_packing.plan(cases[-1]))
    assert used <= 1.005 * sum(k * n for k, n in cases[-1].items()) / 2048 + 1
    assert sum(n for _, n in lp_packing.plan({1025: 10, 1023: 10})) == 10


def least_sequences(pieces, capacity):
    """The fewest sequences, by trying all subsets of the pieces."""
    n = len(pieces)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        for j in range(n):
            if mask >> j & 1:
                used, last = best[mask ^ 1 << j]
                at = (used, last + pieces[j]) if used and last + pieces[j] <= capacity else (used + 1, pieces[j])
                best[mask] = min(best[mask], at)
    return best[-1][0]


def test_small_plans_are_optimal_or_one_more():
    r, more = random.Random(9), 0
    for _ in range(60):
        pieces = [r.randrange(3, 41) for _ in range(r.randrange(1, 12))]
        histogram = {n: pieces.count(n) for n in pieces}
        want, (own, rest, lower) = least_sequences(pieces, 40), lp_packing.solve(histogram, 40)
        used = sum(n for _, n in own) + sum(n for _, n in rest)
        assert lower <= want + 1e-9 and want <= used <= want + 1
        more += used > want
    assert more <= 6


def test_the_programme_places_nearly_all():
    """The fractional solution covers what it says, and at most a tenth of the sequences is left to best fit."""
    r = random.Random(10)
    histogram = {n: r.randrange(1, 400) for n in range(1, 2048, 3)}
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[n] for n in sorted(histogram)])
    covered = np.zeros(len(lengths))
    for pattern, times in lp_packing.fractional(lengths, counts, lp_packing.first_weights(lengths, 2048), 2048):
        assert 0 <= 2048 - sum(int(lengths[j]) * n for j, n in pattern.items()) <= 2048 * lp_packing.WASTE
        for j, n in pattern.items():
            covered[j] += n * times
    assert (covered <= counts + 1e-6).all() and covered.sum() > 0.85 * counts.sum()
    own, rest, lower = lp_packing.solve(histogram)
    own, rest = sum(n for _, n in own), sum(n for _, n in rest)
    assert rest <= 0.12 * own and lower <= own + rest <= 1.001 * sum(n for _, n in lp_packing.best_fit(lengths.tolist(), counts.tolist(), 2048))
    own, rest, lower = lp_packing.solve({n: r.randrange(1, 60) for n in range(20, 1400, 5)})
    own, rest = sum(n for _, n in own), sum(n for _, n in rest)
    assert rest <= 0.05 * own and own + rest <= lower + 6


def test_worths_are_those_of_all_configurations():
    lengths, prices = np.array([3, 5, 7]), np.array([2.0, 4.5, 5.0])
    value = lp_packing.worths(lengths, prices, 30)
    for c in range(31):
        assert value[c] == max(2.0 * i + 4.5 * j + 5.0 * k for i in range(11) for j in range(7) for k in range(5) if 3 * i + 5 * j + 7 * k <= c)


# --- licences


def wrapped(text, n=72, lead="# "):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= n:
            lines.append(lead + line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*lines, lead + line])


def test_license_scan(spark):
    near = license_scan.TEMPLATES["MIT-text"].replace("free of charge", "without charge").replace(". ", ".\n")
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "RELEASED   under the mit license"), (3, near), (4, "This mentions a license and the MIT people."), (5, None), (6, ""), (7, "All rights reserved.\nAll rights reserved."), (7, "All rights reserved.\nAll rights reserved."), (8, "Some project readme. Released under the MIT License."), (None, "license"), (9, "the " * 30_000 + "(c) me. All rights reserved" + " license" * 500)]
    found = license_scan.scan(docs(spark, *rows)).collect()
    got = {(r["doc_id"], r["license"]): r for r in found}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "MIT-text"), (7, "all-rights-reserved"), (8, "MIT"), (9, "all-rights-reserved")} and len(found) == 7
    assert (got[1, "MIT"]["first_word"], got[1, "MIT"]["n_words"], got[1, "MIT"]["dice"]) == (1, 5, 1.0) and got[8, "MIT"]["first_word"] == 3
    assert got[9, "all-rights-reserved"]["first_word"] == 30_002 and 0.8 <= got[3, "MIT-text"]["dice"] < 1
    assert license_scan.scan(docs(spark, *rows).limit(0)).count() == 0


def test_wrapped_notices_in_long_documents(spark):
    """Each template above sixty lines of code, wrapped in a comment, some words of long ones changed."""
    code = "\n".join(f"def f{k}(x): return x + {k}" for k in range(60))
    texts = []
    for t in license_scan.TEMPLATES.values():
        w = t.split()
        if len(w) > 30:
            w[len(w) // 2] = "otherwise"
            w.insert(len(w) // 3, "entirely")
        texts.append(f"#!/bin/x\n{wrapped(' '.join(w))}\n\n{code}")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs(spark, *enumerate(texts))).collect()}
    assert {(k, name) for k, name in enumerate(license_scan.TEMPLATES)} <= got


def test_license_scan_against_brute_force(spark):
    """Windows at all places give no better result than those at the anchors, and no other licence."""
    r = random.Random(3)
    texts = ["plain text\nwithout any notice", "Licensed under CC BY 4.0"]
    for t in license_scan.TEMPLATES.values():
        w = license_scan.words_of(t)
        for edits in (0, 1, len(w) // 12, len(w) // 5):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(["before"] * r.randrange(9) + v + ["after"] * r.randrange(9)))
    want = {}
    for i, text in enumerate(texts):
        w = license_scan.words_of(text)
        for name, t in license_scan.TEMPLATES.items():
            b, k = set(license_scan.bigrams_of(t)), len(license_scan.words_of(t))
            for s in range(max(1, len(w) - k + 1)):
                g = {f"{x} {y}" for x, y in zip(w[s : s + k], w[s + 1 : s + k])}  # noqa: B905
                if g and (dice := 2 * len(g & b) / (len(g) + len(b))) >= license_scan.LEAST:
                    want[i, name] = max(dice, want.get((i, name), 0))
    got = {(r["doc_id"], r["license"]): r["dice"] for r in license_scan.scan(docs(spark, *enumerate(texts))).collect()}
    # Windows that only overlap a notice in part may pass the threshold at places where no anchor lays them.
    assert set(got) <= set(want) and all(got[k] <= want[k] + 1e-9 for k in got)
    assert {k for k, v in want.items() if v > 0.85} <= set(got) and all(abs(got[k] - want[k]) < 1e-9 for k in want if want[k] > 0.9)


def test_op8_against_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    want = con.execute(license_scan.ORACLE)
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op8_license_scan"](spark, data).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got
