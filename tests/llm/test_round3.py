"""Source divergence, whitening and disclosure against brute force, with edge rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import disclosure, divergence, topk, whitening
from test_operators import docs_frame, odd_texts, sentence  # noqa: F401


# --- source divergence

def brute_divergence(rows, least, top):
    terms = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))
             for la, so, t in rows]
    df, n = collections.Counter(), collections.Counter()
    for la, so, ts in terms:
        df.update((la, t) for t in set(ts))
        n.update((la, so, t) for t in ts)
    groups, out = sorted({(la, so) for la, so, _ in terms}), []
    for la in {g[0] for g in groups}:
        stay = [t for (x, t), c in df.items() if x == la and c >= least]
        sources = [g[1] for g in groups if g[0] == la]

        def shares(counts):
            total = sum(counts.values())
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * len(stay)) for t in stay}

        own = {s: {t: n[la, s, t] for t in stay} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in stay})
        for s in sources:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in stay)) for o in sources if o != s],
                     "term": [(t, p[s][t] - q[t]) for t in stay if own[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(la, s, part, x, v, i + 1) for i, (x, v) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("block", [300, 1 << 24])
def test_divergence_equals_brute_force(spark, odd_texts, block, monkeypatch):  # noqa: F811
    monkeypatch.setattr(divergence, "PAIR_CELLS", 40)
    monkeypatch.setattr(divergence, "PAIR_SOURCES", 2)
    monkeypatch.setattr(divergence.term_counts, "__defaults__", (block, 2 if block == 300 else 256))
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = " ".join(re.sub("a", lambda m: rng.choice(["a", "A", "a,", "-a"]), w) for w in sentence(rng, 20).split())
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None]), text))
    rows += [("en", "s1", t) for t in odd_texts[:8]] + [("xx", "only", "rare"), ("yy", "a", ""), ("yy", "b", None)] + rows[:9]
    rows = [(la, so, t if t is None or len(t) < 5000 else t[:900]) for la, so, t in rows]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, source string, text string, term int, n int, p int")
    wanted = brute_divergence(rows, 6, 4)
    got = divergence.source_divergence(frame.repartition(3).cache(), 6, 4).collect()
    assert sorted(tuple(r) for r in got) == wanted
    assert divergence.source_divergence(frame.limit(0), 6, 4).count() == 0


# --- whitening

def whitened_by_numpy(rows, k):
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())), float)
    n, mean = len(fit), fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, {i: (np.array(v) - mean) @ u / np.sqrt(e) for i, v in x.items()}, e / np.trace(cov)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 12)) * np.linspace(2, 0.5, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(900 + i, base[i].tolist()) for i in range(5)]
    odd = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11),
           (2004, [1.0, 2.0]), (2005, [])]
    schema = "vec_id long, embedding array<double>, n int, component int, whitened string"
    frame = spark.createDataFrame([(*r, 7, 7, "x") for r in rows + odd], schema).repartition(3)
    out = collections.defaultdict(dict)
    for r in whitening.whiten(frame).collect():
        out[r.vec_id][r.component] = r
    n, wanted, shares = whitened_by_numpy(rows, 4)
    assert set(out) == {i for i, _ in rows}
    signs = [np.sign(out[0][c + 1].whitened * wanted[0][c]) for c in range(4)]
    sums = np.array(sorted({tuple(math.floor(256 * c) for c in v) for _, v in rows})).sum(0)
    for i, v in rows:
        exact = sum((n * math.floor(256 * c) - int(s)) ** 2 for c, s in zip(v, sums))
        for c in range(4):
            r = out[i][c + 1]
            assert (r.n, r.deviation) == (n, exact) and r.identity_error < 1e-9
            assert abs(r.whitened - signs[c] * wanted[i][c]) < 1e-8 and abs(r.explained / shares[c] - 1) < 1e-9


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None)], schema)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in two) == [("1", 1, 2), ("2", 1, 2), ("None", 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in two)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0])], schema)).collect()
    assert {r.deviation for r in huge} == {None}


def test_solver_on_clustered_and_singular_spectra():
    for values in ([3, 3, 3, 3, 3, 1, .5], [1] * 40, [5, 4, 0, 0, 0, 0, 0, 0], list(np.linspace(1, 2, 90))):
        q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))
        v = q * np.array(values, float) @ q.T
        e, x = whitening.jacobi_davidson(lambda u: v @ u, len(v), 4, float(np.trace(v)))
        wanted = [w for w in sorted(values)[::-1][:4] if w]
        assert np.allclose(e, wanted, rtol=1e-12) and np.abs(v @ x - x * e).max() < 1e-12 * max(values)


# --- disclosure

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            ok = {0: True, 1: all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                  2: 13 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in double) % 10 == 0, 3: 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_patterns_equal_plain_regexes():
    rng = random.Random(2)
    parts = ["a@b.c", "@", "x", ".", "-", " ", "1.2.3.4", "256.1.1.1", "0010.1.2.3", "4539 1488 0343 6467", "4539148803436467", "12", "9",
             "+1 (202) 555-0100", "+", "é", "\n", "a.b%c@d-e.f.g", "a@b.c@d.e@f.g", "(", "٣", "00000000000000"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert disclosure.base_spans(text) == brute_spans(text), text
    for text in ("1" * 60_000, "a" * 300_000 + "@", "1." * 100_000, "@a" * 100_000, "+1 " * 50_000):
        disclosure.base_spans(text)


def brute_terms(texts, width, least, threshold):
    pair, words, shapes, all_n = collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter(), 0
    for t in texts:
        spans = brute_spans(t or "")
        ws = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t or "")
              if not any(m.start() < e and s < m.end() for _, s, e in spans)]
        words.update(w for w, _, _ in ws)
        seen = set()
        for kind, s, e in spans:
            before, after = [i for i, w in enumerate(ws) if w[1] < s], [i for i, w in enumerate(ws) if w[1] >= s]
            near = before[-width:] + after[:width]
            edge = (ws[before[-width - 1]][0] if len(before) > width else "", ws[after[width]][0] if len(after) > width else "")
            c = (kind, t[s:e].lower())
            for i in near:
                if (c, i) not in seen:
                    seen.add((c, i))
                    pair[c, ws[i][0]][edge] += 1
    total = sum(words.values())
    entity = collections.Counter()
    for (c, _), edges in pair.items():
        entity[c] += sum(edges.values())
    out = {}
    for (c, w), edges in pair.items():
        n = sum(edges.values())
        if len(edges) >= least and 2 * len(edges) >= n and total > entity[c]:
            x = 1 + math.log(n / words[w]) / math.log(total / entity[c])
            if x >= threshold:
                out[w] = max(out.get(w, 0), x)
    return out


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(12)
    texts = [None, "", sentence(rng, 3000)]
    for i in range(150):
        text = sentence(rng, 30).split()
        if i % 4 == 0:
            text[15:15] = ["Zorblax", "Quux77", "zq@mail.example.com"]
        if i % 5 == 0:
            text.insert(3, f"u{i}@mail.example.com")
        texts.append(" ".join(text))
    texts += ["rare words beside x@y.zz stay here"] * 40  # copies are no evidence
    frame = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, term string, n int, start int")
    got = {r.term: r.disclosure for r in disclosure.disclosing_terms(frame).collect()}
    wanted = brute_terms(texts, 5, 3, 0.95)
    assert set(got) == set(wanted) and {"zorblax", "quux77"} <= set(got) and "rare" not in got
    assert all(abs(got[w] - wanted[w]) < 1e-9 for w in got)
    for r in disclosure.sanitise(frame.repartition(4), ["doc_id", "term"]).collect():
        text = texts[r.doc_id]
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"\w+", text or "") if m.group().lower() in wanted
                 and not any(m.start() < e and s < m.end() for _, s, e in brute_spans(text))]
        base = [(disclosure.KINDS[k], s, e) for k, s, e in brute_spans(text or "")]
        assert [(s.kind, s.start, s.stop) for s in r.spans] == base + terms
        if text is None:
            assert r.sanitised is None
        elif "Zorblax" in text:
            assert "x  [EMAIL]" in r.sanitised and "Zorblax" not in r.sanitised
    assert disclosure.sanitise(frame.limit(0), ["doc_id"]).count() == 0
    plain = spark.createDataFrame([(1, "only a@b.cc"), (1, "only a@b.cc"), (None, None)], "doc_id long, text string")
    found = disclosure.private_spans(plain, ["doc_id"]).select("doc_id", disclosure.span_text(F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in found) == [("1", "email:5:11"), ("1", "email:5:11"), ("None", "")]
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(disclosure.span_text(
        F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")).cast("binary"), 256)).first()[0]


def test_search_keeps_wide_weights(spark):
    vectors = {0: [200000.0, 1.0], 100: [1.0, 1.0], 1: [1e13, -3.0], 2: [-1e13, 2.5], 3: [1e13, 7.0], 200: [1e13, 1.0], 5: [0.1, 0.2], 6: None}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, 3).collect()}
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items() if v}
    for q in (0, 100, 200):
        scores = sorted(((sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q), key=lambda x: (-x[0], x[1]))
        for n, (s, i) in enumerate(scores[:3]):
            assert got[q, n + 1] == (i, min(max(s, -2 ** 63), 2 ** 63 - 1))
