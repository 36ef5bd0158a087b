"""Whitening, toxicity and the filter audit against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tidemark.llm import filter_audit, toxicity, whitening
from tidemark.llm.common import slices

VECTORS = "vec_id long, embedding array<float>, x string, n long"


def vectors(d=24, n=300):
    r = np.random.default_rng(5)
    scale = np.concatenate([np.linspace(3, 1, 10), np.full(d - 10, 0.2)])
    rows = [(k, [float(c) for c in (r.standard_normal(d) * scale).astype(np.float32)]) for k in range(n)]
    rows += [rows[0], (None, rows[1][1]), *[(900 + k, rows[2][1]) for k in range(40)]]  # copies
    rows += [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] * d), (1005, [1e30] * d), (1006, [1.0] * (d - 1))]
    return [(i, v, "clash", 7) for i, v in rows]


def test_whitening_against_a_full_decomposition(spark):
    d = 24
    rows = vectors(d)
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    whole = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v, *_ in rows[:-7]]
    x = np.unique(np.array([v for _, v in whole]), axis=0)
    n, s = len(x), x.sum(axis=0)
    values, u = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    values, u = values[::-1][:16], u[:, ::-1][:, :16]
    assert len(out) == 16 * len(whole) and {r["n"] for r in out} == {n}
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    first = np.array([[got[i][k]["whitened"] for k in range(1, 17)] for i in range(300)])
    by_id = dict(reversed(whole))
    want = np.array([(by_id[i] - s / n) @ u / np.sqrt(values) for i in range(300)])
    signs = np.sign((first * want).sum(axis=0))
    assert np.abs(first - signs * want).max() < 1e-9
    assert all(abs(got[0][k]["explained"] / (values[k - 1] * n / ((x - s / n) ** 2).sum()) - 1) < 1e-10 for k in range(1, 17))
    assert out[0]["identity_error"] < 1e-10
    for i in (0, 7, 900, None):
        assert got[i][1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(by_id[i], s))


def test_whitening_small_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = make([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])  # rank one
    assert len(line) == 5 and abs(sum(r["whitened"] ** 2 for r in line) / 5 - 1) < 1e-12


def test_whitening_adds_many_parts_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DRIVER_BYTES", 1)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1000)
    one = whitening.whiten(spark.createDataFrame(vectors(), VECTORS).repartition(30)).where("vec_id = 3 and component = 1").first()
    assert one["identity_error"] < 1e-9


def document(r, stems, words, n):
    return " ".join(r.choice(words) if r.random() > 0.08 or not stems else r.choice(stems) + r.choice(["", "en", "ung"]) for _ in range(n))


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghinorst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    stems = ["zorkel", "quimpf", "wuxlam"]
    rows, labels = [], []
    for k in range(700):
        bad = k % 4 == 0
        rows.append((k, document(r, stems if bad else [], words, r.randint(40, 160)), "x", 1.0))
        if k % 3:
            labels.append((k, 1, int(bad)))
    rows += [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (9002, "a" * 3_000_000, "x", 1.0), (None, rows[0][1], "x", 1.0), rows[4]]
    labels += [(9000, None, None), (4, 1, 0), (4, 1, 1), (12345, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    out = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    judged = [x for x in out if x["held_out"] and x["doc_id"] < 700]
    right = sum(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in judged)
    assert len(judged) > 100 and right / len(judged) > 0.95
    none = toxicity.score(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len({x["score"] for x in none.collect()}) == 1
    assert toxicity.score(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_slices_keep_words_whole():
    r = random.Random(1)
    text = b"".join(r.choice([b"ab", b" ", b"\n", b"\xc3\xa9"]) for _ in range(5000))
    assert b"".join(slices(text, 100)) == text
    assert [w for s in slices(text, 100) for w in s.split()] == text.split()
    assert list(slices(b"x" * 500, 100)) == [b"x" * 500] and list(slices(b"", 10)) == [b""]


def test_filter_audit_against_one_document_at_a_time(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(600)]
    pool = [" ".join(r.sample(words, 210)), " ".join(r.choices(words[:20], k=300)), "SHORT Text", " ".join(r.sample(words, 250)) + " $", None, "", "é" * 40 + "AB", " ".join(r.sample(words, 220)).upper()]
    rows = [(k, r.choice(pool) if k % 2 else (r.choice(pool) or "") + f" {k}", [None, "", "en", "de"][k % 4], 1, "m") for k in range(160)]
    rows += [rows[1], rows[1], (None, pool[0], "en", 1, "m"), (None, "only here", "de", 1, "m"), (None, "only here", "de", 1, "m")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 160, 3)] + [(3, None, None), (None, 1, 1), (6, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, mask string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    first = {}
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", 1e9), 1e9 if i is None else i)
    good, bad = ({i for i, q, t in labels if (q, t)[c] == 1 and i is not None} for c in (0, 1))

    def fails(i, t):
        w = t.split()
        e = (1e9 if i is None else i) > first[t]
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": e}

    facts = [(lang or "", fails(i, t or ""), i in good, i in bad) for i, t, lang, *_ in rows]
    want, shapley = {}, Counter()
    parts = {p for p, *_ in facts}
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            for step in range(1, 6):
                want[part, order, step] = Counter()
        for part, f, g, b in facts:
            gone = next((k for k, c in enumerate(order, 1) if f[c]), 9)
            for step, c in enumerate(order, 1):
                cell = want[part, order, step]
                cell["kept"] += gone > step
                cell["removed"] += gone == step
                cell["redundant"] += f[c] and gone < step
                cell["unique_fails"] += f[c] and sum(f.values()) == 1
                cell["good_lost"] += g and gone == step
                cell["toxic_lost"] += b and gone == step
                shapley[part, c] += gone == step
    assert len(got) == len(want) == 600 * len(parts)
    for x in got:
        cell = want[x["part"], x["filter_order"], x["step"]]
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert x[c] == cell[c], (x, c)
        assert x["shapley"] == shapley[x["part"], x["filter"]]
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("names", ["A", "AB", "ABCD"])
def test_removal_steps_are_the_first_failure(names):
    orders, _, steps = filter_audit.removal_steps(names)
    for mask in range(1 << len(names)):
        for o, order in enumerate(orders):
            first = next((k for k, c in enumerate(order, 1) if mask >> names.index(c) & 1), filter_audit.NEVER)
            assert steps[mask, o] == first
