import hashlib
import re
from zlib import crc32

import numpy as np
import pytest

from webweft.llm import periodic_runs as P


def slow_runs(words):
    """All maximal stretches, lag by lag; those of a multiple of a smaller period are left out."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                part = words[i:i + length]
                if not any(all(part[x] == part[x + r] for x in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest, kept)


def random_words(rng, n):
    """Words with repeats of many periods, some nested in each other."""
    out = []
    while len(out) < n:
        kind = rng.integers(0, 4)
        if kind == 0:
            out += rng.integers(0, 40, rng.integers(1, 12)).tolist()
        elif kind == 1:
            out += rng.integers(0, 3, rng.integers(1, 9)).tolist() * int(rng.integers(2, 16))
        elif kind == 2:
            out += rng.integers(0, 60, rng.integers(8, 70)).tolist() * int(rng.integers(2, 5))
        else:
            part = (rng.integers(0, 2, rng.integers(2, 5)).tolist() * 12 + [7]) * int(rng.integers(1, 5))
            out += part
    return out[:n]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_all_lags(seed):
    rng = np.random.default_rng(seed)
    docs = [random_words(rng, int(rng.integers(0, 500))) for _ in range(8)]
    codes = np.array([c for d in docs for c in d], dtype=np.int64)
    got = P.runs_of(codes, np.array([len(d) for d in docs]))
    assert got == [slow_runs(d) for d in docs]


@pytest.mark.parametrize("q", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 100])
def test_shortest_run_of_each_period_is_found_and_a_shorter_one_is_not(q):
    least = max(24, 3 * q)
    for n, want in ((least, 1), (least - 1, 0)):
        body = [i % q for i in range(n)]
        words = [1000, *body, 1001]
        assert P.runs_of(np.array(words), np.array([len(words)]))[0] == [(1, n, q)][:want] == slow_runs(words)


def test_neighbours_that_share_a_document_border_are_not_one_run():
    words = [1, 2] * 10
    assert P.runs_of(np.array(words * 2), np.array([20, 20])) == [[], []]


def test_strongest_run_ties_and_exact_quotients():
    assert P.strongest([]) is None
    assert P.strongest([(0, 30, 10), (5, 24, 8), (9, 60, 20)]) == (0, 30, 10)
    big = 10 ** 17
    assert P.strongest([(0, 3 * big, big), (1, 3 * big + 1, big)]) == (1, 3 * big + 1, big)


def test_long_text_of_one_word_is_quick():
    n = 300_000
    assert P.runs_of(np.zeros(n, dtype=np.int64), np.array([n])) == [[(0, n, 1)]]


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    planted = [d for d in range(4000) if crc32(str(d).encode()) % 10 == 0][:40]
    rows = [(d, " ".join(f"w{c}" for c in random_words(rng, int(rng.integers(0, 200))))) for d in planted]
    rows += [(i + 5000, " ".join(f"w{c}" for c in random_words(rng, 150))) for i in range(40)]
    rows += [(None, "a b " * 30), (9001, None), (9002, ""), (9003, " \n\t"), (9004, "É\x85é\x1cx \x0b" * 40),
             (planted[0], "one"), (planted[1], "x y z " * 12), (planted[1], "x y z " * 12), (-7, "A a " * 20)]
    df = spark.createDataFrame([(d, t, "shown", 1) for d, t in rows], "doc_id long, text string, runs string, start int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in P.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([slow_row(d, t) for d, t in rows], key=str)


def test_operator_gives_runs_and_text_without_repeats(spark):
    df = spark.createDataFrame([(1, "so " + "tick tock " * 13 + "end"), (2, None), (3, "no runs here")], "doc_id long, text string")
    out = {r.doc_id: r for r in P.periodic_runs(df).collect()}
    assert [tuple(x) for x in out[1].runs] == [(1, 26, 2)]
    assert out[1].collapsed == "so tick tock end" and out[1].n_words == 28
    assert out[2].runs == [] and out[2].collapsed == "" and out[3].collapsed == "no runs here"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.periodic_runs(df).collect() == []
