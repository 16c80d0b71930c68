import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from kmerloom.llm.splitting import UNKNOWN_RUN, greedy_cuts, split_oversized


def brute(n, marks, limit, overlap):
    out, s = [], 0
    if n <= limit:
        return out
    while n - s > limit:
        inside = [b for b in marks if s + overlap < b <= s + limit]
        e = max(inside) if inside else s + limit
        out.append((s, e))
        s = e - overlap
    return [*out, (s, n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.lists(st.integers(1, 400), max_size=40)), min_size=1, max_size=6), st.integers(5, 60), st.integers(0, 4))
def test_cuts_match_the_greedy_walk(items, limit, overlap):
    lengths = [n for n, _ in items]
    marks = [sorted({b for b in bs if b <= n}) for n, bs in items]
    item, start, end = greedy_cuts(lengths, [np.array(m, np.int64) for m in marks], limit, overlap)
    got = [[(s, e) for i, s, e in zip(item.tolist(), start.tolist(), end.tolist()) if i == k] for k in range(len(items))]
    assert got == [brute(n, m, limit, overlap) for n, m in zip(lengths, marks)]


def test_records(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("ACGT") if rnd.random() < 0.999 else "N" * rnd.choice([5, 10, 30]) for _ in range(40_000))
    data = [(1, long, 5), (1, long, 6), (2, long[:5000], 7), (3, None, 8), (4, "", 9), (5, long[:300] + " \r\n" + long[300:9000], 1), (None, long, 1)]
    df = spark.createDataFrame(data, "rec_id long, seq string, piece_no int")
    got = split_oversized(df, "rec_id", "seq", with_text=True).collect()
    assert {r.rec_id for r in got} == {1, 5}
    for key, text in ((1, long), (5, long[:9000])):
        pieces = sorted((r.piece_no, r.start_pos, r.end_pos, r.piece) for r in got if r.rec_id == key)
        assert [(s, e) for _, s, e, _ in pieces] == brute(len(text), [m.end() for m in re.finditer(UNKNOWN_RUN, text)], 5000, 31)
        assert all(text[s:e] == p for _, s, e, p in pieces)


def test_texts_of_one_key_that_differ(spark):
    df = spark.createDataFrame([("a", "A" * 30), ("a", "A" * 25), ("a", None)], "k string, t string")
    got = split_oversized(df, "k", "t", 10, 2, unique_length=False).orderBy("piece_no").collect()
    assert [(r.start_pos, r.end_pos) for r in got] == brute(30, [], 10, 2)


def test_empty(spark):
    assert split_oversized(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0
