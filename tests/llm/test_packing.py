import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.packing import pack, pack_histogram


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_histogram(counts):
    patterns = pack_histogram(counts, 30)
    placed = Counter()
    for p, n in patterns:
        assert sum(p) <= 30 and n > 0
        for length in p:
            placed[length] += n
    assert placed == Counter(counts)


def test_little_space_left():
    rng = random.Random(3)
    counts = Counter(min(1024, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(20000))
    used = sum(n for _, n in pack_histogram(counts, 1024))
    need = sum(k * n for k, n in counts.items()) / 1024
    assert need <= used <= need * 1.01 + 1


def check(rows, out, capacity):
    load, by_key = defaultdict(int), defaultdict(list)
    for r in out:
        load[r.container] += r.n_tokens
        by_key[r.id].append(r)
    assert all(v <= capacity for v in load.values())
    want = Counter(k for k, _ in rows)
    for k, n in rows:
        n = max(0, n or 0)
        own = by_key[k]
        assert len(own) == want[k] * max(1, -(-n // capacity)) and sum(r.n_tokens for r in own) == want[k] * n


def test_pack(spark):
    rows = [(9, 30), (10, 10), (11, 10), (1, 5), (2, 0), (3, None), (4, 25), (5, 10), (6, 3), (7, 7), (8, -1), *[(100 + i, 4) for i in range(300)]]
    df = spark.createDataFrame(rows, "id long, size int")
    for bucket_rows in (1_000_000, 40):  # one bucket a length, and several for the frequent one
        out = pack(df, "id", "size", 10, bucket_rows).collect()
        check(rows, out, 10)
        full = [r.container for r in out if r.n_tokens == 10]
        assert len(full) == len(set(full)) == 8  # a full piece is alone
    assert pack(df.limit(0), "id", "size", 10).count() == 0
    assert pack(df.filter("id = 2"), "id", "size", 10).collect()[0].container == 0
