"""Temperature mixing: weights against a plain bisection, and what the permutations must keep."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from tripflow.llm import mixing
from tripflow.llm.queries import op9_temperature_mixing

SF_DIR = "/root/testdata/sf0.01"


def plain_exponent(sizes, budget, max_repeats):
    """The smallest of 4097 exponents that repeats no source more often than allowed."""
    total = sum(sizes.values())
    for step in range(2**mixing.STEPS + 1):
        e = step / 2**mixing.STEPS
        z = sum((t / total) ** e for t in sizes.values())
        if max((t / total) ** (e - 1) for t in sizes.values()) / z * budget / total <= max_repeats:
            return e
    return 1.0


def test_query_keeps_to_weights_and_epochs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()
    tokens = {d.doc_id: -(-len((d.text or "").encode()) // 4) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    sizes = Counter()
    for i, t in tokens.items():
        sizes[source[i]] += t
    total = sum(sizes.values())
    e = plain_exponent(sizes, total, 2.0)
    z = sum((t / total) ** e for t in sizes.values())
    rows = op9_temperature_mixing(spark, SF_DIR).collect()
    drawn, epochs = Counter(), defaultdict(Counter)
    for r in rows:
        assert (r.source, r.n_tokens, r.copy) == (source[r.doc_id], tokens[r.doc_id], 1)
        drawn[r.source] += r.n_tokens
        epochs[r.source, r.epoch][r.doc_id] += 1
    longest = max(tokens.values())
    for s, size in sizes.items():
        budget = round((size / total) ** e / z * total)
        assert budget - longest < drawn[s] <= budget <= 2 * size + 1
        for k in range(budget // size):
            assert epochs[s, k] == Counter({i: 1 for i in tokens if source[i] == s})
    for own in epochs.values():
        assert max(own.values()) == 1
    placed = defaultdict(list)
    for r in rows:
        placed[r.source, r.epoch].append((r.token_start, r.n_tokens))
    for own in placed.values():
        own.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:]))


@pytest.mark.parametrize("max_repeats, entropy", [(1.0, None), (1.5, None), (3.0, None), (None, 1.2), (None, None), (1.2, 1.3)])
def test_exponent(spark, max_repeats, entropy):
    sizes = {"a": 7000, "b": 1500, "c": 900, "d": 40}
    df = spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "source string, units long, source_tokens long")
    total = sum(sizes.values())
    e = mixing.solve_exponent(df, total, total, max_repeats, entropy)
    powers = [(t / total) ** e for t in sizes.values()]
    weights = [p / sum(powers) for p in powers]
    if max_repeats is not None and entropy is None:
        assert e == plain_exponent(sizes, total, max_repeats)
    if max_repeats is not None:
        assert max(w * total / t for w, t in zip(weights, sizes.values())) <= max_repeats + 1e-9
    elif entropy is not None:
        assert 0 <= -sum(w * math.log(w) for w in weights) - entropy < 1e-3
    else:
        assert e == 0


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(1, 400), "big" if i % 3 else "small", 1) for i in range(300)]
    rows += [(7000, "same text", "dup", 1)] * 40 + [(None, "no id", None, 1)] * 3 + [(None, "no id 2", None, 1), (8000, None, "void", 1), (8001, "", "big", 1)]
    rows += [(9000, "y" * 500_000, "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")
    drawn = mixing.mixture(docs, max_repeats=2.0).collect()
    dup = [r for r in drawn if r.key == 7000]
    assert dup and all(r.rows == 40 for r in dup) and len({r.epoch for r in dup}) == len(dup)
    assert not any(r.source == "void" for r in drawn)
    again = mixing.mixture(docs.repartition(7), max_repeats=2.0).collect()
    assert sorted(map(str, drawn)) == sorted(map(str, again))
    small = mixing.mixture(docs, budget=2000, max_repeats=None)
    assert sum(r.tokens * r.rows for r in small.collect()) <= 2000


def plain_drawn(units, shares, seed=mixing.SEED):
    """(name, epoch, token_start) of all units drawn, by loops; units: (key, source, name, tokens, rows)."""
    md5 = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    out = []
    for source, (n, epochs, rest) in shares.items():
        own = [u for u in units if u[1] == source]
        blocks = math.ceil(math.sqrt(n))
        for epoch in range(epochs + (rest > 0)):
            def place(u):
                block = int(md5(seed, source, u[2])[:8], 16) % blocks
                return (md5(seed, epoch, source, block), block, md5(seed, epoch, u[2]), u[3], u[0])

            start = 0
            for u in sorted(own, key=place):
                size = u[3] * u[4]
                if epoch < epochs or start + size <= rest:
                    out.append((u[2], u[3], epoch, start))
                start += size
    return sorted(out)


def test_permutations_equal_loops_with_ties(spark):
    rng = random.Random(12)
    docs = [(i, "x" * rng.randrange(300), rng.choice("aab")) for i in range(150)]
    # Ties: units of one id that differ in tokens alone, and rows that repeat.
    docs += [(5000, "y" * n, "a") for n in (4, 40, 400)] + [(5001, "z" * 9, "b")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    units = Counter((i, s, str(i), -(-len(t) // 4)) for i, t, s in docs)
    units = [(*u, n) for u, n in units.items()]
    total = sum(u[3] * u[4] for u in units)
    sizes = mixing.source_sizes(mixing.units(df, "doc_id", "source", mixing.text_tokens()))
    e = mixing.solve_exponent(sizes, total, total, 1.5)
    shares = {r.source: (r.units, r.epochs, r.rest) for r in mixing.allotted(sizes, total, total, e).collect()}
    drawn = mixing.mixture(df, max_repeats=1.5).collect()
    assert sorted((r.name, r.tokens, r.epoch, r.token_start) for r in drawn) == plain_drawn(units, shares)


def test_a_covering_budget_leaves_nothing_out(spark):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randrange(200), "big" if i % 9 else rng.choice(["s", "t"])) for i in range(400)]
    docs += [(9000, None, "void"), (9001, "", None), (None, "no id", None)]
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, source string, n long")
    drawn = mixing.mixture(df, max_repeats=2.0, tokens="n", cover=True).collect()
    assert {r.key for r in drawn} == {d[0] for d in docs}
    size, spent = Counter(), Counter()
    for _, text, source in docs:
        size[source or ""] += len(text or "")
    for r in drawn:
        spent[r.source] += r.tokens * r.rows
    repeats = {s: spent[s] / size[s] for s in size if size[s]}
    assert min(repeats.values()) == 1.0 and max(repeats.values()) <= 2.0
    with pytest.raises(ValueError):
        mixing.mixture(df, budget=5, cover=True)


def test_empty_table_and_no_tokens(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixture(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mixture(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
