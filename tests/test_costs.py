"""Kernels do no more than their result asks for, and give the same."""

import numpy as np
import pyarrow as pa

from trackforge.operators import runs, sequential


def test_the_last_joined_piece_is_sought_at_the_last_place(monkeypatch):
    n, sizes, plain = 120, [], sequential.lowest
    monkeypatch.setattr(sequential, "lowest", lambda a, b, c: sizes.append(len(a)) or plain(a, b, c))
    x = np.arange(n, dtype=float)
    y = np.where(x < 40, x, 80 - x) + np.random.default_rng(3).normal(0, 0.1, n)
    at, _, error = sequential.joined_pieces(x, y, 2)
    assert at.tolist() == [0.0, 40.0, n - 1.0] and error < 3
    assert sum(sizes) < 3 * n  # not the square of n


def test_random_numbers_of_several_steps_at_once():
    """The counter's fifth power modulo the prime by shifts alone, a row for each step and number."""
    p, (a, b, c, d) = sequential.PRIME, sequential.FACTORS
    whole = lambda key, step, m, number: (pow(key * a + step * b + m * c + number * d, 5, p) + 0.5) / p
    zero = -(5 * a + 9 * b) * pow(c, -1, p) % p  # the sum is a multiple of the prime
    m = np.array([0, 1, 999, p - 1, zero], np.int64)
    got = sequential.uniforms(5, np.array([9, 10])[:, None, None], m, np.arange(4)[:, None])
    assert got.shape == (2, 4, 5) and 0 < got.min() and got.max() < 1
    assert got.tolist() == [[[whole(5, s, int(k), n) for k in m] for n in range(4)] for s in (9, 10)]
    two = sequential.normals(5, np.array([3, 4]), 10)
    assert [two[i].tolist() == sequential.normals(5, np.array([3 + i]), 10)[0].tolist() for i in range(2)] == [True, True]


def test_lines_of_many_short_chunks_are_one_batch():
    kinds = pa.schema([("track", pa.string()), ("to", pa.int32()), ("rows", pa.list_(pa.int32())), ("states", pa.list_(pa.float64()))])
    line = lambda i: (pa.array([f"t{i}" if i % 5 else None], pa.string()), i, np.arange(i % 3), np.full(i % 4, i / 2))
    want = [{"track": f"t{i}" if i % 5 else None, "to": i, "rows": list(range(i % 3)), "states": [i / 2] * (i % 4)} for i in range(3000)]
    got = list(runs.gathered(map(line, range(3000)), kinds))
    assert len(got) == 1 and got[0].to_pylist() == want
    assert not list(runs.gathered(iter(()), kinds))
    long = list(runs.gathered(((pa.array(["a"]), i, np.arange(90_000), np.zeros(0)) for i in range(4)), kinds))
    assert [b.num_rows for b in long] == [2, 2]  # bounded by their values
