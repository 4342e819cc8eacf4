"""Many pairs at once against one pair at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kalangu.functions import blocks, edits


def pairs_of(rng, kind):
    out = []
    for _ in range(150):
        size = rng.choice([0, 1, 5, 24, 63, 64, 65, 130, 400])
        r = [rng.choice("abéж𝒳" if kind == "text" else ["x", "the", "ждать", "a"]) for _ in range(size)]
        h = [rng.choice([x, "x"]) for x in r if rng.random() > 0.2] + ["q"] * rng.choice([0, 0, 3, 90])
        out.append(rng.choice([(r, h), (r, h), (h, r), (r, r), (None, h), (r, None)]))
    return [tuple(x if x is None or kind == "list" else "".join(x) for x in p) for p in out]


@pytest.mark.parametrize("kind", ["text", "list"])
@pytest.mark.parametrize("small", [False, True])
def test_equal_to_one_at_a_time(monkeypatch, kind, small):
    if small:
        for name, size in (("SYMBOLS", 500), ("CELLS", 8), ("KEPT", 1 << 12), ("COMPARED", 3), ("ALIGNED", 2)):
            monkeypatch.setattr(blocks, name, size)
    made = pairs_of(random.Random(7), kind)
    type_ = pa.string() if kind == "text" else pa.list_(pa.string())
    ref, hyp = (pa.array([p[k] for p in made], type_) for k in (0, 1))
    got, long = blocks.distances(ref, hyp)
    aligned, longer = blocks.alignments(ref, hyp)
    assert small == bool(len(long)) == bool(len(longer))
    for k, (r, h) in enumerate(made):
        if k not in long:
            assert got[k] == edits.distance(r or "", h or "")
        if k not in longer:
            assert tuple(aligned[k]) == edits.align(r or "", h or "")


def test_lists_with_nulls_and_slices():
    ref = pa.array([["z"], ["a", None, "b"], [], ["c"]], pa.list_(pa.string())).slice(1)
    hyp = pa.array([["z"], ["a", None], ["d"], None], pa.list_(pa.string())).slice(1)
    assert blocks.distances(ref, hyp)[0].tolist() == [1, 1, 1]
    assert blocks.alignments(ref, hyp)[0].tolist() == [[2, 0, 1, 0], [0, 0, 0, 1], [0, 0, 1, 0]]


def test_a_batch_needs_one_step_a_column(monkeypatch):
    """Steps over a batch of utterances do not grow with its rows (the cost of one pair at a time did)."""
    steps = []
    sweep = blocks._sweep
    monkeypatch.setattr(blocks, "_sweep", lambda r, h, *a: (steps.append(h.shape[1]), sweep(r, h, *a))[1])
    rng = np.random.default_rng(1)
    for rows in (500, 5000):
        steps.clear()
        words = [[f"w{k}" for k in rng.integers(0, 50, 24)] for _ in range(rows)]
        edits.batch_distances(pa.array(words), pa.array([w[:20] for w in words]))
        assert 0 < sum(steps) <= 24


def test_a_long_pair_needs_the_diagonals_between_its_ends(monkeypatch):
    """A text and one with a fifth of it dropped: bits of columns, of one band or two, are less than half the table."""
    bits, sweep = [], edits._sweep
    monkeypatch.setattr(edits, "_sweep", lambda masks, hyp, low, width, *a: (bits.append(width * len(hyp)), sweep(masks, hyp, low, width, *a))[1])
    rng = random.Random(3)
    ref = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    hyp = "".join(x for k, x in enumerate(ref) if k // 10 % 5 != 2)
    assert edits.distance(ref, hyp) == edits.distance(hyp, ref) == len(ref) - len(hyp)
    assert 0 < sum(bits) < len(ref) * len(hyp)
    bits.clear()
    assert edits.align(list(ref), list(hyp)) == (len(hyp), 0, len(ref) - len(hyp), 0)
    assert 0 < sum(bits) < len(ref) * len(hyp)
