import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.functions import kernel
from kmerloom.functions.kernel import SketchParams, gather_bits, mix64, runs, sampled_keys, scatter_bits, unpack_keys

PARAMS = [SketchParams(fold=2), SketchParams(half_context=5, outer=1, inner=3, fold=1), SketchParams(coden=True, fold=1), SketchParams(half_context=4, fold=0)]


def brute(seq, p):
    """Every kept key by walking the sequence letter by letter with Python integers."""
    comp = dict(zip("ACGT", "TGCA"))
    number = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
    pick = lambda x, mask: sum((x >> b & 1) << i for i, b in enumerate(b for b in range(64) if mask >> b & 1))
    out = []
    for i in range(len(seq) - p.k + 1):
        w = seq[i : i + p.k].upper()
        if set(w) <= set("ACGT"):
            f, r = number(w), number("".join(comp[c] for c in reversed(w)))
            fc, rc = f & p.context_mask, r & p.context_mask
            if int(mix64(np.array([min(fc, rc)], np.uint64))[0]) & 0xFFFFFFFF <= p.threshold:
                x = f if fc < rc else r
                out.append(pick(x, p.context_mask) << p.object_bits | pick(x, p.object_mask))
    return out


@pytest.mark.parametrize("p", PARAMS)
def test_keys_match_a_letter_by_letter_walk(p):
    rnd = random.Random(p.k)
    seqs = ["".join(rnd.choice("ACGTacgtN" if rnd.random() < 0.2 else "ACGT") for _ in range(n)) for n in (0, p.k - 1, p.k, p.k + 1, 400, 90)] + [None, "AC" * 40]
    index, keys = sampled_keys(seqs, p)
    for i, s in enumerate(seqs):
        assert keys[index == i].tolist() == brute(s or "", p)


def test_hash_constants():
    assert int(mix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF


@pytest.mark.parametrize("p", PARAMS)
def test_unpack_gives_the_kmer_or_its_other_strand(p):
    seq = "".join(random.Random(1).choices("ACGT", k=300))
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    _, keys = sampled_keys([seq], p)
    assert all(k in seq or k in other for k in unpack_keys(keys.view(np.int64), p)) and len(keys)


def test_bits():
    x = np.arange(0, 2**16, 7, dtype=np.uint64)
    mask = 0b1111001111001111
    assert runs(0b1101) == [(0, 1), (2, 2)]
    assert (scatter_bits(gather_bits(x & np.uint64(mask), mask), mask) == (x & np.uint64(mask))).all()


def test_parameters():
    assert SketchParams(fold=3).hash_id != SketchParams(fold=4).hash_id
    assert SketchParams(coden=True).k == 32 and SketchParams(coden=True).object_bits == 20
    for bad in ({"half_context": 3}, {"fold": 24}, {"half_context": 16, "inner": 1}, {"least_count": 0}):
        with pytest.raises(ValueError):
            SketchParams(**bad)


def test_larger_fold_keeps_a_subset():
    seq = "".join(random.Random(2).choices("ACGT", k=3000))
    keys = [set(sampled_keys([seq], SketchParams(fold=f))[1].tolist()) for f in (1, 2, 3)]
    assert keys[2] < keys[1] < keys[0]


def test_slices_and_borders(monkeypatch):
    """Slices of a few windows give what one slice gives; no window crosses a sequence, and Arrow slices and nulls are minded."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ACGTacgtN") for _ in range(rnd.randrange(60))) for _ in range(40)] + [None, "", "ACGT" * 30]
    p = SketchParams(half_context=4, outer=1, inner=1, fold=1)
    whole = [sampled_keys([t], p)[1].tolist() for t in texts]
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(kernel, "SLICE", size)
        for array in (pa.array(texts), pa.array(["ACGTACGTACGTACGT", *texts, "TTTT"])[1:-1], pa.array(texts, pa.large_string())):
            index, keys = sampled_keys(array, p)
            assert [keys[index == i].tolist() for i in range(len(texts))] == whole


def test_a_long_record_needs_little_memory():
    """300 million letters, of which the text itself takes 300 MB: the rest stays below 400 MB."""
    script = (
        "import resource, numpy as np, pyarrow as pa\n"
        "from kmerloom.functions.kernel import SketchParams, sampled_keys\n"
        "n = 300_000_000\n"
        "text = np.tile(np.frombuffer(np.random.default_rng(1).choice(list(b'ACGT'), 1_000_003).astype(np.uint8).tobytes(), np.uint8), 300)[:n]\n"
        "column = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, n], np.int64)), pa.py_buffer(text))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "index, keys = sampled_keys(column, SketchParams(fold=12))\n"
        "print(len(keys), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600, cwd=Path(__file__).parent.parent)
    n, grown = map(int, out.stdout.split())
    assert n > 30_000 and grown < 400
