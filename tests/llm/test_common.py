import numpy as np
import pyarrow as pa

from assetlake.llm import common


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (common.unpack_keys(common.pack_keys(keys)) == keys).all()
        for dtype in ("uint8", "uint32", "int64"):
            vals = rng.integers(0, 100, n).astype(dtype)
            assert (common.unpack_values(common._planes(vals), dtype) == vals).all()


def test_answers():
    tables = [
        common.requests(0, np.array([5, 9, 9], np.uint64), np.array([1, 4, 2], np.uint64), 1),
        common.requests(1, np.array([5, 7], np.uint64), np.array([1, 3], np.uint64), 1),
        common.requests(2, np.array([11], np.uint64), np.array([1], np.uint64), 1),
        common.note(1, 1, b"kept"),
    ]
    out = common._answers("min", "uint64", True)(pa.concat_tables(tables))
    by_batch = {b: out.filter(pa.array([x == b for x in out["batch"].to_pylist()])) for b in range(3)}
    keys, vals = common.answered(by_batch[0])
    assert (keys.tolist(), vals.tolist()) == ([9], [2])
    assert common.answered(by_batch[1])[0].tolist() == []
    assert common.answered(by_batch[2])[0].tolist() == []
    assert common.notes_of(by_batch[1]) == [b"kept"]


def test_sums_beyond_32_bits():
    """Two batches with counts near 2^32 each: the sum is whole, and so is a small one beside it."""
    keys = np.array([5, 9], np.uint64)
    tables = [
        common.requests(b, keys, np.array([2**32 - 1, b], np.uint32), 1) for b in range(3)
    ]
    out = common._answers("sum", "uint32", False)(pa.concat_tables(tables))
    mine = out.filter(pa.array([b == 1 for b in out["batch"].to_pylist()]))
    assert common.sums_of(mine, keys, 1).tolist() == [3 * (2**32 - 1), 3]
    for top in (0, 255, 256, 65535, 2**32 - 1, 2**32, 2**63):
        sums = np.array([1, top, 0], np.uint64)
        assert (common.unpack_sums(common.pack_sums(sums)) == sums).all()
    assert common.unpack_sums(common.pack_sums(np.empty(0, np.uint64))).tolist() == []


def test_word_classes():
    assert common.blank_words("A B\x1c\tÇc\x0b".encode()) == ["a b\x1c".encode(), "Çc".encode()]
    assert common.alnum_words("A-1_é x{Q}".encode()) == [b"a", b"1", "é x".encode(), b"q"]


def test_packed_values_take_what_they_tell():
    """Counts that are mostly one or two take less than half a byte each, keys no more than theirs."""
    rng = np.random.default_rng(3)
    counts = rng.geometric(0.6, 100_000).astype("uint32")
    assert len(common._planes(counts)) < len(counts) // 2
    keys = np.unique(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))
    blob = common.pack_keys(keys)
    assert len(blob) < 6.5 * len(keys) and (common.unpack_keys(blob) == keys).all()
    assert len(common.unpack_keys(common.pack_keys(keys[:0]))) == 0
