"""What keeps the cost of token files down, and the packing of last bits."""

import numpy as np
import pyarrow as pa

from tallywing.llm import range_coder, tokens


def test_what_a_batch_has_again_outlives_the_bound(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 3)
    asked = []

    def encode(strings):
        asked.append(strings.to_pylist())
        return np.array([ord(s[0]) for s in asked[-1] for _ in s], np.uint32), np.array([len(s) for s in asked[-1]])

    kept = tokens._Kept(encode)
    long = "z" * (tokens.LONGEST_KEPT + 1)
    for strings in (["a", "bb", "c", "dd"], ["c", "e", long, "bb"], [long, "bb", "e", "a"], ["a"]):
        ids, lengths = kept.flat(kept.places(pa.array(strings, pa.large_string())))
        assert ids.tolist() == [ord(s[0]) for s in strings for _ in s] and lengths.tolist() == [len(s) for s in strings]
    assert asked == [["a", "bb", "c", "dd"], ["e", long], ["a", long]]


def test_places_of_the_coder_need_no_conversion():
    model = range_coder._Model(5, np.ones(range_coder._RUNS))
    model.predict()
    assert {x.dtype for x in (model.at1, model.at2, model.k1, model.k2)} == {np.dtype(np.intp)}


def test_last_bits_are_packed_one_after_the_other():
    rng = np.random.default_rng(4)
    rows = [[(int(rng.integers(0, 1 << k)), k) for k in rng.integers(1, 33, m).tolist()] for m in (0, 1, 40, 0, 7, 300, 0)]
    flat = [x for row in rows for x in row]
    data, off = range_coder._packed_bits(np.array([v for v, _ in flat]), np.array([k for _, k in flat], np.int32), np.array(list(map(len, rows))))
    for i, row in enumerate(rows):
        whole = at = 0
        for v, k in row:
            whole |= v << at
            at += k
        assert data[off[i] : off[i + 1]].tobytes() == whole.to_bytes(-(-at // 32) * 4, "little")


def test_spoilt_blocks_raise_no_other_error():
    ids = np.random.default_rng(3).integers(0, 3000, 4000).astype(np.uint32)
    coded = range_coder.encode(ids, 256)
    for at in range(len(coded) // 2, len(coded), 397):
        broken = bytearray(coded)
        broken[at] ^= 0xA5
        with np.errstate(all="raise"):
            try:
                assert (range_coder.decode(bytes(broken)) == ids).all()  # bits that nothing reads
            except ValueError:
                pass
