"""Seeds of benchmark decontamination, hashed for many documents at once."""

import numpy as np

from sluice.llm import decontaminate
from sluice.llm.common import WordHash


def test_seeds_of_documents_in_one_array():
    """The candidates of many documents at once are those of each document alone; none reaches beyond its document."""
    item = [b"w%d" % i for i in range(20)]
    words = [[], item[:5], item[5:], [b"--", *item, b"..."], [], [b"x"] * 3 + item[:12], [b"5.", *item[2:6], b"!"], [b"!"]]
    hashes = WordHash(decontaminate.bare)
    array = lambda x: (lambda h: h[h != 0])(hashes.array(x))
    bits, last = np.zeros(1 << 17, np.uint64), np.uint64((1 << 23) - 1)
    for h in [*decontaminate.seeds(array(item)), *decontaminate.whole_seeds(array(item[2:6]), [4])]:
        for spot in (h & last, (h >> np.uint64(32)) & last):
            np.bitwise_or.at(bits, (spot >> np.uint64(6)).astype(int), np.uint64(1) << (spot & np.uint64(63)))
    want = []
    for i, x in enumerate(words):
        for h in [*decontaminate.seeds(array(x)), *decontaminate.whole_seeds(array(x), [4])]:
            spots = [(h & last), (h >> np.uint64(32)) & last]
            want += [(i, int(v), k) for k, v in enumerate(h.view(np.int64)) if all(int(bits[int(s[k]) >> 6]) >> (int(s[k]) & 63) & 1 for s in spots)]
    got = sorted(zip(*(x.tolist() for x in decontaminate.candidates(bits, words, [4], hashes))))
    assert got == sorted(want) and {i for i, *_ in got} == {2, 3, 5, 6}
    assert all(len(x) == 0 for x in decontaminate.candidates(bits, [[], [b"--"]], [4], hashes))


def test_bare_words():
    for word in (b"Abc9", b"a_b", b"--", "É2".encode(), b"x-y", b"", "١".encode()):
        assert decontaminate.bare(word) == decontaminate._MARKS.sub("", word.decode().lower()).encode()
