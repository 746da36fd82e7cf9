"""Windows with more offsets than a mask has bits, against brute force."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tabloom.llm import bwt, suffixtrees  # noqa: E402

RNG = random.Random(3)


def prose(n):
    return " ".join("".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 6))) for _ in range(n))


SHARED = prose(260)
ROWS = [(1, f"{prose(40)} {SHARED} {prose(30)}"), (2, f"{prose(25)} {SHARED} {prose(50)}"), (3, f"{prose(9)} {' '.join(SHARED.split()[60:200])} {prose(70)}"),
        (4, f"{SHARED} {SHARED}"), (5, prose(300)), (6, "a" * 900), (7, "a" * 700), (8, None)]


@pytest.mark.parametrize("how", [{}, {"hot_bytes": 500, "bin_bytes": 2000}])
@pytest.mark.parametrize("length", [75, 90, 140])
def test_long_word_windows(spark, length, how):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    got = sorted(map(tuple, suffixtrees.drop_repeats(docs, length=length, **how).collect()), key=repr)
    assert got == sorted(brute.repeats(ROWS, length), key=repr)


@pytest.mark.parametrize("how", [{}, {"hot_bytes": 500, "bin_bytes": 2000}])
@pytest.mark.parametrize("length", [82, 83, 100, 300])
def test_long_byte_windows(spark, length, how):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    got = bwt.drop_repeats(docs, length=length, **how).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=repr)
    assert got == sorted(brute.strings(ROWS, length), key=repr)
