"""Token alignment against a plain loop over tokens, the fragment monoid against whole texts, and the fast tokenizer against the slow one."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabloom.llm import alignment
from test_operators import ODD, ROWS, frame, prose

PATHS = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
RNG = random.Random(5)
TEXTS = ["", None, "plain words", "  two  spaces ", "tab\tand\nline\n\nend\n", "naïve café — “quoted” …", "日本語の文と words", "emoji 🙂🙂 <|endoftext|> </s> <s>",
         "holds ▁ its mark", "a b c", "x" * 4000, " " * 5000 + "y", "\x00nul", "ﬁ ligature Å", "don't we'll I'd", "1234567 89", "ab" * 700 + " end", "é combined"]


def plain(rows):
    """Tokens of every text by both libraries, one text at a time, cut and linked by loops."""
    pair = alignment.Pair(*PATHS[:2])
    table, tallies = [], Counter()
    for key, text in rows:
        spaced = " " + (text or "")
        a = pair.slow.encode(spaced, add_special_tokens=False).ids if text else []
        b = pair.pieces.encode(text) if text else []
        data = spaced.encode()
        if b"".join(pair.a_bytes[i] for i in a) != data or b"".join(pair.b_bytes[i] for i in b) != data:
            a, b = [], []
        spans = []
        for ids, of in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(out)
        pairs, j = [], 0
        for s, e, i in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                pairs.append((i, spans[1][k][2]))
                k += 1
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= high) for side in spans) if len(a) < 2000 else None)
            low = high
        tallies.update(pairs)
        table.append((key, len(a), len(b), groups, pairs))
    best = defaultdict(int)
    for (_, b), n in tallies.items():
        best[b] = max(best[b], n)
    return [(key, na, nb, len(g), len(p), sum(tallies[x] == best[x[1]] for x in p), sum(tallies[x] for x in p), None if None in g else ";".join(g)) for key, na, nb, g, p in table]


@pytest.mark.parametrize("chunk,block", [(64 << 10, 4 << 20), (700, 3000), (97, 400)])
def test_alignment(spark, chunk, block):
    rows = ROWS + ODD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = sorted(map(tuple, alignment.align(frame(spark, rows), *PATHS, chunk_bytes=chunk, block_tokens=block).collect()), key=repr)
    want = sorted(plain(rows), key=repr)
    assert len(got) == len(want)
    got, want = (sorted(x, key=lambda r: (repr(r[0]), r[1:7])) for x in (got, want))
    for g, w in zip(got, want):
        assert g[:7] == w[:7]
        if w[7] is not None:
            assert g[7] == w[7]


def test_empty_table_and_other_names(spark):
    assert alignment.align(frame(spark, []), *PATHS).count() == 0
    df = spark.createDataFrame([("k", "some text", 1, 2)], "`the key` string, body string, n_a int, `row` int")
    out = alignment.align(df, *PATHS, text="body", key="the key").collect()
    assert out[0]["the key"] == "k" and out[0]["n_a"] == 2


def test_any_tree_gives_the_whole_texts_groups():
    for trial in range(60):
        n = RNG.randint(2, 60)
        a_ends, b_ends = (np.array(sorted({*RNG.sample(range(1, 200), RNG.randint(1, n)), 200})) for _ in range(2))
        tokens = alignment.Tokens(0, np.arange(len(a_ends)), a_ends, np.arange(len(b_ends)), b_ends)
        # ranges of each side are cut at different places
        places = [sorted(RNG.choice(range(0, 201)) for _ in range(4)) for _ in range(2)]
        pieces, before = [], (-1, -1)
        for one, two in [*zip(*places), (200, 200)]:
            x, y = tokens.between(before[0], one), tokens.between(before[1], two)
            pieces.append(alignment.fragment(alignment.Tokens(min(before), x.a, x.a_ends, y.b, y.b_ends)))
            before = (one, two)
        while len(pieces) > 1:
            i = RNG.randrange(len(pieces) - 1)
            pieces[i: i + 2] = [alignment.compose(pieces[i], pieces[i + 1])]
        f = pieces[0]
        assert f.suffix is not None and not len(f.suffix.a) and not len(f.suffix.b)
        parts = [f.prefix, *f.closed]
        assert np.array_equal(np.concatenate([p.a for p in parts]), tokens.a) and np.array_equal(np.concatenate([p.b for p in parts]), tokens.b)
        # every part ends at a common end, and the ends inside it are those of the whole
        assert all(p.a_ends[-1] == p.b_ends[-1] for p in parts)


def test_fast_tokenizer_is_the_slow_one():
    pair = alignment.Pair(*PATHS)
    assert pair.fast is not None
    slow = Tokenizer.from_file(PATHS[0])
    slow.encode_special_tokens = True
    pool = [chr(c) for c in range(0x250) if not 0xD800 <= c < 0xE000] + list("‐‑–—‘’“”•…") + [" "] * 60 + list("etaoin\n\t'") * 6 + ["'s", "'LL", "<|endoftext|>", "日", "́", " "]
    for _ in range(3000):
        text = "".join(RNG.choice(pool) for _ in range(RNG.randint(0, 60)))
        assert pair.encode_a(text) == slow.encode(text, add_special_tokens=False).ids, ascii(text)
