"""Every operator against a plain version: planted cases, nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tabloom.llm import bwt, languages, minhash, packing, pages, quality, sitelines, suffixtrees, tiling, toolcalls  # noqa: E402
from tabloom.llm.queries import tokenizer_path  # noqa: E402

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgéñü") for _ in range(RNG.randint(1, 9))) for _ in range(900)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Rows (doc_id, text): plain, copies, near copies, shared passages, repeats inside one text, junk and edge cases."""
    base, passage = prose(200), prose(60)
    rows = [prose(RNG.randint(1, 150)) for _ in range(25)]
    rows += [base, base, base.upper(), base.replace(" ", "\n", 7)]
    for k in (1, 3, 6, 12, 25, 50):
        w = base.split()
        for i in RNG.sample(range(len(w)), k):
            w[i] = RNG.choice(VOCABULARY)
        rows.append(" ".join(w))
    rows += [prose(10) + " " + passage + " " + prose(15), passage, passage[3:] + " " + prose(5), passage + "  " + passage, "a b\nc d\na b\n\nc d " * 9]
    rows += [None, "", "   \n\t", "one", "one two", "x" * 3000, prose(9000), " ".join(["same"] * 400), "Ab\x00c " * 40, "a b " * 30]
    return list(enumerate(rows))


ROWS = corpus()
ODD = [(7, ROWS[25][1]), (7, ROWS[25][1]), (None, ROWS[25][1]), (None, None), (9, ""), (9, "other text " * 40), (12, prose(300))]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    full = [(k, t, ["en", "de", None][(k or 0) % 3], [f"s{(k or 0) % 4}", None][(k or 1) % 9 == 0], -1, "x", 1, True, 2, "y") for k, t in rows]
    return spark.createDataFrame(full, brute.SCHEMA + ", `kept` string, n_words int, spans boolean, start int, `a.b` string").repartition(3)


def test_suffix_trees(spark, docs):
    for rows, how in ((ROWS, {}), (ROWS, {"hot_bytes": 500, "bin_bytes": 2000}), (ROWS + ODD, {}), ([], {})):
        for length, anchor in ((35, 12), (6, 3)):
            got = sorted(map(tuple, suffixtrees.drop_repeats(frame(spark, rows), length=length, anchor=anchor, **how).collect()), key=repr)
            assert got == sorted(brute.repeats(rows, length), key=repr)


def test_column_bwt(spark):
    for rows, how in ((ROWS, {}), (ROWS, {"hot_bytes": 500, "bin_bytes": 2000}), (ROWS + ODD, {}), ([], {})):
        got = bwt.drop_repeats(frame(spark, rows), **how).collect()
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=repr)
        assert got == sorted(brute.strings(rows, 50), key=repr)


def test_collection_transform():
    """The column-wise construction sorts all suffixes and keeps the symbols before them."""
    texts = [b"banana", b"ananas", b"nan", b"b"]
    c = bwt.Collection([np.frombuffer(t, np.uint8) for t in texts], 3).build()
    got = [texts[d][len(texts[d]) - n:] for d, n in zip(c.doc, c.length)]
    want = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t) + 1))
    assert got == [w[0] for w in want]
    alphabet = sorted(set(b"".join(texts)))
    before = {(d, n): (alphabet[s - 1] if s else None) for d, n, s in zip(c.doc.tolist(), c.length.tolist(), c.before.tolist())}
    for d, t in enumerate(texts):
        for n in range(len(t) + 1):
            assert before[d, n] == (t[len(t) - n - 1] if n < len(t) else None)
    for i in range(1, len(got)):
        if len(got[i]) >= 3 and len(got[i - 1]) >= 3:
            assert bool(c.shared[i]) == (got[i][:3] == got[i - 1][:3])


def test_minhash(spark):
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, ROWS), size, percent).collect()}
        assert got == {k: (n, c, c == k) for k, (n, c) in brute.groups(ROWS, size, percent).items()}
    assert minhash.near_duplicates(frame(spark, []), 3, 85).count() == 0
    odd = minhash.near_duplicates(frame(spark, ODD), 3, 85).collect()
    assert len(odd) == len(ODD) and all(r.component_id == 7 for r in odd if r.n_shingles > 150 and r.doc_id in (7, None))
    kept = minhash.drop_near_duplicates(frame(spark, ODD)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept if r.text) == sorted(
        (k is None, k or 0, t) for k, t in {(7, ROWS[25][1]), (9, "other text " * 40), (12, ODD[-1][1])})


def test_minhash_banding(spark):
    """Pairs of similarity 0.8 that meet in none of 36 bands of 7 rows are found at 80 percent."""
    assert minhash.banding(85) == (36, 7)
    for percent in (1, 10, 30, 50, 70, 80, 85, 90, 99):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1.01e-6
    rows = []
    for i in (2604, 5858, 7266, 15862, 23286):
        w = [f"w{i * 14 + j}" for j in range(14)]
        rows += [(2 * i, " ".join(w[:13])), (2 * i + 1, " ".join(w[1:]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 5, 80).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_minhash_shared_keys(spark):
    """Unlike texts under a null key or under one id are groups of their own: one row of each stays."""
    rng = random.Random(11)
    plain = [" ".join(rng.choice(VOCABULARY) for _ in range(n)) for n in (80, 90, 100, 110, 120, 130)]
    near = plain[5] + " more"
    rows = [(None, plain[0]), (None, plain[1]), (None, plain[1]), (7, plain[2]), (7, plain[3]), (7, plain[3]), (8, plain[4]), (None, plain[4]), (9, plain[5]), (9, near), (None, None), (None, "")]
    kept = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(frame(spark, rows)).collect()]
    assert len(kept) == 8 and {(None, plain[0]), (None, plain[1]), (7, plain[2]), (7, plain[3]), (8, plain[4]), (None, None), (None, "")} < set(kept)
    assert sum(k == 9 for k, _ in kept) == 1


def test_minhash_large_group(spark):
    """Many near copies of one text, most of them too far from each other: no link is lost in blocks of a hot bucket."""
    base, rows = [RNG.choice(VOCABULARY) for _ in range(120)], []
    for k in range(160):
        w = list(base)
        for i in RNG.sample(range(120), RNG.choice((1, 2, 4, 7))):
            w[i] = RNG.choice(VOCABULARY)
        rows.append((k, " ".join(w)))
    before = minhash.BLOCK_CLASSES
    minhash.BLOCK_CLASSES = 20
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    finally:
        minhash.BLOCK_CLASSES = before
    assert got == {k: c for k, (_, c) in brute.groups(rows, 3, 85).items()}


def test_circulant_estimate():
    a, b = np.arange(0, 900, dtype=np.uint64) * 77, np.arange(100, 1000, dtype=np.uint64) * 77
    same = np.mean(minhash.signature(a, 252) == minhash.signature(b, 252))
    assert abs(same - 0.8) < 0.12


def test_quality(spark):
    rows = ROWS + ODD
    got = quality.quality_rules(frame(spark, rows), min_rows=5).collect()
    assert len(got) == len(rows)
    measured = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert measured == sorted((k is None, k or 0, *brute.quality(t)) for k, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        over = [r[m] > r[f"max_{m}"] for m in quality.MEASURES if r[f"max_{m}"] is not None]
        assert r.kept == (not r.base_failed and not any(over))
    assert quality.quality_rules(frame(spark, [])).count() == 0
    kept = quality.drop_rejected(frame(spark, rows), min_rows=5)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r.kept for r in got)


def test_adaptive_threshold(spark):
    """Symbol-laden texts fall out of a group where they are rare and stay where they are usual."""
    plain = [(i, prose(40), "en", "a", 0) for i in range(40)]
    laden = [(100 + i, prose(30) + " # | " * 20, "en", "a" if i < 2 else "b", 0) for i in range(42)]
    laden = [(k, " ".join(f"{w}{i}" for i, w in enumerate(t.split())), x, s, n) for k, t, x, s, n in laden]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(plain + laden, brute.SCHEMA)).collect()}
    assert all(got[i] for i in range(40)) and not got[100] and not got[101] and all(got[100 + i] for i in range(2, 42))


def test_site_lines(spark):
    lines = [prose(6) for _ in range(12)]
    rows = []
    for k in range(60):
        t = "\n".join(["  " + lines[0] + "\r", *[x for i, x in enumerate(lines[1:], 1) if k % (i + 1) == 0], prose(5), "", " "])
        rows.append((k, t, "en", f"s{k % 14}", 0))
    rows += [(60, None, None, None, 0), (61, "", "x", None, 0), (5, rows[5][1], "en", "s5", 0), (None, lines[0], "en", None, 0)]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], brute.SCHEMA + ", n_lines int, `__i` string")
    for sites in (3, 5, 10, 14):
        want = brute.boilerplate([(t, s) for _, t, _, s, _ in rows], sites)
        got = sitelines.strip_lines(df, sites).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_lines - r.n_removed_lines) for r in got) == sorted(
            (r[0] is None, r[0] or 0, w or "", max(1, len((w or "").split("\n")) if w or r[1] in (None, "") else 0) if w or not r[1] else 0)
            for r, w in zip(rows, want))
    assert sitelines.strip_lines(df.limit(0)).count() == 0


def test_tiling(spark):
    items = [(1, prose(30)), (2, prose(12)), (3, "one short"), (4, ""), (5, None), (2, prose(14))]
    w = items[0][1].split()
    docs = [(0, prose(20) + " " + items[0][1] + " " + prose(9)), (1, " ".join(w[15:] + ["x"] + w[:15])), (2, " ".join(w[:10])), (3, items[1][1].upper() + "!"),
            (4, "one, short"), (5, None), (6, ""), (7, prose(400)), (7, items[1][1]), (8, " ".join(w[:16]) + " y " + " ".join(w[:16]))]
    bench = spark.createDataFrame([(k, t, "q") for k, t in items], "item_id long, text string, coverage string")
    for block in (tiling.BLOCK_BYTES, 60):
        got = sorted((r.doc_id, r.item_id, r.covered_tokens, r.item_tokens) for r in tiling.leaks(frame(spark, docs), bench, block_bytes=block).collect())
        want = []
        for k, t in docs:
            for j, x in items:
                covered, n = brute.tiled(t, x, tiling.SEED_WORDS)
                if n and covered >= tiling.COVERAGE * n:
                    want.append((k, j, covered, n))
        assert got == sorted(want)
    left = tiling.drop_leaked(frame(spark, docs), bench).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == sorted((k, t or "") for k, t in docs if not any(
        n and c >= tiling.COVERAGE * n for c, n in (brute.tiled(t, x, tiling.SEED_WORDS) for _, x in items)))
    assert tiling.leaks(frame(spark, docs), bench.limit(0)).count() == 0 and tiling.leaks(frame(spark, []), bench).count() == 0


def test_tiling_unicode(spark, tmp_path):
    """The registered query and the pipeline find a passage whose case, quotes and dashes were changed, outside ASCII as well."""
    import corpus_pipeline
    from tabloom.llm.queries import QUERIES

    item = "el niño pequeño señaló mañana la cigüeña über größere straße où l’été “déjà” fini – même après noël όλος ο κόσμος"
    other = "ein ganz anderer satz über völlig fremde dinge ohne gemeinsame wörter"
    docs = [(0, "vor " + item.upper() + " nach"), (1, item.replace("–", ",").replace("“", '"').replace("”", '"')), (2, other), (3, other.upper()), (4, None), (5, item.title())]
    folder = str(tmp_path)
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r.coverage for r in QUERIES["op4_string_tiling"](spark, folder).collect()}
    assert got == {0: 1.0, 1: 1.0, 5: 1.0}
    left = corpus_pipeline.decontamination(spark, frame(spark, docs), folder).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == [(k, t or "") for k, t in docs if k in (2, 3, 4)]


def test_language(spark):
    letters = "abcdefghilmnorstu"
    vocabularies = {x: ["".join(RNG.choice(letters) for _ in range(RNG.randint(4, 9))) for _ in range(300)] for x in ("aa", "bb", "cc")}
    make = lambda s, n: " ".join(RNG.choice(s) for _ in range(n))
    rows = [(i, make(vocabularies[x], 60), x, "s", 0) for i, x in enumerate(list(vocabularies) * 60)]
    df = spark.createDataFrame(rows, brute.SCHEMA)
    known = languages.learn_dictionaries(df.where("doc_id % 5 <> 0"))
    assert sorted(known) == sorted(vocabularies)
    out = languages.classify(df.where("doc_id % 5 = 0"), known, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out) and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", "aa", None, 0), (3, "12 !", "aa", None, 0), (None, make(vocabularies["aa"], 9000), "aa", "s", 0)], brute.SCHEMA)
    got = {r.doc_id: r for r in languages.classify(odd, known).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, None)] == ["und", "und", "und", "aa"] and not got[1].accepted and got[1].score == 0
    assert languages.classify(odd, languages.learn_dictionaries(odd.limit(0))).where("lang_pred <> 'und'").count() == 0
    narrow = languages.classify(df, known, margin=0.9)
    assert narrow.where("accepted").count() == 0


def test_piece_ids_are_the_tokenizers(spark):
    """Ids put together from pieces are those of the whole text, and other tokenizers encode whole texts."""
    from tokenizers import Tokenizer, normalizers

    tokenizer = Tokenizer.from_file(tokenizer_path(spark))
    assert packing.by_pieces(tokenizer)
    known = packing.Words(tokenizer, "<u2")
    pool = [chr(c) for c in range(0x250)] + list("etaoinETAOIN .,'") * 30 + ["'S", "'ll", "<|endoftext|>", " <|startoftext|> ", "\u0301", "İ", "ſ", "ﬁ", "日本", "\u2003", "🙂", "$$$", "№", "K"]
    for _ in range(3000):
        text = "".join(RNG.choice(pool) for _ in range(RNG.randint(0, 40)))
        got = np.frombuffer(b"".join(map(known.__getitem__, text.encode().split())), "<u2").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
    assert len(known) > 3000 and known.young() is known
    other = Tokenizer.from_file(tokenizer_path(spark))
    other.normalizer = normalizers.Lowercase()
    assert not packing.by_pieces(other)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Whole(other, "<u4")([b"One two", b""])] == [other.encode("One two", add_special_tokens=False).ids, []]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(spark)
    tokenizer = Tokenizer.from_file(path)
    for rows, length in ((ROWS, 4096), (ROWS[:30] + [(40, "<|endoftext|> a<|startoftext|>b  c\x1cd")], 64), (ROWS[-10:] + [(3, "twice"), (3, "twice"), (None, "x")], 128), ([], 64)):
        out = packing.pack(frame(spark, rows), path, length=length).collect()
        ids = defaultdict(list)
        for k, t in rows:
            ids[k].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
        for k, many in ids.items():
            mine = sorted((r for r in out if r.doc_id == k), key=lambda r: (r.start, r.sequence_id))
            assert sum(r.length for r in mine) == sum(map(len, many))
            for r in mine:
                assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start: r.start + r.length].tobytes()) == r.ids_crc32 for x in many)
            if len(many) == 1:
                assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        sequences = defaultdict(list)
        for r in out:
            sequences[r.sequence_id].append((r.offset, r.length))
        assert sorted(sequences) == list(range(len(sequences)))
        for parts in sequences.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
            assert ends[-1] == length or ends[-1] & (ends[-1] - 1) == 0


def test_hilbert_curve():
    """Every cell once, neighbours one step apart."""
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * d)).reshape(d, -1).T
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">{n}</a></li><li><a>{n}</a></li></ul></nav>
<!-- x --><div class="ad">{n} {n}.</div><article><h1>{t}</h1><p><b>{p}<br><p>{q} &amp; &eacute;<a href="x>y">z</a></p></article><footer>&copy; {n}</footer><script>var a="</p><p>no"</script>"""


def test_pages(spark):
    make = lambda i: PAGE.format(t=prose(4), n=prose(2), p=prose(20), q=prose(12))
    rows = [(i, f"u{i}", make(i), "x") for i in range(60)] + [(60, None, None, "x"), (61, "u", "", "x"), (61, "u", "", "x"), (62, "u", "plain < text", "x"), (63, "u", "<p" * 5000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = pages.learn(df, sample=30)
    got = {r.page_id: r for r in pages.extract(df, model).collect()}
    for i in range(60):
        source = rows[i][2]
        title = source.split("<title>")[1].split("</title>")[0]
        first, second = source.split("<p><b>")[1].split("<br>")[0], source.split("<br><p>")[1].split(" &amp;")[0]
        assert got[i].text == "\n\n".join((title, first, second + " & éz")) and got[i].n_chars == len(got[i].text)
    assert got[60].text == got[61].text == "" and got[60].n_chars == 0 and len(got) == 64
    assert pages.extract(df.limit(0), pages.learn(df.limit(0), sample=5)).count() == 0


def test_pages_other_layouts(spark):
    """Held-out layouts: most blocks of pages rebuilt with another seed are told apart."""
    source = [PAGE.format(t=prose(4), n=prose(2), p=prose(20), q=prose(12)) for _ in range(60)]
    model = pages.learn(spark.createDataFrame([(x,) for x in source[:40]], "html string"))
    rng, right, total = random.Random(99), 0, 0
    for x in source[40:]:
        blocks, labels = pages.rebuilt(*pages.labelled(x), rng)
        right += sum(a == b for a, b in zip(model.decode(blocks), labels))
        total += len(labels)
    assert right > 0.9 * total


def test_tool_calls(spark):
    calls = [(1, 1, "a", "search", '{"query":"x", "limit": 3}'), (1, 2, "b", "search", '{"limit":"3","query":"@a"}'), (1, 3, "c", "search", '{"query":"@d"}'),
             (1, 4, "d", "search", '{"query":"@c"}'), (1, 5, "e", "search", '{"query":"@c"}'), (1, 6, "a", "search", '{"query":"later"}'), (1, 7, None, "search", "{}"),
             (2, 0, "a", "nothing", '{"z":1}'), (2, 0, "f", "search", "not json"), (2, 3, "g", "search", '{"query":"@zz"}'), (2, 1, "h", "search", '{"query":"@g", "no": null}'),
             (2, 9, "i", "search", '{"query":"q", "query2": [1]}'), (2, 9, "i", "search", '{"query":"q", "query2": [1]}')]
    results = [(1, 2, "a", 'r"1'), (1, 3, "a", "second"), (1, 0, "b", "before"), (2, 5, "g", None), (2, 5, "missing", "x"), (3, 1, None, "n")]
    c = spark.createDataFrame([(*x, "extra") for x in calls], "conv_id long, turn long, call_id string, name string, arguments string, status string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    schemas = toolcalls.schema_table(spark, {"search": {"query": ("string", True), "limit": ("integer", False)}})
    got = {(x.conv_id, x.call_id, x.turn): x for x in toolcalls.link(c, r, schemas).collect()}
    status = {k: v.status for k, v in got.items()}
    assert status == {(1, "a", 1): "ok", (1, "b", 2): "invalid", (1, "c", 3): "cyclic", (1, "d", 4): "cyclic", (1, "e", 5): "cyclic", (1, "a", 6): "duplicate",
                      (1, None, 7): "unanswered", (2, "a", 0): "invalid", (2, "f", 0): "invalid", (2, "g", 3): "ok", (2, "h", 1): "invalid", (2, "i", 9): "invalid",
                      (1, "a", 3): "orphan", (1, "b", 0): "orphan", (2, "missing", 5): "orphan", (3, None, 1): "orphan"}
    assert got[1, "b", 2].errors == ["limit: string instead of integer"] and got[2, "f", 0].errors == ["arguments: not a JSON object"]
    assert got[2, "a", 0].errors == ["tool: unknown"] and got[2, "i", 9].errors == ["query2: not a parameter"]
    assert (got[1, "a", 1].position, got[1, "b", 2].position) == (1, 2) and got[2, "g", 3].position < got[2, "h", 1].position
    assert got[1, "a", 1].json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"r\\"1"}'
    assert got[2, "g", 3].json == '{"arguments":{"query":"@zz"},"id":"g","name":"search","result":null}'
    assert toolcalls.link(c.limit(0), r.limit(0), schemas).count() == 0
    assert toolcalls.link(c.limit(0), r, schemas).where("status = 'orphan'").count() == len(results)


def test_native_plans(spark, docs):
    """The operators that are to stay inside the JVM run no Python."""
    made = [quality.quality_rules(docs), quality.measured(docs, keep=("doc_id",)), sitelines.strip_lines(docs),
            sitelines.line_hashes(docs.select("doc_id", "text", "source"), "text", "source", "doc_id")]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
        assert F is not None
