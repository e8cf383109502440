"""Packing, alignment and whitening against brute force: whole texts by the plain tokenizers, and numpy's eigenvectors."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from tidelane.llm import alignment, packing, units, whitening
from tidelane.llm.storage import Scratch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, start string, length long, sequence_id long, n_a long"
ODD = [None, "", " ", "a", " lead", "trail ", "two  spaces", "tab\t x", "x \n y", "<|endoftext|> and <|startoftext|>x", "it's we're '", "déjà vu naïve Ünïcode", "日本語 の テキスト です", "emoji 👩‍👩‍👧 ok 🙂🙂", "has ▁ mark", "a▁ b", "x ▁", "zero\x00byte \x1c fs", "é a ́b", "ΟΔΟΣ ΣΑΣ end", "1234 56,789.0", "=" * 5000, "no" * 3000, " nbsp  x", "  line 　wide"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, marks of both tokenizers, long units and texts, repeated rows and clashing columns."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta,", "Gamma", "δ", "x" * 30, " ", "\n"]) for _ in range(30_000))
    rows = [(i, t, None, None, i, None) for i, t in enumerate(ODD)] + [(None, "a null id", "s", 1, 1, 1), (None, "a null id", "s", 1, 1, 1), (3, "a", None, None, 3, None), (2**60 + 1, long, None, 4, 5, 6)]
    return spark.createDataFrame(rows, DOCS).repartition(3, "sequence_id").cache()


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet") if os.path.isdir(SF) else None


def whole_ids(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(units.tokenizer_file(packing.WORD_BPE))
    return [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_blocks_keep_units():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab  ▁\n") for _ in range(rng.randrange(60)))
        assert [u for b in units.blocks(text, 5) for u in units.units(b)] == units.units(text)
    assert " ".join(units.units("a b  c d▁ e")) == "a b  c d▁ e" and units.units("a b  c d▁ e") == ["a", "b  c", "d▁ e"]


@pytest.mark.parametrize("name", ["odd", "given"])
def test_packing(spark, request, name):
    docs = request.getfixturevalue(name)
    if docs is None:
        pytest.skip("no test tables")
    stream = packing.token_stream(docs, Scratch(spark, "test"))
    got = [r.asDict() for r in packing.pieces(stream).collect()]
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    want = {k: Counter(tuple(x) for x in whole_ids(v)) for k, v in texts.items()}
    laid = sorted(((g["sequence_id"] * 4096 + g["offset"], g) for g in got), key=lambda x: x[0])
    at, stream_rows = 0, sorted((Row(doc_id=r.doc_id, at=r["at"], ids=np.frombuffer(r.ids, "<u4").tolist()) for r in stream.collect()), key=lambda r: r["at"])
    flat = [i for r in stream_rows for i in r.ids]
    assert {k: Counter(tuple(r.ids) for r in stream_rows if r.doc_id == k) for k in want} == want
    for place, g in laid:
        assert place == at and g["offset"] + g["length"] <= 4096 and g["length"] > 0
        assert zlib.crc32(np.array(flat[at : at + g["length"]], "<u4").tobytes()) == g["ids_crc32"]
        at += g["length"]
    assert at == len(flat)
    for r in stream_rows:
        mine = [g for p, g in laid if r["at"] <= p < r["at"] + len(r.ids)]
        assert [g["start"] for g in mine] == list(np.cumsum([0] + [g["length"] for g in mine])[:-1]) and {(g["doc_tokens"], g["doc_id"]) for g in mine} == {(len(r.ids), r.doc_id)}
    for length in (16, 4096):
        made = {r.sequence_id: r for r in packing.sequences(stream, length, pad_id=9).collect()}
        assert len(made) == -(-len(flat) // length)
        for k, r in made.items():
            part = flat[k * length : (k + 1) * length]
            n = len(part)
            assert r.tokens == n and r.ids == part + ([] if n & (n - 1) == 0 else [9] * (length - n))


def test_packing_of_an_empty_table(spark, odd):
    stream = packing.token_stream(odd.limit(0), Scratch(spark, "test"))
    assert packing.pieces(stream).count() == 0 and packing.sequences(stream).count() == 0


def brute_alignment(rows):
    """Every text encoded whole; groups by the set of common ends, links by all occurrence pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(units.tokenizer_file(alignment.BYTE_BPE))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=units.tokenizer_file(alignment.PIECE_BPE))
    back = alignment.byte_level_alphabet()
    a_bytes = lambda i: bytes(back[c] for c in a_side.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    found, held = [], Counter()
    for doc_id, text in rows:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            found.append((doc_id, [], [], []))
            continue
        a_end, b_end = np.cumsum([len(a_bytes(i)) for i in a]), np.cumsum([len(b_bytes(i)) for i in b])
        common = sorted(set(a_end.tolist()) & set(b_end.tolist()))
        groups = [([], []) for _ in common]
        for side, ids, ends in ((0, a, a_end), (1, b, b_end)):
            for i, g in zip(ids, np.searchsorted(common, ends), strict=True):
                groups[g][side].append(i)
        pairs = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(pairs))
        found.append((doc_id, a, groups, pairs))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, a, groups, pairs in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((str(doc_id), len(a), sum(len(y) for _, y in groups), len(groups), len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out)


@pytest.mark.parametrize("name, bound", [("odd", 2_000_000), ("odd", 3), ("given", 2_000_000), ("given", 100)])
def test_alignment(request, name, bound):
    docs = request.getfixturevalue(name)
    if docs is None:
        pytest.skip("no test tables")
    got = alignment.align(docs, frequent_pairs=bound).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_white_space_at_the_edges_of_texts(spark):
    """No text here has a U+2581, so units are encoded together; those with white edges must not run into their neighbours."""
    texts = [" ", "trail ", "  lead", "a", "trail\t", "\t\tlead", "x  ", "  \n", " \x1c", "b \u3000", "\u2003 c", "\x85d\x1e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted((str(r.doc_id), *r[1:]) for r in alignment.align(docs).collect()) == brute_alignment([*enumerate(texts)])


def test_alignment_of_an_empty_table(odd):
    assert alignment.align(odd.limit(0)).count() == 0


def test_no_piece_has_a_mark_behind_another_character():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=units.tokenizer_file(alignment.PIECE_BPE))
    assert not [p for p in map(model.id_to_piece, range(model.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_groups_and_links_equal_two_pointers():
    rng = random.Random(6)
    for _ in range(300):
        total = rng.randrange(1, 40)
        cut = lambda: sorted({total, *(rng.randrange(1, total + 1) for _ in range(rng.randrange(12)))})  # noqa: B023, E731
        a, b = cut(), cut()
        assert alignment.common_ends(np.array(a), np.array(b)).tolist() == sorted(set(a) & set(b))
    ids = np.array([1, 1, 2, 3], np.int64)
    for most in (0, 4096):
        alignment.PAIRS_OF_GROUP, before = most, alignment.PAIRS_OF_GROUP
        group, keys, times = alignment.group_links(ids, np.array([0, 3, 4]), np.array([5, 6, 5], np.int64), np.array([0, 2, 3]))
        alignment.PAIRS_OF_GROUP = before
        found = Counter()
        for g, k, t in zip(group.tolist(), keys.tolist(), times.tolist(), strict=True):
            found[g, k >> 32, k & 0xFFFFFFFF] += t
        assert found == {(0, 1, 5): 2, (0, 1, 6): 2, (0, 2, 5): 1, (0, 2, 6): 1, (1, 3, 5): 1}


def test_merging_states_loses_nothing():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) * 50) + 1_000_000
    cut = [x[:1], x[1:3], x[3:200], x[200:]]
    state = whitening.merge_all([whitening.of_rows(c, [int(t) for t in c.sum(0)]) for c in cut])
    v = np.cov(x.T, bias=True)
    assert state.n == 500 and state.total == [int(t) for t in x.sum(0)]
    assert np.allclose(state.vt.T @ (state.values[:, None] * state.vt), v, rtol=1e-9)
    assert np.allclose(state.values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)


def check_whitening(rows, got, dims):
    """``rows``: (vec_id, usable vector)."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    fitted = np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(0)
    v = np.cov(fitted.T.astype(float) - 1_000_000, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, min(16, dims) + 1))
    for k, mine in by.items():
        assert len(mine) == len(rows) and {r.n for r in mine} == {n}
        assert abs(mine[0].explained / (values[k - 1] / values.sum()) - 1) < 1e-9 and mine[0].identity_error < 1e-8
        want = sorted((str(i), int(((n * a - s).astype(object) ** 2).sum()), ((a - s / n) @ vectors[:, k - 1]) / np.sqrt(values[k - 1])) for (i, _), a in zip(rows, x, strict=True))
        have = sorted((str(r.vec_id), r.deviation, r.whitened) for r in mine)
        signs = [np.sign(a[2] * b[2]) for a, b in zip(sorted(want, key=lambda t: t[:2]), sorted(have, key=lambda t: t[:2]), strict=True)]
        sign = 1 if sum(signs) > 0 else -1
        for a, b in zip(sorted(want), sorted((i, d, sign * w) for i, d, w in have), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(7)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(rows, whitening.whiten(table).collect(), 64)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i if i % 7 else None, [float(np.float32(t)) for t in rng.normal(size=4)]) for i in range(300)]
    good += good[:40] + [good[3]] * 50
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    table = spark.createDataFrame([(i, v, 1, None, 5.0) for i, v in good + bad], "vec_id long, embedding array<float>, n long, component string, x double").repartition(5)
    check_whitening(good, whitening.whiten(table).collect(), 4)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id >= 900")).count() == 0


def test_whitening_without_variance_in_some_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 50 and abs(got[0].explained - 1) < 1e-9
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).count() == 0


def test_many_states_merge_in_levels(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(t) for t in rng.normal(size=3)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = whitening.quantised(table).select("x").repartition(40)
    state = whitening.fit(x, Scratch(spark, "test"))
    want = np.array([r.x for r in x.collect()])
    assert state.n == 400 and state.total == want.sum(0).tolist() and np.allclose(state.values, np.linalg.eigvalsh(np.cov(want.T, bias=True))[::-1])
