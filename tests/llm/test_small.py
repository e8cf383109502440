"""Every operator on small tables: nulls, blanks, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelane.llm import chain_dedup, components, decontamination, jaccard_join, mixing, prefix, quality_lm, quality_rules, seeding, sharding, storage, suffix_dedup, toxicity, warc
from tidelane.llm.storage import Scratch

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, blanks, a long text, copies and a repeated row."""
    base = " ".join(words(90, 1))
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "de", "b", 0), (5, " \n ", "de", "b", 3), (None, "a null id has words", "en", "c", 5), (7, "x", "en", "c", 1), (8, " ".join(words(6000, 2)), "en", "a", 9), (9, base.replace("w1 ", "changed ", 1), "en", "b", 2)]
    return spark.createDataFrame(rows, DOCS).cache()


def test_mixing(spark, odd):
    got = mixing.mix(odd, carry=["lang"]).collect()
    assert len(got) == odd.count()
    sizes = defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"] and r.target <= 3 * r.source_size
        sizes[r.source] += r["size"]
    assert {r.source: r.source_size for r in got} == dict(sizes)
    again = mixing.mix(odd.withColumnRenamed("n_chars", "size"))
    assert sorted((str(r.doc_id), r.taken) for r in again.collect()) == sorted((str(r.doc_id), r.taken) for r in got)
    assert mixing.repeat_rows(odd).columns == odd.columns and mixing.repeat_rows(odd).count() == sum(r.copies for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_comes_near_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "en", f"s{min(3, int(rng.expovariate(1)))}", 0) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 20 for r in got)
    assert abs(sum(r.target for r in got) - sum(r["size"] for r in got)) < 1e-6


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "equal rows without text"])
def test_mixing_comes_near_targets_without_ids_of_their_own(spark, kind):
    """300 of a source's 400 rows share an id or have none; targets are met to half a document."""
    text = lambda i: None if kind == "equal rows without text" else " ".join(["w"] * 10 + ([] if kind == "equal rows" else [f"x{i}"]))
    rows = [(i if i >= 300 else None if kind == "null ids" else 7, text(i), "en", "a", 0) for i in range(400)] + [(1000 + i, " ".join(words(12, i)), "en", "b", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mix(docs).collect()
    assert len(got) == 900
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 6.5
    assert mixing.repeat_rows(docs).count() == sum(r.copies for r in got)


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, " ".join(words(90, 1)[10:40])), (2, "a null id"), (3, None), (None, "x")], "item_id long, text string")
    items = {1: words(90, 1)[10:40], 2: ["a", "null", "id"], None: ["x"]}
    normal = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for r in odd.collect():
        w, hit, found = normal.findall((r.text or "").lower()), set(), set()
        for item, x in items.items():
            k = min(13, len(x))
            for win in {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}:
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) == win:
                        hit |= set(range(i, i + k))
                        found |= {str(item)} if item is not None else set()
        want.append((str(r.doc_id), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for bound in (10**6, 2000):
        got = decontamination.contamination_report(odd, bench, broadcast_bytes=bound).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert decontamination.decontaminate(odd, bench).count() == sum(not x[-1] for x in want)
    assert decontamination.decontaminate(odd, bench, remove="spans").columns == odd.columns
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_removes_hit_words_only(spark):
    item = "alpha beta gamma delta internationalisation epsilon"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "Foo ALPHA beta, gamma delta internationalisation epsilon! bar"), (2, "ALPHA beta GAMMA delta, INTERNATIONALISATION Epsilon"), (3, "(Alpha beta)"), (None, "x " + item.upper()), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert {k: (v or "").split() for k, v in got.items()} == {1: ["Foo", ",", "!", "bar"], 2: [","], 3: ["(Alpha", "beta)"], None: ["x"], 5: []}


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = SPACE_WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("short", [32, 2])
def test_jaccard_join(spark, odd, short, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    rng = random.Random(5)
    base, passage, rows = words(60, 6, 3000), words(50, 7, 3000), []
    for i in range(60):
        rows.append((i, " ".join(x if rng.random() > 0.02 else f"n{rng.randrange(10**6)}" for x in base)))
        rows.append((1000 + i, " ".join(words(15, 100 + i, 10**6) + passage)))
    rows += [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None and r.doc_id > 2]
    rows.append(rows[0])
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_jaccard_keeps_one_and_empty(spark, odd):
    kept = jaccard_join.keep_one_of_each(odd.where("doc_id is not null"))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7, 8]
    assert jaccard_join.similar_groups(odd.limit(0)).count() == 0


def test_jaccard_keeps_texts_without_an_id_of_their_own(spark):
    text = lambda seed: " ".join(words(60, seed, 10**6))
    near = text(403).rsplit(" ", 1)[0]
    rows = [(None, text(400)), (None, text(401)), (None, text(401)), (None, text(403)), (None, near), (1, text(404)), (1, text(405)), (1, text(405)), (2, text(406)), (None, text(406)), (3, text(405)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in jaccard_join.keep_one_of_each(docs).collect()]
    linked = [r for r in kept if r[1] in (text(403), near)]
    assert len(linked) == 1 and linked[0][0] is None
    want = [(None, text(400)), (None, text(401)), (1, text(404)), (1, text(405)), (2, text(406)), (None, None)]
    assert sorted(map(str, kept)) == sorted(map(str, want + linked))


def test_quality_rules(spark, odd):
    line = " ".join(words(12, 9))
    rows = [(1, line + "\n" + line + "\n" + " ".join(words(260, 10, 10**6))), (2, "#*$ a | b")]
    got = {r.doc_id: r for r in quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_dup_lines, got[1].n_repeat_words, got[1].longest_repeat, got[1].covered_words, got[1].kept) == (1, 24, 12, 24, True)
    assert (got[2].n_symbols, got[2].word_chars, got[2].base_failed) == (4, 6, True)
    strict = quality_rules.RepetitionLimits(max_longest=11)
    assert not quality_rules.apply_quality_rules(spark.createDataFrame(rows[:1], "doc_id long, text string"), strict).first().kept
    clash = quality_rules.apply_quality_rules(odd.withColumn("kept", F.lit("x")))
    assert clash.count() == odd.count() and dict(clash.dtypes)["kept"] == "boolean"
    assert quality_rules.apply_quality_rules(odd.limit(0)).count() == 0


def brute_rules(text):
    """All result columns of the quality rules, by comparing every two positions."""
    w = SPACE_WORD.findall(text or "")
    n, lines, seen, dup = len(w), (text or "").split("\n"), set(), 0
    for x in lines:
        if SPACE_WORD.search(x):
            dup += x in seen
            seen.add(x)
    where = defaultdict(list)
    for i in range(n - 4):
        where[tuple(w[i : i + 5])].append(i)
    repeated, longest, spans = set(), 0, set()
    for places in where.values():
        for i in places if len(places) > 1 else ():
            repeated |= set(range(i, i + 5))
            best = 0
            for j in places:
                k = 0
                while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
            longest = max(longest, best)
            if best >= 10:
                spans |= set(range(i, i + best))
    failed = n < 10 or 100 * len(repeated) > 20 * n
    kept = not failed and len(spans) <= 0.1 * n and longest <= 50
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated), failed, kept, len(spans), longest


def test_quality_rules_against_brute_force(spark, odd):
    rng = random.Random(41)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(150):
        w = words(rng.randrange(10, 700), 9000 + i, rng.choice((3, 40, 10**6, 10**6)))
        for _ in range(rng.randrange(4)):
            a, k, b = rng.randrange(len(w)), rng.choice((4, 5, 9, 10, 11, 40, 60)), rng.randrange(len(w))
            w[b:b] = w[a : a + k]
        glue = [" ", " ", " ", "\n", "\t", " & ", "  "]
        rows.append((100 + i, "".join(x + rng.choice(glue) for x in w)))
    rows += [(900, "é#\nx\nx\n\n\nx y"), (901, "\n".join(["same line here"] * 5))]
    got = quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_text=False).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((k, *brute_rules(t))) for k, t in rows)
    assert any(r.base_failed for r in got) and any(not r.base_failed and not r.kept and r.longest_repeat <= 50 for r in got) and any(r.kept for r in got)


def brute_kneser_ney(texts, order=5):
    """log P(byte | up to four bytes before) by plain dictionaries, and the discounts of each order."""
    counts = {order: defaultdict(int)}
    for t in texts:
        for i in range(len(t) - order + 1):
            counts[order][t[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = defaultdict(int)
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    cuts, totals = {}, {k: defaultdict(int) for k in counts}
    masses = {k: defaultdict(float) for k in counts}
    for k, table in counts.items():
        n = [sum(c == j for c in table.values()) for j in range(5)]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.9]
            d = [min(max(v, 0.05), i + 1) for i, v in enumerate(d)]
        else:
            d = [0.5, 0.75, 0.9]
        cuts[k] = lambda c, d=d: d[min(c, 3) - 1]
        for g, c in table.items():
            totals[k][g[:-1]] += c
            masses[k][g[:-1]] += cuts[k](c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        total = totals[k][g[:-1]]
        lower = p(g[1:])
        if not total:
            return lower
        c = counts[k].get(g, 0)
        return max(c - cuts[k](c), 0) / total + masses[k][g[:-1]] / total * lower if c else masses[k][g[:-1]] / total * lower

    return p


def test_kneser_ney_against_brute_force(spark, tmp_path):
    rng = random.Random(17)
    vocabulary = ["abba", "bab", "cab", "naïve", "日本", "dad", "a"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "abb"), (53, "XYZ " * 400), (None, "cab dad cab"), (3, docs[3][1])]
    table = spark.createDataFrame([(k, t, "en") for k, t in docs], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(25)], "doc_id long")
    train = {r.doc_id for r in trusted.where(~quality_lm.for_thresholds(F.col("doc_id"))).collect()}
    p = brute_kneser_ney([t.encode() for k, t in docs if k in train])
    assert all(abs(sum(p(c + bytes([x])) for x in range(256)) - 1) < 1e-9 for c in (b"", b"a", b"ab", b"abba", b"zzzz"))
    want = []
    for k, t in docs:
        b = (t or "").encode()
        logs = [np.log(p(b[i : i + 5])) for i in range(len(b) - 4)]
        want.append((str(k), len(logs), round(float(np.exp(-np.mean(logs))), 3) if logs else None))
    for parts in (1, 5):  # in memory, and as files in several chunks
        table.repartition(parts).write.parquet(f"{tmp_path}/{parts}")
        for source in (table, spark.read.parquet(f"{tmp_path}/{parts}")):
            got = quality_lm.classify(source.withColumn("chunk", F.lit(1)), trusted).collect()
            assert sorted(map(str, ((str(r.doc_id), r.n_grams, None if r.perplexity is None else round(r.perplexity, 3)) for r in got))) == sorted(map(str, want))


def test_quality_lm_keeps_clean_text(spark, odd):
    clean = [(i, " ".join(words(80, i)), "en") for i in range(150)]
    junk = [(1000 + i, " ".join(f"%%{x}!!$" for x in words(60, i)).upper(), "en") for i in range(5)]
    docs = spark.createDataFrame([*clean, *junk, (2000, None, None), (2001, "ab", "en")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    kept = {r.doc_id: r.kept for r in quality_lm.classify(docs, trusted).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in (1000, 1001, 1002, 1003, 1004, 2000, 2001))
    assert quality_lm.classify(docs.limit(0), trusted).count() == 0
    assert quality_lm.classify(odd, trusted.limit(0)).count() == odd.count()


def test_edit_distance_and_chains():
    rng = random.Random(8)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(100):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(20))], np.uint32) for _ in "ab")
        assert chain_dedup.edit_distance(a, b) == plain(a.tolist(), b.tolist())


def test_chains_reach_back_within_the_gap_only():
    rng, s = random.Random(9), chain_dedup.ChainSettings()

    def plain(x, y):
        score, root, count, best = [], [], [], {}
        for i in range(len(x)):
            near = [(score[j] - (x[i] - x[j] + y[i] - y[j]), -j) for j in range(i) if 0 < x[i] - x[j] <= s.max_gap and 0 < y[i] - y[j] <= s.max_gap]
            top, j = max(near, default=(0, 0))
            score.append(round(1 / s.gap_cost) + max(top, 0))
            root.append(root[-j] if top > 0 else i)
            count.append(count[-j] + 1 if top > 0 else 1)
            if root[i] not in best or score[i] > score[best[root[i]]]:
                best[root[i]] = i
        return sorted((r, e, count[e]) for r, e in best.items())

    for _ in range(50):
        points = sorted({(rng.randrange(400), -rng.randrange(400)) for _ in range(60)})
        x, y = (np.array(v) for v in zip(*points))
        assert sorted(chain_dedup.chain_pair(x, -y, s)) == plain(x.tolist(), (-y).tolist())
    # a second block 100 words after a first one of 13 seeds is one chain of its own
    x = np.array([*range(0, 52, 4), *range(150, 202, 4)])
    assert sorted(chain_dedup.chain_pair(x, x + 7, s)) == [(0, 12, 13), (13, 25, 13)]


def test_extension_over_edits(spark):
    def plain(a, b):
        best, row = 0, [-j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [-i]
            for j, y in enumerate(b, 1):
                new.append(max(row[j] - 1, new[-1] - 1, row[j - 1] + (1 if x == y else -1)))
            row, best = new, max(best, *new)
        return best

    rng = random.Random(10)
    for _ in range(100):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(20))], np.uint32) for _ in "ab")
        i, j = chain_dedup.extension(a, b)
        assert plain(a.tolist(), b.tolist()) == plain(a[:i].tolist(), b[:j].tolist())
    passage = words(60, 21, 5000)
    edited = [*passage[:7], "one", *passage[8:52], "two", *passage[53:]]
    rows = [(1, " ".join(words(40, 22, 10**6) + passage + words(40, 23, 10**6))), (2, " ".join(words(40, 24, 10**6) + edited + words(40, 25, 10**6)))]
    r = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert (r.start_word, r.end_word, r.other_start, r.other_end) == (40, 100, 40, 100)


def test_fuzzy_passages(spark, odd):
    passage, rows = words(90, 20, 5000), []
    for i in range(20):
        p = list(passage)
        p[10 + i] = "other"
        rows.append((i, " ".join(words(40, 30 + i, 10**6) + (p if i % 2 else []) + words(40, 60 + i, 10**6))))
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in found for x in (r.doc_id, r.other_doc_id)} == set(range(1, 20, 2))
    assert all(80 <= r.end_word - r.start_word <= 100 and r.identity > 0.9 for r in found)
    pairs = {(r.doc_id, r.other_doc_id) for r in chain_dedup.fuzzy_passages(odd).collect()}
    assert {x for p in pairs for x in p} == {1, 2, 9}
    assert chain_dedup.fuzzy_passages(odd.limit(0)).count() == 0


def test_passages_of_other_partners(spark):
    """B and C share 60 words; smaller documents hold parts of them that are too short for passages."""
    p, rows = words(60, 26, 10**6), []
    fill = lambda i: words(30, 300 + i, 10**6)
    for i, part in enumerate([p[:40], p[20:], p[:45], p[15:], p, p, p[:30] + fill(50)[:1] + p[31:]]):
        rows.append((i, " ".join(fill(2 * i) + part + fill(2 * i + 1))))
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.other_doc_id < r.doc_id and r.other_doc_id in (4, 5) for r in found)
    covered = {d: {x for r in found if r.doc_id == d for x in range(r.start_word, r.end_word)} for d in (5, 6)}
    assert all(set(range(30, 90)) <= covered[d] for d in covered)


def test_passages_beside_fragments_in_smaller_documents(spark):
    """Two documents share 90 words exactly; fragments of 20, 25 or 40 words stand in smaller documents."""
    rows, k = [], 0
    for case, size in enumerate((20, 25, 40)):
        p = words(90, 700 + case, 10**6)
        for at in range(0, 90 - size + 1, size // 2):
            rows.append((k, " ".join(words(40, 2000 + k, 10**6) + p[at : at + size] + words(40, 3000 + k, 10**6))))
            k += 1
        rows += [(1000 + 10 * case + j, " ".join(words(30, 4000 + 10 * case + j, 10**6) + p + words(30, 5000 + 10 * case + j, 10**6))) for j in (0, 1)]
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.other_doc_id) for r in found} == {(1001 + 10 * c, 30, 120, 1000 + 10 * c) for c in range(3)}


def test_recall_on_edited_families_beside_fragments(spark):
    """Families of four copies of a passage, 4 % of words changed in each; half of them beside fragments in documents all around."""
    rng, rows, truth = random.Random(31), [], set()
    ids = list(range(2000))
    rng.shuffle(ids)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    for family in range(60):
        p = words(rng.randrange(60, 120), 6000 + family, 10**6)
        for _ in range(4):
            i = ids.pop()
            truth.add(i)
            rows.append((i, " ".join(fill(30) + [w if rng.random() > 0.04 else f"e{rng.randrange(10**6)}" for w in p] + fill(30))))
        for _ in range(4 * (family % 2)):
            size = rng.choice((20, 25, 40))
            at = rng.randrange(len(p) - size)
            rows.append((ids.pop(), " ".join(fill(30) + p[at : at + size] + fill(30))))
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    seen = {x for r in found for x in (r.doc_id, r.other_doc_id)}
    print("recall", len(truth & seen) / len(truth))
    assert len(truth & seen) >= 0.9 * len(truth) and seen <= truth


def test_edited_pair_whose_seeds_have_other_holders_below_and_beside(spark):
    """Two edited copies of 90 words; fragments of 30 words stand in documents below both and between them."""
    p, edited = words(90, 740, 10**6), words(90, 740, 10**6)
    edited[22], edited[45], edited[68] = "one", "two", "three"
    fill = lambda k: words(30, 9000 + k, 10**6)
    rows = [(1000, " ".join(fill(1) + p + fill(2))), (2000, " ".join(fill(3) + edited + fill(4)))]
    rows += [(first + at, " ".join(fill(first + at) + edited[at : at + 30] + fill(first + at + 100))) for first in (10, 1500) for at in range(0, 61, 10)]
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.other_doc_id) for r in found} == {(2000, 30, 120, 1000)}


def test_pairs_whose_seeds_stand_in_many_documents(spark):
    """Two edited copies of 90 words, each seed of which stands in 40 documents below and 40 between them, in fragments of 30 words."""
    p, edited = words(90, 740, 10**6), words(90, 740, 10**6)
    edited[22], edited[45], edited[68] = "one", "two", "three"
    fill = lambda k: words(30, 9000 + k, 10**6)
    rows = [(10_000, " ".join(fill(1) + p + fill(2))), (20_000, " ".join(fill(3) + edited + fill(4)))]
    rows += [(first + 40 * at + k, " ".join(fill(first + 40 * at + k) + edited[at : at + 30] + fill(first + 40 * at + k + 50_000))) for first in (100, 15_000) for at in range(0, 61, 10) for k in range(40)]
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert (20_000, 30, 120, 10_000) in {(r.doc_id, r.start_word, r.end_word, r.other_doc_id) for r in found}


def test_frequent_seeds_of_pairs_by_brute_force():
    rng = np.random.default_rng(35)
    doc, key, pos = np.unique(np.stack([rng.integers(0, 9, 500), rng.integers(0, 12, 500), 13 * rng.integers(0, 90, 500)]), axis=1)
    a, b, x, y = rng.integers(0, 5, 40), rng.integers(5, 12, 40), rng.integers(0, 1200, 40), rng.integers(0, 1200, 40)
    want = set()
    for i in range(len(doc)):
        for j in range(len(doc)):
            if key[i] == key[j]:
                near = [(a == doc[i]) & (b == doc[j]) & (abs(v - w) <= 128) for v, w in ((x, pos[i]), (y, pos[j]))]
                want |= {(int(doc[i]), int(doc[j]), int(pos[i]), int(pos[j]))} if near[0].any() and near[1].any() else set()
    got = chain_dedup.frequent_matches(a, b, x, y, doc, key, pos, 128)
    assert len(want) > 50 and set(zip(*(v.tolist() for v in got))) == want


def test_regions_are_labelled_by_their_links():
    rng, nodes = random.Random(36), [(k, d, 7 * d) for k in (3, 5) for d in range(30)]
    links = [(k, a, 7 * a, b, 7 * b) for k in (3, 5) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(18 + 40 * (k == 5)))]
    links += [(5, 0, 0, d, 7 * d) for d in range(30)]
    table = chain_dedup.pa.Table.from_pylist([dict(zip(("key", "doc", "lo", "other", "other_lo"), (*r, None, None)[:5])) for r in nodes + links])
    rows = chain_dedup._labelled(table).to_pylist()
    of = {(r["key"], r["doc"]): r["label"] for r in rows}
    group = {n[:2]: {n[:2]} for n in nodes}
    for k, a, _, b, _ in links:
        both = group[k, a] | group[k, b]
        for n in both:
            group[n] = both
    assert len(rows) == 60 and all((of[m] == of[n]) == (m in group[n]) for m in of for n in of)
    assert {r["key"] for r in rows if r["settled"]} == {5} and {r["regions"] for r in rows} == {30}


def test_all_pairs_of_seeds_by_brute_force():
    rng = random.Random(32)
    key, doc, pos = (np.array([rng.randrange(n) for _ in range(600)], np.int64) for n in (40, 12, 10**6))
    key = np.where(rng.random() + np.arange(600) % 3 > 1.5, key, key % 3)
    more = key == 7
    keys = key.tolist()
    want = sorted((int(doc[i]), int(doc[j]), int(pos[i]), int(pos[j])) for i in range(600) for j in range(600) if keys[i] == keys[j] and doc[i] < doc[j] and keys.count(keys[i]) <= chain_dedup.PAIRED and not more[i])
    assert want and max(map(keys.count, keys)) > chain_dedup.PAIRED
    assert sorted(zip(*(x.tolist() for x in chain_dedup.all_matches(key, doc, pos, more)))) == want


def test_near_repeats_and_matches_of_repeats_by_brute_force():
    rng = random.Random(33)
    for _ in range(20):
        key, doc, pos = (np.array([rng.randrange(n) for _ in range(300)], np.int64) for n in (4, 5, 200))
        kept, cells = [], {}
        for i in sorted(range(300), key=lambda i: pos[i]):
            first, last, cell = cells.get((key[i], doc[i]), (0, -(10**9), 0))
            if pos[i] - last >= 7:  # far from the one before: a run of its own
                first, cell = pos[i], -1
            if (pos[i] - first) // 7 != cell:
                kept.append((key[i], doc[i], pos[i]))
            cells[key[i], doc[i]] = first, pos[i], (pos[i] - first) // 7
        keep = chain_dedup.without_near_repeats(key, doc, pos, 7)
        assert (np.diff(keep) > 0).all() and sorted(zip(key[keep], doc[keep], pos[keep])) == sorted(kept)
        of = {}
        for k, d, p in sorted(zip(key.tolist(), doc.tolist(), pos.tolist())):
            of.setdefault(k, {}).setdefault(d, []).append(p)
        want = []
        for docs in of.values():
            ids = sorted(docs)
            for n, d in enumerate(ids[1:], 1):
                for other in {ids[0], ids[n - 1]}:
                    want += [(other, d, docs[other][min(i, len(docs[other]) - 1)], p) for i, p in enumerate(docs[d])]
        matches, ends = chain_dedup.neighbour_matches(key, doc, pos)
        assert sorted(zip(*(x.tolist() for x in matches))) == sorted(want)
        assert sorted(ends.tolist()) == [i for i in range(300) if doc[i] in (min(of[key[i]]), max(of[key[i]]))]


def test_runs_of_a_repeated_word_pair(spark, monkeypatch):
    """Sixty documents hold one word pair 150 times over: a run is one chain with each of two others, and one whole passage."""
    made, plain = [], chain_dedup.Scratch.keep

    def keep(self, df, name):
        out = plain(self, df, name)
        made.extend([out.count()] if name == "chains" else [])
        return out

    monkeypatch.setattr(chain_dedup.Scratch, "keep", keep)
    rows = [(i, " ".join(words(20, 500 + i, 10**6) + ["left", "right"] * 150 + words(20, 600 + i, 10**6))) for i in range(60)]
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert made[0] <= 5 * 60
    assert {r.doc_id for r in found if r.end_word - r.start_word >= 300 and r.identity == 1} == set(range(1, 60))


def test_rows_without_ids_are_documents_of_their_own(spark):
    p = words(80, 33, 10**6)
    rows = [(None, " ".join(words(20, 8000 + i, 10**6) + p)) for i in range(2)] + [(-1, " ".join(p + words(20, 8010, 10**6))), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in suffix_dedup.repeated_spans(docs).collect()) == ["-1", "None", "None"]
    assert {(r.doc_id, r.other_doc_id) for r in chain_dedup.fuzzy_passages(docs).collect()} >= {(None, -1)}


def test_suffix_dedup_is_exact(spark, odd):
    rng, parts = random.Random(11), [words(n, 40 + n, 600) for n in (50, 51, 60, 130)]
    rows = []
    for i in range(80):
        w = words(rng.randrange(120), 200 + i, 600)
        for _ in range(rng.randrange(3)):
            p, j = rng.choice(parts), rng.randrange(len(w) + 1)
            w = w[:j] + p[rng.randrange(8) :] + w[j:]
        rows.append((i, " ".join(w)))
    where = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 50):
            where[tuple(w[s : s + 51])].add(i)
    want = set()
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 50):
            if len(where[tuple(w[s : s + 51])]) > 1:
                want |= {(i, x) for x in range(s, s + 51)}
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, x) for r in got for x in range(r.start_word, r.end_word)} == want
    spans = suffix_dedup.repeated_spans(odd)
    assert {r.doc_id for r in spans.collect()} == {1, 2, 9}
    clean = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(odd, spans).collect()}
    assert clean[1] == odd.where("doc_id = 1").first().text and not clean[2].strip()
    assert suffix_dedup.repeated_spans(odd.limit(0)).count() == 0


def test_remove_repeats_keeps_one_copy_overall(spark, monkeypatch):
    from tidelane.llm import seeding

    monkeypatch.setattr(seeding, "CHUNK_ENTRIES", 1)
    passage = words(80, 450, 10**6)
    rows = [(i, " ".join(words(20, 460 + i, 10**6) + passage + words(20, 500 + i, 10**6) + (passage if i == 7 else []))) for i in range(24)]
    for n in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        spans = suffix_dedup.repeated_spans(docs)
        assert all(r.other_doc_id == (0 if r.doc_id else 1) for r in spans.collect())
        clean = suffix_dedup.remove_repeats(docs, spans).collect()
        assert [r.doc_id for r in clean if passage[0] in r.text.split()] == [0]


def test_toxicity_learns_and_generalises(spark, odd):
    rng = random.Random(13)
    texts, labels = [], []
    for i in range(400):
        w = words(40, 500 + i, 300)
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["scoundrel", "scoundrels", "blockhead"])
        texts.append(" ".join(w))
        labels.append(int(bad))
    model = toxicity.train(pa.array(texts[:320]), np.array(labels[:320]))
    kernel = toxicity.TextKernel("symbol", lower=True)
    score = lambda xs: np.concatenate([toxicity.score_texts(kernel, model, b, o) for _, _, b, o in toxicity.text_slices(pa.array(xs))])
    assert ((score(texts[320:]) >= 0.5) == (np.array(labels[320:]) == 1)).mean() > 0.95
    assert score([" ".join(words(30, 1, 300)) + " sscoundrel " + " ".join(words(30, 2, 300))])[0] >= 0.5
    assert score([None, "", "..."]).max() < 0.5
    known = spark.createDataFrame([(1, 1), (2, 0), (8, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.add_toxicity(odd, toxicity.fit_toxicity(odd, known)).count() == odd.count()
    assert toxicity.drop_toxic(odd, known.limit(0)).columns == odd.columns and toxicity.drop_toxic(odd, known.limit(0)).count() == odd.count()


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/ c", long), (3, None, long), (4, "http://d/", "short"), (5, "http://e/", "short"), (6, "http://f/", None), (7, "http://g/", "a\r\n\r\nWARC/1.1\r\nb")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/w")
    rows = {r.page_id: r for r in warc.resolve_revisits(warc.read_archive(spark, f"file://{tmp_path}/w")).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in rows.items()} == {1: ("revisit", 3, 1200), 2: ("revisit", 3, 1200), 3: ("response", None, 1200), 4: ("response", None, 5), 5: ("response", None, 5), 6: ("response", None, 0), 7: ("response", None, 16)}
    assert all(r.payload_digest == hashlib.sha1((p.html or "").encode()).hexdigest() for p in pages.collect() for r in [rows[p.page_id]])
    assert warc.read_archive(spark, f"file://{tmp_path}/w").where("digest_ok = false").count() == 0
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/empty")


def test_sharding(spark, odd):
    got = sharding.external_shuffle(odd.withColumn("slot", F.lit("x")), F.lit(32), text_crc=sharding.text_crc32(F.col("text")), bucket_rows=3).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    many = sharding.external_shuffle(spark.range(1000).withColumnRenamed("id", "doc_id"), F.lit(32), bucket_rows=100)
    counts = [r["count"] for r in many.groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1
    assert sorted(sharding.fisher_yates(50, 1)) == list(range(50))
    assert sharding.external_shuffle(odd.limit(0), F.lit(32)).count() == 0


@pytest.mark.parametrize("most", [10**6, 2])
def test_warc_writes_groups_of_files(spark, tmp_path, most):
    """Revisits over the bound of one scan: the files are written in groups, or joined by shuffle where there are none."""
    rows = [(i if i % 9 else None, f"http://h/{i}", f"{i % 7}" * 1200 if i % 2 else str(i), 1) for i in range(60)]
    rows += rows[:3]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").withColumn("file", F.lit("x"))
    pages.repartition(5).write.parquet(f"{tmp_path}/p")
    best = {}
    for k, _, t, _ in rows:
        best[t] = max(best.get(t, -1), -1 if k is None else k)
    want = sorted((str(k), "revisit" if len(t) >= 1000 and (-1 if k is None else k) < best[t] else "response") for k, _, t, _ in rows)
    for name, table in (("files", spark.read.parquet(f"file://{tmp_path}/p")), ("rows", pages)):
        warc.write_archive(table, f"file://{tmp_path}/{name}", scan_revisits=most)
        got = warc.resolve_revisits(warc.read_archive(spark, f"file://{tmp_path}/{name}")).collect()
        assert sorted((str(r.page_id), r.record_type) for r in got) == want
        assert all(r.refers_to is not None and r.payload_bytes == 1200 for r in got if r.record_type == "revisit")


def test_broken_archives_raise():
    record = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.parse_records(record * 2)] == [b"abcd"] * 2
    for bad in (record[:20], record[:-6], record + b"x\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


LONG_TEXT = " ".join(words(180_000, 77, 10**6))


@pytest.fixture(scope="module")
def plain_docs(spark, odd):
    """``odd`` and a text above one slice."""
    assert len(LONG_TEXT) > 1 << 20
    return odd.unionByName(spark.createDataFrame([(50, LONG_TEXT, "en", "a", 1)], DOCS)).cache()


def crowded(docs, *modules):
    """``docs`` with every column name that the modules use inside."""
    import inspect

    names = {n for m in modules for n in re.findall(r"""(?:col|alias|withColumn|withColumns|select|agg|join|groupBy)\(\{?["']([A-Za-z_]\w*)["']""", inspect.getsource(m))}
    names |= {"a", "b", "row", "chunk", "spans", "k_id", "copies", "epochs", "cut", "c_id", "s_id", "__class", "__copy"}
    own = {n.lower(): n for n in sorted(names) if n.lower() not in {c.lower() for c in docs.columns}}
    return docs.withColumns({n: F.lit("own") for n in own.values()})


def outputs(spark):
    bench = spark.createDataFrame([(1, " ".join(words(90, 1)[10:40])), (2, "a null id")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    spans = lambda d: suffix_dedup.repeated_spans(d)
    return {
        "repeat_rows": lambda d: mixing.repeat_rows(d, quality=mixing.label_weights(labels)),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench),
        "decontaminate spans": lambda d: decontamination.decontaminate(d, bench, remove="spans"),
        "keep_one_of_each": lambda d: jaccard_join.keep_one_of_each(d),
        "quality_rules": lambda d: quality_rules.apply_quality_rules(d),
        "classify": lambda d: quality_lm.classify(d, quality_lm.trusted_ids(labels)),
        "fuzzy_passages": lambda d: chain_dedup.fuzzy_passages(d),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, labels),
        "remove_repeats": lambda d: suffix_dedup.remove_repeats(d, spans(d)),
        "external_shuffle": lambda d: sharding.external_shuffle(d, F.lit(32), text_crc=sharding.text_crc32(F.col("text"))),
    }


@pytest.mark.parametrize("name", ["repeat_rows", "decontaminate", "decontaminate spans", "keep_one_of_each", "quality_rules", "classify", "fuzzy_passages", "drop_toxic", "remove_repeats", "external_shuffle"])
def test_clashing_columns_change_nothing(spark, plain_docs, name):
    home = {"repeat_rows": mixing, "keep_one_of_each": jaccard_join, "quality_rules": quality_rules, "classify": quality_lm, "fuzzy_passages": chain_dedup, "drop_toxic": toxicity, "remove_repeats": suffix_dedup, "external_shuffle": sharding}
    plain, full = plain_docs, crowded(plain_docs, home.get(name, decontamination))
    run = outputs(spark)[name]
    want, got = run(plain), run(full)
    same = [c for c in want.columns if not (name == "external_shuffle" and c in ("shard", "slot"))]
    own = [c for c in full.columns if c not in plain.columns and c in got.columns and c not in want.columns]
    rows = got.select(*same, *own).collect()
    assert sorted(str(tuple(r)[: len(same)]) for r in rows) == sorted(str(tuple(r)) for r in want.select(*same).collect())
    assert all(set(tuple(r)[len(same) :]) <= {"own"} for r in rows)
    if name in ("repeat_rows", "decontaminate", "decontaminate spans", "keep_one_of_each", "drop_toxic", "remove_repeats"):
        assert got.columns == full.columns


def test_warc_with_clashing_columns(spark, plain_docs, tmp_path):
    pages = crowded(plain_docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html")), warc)
    warc.write_archive(pages, f"file://{tmp_path}/w")
    got = warc.resolve_revisits(warc.read_archive(spark, f"file://{tmp_path}/w")).collect()
    assert len(got) == plain_docs.count() and max(r.payload_bytes for r in got) == len(LONG_TEXT)


def test_equal_rows_fill_no_bucket(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"))
    tasks = [sharding.external_shuffle(rows.repartition(n), F.lit(32), bucket_rows=500) for n in (2, 5)]
    one, two = (t.collect() for t in tasks)
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 6000
    shards = defaultdict(list)
    for r in one:
        shards[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(250)) for x in shards.values()) and len(shards) == 24
    keyed = sharding.numbered(rows, ["doc_id"], "nth", Scratch(spark, "test"), "rows").collect()
    assert sorted(r.nth for r in keyed if r.doc_id == 7) == list(range(4000))


def test_shards_are_written_in_slot_order(spark, odd, tmp_path):
    dealt = sharding.external_shuffle(odd, F.lit(32), text_crc=sharding.text_crc32(F.col("text")), bucket_rows=3, shards=3)
    back = sharding.write_shards(dealt, f"file://{tmp_path}/s")
    assert sorted(map(str, back.collect())) == sorted(map(str, dealt.collect())) and back.columns == dealt.columns
    files = back.withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list("slot").alias("slots")).collect()
    assert all(list(r.slots) == sorted(r.slots) for r in files)
    none = sharding.write_shards(sharding.external_shuffle(odd.limit(0), F.lit(32)), f"file://{tmp_path}/none")
    assert none.count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Held:
        isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = type("C", (), {"getConf": lambda self: {}, "master": "spark://host:7077"})()
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
