"""Plans of in-place edits, undo logs and readings by confidence, against plain loops."""

import random

from pyspark.sql import functions as F

from tidelane.operators import edits, media, rules


def test_index_slots_and_plans(spark):
    def free(kind, referenced):
        return kind in ("free", "skip", "wide") or (kind == "mdat" and not referenced)

    rng, rows, want = random.Random(1), [], {}
    for f in range(120):
        kinds = ["ftyp"] + rng.sample(["free", "mdat", "mdat", "skip", "uuid", "free", "moov"], 7)
        at, boxes = 0, []
        for kind in kinds:
            size = rng.choice([8, 16, 40, 100])
            boxes.append((f, kind, at, size, kind == "mdat" and rng.random() < 0.5))
            at += size
        rows += boxes
        m = kinds.index("moov")
        a = b = m
        while a > 0 and free(boxes[a - 1][1], boxes[a - 1][4]):
            a -= 1
        while b + 1 < len(boxes) and free(boxes[b + 1][1], boxes[b + 1][4]):
            b += 1
        new = rng.randrange(8, 200)
        start, end = boxes[a][2], boxes[b][2] + boxes[b][3]
        left = end - start - new
        plan = "tail" if b == len(boxes) - 1 else "slot" if left == 0 or left >= 8 else "rewrite"
        want[f] = (start, end, plan, left if plan == "slot" else 0, new)
    slots = edits.index_slots(spark.createDataFrame(rows, "f int, kind string, offset long, size long, referenced boolean"), ["f"])
    sizes = spark.createDataFrame([(f, w[4], 0) for f, w in want.items()], "f int, moov long, extra long")
    got = edits.index_edit(slots.join(sizes, "f"), "moov", "extra").collect()
    assert {r.f: (r.slot_start, r.slot_end, r.plan, r.filler, r.moov) for r in got} == want


def test_element_places(spark):
    rows = [
        ("a", 0, 20, "info", 4, 15), ("a", 20, 10, "void", 0, None), ("a", 30, 50, "tracks", 4, 45), ("a", 80, 30, "tags", 4, 24), ("a", 110, 5, "void", 0, None), ("a", 115, 4, "void", 0, None), ("a", 119, 9, "cues", 4, None),
        ("b", 0, 40, "tags", 4, 34), ("b", 40, 132, "info", 4, 126),
    ]
    df = spark.createDataFrame(rows, "f string, position long, size long, kind string, id_bytes int, payload long")
    got = {(r.f, r.kind): (r.room, r.place, r.filler) for r in edits.element_places(df, ["f"]).collect()}
    assert got == {("a", "info"): (30, "void", 10), ("a", "tracks"): (50, "exact", 0), ("a", "tags"): (39, "void", 10), ("b", "tags"): (40, "wide", 0), ("b", "info"): (132, "wide", 0)}
    lengths = spark.createDataFrame([(n,) for n in (0, 126, 127, 16382, 16383, (1 << 49) - 2, (1 << 49) - 1)], "n long").select(edits.size_length(F.col("n")))
    assert [r[0] for r in lengths.collect()] == [1, 1, 2, 2, 3, 7, 8]


def test_undo_logs_equal_two_stacks(spark):
    rng, rows, want = random.Random(3), [], {}
    for doc in range(40):
        done, undone, values, txn, seq = [], [], {}, 0, 0
        for _ in range(rng.randrange(1, 25)):
            op = rng.choice(["edit", "edit", "undo", "redo"])
            if op == "edit":
                txn += 1
                changes = []
                for _ in range(rng.randrange(1, 4)):
                    key = rng.choice("xyz")
                    new = str(rng.randrange(3))
                    rows.append((doc, seq, "edit", txn, key, values.get(key), new))
                    seq += 1
                    if values.get(key) != new:
                        changes.append((key, values.get(key), new))
                        values[key] = new
                if changes:
                    done.append(changes)
                    undone = []
            elif op == "undo" and done:
                changes = done.pop()
                undone.append(changes)
                for key, old, _ in reversed(changes):
                    values[key] = old
                rows.append((doc, seq, "undo", None, None, None, None))
                seq += 1
            elif op == "redo" and undone:
                changes = undone.pop()
                done.append(changes)
                for key, _, new in changes:
                    values[key] = new
                rows.append((doc, seq, "redo", None, None, None, None))
                seq += 1
        for key, v in values.items():
            if v is not None:
                want[doc, key] = v
    log = spark.createDataFrame(rows, "doc int, seq long, op string, txn long, key string, old string, new string")
    got = {(r.doc, r.key): r.value for r in edits.current_values(log, ["doc"], ["key"]).collect()}
    assert got == want


def test_best_readings(spark):
    rows = [(1, 0, "a", 0.5), (1, 1, "b", 0.9), (1, 2, "c", 0.9), (2, 0, " ", 0.99), (2, 1, "x", 0.1), (3, 0, None, None), (3, 1, "", 0.2)]
    got = edits.best_readings(spark.createDataFrame(rows, "picture int, engine int, text string, sure double"), ["picture"], "sure", "engine").collect()
    assert {r.picture: r.engine for r in got} == {1: 1, 2: 1, 3: 1}


def test_pairs_of_audio_tracks(spark):
    rows = [("f", 1, "aac_plus_ac3", True, False, 0), ("f", 2, None, True, True, 3), ("f", 3, "aac_plus_passthrough", False, False, 7), ("g", 1, "convert", True, False, 0)]
    got = rules.audio_pairs(spark.createDataFrame(rows, "file string, pos long, action string, enabled boolean, is_default boolean, alt_group int"), ["file"], "pos")
    assert [tuple(r[c] for c in ("file", "new_pos", "pos", "action", "enabled", "is_default", "alt_group", "fallback")) for r in got.orderBy("file", "new_pos").collect()] == [
        ("f", 1, 1, "aac", True, True, 1, None), ("f", 2, 1, "ac3", False, False, 1, 1), ("f", 3, 2, None, True, True, 3, None),
        ("f", 4, 3, "aac", False, False, 7, None), ("f", 5, 3, "passthrough", False, False, 7, 4), ("g", 1, 1, "convert", True, False, 0, None),
    ]


def test_rules_of_levels_and_contexts(spark):
    tags = spark.createDataFrame([("f", "Title", 1, 50, "tv"), ("f", "TITLE", 2, 70, "tv"), ("f", "title", 3, 50, "movie"), ("f", "part", 4, 30, "tv")], "file string, name string, pos int, level int, context string")
    given = spark.createDataFrame([("title", "show", 1, 70, "tv"), ("title", "episode", 2, 50, "tv"), ("title", "film", 3, None, "movie"), ("part", "episode", 4, None, None), ("title", "other", 5, None, None)], "rule string, target string, ord int, level int, context string")
    got = media.consume_by_rules(tags, given, ["file"], "rule", "name", within=["level", "context"])
    assert sorted((r.target, r.pos, r.level) for r in got.collect()) == [("episode", 1, 50), ("film", 3, 50), ("show", 2, 70)]
