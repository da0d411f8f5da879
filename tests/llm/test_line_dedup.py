from __future__ import annotations

import random

from pyspark.sql import functions as F

from evidloom.llm.line_dedup import LineRuns, drop_repeated_lines, line_key

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=40, min_docs=5):
    keys = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                k = ascii_lower(line.strip(SPACE))
                if len(k) >= min_chars:
                    keys.setdefault(k, set()).add(i)
    drop = {k: max(v) for k, v in keys.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or drop.get(ascii_lower(x.strip(SPACE)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, make_docs, words):
    rng = random.Random(1)
    hot = [" ".join(rng.choices(words, k=12)).capitalize() for _ in range(6)]
    rows = []
    for i in range(160):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        for line in rng.sample(hot, rng.randint(0, 4)) * rng.choice([1, 1, 2]):
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "  ", "\t"]) + rng.choice([line, line.upper()]) + "\r")
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (None, hot[0]), (None, None), (7, hot[1] + "\n" + hot[1]), (160, "\n" * 5),
             (161, hot[2] + "É"), (162, "\n".join([hot[3]] * 3000))]
    rows += rows[:2]
    got = drop_repeated_lines(make_docs(rows), batches=4, fanout=2)
    out = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=repr)
    assert out == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_lines(none).collect() == []
    odd = spark.createDataFrame([(1, "a", "x", 5)], "doc_id long, text string, n_lines string, pos int")
    row = drop_repeated_lines(odd).first()
    assert (row.n_lines, row.pos, row.text) == (1, 5, "a")


def test_runs_are_compacted(spark):
    runs = LineRuns(spark, fanout=2, buckets=3)
    for base in (40, 30, 20, 10):
        batch = spark.createDataFrame([(k, k, 2, base) for k in range(base // 10)], "__h1 long, __h2 long, docs long, keeper long")
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    got = {r["__h1"]: (r.docs, r.keeper) for r in runs.frequent(1).collect()}
    assert got == {0: (8, 40), 1: (6, 40), 2: (4, 40), 3: (2, 40)}
    runs.close()


def test_keys_fold_only_ascii_letters(spark):
    texts = [" ABC éÉ ", "ÉCOLE A", "plain x", "ΑΣ A", "İ A", "\x1fA\x1f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == {t: ascii_lower(t.strip(SPACE)) for t in texts}
