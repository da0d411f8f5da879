from __future__ import annotations

import duckdb
import pytest

from evidloom.llm.chat import format_preferences, preference_turns
from evidloom.llm.queries import OP4_SQL, OP8_SQL, QUERIES

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
B, E = "<|im_start|>", "<|im_end|>\n"


def test_common_prefix_and_masks(spark):
    turns = []
    for side, last in (("chosen", "good é"), ("rejected", "bad")):
        turns += [(1, side, 0, "system", "s"), (1, side, 1, "user", "u"), (1, side, 2, "assistant", last), (1, side, 3, "user", "bye")]
    turns += [(2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, "assistant", "only"),
              (4, "chosen", 0, None, None), (4, "rejected", 0, "user", ""), (None, "chosen", 0, "user", "x"),
              (5, "chosen", 0, "user", "a"), (5, "chosen", 1, "assistant", "b"), (5, "rejected", 0, "user", "a")]
    got = {r.pair_id: r for r in format_preferences(
        spark.createDataFrame(turns, "pair_id long, side string, turn int, role string, text string")).collect()}
    one = got[1]
    assert one.n_prompt_turns == 2 and one.prompt == f"{B}system\ns{E}{B}user\nu{E}"
    assert one.chosen == f"{B}assistant\ngood é{E}{B}user\nbye{E}"
    spans = [tuple(map(int, s.split("-"))) for s in one.chosen_mask.split(",")]
    assert [one.chosen[a:b] for a, b in spans] == [f"good é{E}"]
    a, b = map(int, one.rejected_mask.split("-"))
    assert one.rejected[a:b] == f"bad{E}"
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].prompt, got[3].rejected, got[3].chosen) == ("", "", f"{B}assistant\nonly{E}")
    assert got[4].n_prompt_turns == 0 and got[4].chosen == f"{B}\n{E}"
    assert got[5].n_prompt_turns == 1 and got[5].rejected == "" and got[5].chosen_mask == f"{len(B) + 10}-{len(B) + 11 + len(E)}"
    assert got[None].chosen == f"{B}user\nx{E}"
    assert format_preferences(spark.createDataFrame([], "pair_id long, side string, turn int, role string, text string")).collect() == []


def test_lent_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "A"), (1, 0, "user", "p"), (1, 1, "assistant", "B"), (2, 0, "user", "alone"),
            (3, 0, "assistant", "C"), (3, 1, "user", "end")]
    got = {r.pair_id: r for r in format_preferences(preference_turns(
        spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert got[0].rejected == f"{B}assistant\nB{E}" and got[1].rejected == f"{B}assistant\nA{E}"
    assert got[2].chosen == got[2].rejected == "" and got[3].rejected == f"{B}assistant\n{E}{B}user\nend{E}"


@pytest.mark.parametrize("name, sql", [("op4_preference_format", OP4_SQL), ("op8_line_dedup", OP8_SQL)])
def test_queries_equal_their_sql(spark, name, sql):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    rows = sorted(want.fetchall(), key=repr)
    assert sorted((tuple(r) for r in QUERIES[name](spark, SMALL).select(*columns).collect()), key=repr) == rows


def test_stages_take_effect_on_planted_rows(spark, make_docs, tmp_path, words):
    import random

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(words, k=n))
    line, base, item = text(14), text(60), text(25)
    rows = [(i, text(40)) for i in range(60)]
    rows += [(100 + i, f"{text(30)}\n{line}") for i in range(6)]
    rows += [(200, base), (201, base), (202, base + " more")]
    rows += [(300, f"{text(20)} {item} {text(20)}"), (301, None), (302, "")]
    rows += [(400 + i, f"{text(20)} idiot {text(10)} scumbag {text(9)}") for i in range(40)]
    docs = make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(400 <= i < 500)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontamination", "packing"]
    seen, left = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        left = stage(spark, left, str(tmp_path))
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = str(tmp_path / f"stage{k}")
        left.write.parquet(path)
        left = spark.read.parquet(path)
        seen.append({r.doc_id: r.text for r in left.collect()})
    ids = {i for i, _ in rows}
    assert set(seen[0]) == {i for i in ids if not 400 <= i < 500}
    assert [i for i in range(100, 106) if line in seen[1][i]] == [105] and set(seen[1]) == set(seen[0])
    assert set(seen[1]) - set(seen[2]) == {201, 202} and set(seen[2]) - set(seen[3]) == {300}
    packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, whole)) and {r.doc_id for r in packed} == set(seen[3])
