import duckdb
import pandas as pd

from rolesift.llm import preference

TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", None), (0, 3, "assistant", "fine"), (1, 0, "user", "hi"), (1, 1, "assistant", "other"),
    (2, 0, "user", "only"), (3, 0, "assistant", "alone"), (4, 0, None, "x"), (4, 0, None, "x"), (4, 1, "assistant", "yes"), (5, 3, "assistant", "yes"),
    (6, None, "assistant", ""), (7, 0, "system", "s" * 90_000), (7, 1, "assistant", "é😀"), (None, 0, "user", "lost"), (8, 0, "user", "a"), (8, 1, "assistant", "b"), (8, 2, "user", "c"),
    (9, 0, "user", "z"), (9, 1, "assistant", "d"),
]


def test_pairs_match_their_sql(spark):
    rows = [(*t, 1, "side") for t in TURNS]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, side string")
    got = preference.pairs(*preference.resampled(turns)).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(preference.SQL).df().sort_values("conv_id").reset_index(drop=True)[got.columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    one = got.set_index("conv_id").loc[0]
    assert one.n_prompt_turns == 3 and one.chosen == "<|assistant|>\nfine<|end|>\n" and one.rejected == "<|assistant|>\nother<|end|>\n"
    assert one.chosen[14:] == one.chosen[slice(*map(int, one.chosen_mask.split(":")))]


def test_general_pairs_and_empty(spark):
    kind = "conv_id long, pos int, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "same")], kind)
    b = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "c"), (2, 0, "user", "same"), (3, 0, "assistant", "w")], kind)
    got = {r.conv_id: r for r in preference.pairs(a, b).collect()}
    assert got[1].n_prompt_turns == 1 and got[1].chosen_mask == "14:23,55:64" and got[1].rejected_mask == "14:23"
    assert got[2].chosen == got[2].rejected == "" and got[2].n_prompt_turns == 1
    assert got[3].prompt == got[3].chosen == "" and got[3].n_prompt_turns == 0
    none = spark.createDataFrame([], kind)
    assert preference.pairs(none, none).count() == 0
