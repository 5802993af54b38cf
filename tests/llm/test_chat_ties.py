from pyspark.sql import functions as F

from loomspark.llm import chat


def test_rows_of_one_turn_and_role_are_ordered_by_text(spark):
    turns, want = [], set()
    for turn, base in ((0, 0), (None, 1000)):
        for i in range(0, 60, 3):  # of [a, b], [a] is a snapshot and [b] is none
            a, b = f"a{base + i}", f"b{base + i}"
            turns += [(base + i, turn, "user", b), (base + i, turn, "user", a), (base + i + 1, turn, "user", a), (base + i + 2, turn, "user", b)]
            want |= {base + i, base + i + 2}
    got = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id for r in got.collect()} == want
    first = got.where(F.col("conv_id") == 0).first().rendered
    assert first.index("a0") < first.index("b0")
