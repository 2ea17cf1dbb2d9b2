"""Word diffs over whole tables."""


def test_word_diff_covers_all_turns(spark, tmp_path):
    from proofsheet import plans

    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "a c"), (1, 2, "system", "c"), (2, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in plans.QUERIES["word_diff"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "equal", "a"), (1, 1, "delete", "b"), (1, 1, "insert", "c"), (1, 2, "delete", "a"), (1, 2, "equal", "c")}
