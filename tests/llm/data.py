"""Small awkward documents that every operator must survive."""

ODD = [
    (1, "one two three", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (None, "one two three", "en", "a"),
    (4, "one two three", "en", "b"),
    (4, "one two three", "en", "b"),
    (5, " \n\t ", "en", "b"),
    (6, "é漢字😀 \x1c\x85 naïve " * 40, "fr", "c"),
    (7, "word " * 30_000, "en", "a"),
    (8, "x" * 60_000, "en", "a"),
    (9, "1" * 40_000 + " " + "a1" * 20_000, "en", "a"),
]


def odd(spark):
    """Documents with an extra column whose name operators may use inside."""
    return spark.createDataFrame([(i, t, la, so, len(t or ""), "extra") for i, t, la, so in ODD], "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


def empty(spark):
    return odd(spark).limit(0)
