"""Documents that operators must survive: nulls, empty and long texts, repeats, clashing names."""

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox.\nIt's 3 o'clock", "en", "a", 10, "x"),
    (1, "The quick brown fox.\nIt's 3 o'clock", "en", "a", 10, "x"),
    (None, "text without id", "en", None, None, None),
    (2, None, None, "a", None, "y"),
    (3, "", "en", "b", 0, None),
    (4, " \t\n\x0b ", "en", "b", 5, None),
    (5, "Été à la plage, où l'on dort . 　 日本語テキスト", "fr", "b", 1, None),
    (6, LONG, "en", "a", len(LONG), None),
    (-7, "same same same same same same same same same same same same same same same same", None, "c", 1, None),
    (8, "a" * 5000, "de", "c", 5000, None),
    (9, "!!!! #### <|endoftext|> \x1c\x85", "de", "c", 3, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def odd(spark, n=None):
    return spark.createDataFrame(ROWS[:n], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
