"""Documents with everything that must not break an operator."""

SCHEMA = "doc_id long, text string, keep_id string, score string, ids string, bucket string, entities string, n_words string, gone string, row string, id string, label string, kept string, new string, text_parts string, own_id string, flat string"
LONG = "word " * 30_000
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two  three"), (6, "one two three"), (7, "a b c d e f g h i j k l m"), (7, "a b c d e f g h i j k l m"),
    (None, "no id here at all"), (None, None), (8, LONG), (9, LONG), (10, "über größe naïve 你好 😀 end"), (11, "x" * 20_000), (12, "a b c d e f g h i j k l m"),
]


def docs(spark):
    return spark.createDataFrame([(i, t, *["clash"] * 15) for i, t in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
