"""Documents with the awkward rows that every operator has to take."""

LONG = "lorem ipsum dolor sit amet consectetur " * 4000

#: (doc_id, text, lang, source, n_chars, and columns whose names operators might use themselves)
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, 1, "x", 7),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, 1, "x", 7),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today!", "en", "b", 70, 1, "x", 7),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today!", "en", "b", 70, 1, "x", 7),
    (3, None, None, None, None, None, None, None),
    (4, "", "fr", "a", 0, 1, "x", 7),
    (5, " \t\n\x0b\x0c\r ", "de", "a", 7, 1, "x", 7),
    (6, "École 中文 😀 naïve\x1cword\x85next gap \U0001e900", "fr", "b", 30, 1, "x", 7),
    (7, LONG, "en", "c", len(LONG), 1, "x", 7),
    (8, LONG + "end", "en", "c", len(LONG) + 3, 1, "x", 7),
    (None, "a row without an id", "en", None, 19, 1, "x", 7),
    (9, "one", "es", "d", 3, 1, "x", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, fp long, `a.b` int, tags map<string,int>"


def documents(spark, rows=ROWS):
    """The rows with a column whose name has a dot, and one of a type that cannot be hashed."""
    return spark.createDataFrame([(*row, k, {"k": k} if k % 3 else None) for k, row in enumerate(rows)], SCHEMA)
