"""A small table with everything that goes wrong: NULLs, empty and long texts, ties, repeated rows."""

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2 ** 31
        out.append(WORDS[state // 65536 % len(WORDS)] + str(state // 1024 % 97))
    return out


def lines(seed, n, per_line=9):
    return "\n".join(" ".join(prose(seed * 100 + i, per_line)) for i in range(n))


LONG = lines(3, 3000)
ROWS = [
    (1, lines(1, 8), "en", "a"), (1, lines(1, 8), "en", "a"), (2, lines(1, 8), "en", "b"), (3, None, "de", "a"),
    (4, "", None, "b"), (5, " \t\n\n ", "en", None), (6, lines(2, 6) + "\n" + lines(1, 4), "en", "a"), (7, LONG, "en", "b"),
    (8, LONG[:5000] + " tail " + LONG[5000:], "fr", "a"), (None, lines(4, 5), "en", "a"), (None, None, None, None),
    (9, "one two", "en", "a"), (10, "1234 5678", "en", "a"), (11, "x\n" * 40, "en", "b"),
    (12, "\u4f60\u597d \u00e9t\u00e9 \U0001F600", "zh", "a"), (13, lines(1, 8).upper(), "en", "c"), (14, lines(9, 4) + "\n" + lines(9, 4), "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd_documents(spark, rows=None):
    """The table with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    extra = ("_row", "row", "key", "n", "fp", "size", "_runs", "_taken", "at", "ids", "_text", "_score", "group", "part", "w", "runs", "rank")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in extra})


def no_documents(spark):
    return odd_documents(spark, [])
