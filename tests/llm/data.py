"""Small tables with everything that may go wrong in them."""

LONG = " ".join(f"wort{i % 977} and{i % 31}" for i in range(9000))
TEXT = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old trees nearby tonight"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, score double, rank int"


def documents(spark):
    """Nulls in any column, empty, blank and very long texts, copies, near copies, repeated rows, and
    columns named like those that operators add."""
    texts = [
        (1, TEXT), (2, TEXT), (3, TEXT + " indeed"), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (7, LONG),
        (None, "no id here but some words all the same"), (None, None), (8, "ééé 漢字 🙂 ▁▁  x\n\n  end  "), (9, "one two"),
        (10, "ONE  two"), (11, TEXT.upper()), (12, 'token = "abcdef123456" and AKIA' + "B" * 16), (13, "a b c d e f g h " * 40),
    ]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else f"src{k % 2}", None, "x", 0.5, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def labels(spark):
    rows = [(1, 1, 0), (3, 1, None), (5, 0, 0), (7, 1, 0), (8, 0, 1), (9, None, 0), (None, 1, 0), (13, 0, 0), (13, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def empty(df):
    return df.limit(0)
