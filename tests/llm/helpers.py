"""Awkward rows that every operator has to take: nulls, blanks, repeats, clashing extra columns."""

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, rid long, block string, `group` string, row string"
BASE = [
    (1, "The cat sat on the mat and the dog lay by the door of the house."),
    (2, "The cat sat on the mat and the dog lay by the door of the house."),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "word"),
    (None, "a text without an id"),
    (7, "Ünïcödé   spaces and <|endoftext|> special <|startoftext|>strings don't 123 45.6 \U0001f642 é"),
    (8, "xyz " * 3000),
    (9, "q" * 5000),
    (10, "12 34 !!"),
]


def awkward(spark, rows=BASE):
    langs = ["en", "en", None, "de", None, "en", "en", "de", "de", "en", None]
    data = [(i, t, langs[k % len(langs)], f"s{k % 2}", None, 0.5, True, 1, "b", "g", "r") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, EXTRA)
