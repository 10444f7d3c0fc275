"""Odd rows that every operator must take."""

#: Texts that every operator must take: none, empty, blank, one word, repeats, very long, other scripts.
ODD = [None, "", " \n\t ", "word", "a b c d", "same line\nsame line\nsame line", "é ü 日本語 😀 ß", "x" * 5000, "go " * 4000, "tab\tand\x0bother\x0c spaces\r\nhere now", "<|endoftext|> inside"]


def odd_docs(spark, texts=ODD, extra=True):
    """Rows with repeated and null ids, and columns named like results."""
    rows = [(i, t, "en", f"s{i % 3}", "x", 1.5) for i, t in enumerate(texts)]
    rows += [(1, "", "en", None, None, None), (None, None, None, None, None, None), (None, "a b c d", None, "s1", "y", 0.0), (3, "word", "en", "s0", "x", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, score double")
    if extra:
        df = df.selectExpr("*", "score as size", "fp as leaks", "fp as kept", "score as n_words", "fp as row", "fp as shard", "fp as k1", "fp as spans", "fp as lines", "fp as length")
    return df
