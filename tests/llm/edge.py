"""Documents that every operator must take: nulls, empties, ties, repeats, a long text,
and a column whose name an operator might use itself."""

LONG = " ".join(f"w{i % 997} v{i % 89}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near the old stone bridge and count bright stars"
EDGE = [
    (1, None, "en"), (2, "", None), (3, "   \n\t\n ", "en"), (4, "one", "en"), (5, LONG, "de"), (6, PROSE, "en"), (7, PROSE, "en"),
    (7, PROSE, "en"), (8, PROSE.upper() + " !", None), (9, "a b c d e\na b c d e\n\nÜber straße ſ İ", "de"), (10, "\x0b\x0c x \r\n y", "fr"),
    (11, "1234 5678 9012 3456 \U0001f600 汉字 text", "en"), (12, (PROSE + "\n") * 3, "en"),
]


def edge_docs(spark):
    rows = [(i, t, lang, "src", len(t or ""), f"node{i}") for i, t, lang in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").repartition(3)


def empty_docs(spark):
    return edge_docs(spark).limit(0)
