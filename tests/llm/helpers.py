"""Tables with what inputs may hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, batch string, ids string, score double, media string, key string, size string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source). Further columns bear names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "r", None, "x", 0.5, "m", "k", "z") for i, t, lang, s in rows], DOC)


WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from old oak trees near the quiet river bank".split()


def prose(seed, n):
    """Made-up sentences that differ by seed."""
    return " ".join(WORDS[(seed * 31 + k * k * (seed % 7 + 1) + k // 3) % len(WORDS)] + str((seed * 17 + k) % 97) for k in range(n))


ODD = [
    (1, prose(1, 80), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "  \t\n ", "de", "b"), (5, prose(1, 80), "en", "b"), (6, "Ünïcode … 日本語 😀 text", "fr", "c"),
    (7, prose(2, 4000), "en", "a"), (8, "x", "en", "b"), (9, "x", "en", "b"), (None, prose(3, 30), "en", "a"), (11, prose(1, 79) + " changed", "en", "c"), (12, "A" * 500, "en", "a"), (8, "x", "en", "b"),
]
