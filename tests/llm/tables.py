"""Small tables of awkward rows."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, k1 string, host string, score string, item string, words string, start string"
CLASH = ("a", "b", "c", "d", "e", "f")


def prose(seed, n, stem="w"):
    """``n`` words that no other seed has."""
    own = random.Random(seed)
    return " ".join(f"{stem}{seed}x{own.randrange(10 ** 6)}" for _ in range(n))


def documents(spark, rows):
    """Rows are (doc_id, text[, lang, source]); further columns have names that operators use inside."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else row
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, *CLASH))
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "\n\t"), (5, "a"), (6, "one two three four"), (7, "Ünïcode 漢字   \x1c \x85 mixed  spaces "),
    (8, " leading"), (9, "trailing "), (10, "tab\tand\nline \n next"), (11, "<|endoftext|> inside <|endoftext|>"), (12, "x" * 3000),
    (13, "ab" * 700 + " " + "aaaa " * 50), (14, "😀 emoji 😀😀 don't I'LL we've"), (15, prose(1, 4000)), (16, prose(2, 40)), (16, prose(2, 40)),
    (17, prose(2, 40)), (None, "null id here"), (18, "1234567890 12 3.14 --- ***"),
]
