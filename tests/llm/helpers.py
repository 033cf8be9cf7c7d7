"""Small documents with nulls, empty and long texts, copies and repeated rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def sentence(seed: int, n: int) -> str:
    words, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        words.append("".join(chr(97 + (x >> s) % 26) for s in (3, 8, 13, 18, 23)[: 2 + x % 4]))
    return " ".join(words)


def make(spark, rows):
    """rows: (doc_id, text[, source[, lang]])"""
    full = []
    for r in rows:
        doc_id, text, source, lang = (*r, *("s", "en")[len(r) - 2 :])
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, "e"))
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    base = sentence(1, 120)
    return [(1, base), (2, base), (3, base.replace(base.split()[60], "changed", 1)), (4, None), (5, ""), (6, " \n\t "), (7, sentence(2, 30)),
            (8, sentence(3, 4)), (9, sentence(4, 9000)), (10, "x"), (11, "日本語 é ß \U0001f600"), (12, sentence(2, 30)), (13, base + " tail words here")]
