"""Awkward documents for every operator: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

#: Columns named like ones that operators make for themselves.
EXTRA = "rid long, block string, name string, pos long, k1 long, k2 long, body string, node long, p int, key string, host string, band long, html string, words string, "
EXTRA += "__id long, __sha string, __k1 long, __k2 long, __copy int, o long, at int, line string, form string, digest string, first long"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = words(rng, 300)
    near = base.split()
    near[150] = "changed"
    long_ = words(rng, 30_000)
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one"), (9, long_), (10, long_), (11, long_ + " tail"), (None, base), (None, None),
        (12, "twice the same row"), (12, "twice the same row"), (13, words(rng, 200)), (14, "ends with emoji 😀 and é"), (15, "\u0000nul\u001cbyte"),
    ]
    return [(i, t, "en" if t else None, "hot", None, *[7, "x", None, 3, 1, 2, "b", 9, 0, "k", "h", 4, "<p>", "w"], *[1, "s", 2, 3, 1, 5, 6, "l", "plain", "d", 8]) for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), DOCUMENT)


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)
