"""Tables with everything that an operator must bear."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, h string, id string, score string, row string"


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def odd_rows(seed=1):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(seed)
    prose = [" ".join(words(rng, rng.randint(20, 90))) for _ in range(30)]
    rows = [(k, prose[k], "en", f"s{k % 3}") for k in range(30)]
    rows += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, " \n\t ", None, None), (None, prose[3], "en", "s1"), (None, None, None, None)]
    rows += [(200, prose[5], "en", "s1"), (201, prose[5], None, "s2"), (202, prose[6] + " tail", "en", "s0"), (7, prose[7], "en", "s1"), (7, prose[8], "en", "s1")]
    rows += [(300, " ".join(words(rng, 6000)), "en", "s0"), (301, "x" * 20000, "en", "s0"), (302, "a " * 3000, "en", "s0"), (303, prose[1] + "\n" + prose[2] + "\r\n" + prose[1], "en", "s0")]
    return [(d, t, lang, s, len(t or ""), "9", "8", "7", "6", "5") for d, t, lang, s in rows] * 1


def table(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else [(d, t, "en", "s", len(t or ""), "9", "8", "7", "6", "5") for d, t in rows], SCHEMA)
