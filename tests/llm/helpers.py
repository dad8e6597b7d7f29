"""Small document tables with awkward rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, part string, kind string, score string, line string"


def table(spark, rows):
    """rows: (doc_id, text[, lang]); more columns take names that operators use."""
    full = [(d, t, *(rest or (None,)), "s", len(t or ""), "x", "x", "x", "x", "x") for d, t, *rest in rows]
    return spark.createDataFrame([r[:3] + r[3:] for r in full], SCHEMA)


def awkward(seed=0):
    """Null and empty texts, ties, repeated rows, one long text, odd characters."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Ünïcode", "日本語", "x1", "don't", "<|endoftext|>", "🤗"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, line = prose(60), prose(14)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, base), (5, base), (6, " ".join(near)), (7, base.upper()), (8, "one"), (9, "a b c"),
        (10, f"{line}\n{prose(20)}\n{line}"), (11, f"{prose(5)}\n{line}"), (12, prose(4000)), (13, "🤗" * 70), (14, "🤗" * 70 + " tail"),
        (15, "a" * 300), (16, "a" * 120), (17, "tabs\tand  spaces \n\n x "), (18, "\x1c odd \x00 chars\xa0"), (4, base), (None, base), (None, None),
        (19, prose(30)), (20, "--- === !!!"), (21, line.replace("alpha", "alphx")),
    ]
    return rows
