"""Documents that hold every awkward case: nulls, blanks, ties, repeated rows, long texts, clashing columns."""

import random

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "token string, n long, key string, bucket int, kept string, h string, x string, root string"
)
WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ran sel tim vor zun lap mek".split()]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    out = []
    while len(out) < n:
        out += [pick.choice(WORDS) for _ in range(pick.randint(5, 14))]
        out[-1] += pick.choice([".\n", ".", ",", "."])
    return " ".join(out[:n]).replace("\n ", "\n")


def edited(text: str, seed: int, edits: int) -> str:
    pick, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[pick.randrange(len(words))] = pick.choice(WORDS)
    return " ".join(words)


def texts() -> list[tuple]:
    """(doc_id, text, lang, source) rows."""
    base, long = prose(1, 120), prose(2, 6000)
    shared = "\n".join(prose(s, 14) for s in (90, 91, 92))
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, edited(base, 3, 1), "en", "a"), (3, edited(base, 4, 3), "en", None),
        (4, edited(base, 5, 30), None, "b"), (5, None, "en", "a"), (6, "", "en", "a"), (7, " \t\n ", "de", "a"), (8, "one", "de", "b"),
        (9, "one", "de", "b"), (10, "One two three", "de", "b"), (11, "one two three", "de", "b"), (12, long, "en", "a"),
        (13, edited(long, 6, 20), "en", "a"), (14, f"{prose(7, 40)}\n{shared}\n{prose(8, 40)}", "fr", "c"),
        (15, f"{shared}\n{prose(9, 30)}", "fr", "c"), (16, f"{prose(10, 25)}\n{shared}", "fr", "c"), (16, f"{prose(10, 25)}\n{shared}", "fr", "c"),
        (17, "ab " * 300, "en", "c"), (18, "ñandú çedilla größe 漢字 " * 12, "es", "c"), (19, "x" * 70, "es", "c"), (20, "x" * 69 + "y", "es", "c"),
        (None, base, "en", "a"), (None, None, None, None), (21, "a\x00b " * 30, "en", "d"), (22, shared.replace("\n", "\n\n"), "fr", "c"),
    ]
    rows += [(30 + i, edited(base, 100 + i, i % 5), "en", "a") for i in range(12)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(*row, len(row[1]) if row[1] is not None else None, *(["clash"] + [7] + ["clash"] + [3] + ["clash"] * 4)) for row in rows]
    return spark.createDataFrame(full, DOCS)


def identified() -> dict[int, str]:
    """Texts of the rows with an id; rows of one id are equal."""
    return {d: t for d, t, *_ in texts() if d is not None}
